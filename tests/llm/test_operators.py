"""Each operator against brute force, on a table with nulls, empty and long texts, copies, near copies, and repeated ids."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeweave.llm import exact_dedup, packing, simhash, suffix_dedup, token_counts, transport_stream, url_filter
from placeweave.llm.common import saved
from placeweave.llm.tokens import Encoder, default_path


def texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("aeiou mnrst\n") for _ in range(draw.randint(2, 7)))
    base = [" ".join(word() for _ in range(draw.randint(1, 400))) for _ in range(40)]
    shared = " ".join(word() for _ in range(60))
    near = [re.sub(r"^\S+", f"w{i}", base[7]) for i in range(6)]
    return [None, "", "  ", "x", *base, *base[:9], *near, *[f"{i} {shared} end{i}" for i in range(5)], "long " * 9000, "\u00e4\u4e2d  \n \t y" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", f"src{i % 4}", i) for i, t in enumerate(texts())]
    return saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long"))


@pytest.fixture(scope="module")
def empty(spark, docs):
    return saved(docs.limit(0))


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(docs).collect()}
    seen = set()
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.removed_spans(empty).count() == 0


def test_suffix_dedup_deals_out_a_frequent_line():
    draw, line = random.Random(2), "the same line of ninety bytes is in every document, but what is around it differs each time"
    fill = lambda: "".join(draw.choices("abcdefghijklmnop ", k=60))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array([f"{fill()}{line}{fill()}" for _ in range(400)])], ["doc", "row", "text"])
    of = Counter()
    for out in suffix_dedup._ranked(iter([batch]), 100, 32, 8):
        for kind, part, data in zip(*(c.to_pylist() for c in out.columns), strict=True):
            rows = suffix_dedup._unpacked([data], suffix_dedup._ROWS) if kind == "suffix" else {"rank": []}
            of.update((int(r), part) for r in rows["rank"])
    hot = Counter()
    for (rank, _), n in of.items():
        hot[rank] += n
    rank, n = hot.most_common(1)[0]
    assert n > 300 and max(m for (r, _), m in of.items() if r == rank) < n / 4


def test_transport_stream(docs, empty):
    rows = transport_stream.described(transport_stream.with_streams(docs)).collect()
    for r in rows:
        want = transport_stream.padded(texts()[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_bytes % 188 == 0 and "cc_errors=0" in r.feature
    assert transport_stream.described(transport_stream.with_streams(empty)).count() == 0
    data = transport_stream.mux(b"q" * 9000)
    broken = data[: 188 * 5] + data[188 * 6 :]
    found = transport_stream.demux(b"junk" + broken)
    assert (found.lost_sync, found.cc_errors) == (1, 1) and not found.units[0].complete and found.units[1].complete
    assert transport_stream.demux(data[:752] + data[564:752] + data[752:]).cc_errors == 0
    assert transport_stream.demux(b"G" * 187).packets == transport_stream.demux(b"").packets == 0


def test_sync_bytes_in_payloads_are_no_sync():
    data = transport_stream.mux(b"G" * 9000)
    for at, lost in ((188 * 20 + 50, 3), (188 * 8 + 4, 1), (188 * 30, 188)):
        found = transport_stream.demux(data[:at] + data[at + lost :])
        complete = [u for u in found.units if u.complete]
        assert found.cc_errors == 1 and found.packets == len(data) // 188 - 1 and len(complete) == 2, (at, lost)
        assert all(set(u.data) == {71} for u in complete)


def test_sections_over_packets():
    """A program map that begins behind the tail of another, and one that isn't in force yet."""
    body = bytes([0xE1, 0x00, 0xF0, 200]) + bytes(200) + bytes([6, 0xE1, 0x00, 0xF0, 0])
    long, soon = transport_stream._section(2, 1, body), bytearray(transport_stream._section(2, 1, bytes([0xE1, 0x00, 0xF0, 0, 9, 0xE1, 0x00, 0xF0, 0]))[:-4])
    soon[5] &= 0xFE
    soon = bytes(soon) + transport_stream.crc32_mpeg(bytes(soon)).to_bytes(4, "big")
    head = lambda begins, cc: bytes([0x47, begins | 0x10, 0x00, 0x10 | cc])
    tail = long[183:]
    packets = head(0x40, 0) + b"\0" + long[:183] + (head(0x40, 1) + bytes([len(tail)]) + tail + soon).ljust(188, b"\xff")
    stream = transport_stream.mux(b"x" * 500)
    found = transport_stream.demux(stream[:188] + packets + stream[376:])
    assert found.types == {0x100: 6} and found.bad_tables == 0 and found.units[0].data == b"x" * 500


def test_elementary_packets_and_access_points(docs, empty):
    media = transport_stream.with_streams(docs.unionByName(docs.filter("doc_id = 5")))
    rows = transport_stream.elementary_packets(media.select("doc_id", "media"), "doc_id").collect()
    for i, t in enumerate(texts()):
        want, mine = transport_stream.padded(t), sorted((r for r in rows if r.doc_id == i), key=lambda r: r.nth)
        mine = mine[::2] if i == 5 else mine
        cut = [want[a : a + transport_stream.UNIT] for a in range(0, len(want), transport_stream.UNIT)]
        assert [bytes(r.data) for r in mine] == cut and all(r.complete and r.dts is None and r.stream_type == 6 for r in mine)
        assert [(r.pts, r.random_access) for r in mine] == [(3600 * k, k % 8 == 0) for k in range(len(cut))]
    points = transport_stream.access_points(transport_stream.described(media.filter("doc_id <> 5")), "doc_id").collect()
    assert {(r.doc_id, r.pts, r.start) for r in points} == {(r.doc_id, r.pts, r.nth * transport_stream.UNIT) for r in rows if r.random_access and r.doc_id != 5}
    assert transport_stream.elementary_packets(transport_stream.with_streams(empty), "doc_id").count() == 0


def test_token_counts_and_flat_file(spark, docs, tmp_path):
    blocks, order = token_counts.flat_files(docs, block=64)
    got = token_counts.document_spans(blocks).join(order, ["file", "doc_index"]).collect()
    encoder = Encoder.get(escaped=True)
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(encoder.encode(t)) // 4 for i, t in enumerate(texts())}
    assert token_counts.document_spans(token_counts.flat_files(docs.limit(0))[0]).count() == 0


def test_flat_files_of_any_length(spark, tmp_path, monkeypatch):
    files = [[5, 6, 50256, 50256, 7, 50256, 8], [], list(range(11)), [50256], [1] * 12 + [50256] + [2] * 6]
    for i, f in enumerate(files):
        (tmp_path / f"flat{i}.bin").write_bytes(np.array(f, "<u2").tobytes())
    want = set()
    for i, f in enumerate(filter(None, files)):  # an empty one has no number
        start = 0
        for k, part in enumerate(re.findall(r"(?:\d+ )*?50256 |(?:\d+ )+", " ".join(map(str, [*f, ""])))):
            n, complete = len(part.split()), part.endswith("50256 ")
            want.add((i, k, start, n - complete, complete))
            start += n
    for whole in (token_counts.WHOLE_FILE, 0, 20):
        monkeypatch.setattr(token_counts, "WHOLE_FILE", whole)
        blocks, names = token_counts.read_flat(spark, str(tmp_path), most=3)
        assert [n.rpartition("/")[2] for _, n in sorted(names.items())] == [f"flat{i}.bin" for i in (0, 2, 3, 4)]
        got = {(r.file, r.doc_index, r.start, r.n_tokens, r.complete) for r in token_counts.document_spans(blocks).collect()}
        assert got == want
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole number"):
        token_counts.read_flat(spark, str(tmp_path))


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/x", "http://example.org/en/12?q", "http://org/", "http://x.com/fr/", "http://x.com/de/#y", "http://xcom/de/", "ftp", None, "http://example.org", "a://h?x=/b"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert [got[i][2] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None]
    assert [got[i][3] for i in range(6)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert got[7][:2] == ("", "") and got[9][:2] == ("h", "") and got[0][0] == "a.example.org"


def test_url_filter_with_many_rules(spark, monkeypatch):
    draw = random.Random(12)
    rules = {(".".join(draw.choices(["a", "b", "com", "org"], k=draw.randint(1, 3))), "/" + "".join(draw.choices("xy/", k=draw.randint(0, 5)))): draw.choice(["allow", "block"]) for _ in range(300)}
    urls = [f"http://{'.'.join(draw.choices(['a', 'b', 'com', 'org'], k=draw.randint(1, 4)))}/{''.join(draw.choices('xy/', k=draw.randint(0, 7)))}" for _ in range(400)] + [None, "", "http://"]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] + [(None, "/", "block"), ("a", None, "block"), ("a", "x", "block")], "host string, path string, verdict string")
    pages = saved(spark.createDataFrame([(i // 2, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, rule int, _row int"))
    want = []
    for i, u in enumerate(urls):
        host, path = (re.fullmatch(r"http://([^/]*)(.*)", u or "") or re.fullmatch("()()", "")).groups()
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        want.append((i // 2, host, path, best[2], best[3]))
    for most in (url_filter.BROADCAST_RULES, 10):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = [tuple(r) for r in url_filter.judge_urls(pages, table).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_simhash(docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fp(t) for t in texts()]
    label = list(range(len(want)))
    for _ in want:
        label = [min(label[j] for j in range(len(want)) if (want[i] ^ want[j]).bit_count() <= 3) for i in range(len(want))]
    got = {r.doc_id: (r.fp % (1 << 64), r.component) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (want[i], label[i]) for i in range(len(want))}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(label)
    assert simhash.near_groups(empty).count() == 0


def test_simhash_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fps = [sum(1 << b for b in range(12) if i >> b & 1) for i in range(0, 4096, 37)]
    frame = saved(spark.createDataFrame([(x,) for x in fps], "fp long"))
    edges = [(r.a, r.b) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def parts(links):
        root = {x: x for x in fps}
        for _ in fps:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(edges) == parts([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def test_packing(docs, empty):
    encoder, rows = Encoder.get(), packing.pack(docs).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    for i, t in enumerate(texts()):
        ids = encoder.encode(t) + b"\0\0\0\0"
        got = sorted(pieces[i])
        assert [x[0] for x in got] == list(range(len(got))) and sum(x[2] for x in got) == len(ids) // 4
        assert all(n == 2048 for _, _, n, _ in got[1:]) and all(c == zlib.crc32(ids[4 * s : 4 * (s + n)]) for _, s, n, c in got)
    assert packing.pack(empty).count() == 0


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                place(i + 1, [*rooms[: rooms.index(r)], r - lengths[i], *rooms[rooms.index(r) + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_plans_use_all_and_are_near_the_optimum():
    draw, over = random.Random(4), 0
    for case in range(60):
        capacity = draw.choice([7, 10, 16])
        lengths = sorted((draw.randint(1, capacity) for _ in range(9)), reverse=True)
        plan = packing.plan(dict(Counter(lengths)), capacity)
        assert sum((Counter({n: k * m for n, m in Counter(ls).items()}) for ls, k in plan), Counter()) == Counter(lengths)
        assert all(sum(ls) <= capacity for ls, _ in plan)
        over += sum(k for _, k in plan) - fewest(lengths, capacity)
    assert over <= 3
    lengths = [min(2048, max(1, int(draw.lognormvariate(5.5, 1)))) for _ in range(20_000)]
    assert sum(k for _, k in packing.plan(dict(Counter(lengths)))) <= -(-sum(lengths) // 2048) + 1


def test_index_of_sums_equals_all_combinations():
    draw = random.Random(9)
    for _ in range(40):
        left = np.array([0, *[draw.choice([0, 0, 1, 2, 5]) for _ in range(14)]])
        index = packing.Sums(left)
        for _ in range(3):
            for gap in range(1, 15):
                have = lambda c: all(left[n] >= k for n, k in Counter(c).items())  # noqa: E731, B023
                fits = [c for c in [(gap,), *[(a, gap - a) for a in range(gap - 1, 0, -1) if a >= gap - a], *[(a, b, gap - a - b) for a in range(gap - 2, 0, -1) for b in range(a, 0, -1) if gap - a - b > 0 and b >= gap - a - b]] if have(c)]
                assert index.exact(gap) == (fits[0] if fits else None)
            some = [n for n in range(1, 15) if left[n]]
            if some:
                index.take((draw.choice(some),), 1)


def test_encoder_matches_an_untouched_tokenizer():
    plain, escaped = Tokenizer.from_file(default_path("byte_bpe_50k.json")), Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    escaped.encode_special_tokens = True
    for t in [*texts(), "a  b", "a   b", "a\n \nb", "a \nb", "\u00a0 \u00a0x", " it's 's", "<|endoftext|> x", "a <|endoftext|><|endoftext|>", "a "]:
        for tokenizer, encoder in ((plain, Encoder.get()), (escaped, Encoder.get(escaped=True))):
            assert encoder.encode(t) == np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert 50256 in np.frombuffer(Encoder.get().encode("a<|endoftext|>"), "<u4") and 50256 not in np.frombuffer(Encoder.get(escaped=True).encode("a<|endoftext|>"), "<u4")


def test_exact_dedup(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts()]
    first = {n: i for i, n in reversed(list(enumerate(norm)))}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()}
    assert got == {i: (first[n], norm.count(n), first[n] == i) for i, n in enumerate(norm)}
    index = exact_dedup.DigestIndex(docs.sparkSession)
    exact_dedup.dedup(docs.filter("doc_id < 20"), index)
    later = {r.doc_id: r.kept for r in exact_dedup.dedup(docs.filter("doc_id >= 20"), index).collect()}
    assert later == {i: first[norm[i]] == i for i in range(20, len(norm))}
    assert exact_dedup.dedup(empty).count() == 0
    assert exact_dedup.keep_first(docs.unionByName(docs)).count() == len(first)
