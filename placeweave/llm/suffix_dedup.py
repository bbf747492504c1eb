"""Removal of byte strings that repeat anywhere earlier in the corpus, by prefix doubling over sampled suffixes.

Ranks are content hashes, so that rank equality is string equality in all
tasks. Of the suffixes only those at minimisers are ranked first, by their
first SEED bytes: each string of the threshold's length has one minimiser,
the same in all its copies. Suffixes whose rank is unique end there. The
others are reranked at the longer offsets around the minimiser by all the
strings that share it; what is still equal to an earlier one is past the
threshold, and what differs is ranked once more, string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_texts, saved, table

THRESHOLD = 100
SEED = 32
#: Bytes that are hashed at once, and sampled suffixes that a task holds before it merges them.
BUFFER = 1 << 19
HELD = 1 << 20
#: Places in what is ranked at once: less than two buffers and a string.
_PLACE = np.uint64((1 << 21) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Hasher:
    """Hashes of all substrings of a buffer by powers modulo 2**64."""

    up: np.ndarray
    down: np.ndarray
    _one = None

    @classmethod
    def get(cls, n: int = BUFFER + 4096) -> Hasher:
        if cls._one is None or len(cls._one.up) < n:
            base = 0xD1342543DE82EF95
            cls._one = cls(_powers(base, n), _powers(pow(base, -1, 1 << 64), n))
        return cls._one

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def sampled(data: np.ndarray, valid: np.ndarray, length: int, seed: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring strings of ``length`` bytes that share a minimiser.

    ``valid`` tells at which places a string may start. Of each run: first
    and last start, place and rank of the minimiser, and rank of all the
    run's bytes together.
    """
    hasher = Hasher.get(len(data) + 1)
    sums = hasher.sums(data)
    n = len(data) - seed + 1
    ranks = mixed((sums[seed:] - sums[:-seed]) * hasher.down[:n])
    low = (ranks & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, size = length - seed + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    at = np.flatnonzero(valid[: len(low)])
    place = (low[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    first, last, place = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1] if len(new) else at[new], place[new]
    shape = ((last - first) * 256 + place - first).astype(np.uint64)
    return {"first": first, "last": last, "rank": ranks[place], "all": mixed(hasher.of(sums, first, last + length) ^ (shape * _MIX)), "shape": shape}


_ROWS = {"rank": np.uint64, "all": np.uint64, "doc": np.int64, "row": np.int64, "first": np.int64, "shape": np.uint64}
_COVER = {"row": np.int64, "start": np.int64, "stop": np.int64}
_ASK = {"doc": np.int64, "row": np.int64, "first": np.int64, "span": np.int64}
#: One of a part's runs of a rank, and whether the part has others of that rank and has asked for all of them.
_ONE = {"rank": np.uint64, "asked": np.int64} | _ASK
#: Strings of the threshold's length.
_STRINGS = {"rank": np.uint64, "doc": np.int64, "row": np.int64, "at": np.int64}


def _packed(rows: dict[str, np.ndarray], kinds: dict) -> bytes:
    """Columns as planes of bytes, so that small numbers cost little."""
    planes = [np.ascontiguousarray(rows[k].astype(t).view(np.uint8).reshape(-1, 8).T).tobytes() for k, t in kinds.items()]
    return zstandard.compress(b"".join(planes), 1)


def _unpacked(data: list[bytes], kinds: dict) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    for x in data:
        planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(len(kinds), 8, -1)
        for (k, t), p in zip(kinds.items(), planes, strict=True):
            parts[k].append(np.ascontiguousarray(p.T).reshape(-1).view(t))
    return {k: np.concatenate(v) for k, v in parts.items()}


def _dealt(kind: str, rows: dict[str, np.ndarray], by: np.ndarray, parts: int, kinds: dict) -> Iterator[tuple]:
    """A row (kind, part, packed columns) for each part that ``by`` deals rows to."""
    part = (mixed(by.astype(np.uint64)) >> np.uint64(16)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(edges)):
        pick = order[edges[i] : edges[i + 1]]
        yield kind, int(i), _packed({k: rows[k][pick] for k in kinds}, kinds)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["kind", "part", "data"])


PARTS = "kind string, part int, data binary"


def _firsts(rows: dict[str, np.ndarray], length: int, parts: int) -> tuple[dict[str, np.ndarray], Iterator[tuple]]:
    """Of the runs with equal bytes the earliest, in the order of ranks; and what the others cover."""
    order = np.lexsort((rows["first"], rows["row"], rows["doc"], rows["all"], rows["rank"]))
    rows = {k: v[order] for k, v in rows.items()}
    same = np.concatenate([[False], (rows["rank"][1:] == rows["rank"][:-1]) & (rows["all"][1:] == rows["all"][:-1])]) if len(order) else np.zeros(0, bool)
    again = {k: v[same] for k, v in rows.items()}
    cover = merged(again["row"], again["first"], again["first"] + (again["shape"] >> np.uint64(8)).astype(np.int64) + length)
    return {k: v[~same] for k, v in rows.items()}, _dealt("cover", cover, cover["row"], parts, _COVER)


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal runs of bytes that intervals cover in each row."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return {"row": row, "start": start, "stop": stop}
    base = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base)
    new = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    new[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(row)]]) - 1
    return {"row": row[at], "start": start[at], "stop": reach[last] - base[last]}


def _ranked(batches: Iterator[pa.RecordBatch], length: int, seed: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes of the partition's documents, with one of each kind of run sent on."""
    held: list[dict[str, np.ndarray]] = []
    pieces: list[tuple[int, int, int, bytes]] = []  # doc, row, place of the piece in its document, bytes

    def rank() -> None:
        lengths = np.array([len(p[3]) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        valid = np.ones(len(data), bool)
        for e in ends.tolist():
            valid[max(0, e - length + 1) : e] = False
        runs = sampled(data, valid, length, seed)
        of = np.searchsorted(ends, runs["first"], "right")
        doc, row, at = (np.array([p[i] for p in pieces], np.int64)[of] for i in range(3))
        held.append({"rank": runs["rank"], "all": runs["all"], "doc": doc, "row": row, "first": runs["first"] - starts[of] + at, "shape": runs["shape"]})
        pieces.clear()

    def flush() -> pa.RecordBatch:
        rows = {k: np.concatenate([h[k] for h in held] or [np.zeros(0, t)]) for k, t in _ROWS.items()}
        held.clear()
        one, cover = _firsts(rows, length, parts)
        return _batch([*cover, *_dealt("suffix", one, one["rank"] ^ one["all"], parts, _ROWS)])

    size = 0
    for batch in batches:
        for doc, row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            for at in range(0, len(data) - length + 1, BUFFER):
                pieces.append((doc, row, at, data[at : at + BUFFER + length - 1]))
                size += len(pieces[-1][3])
                if size >= BUFFER:
                    rank()
                    size = 0
                    if sum(len(h["rank"]) for h in held) > HELD:
                        yield flush()
    if pieces:
        rank()
    yield flush()


def _split(batches: Iterator[pa.RecordBatch], kind: str, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of other kinds, passed on; the packed columns of ``kind`` go to ``data``."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        data += [r[2] for r in rows if r[0] == kind]
        yield _batch([r for r in rows if r[0] != kind])


def _reranked(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of runs dealt by their rank and bytes: those equal to an earlier one are covered, different ones of a rank ask for their bytes.

    One run of each rank is sent on, so that the next step meets no more runs
    of a rank than there are parts, however frequent it is.
    """
    data: list[bytes] = []
    yield from _split(batches, "suffix", data)
    one, cover = _firsts(_unpacked(data, _ROWS), length, parts)
    yield _batch(list(cover))
    rank = one["rank"]
    if len(rank):
        equal = rank[1:] == rank[:-1]
        again = np.concatenate([[False], equal])
        one["span"] = (one["shape"] >> np.uint64(8)).astype(np.int64) + length
        one["asked"] = (again | np.concatenate([equal, [False]])).astype(np.int64)
        ask, sent = ({k: v[pick] for k, v in one.items()} for pick in (one["asked"] > 0, ~again))
        yield _batch([*_dealt("ask", ask, ask["row"], parts, _ASK), *_dealt("one", sent, sent["rank"], parts, _ONE)])


def _met_again(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Runs whose rank other parts have too ask for their bytes as well; unique ones end."""
    data: list[bytes] = []
    yield from _split(batches, "one", data)
    rows = _unpacked(data, _ONE)
    order = np.argsort(rows["rank"], kind="stable")
    rows = {k: v[order] for k, v in rows.items()}
    if len(order):
        equal = rows["rank"][1:] == rows["rank"][:-1]
        ask = (np.concatenate([[False], equal]) | np.concatenate([equal, [False]])) & (rows["asked"] == 0)
        rows = {k: v[ask] for k, v in rows.items()}
        yield _batch(list(_dealt("ask", rows, rows["row"], parts, _ASK)))


def _by_row(batches: Iterator[pa.RecordBatch], kinds: dict) -> Iterator[tuple[int | None, int, bytes, dict[str, np.ndarray]]]:
    """(doc, row, bytes, its rows of packed columns) of each text; packed columns come first in a partition."""
    data: list[bytes] = []
    rows: dict[str, np.ndarray] | None = None
    for batch in batches:
        for packed, doc, row, text in zip(*(c.to_pylist() for c in batch.columns[:3]), raw_texts(batch.column(3)), strict=True):
            if packed is not None:
                data.append(packed)
                continue
            if rows is None:
                rows = _unpacked(data, kinds)
                order = np.argsort(rows["row"], kind="stable")
                rows = {k: v[order] for k, v in rows.items()}
            a, b = np.searchsorted(rows["row"], [row, row + 1])
            yield doc, row, text, {k: v[a:b] for k, v in rows.items()}


def _strings(asked: dict[str, np.ndarray], texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Each string of ``length`` bytes in what was asked for, with its rank."""
    half = length // 2
    own, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(asked["span"])
    counts = asked["span"] - length + 1
    of = np.repeat(np.arange(len(ends)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(ends - asked["span"], counts) + inner
    hasher = Hasher.get(len(own) + 1)
    sums = hasher.sums(own)
    # The pair of ranks at the offset half: one rank of the whole string.
    rank = mixed(hasher.of(sums, place, place + half) * _MIX + hasher.of(sums, place + half, place + length))
    return {"rank": rank, "doc": asked["doc"][of], "row": asked["row"][of], "at": asked["first"][of] + inner}


def _earliest(rows: dict[str, np.ndarray], length: int, parts: int) -> tuple[dict[str, np.ndarray], Iterator[tuple]]:
    """The earliest of equal strings, in the order of rows; and what the others cover."""
    order = np.lexsort((rows["at"], rows["row"], rows["doc"], rows["rank"]))
    rank = rows["rank"][order]
    again = np.zeros(len(order), bool)
    again[order[1:]] = rank[1:] == rank[:-1]
    cover = merged(rows["row"][again], rows["at"][again], rows["at"][again] + length)
    return {k: v[~again] for k, v in rows.items()}, _dealt("cover", cover, cover["row"], parts, _COVER)


def _answers(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The strings of the bytes that were asked for, dealt by their own ranks; of equal ones the earliest that a task holds."""
    held: list[dict[str, np.ndarray]] = []
    asked: list[dict[str, np.ndarray]] = []
    texts: list[bytes] = []

    def rank() -> None:
        held.append(_strings({k: np.concatenate([x[k] for x in asked]) for k in _ASK}, texts, length))
        asked.clear()
        texts.clear()

    def flush() -> pa.RecordBatch:
        one, cover = _earliest({k: np.concatenate([h[k] for h in held]) for k in _STRINGS}, length, parts)
        held.clear()
        return _batch([*cover, *_dealt("string", one, one["rank"], parts, _STRINGS)])

    size = 0
    for _, _, data, rows in _by_row(batches, _ASK):
        cut, ends = 0, np.cumsum(rows["span"])
        while cut < len(ends):  # so many at a time as a buffer holds
            to = max(cut + 1, int(np.searchsorted(ends, (int(ends[cut - 1]) if cut else 0) + BUFFER, "right")))
            asked.append({k: v[cut:to] for k, v in rows.items()})
            texts += [data[a : a + n] for a, n in zip(asked[-1]["first"].tolist(), asked[-1]["span"].tolist(), strict=True)]
            size += sum(asked[-1]["span"].tolist())
            cut = to
            if size >= BUFFER:
                rank()
                size = 0
                if sum(len(h["rank"]) for h in held) > HELD:
                    yield flush()
    if asked:
        rank()
    if held:
        yield flush()


def _compared(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """All but the earliest of equal strings are covered."""
    data: list[bytes] = []
    yield from _split(batches, "string", data)
    yield _batch(list(_earliest(_unpacked(data, _STRINGS), length, parts)[1]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])

    for doc, _, data, cover in _by_row(batches, _COVER):
        runs = merged(cover["row"], cover["start"], cover["stop"])
        starts, stops = runs["start"].tolist(), runs["stop"].tolist()
        left = b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True))
        out.append((doc, len(data), len(data) - len(left), len(starts), hashlib.sha256(left).hexdigest(), starts, stops))
        if len(out) >= 2000:
            yield flush()
            out.clear()
    yield flush()


#: Bits of a filter of rows; it grows with nothing, and a row that it lets pass wrongly only costs its way.
FILTER_BITS = 1 << 23


def _rows_of(packed: DataFrame, kinds: dict, parts: int) -> dict[int, bytes]:
    """A fixed-size bitmap of the rows that packed columns name, by pages of 32,768 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                there[_slot(_unpacked([x], kinds)["row"])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there) + 1)], ["slot"])

    # Dealt by row, so that a row comes up once, however many parts name it.
    slots = packed.select("part", "data").repartition(parts, "part").mapInArrow(run, "slot long")
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return {r.page: bytes(r.bits) for r in pages.collect()}  # FILTER_BITS / 8 bytes at most


def _slot(row: np.ndarray) -> np.ndarray:
    return ((mixed(row.astype(np.uint64)) >> np.uint64(20)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _sorted_out(texts: DataFrame, pages: dict[int, bytes], parts: int) -> DataFrame:
    """(part, doc, row, text, named): the part that a row's packed columns are dealt to, and whether the bitmap has the row."""
    size = 32768
    bitmap = np.zeros(FILTER_BITS + size, bool)
    for page, bits in pages.items():
        got = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        bitmap[(page - 1) * size : (page - 1) * size + len(got)] = got
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).to_numpy()
            slot = _slot(row)
            named = (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            part = ((mixed(row.astype(np.uint64)) >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns, pa.array(named.astype(bool))], ["part", "doc", "row", "text", "named"])

    return texts.mapInArrow(run, "part int, doc long, row long, text string, named boolean")


def _met(texts: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """Texts with the packed columns of their part before them in each partition."""
    columns = packed.select("part", "data", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("text"))
    rows = texts.select("part", F.lit(None).cast("binary").alias("data"), "doc", "row", "text")
    return columns.unionByName(rows).repartition(parts, "part").sortWithinPartitions(F.col("data").isNull()).select("data", "doc", "row", "text")


def removed_spans(docs: DataFrame, length: int = THRESHOLD, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops) of each document.

    A byte of a text as UTF-8 is removed if a string of ``length`` bytes
    covers it that also starts earlier: in a document of a smaller id, or
    earlier in the same one. ``starts`` and ``stops`` are the maximal removed
    runs. Null texts are empty; texts shorter than ``length`` keep all. Rows
    that repeat an id come one after another in the order they are read; null
    ids come last. An empty table gives no rows; other columns are not read.
    ``docs`` is read several times and must be files or a saved table.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    ordered = rows.select(F.coalesce("doc", F.lit(last)).alias("doc"), "row", "text").filter(F.octet_length("text") >= length)
    ranked = ordered.mapInArrow(lambda b: _ranked(b, length, seed, parts), PARTS)
    reranked = saved(ranked.repartition(parts, "part").mapInArrow(lambda b: _reranked(b, length, parts), PARTS))
    ones = reranked.filter("kind = 'one'").repartition(parts, "part").mapInArrow(lambda b: _met_again(b, parts), PARTS)
    ask, cover = saved(reranked.filter("kind = 'ask'").unionByName(ones)), reranked.filter("kind = 'cover'")
    asked = _sorted_out(ordered, _rows_of(ask, _ASK, parts), parts).filter("named")
    answers = _met(asked, ask, parts).mapInArrow(lambda b: _answers(b, length, parts), PARTS)
    compared = saved(answers.repartition(parts, "part").mapInArrow(lambda b: _compared(b, length, parts), PARTS))
    covered = cover.unionByName(compared)
    texts = _sorted_out(rows, _rows_of(covered, _COVER, parts), parts)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>"
    cut = _met(texts.filter("named"), covered, parts).mapInArrow(_kept, schema)
    none = F.array().cast("array<long>")
    content = F.coalesce("text", F.lit("")).cast("binary")
    whole = texts.filter("not named").select(F.col("doc").alias("doc_id"), F.length(content).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(content, 256).alias("kept_sha256"), none.alias("starts"), none.alias("stops"))
    return cut.unionByName(whole)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents")).drop("starts", "stops")
