"""Null and repeated ids, null texts, and extra columns of clashing names: what each operator makes of them."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeweave.llm import exact_dedup, packing, simhash, suffix_dedup, token_counts, transport_stream, url_filter
from placeweave.llm.common import saved
from placeweave.llm.tokens import Encoder

LONG = "the quick brown fox jumps over the lazy dog while the band plays on and on and on until the morning comes"
ROWS = [(1, LONG), (1, LONG), (None, LONG), (None, None), (2, ""), (2, "other"), (3, None), (None, "other")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, n, "own", -n, "own", "own") for n, (i, t) in enumerate(ROWS)]
    return saved(spark.createDataFrame(rows, "doc_id long, text string, _row int, _nth string, row int, fp string, digest string"))


def by_id(rows, *names):
    return Counter((r.doc_id, *[r[n] for n in names]) for r in rows)


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.removed_spans(docs).collect(), "n_bytes", "n_removed")
    n = len(LONG)
    assert sum(k for (i, size, _), k in got.items() if size == n) == 3 and sum(k for (_, size, gone), k in got.items() if size == n == gone) == 2
    assert got[1, n, 0] == 1 and got[1, n, n] == 1  # of rows that repeat an id the first keeps its bytes
    assert sum(got.values()) == len(ROWS)


def test_streams_and_token_files_and_packing(docs):
    lengths = Counter((i, len((t or "").encode())) for i, t in ROWS)
    assert by_id(transport_stream.described(transport_stream.with_streams(docs)).collect(), "n_bytes") == lengths
    blocks, order = token_counts.flat_files(docs, block=16)
    assert Counter(r.doc_id for r in token_counts.document_spans(blocks).join(order, ["file", "doc_index"]).collect()) == Counter(i for i, _ in ROWS)
    assert Counter(r.doc_id for r in packing.pack(docs).collect()) == Counter(i for i, _ in ROWS)


def test_exact_dedup(docs):
    got = sorted((r.row, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, row="_row").collect())
    want = [(0, 1, 3, None), (1, 1, 3, None), (2, 1, 3, False), (3, 2, 3, False), (4, 2, 3, True), (5, 2, 2, True), (6, 2, 3, False), (7, 2, 2, False)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(w[3] in (None, g[3]) for g, w in zip(got, want, strict=True))
    assert [g[3] for g in got[:2]].count(True) == 1
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r._row for r in kept.collect())[1:] == [4, 5] and kept.filter("_nth = 'own'").count() == 3


def test_index_over_batches_and_sessions(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 3)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    all_ = [f"text {i % 30}" for i in range(60)]
    kept = set()
    for at in range(0, 60, 12):
        part = spark.createDataFrame([(i, all_[i]) for i in range(at, at + 12)], "doc_id long, text string")
        kept |= {r.doc_id for r in exact_dedup.dedup(part, index, batches=2).collect() if r.kept}
        assert index.files() < 3
    assert kept == set(range(30)) and index.table().count() == 30 and index.generation > 0
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.generation == index.generation and again.table().count() == 30
    again.compact()
    with exact_dedup._ordered(spark):
        plan = exact_dedup.with_digest(spark.createDataFrame([("x",)], "text string")).join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SortMergeJoin") :]
    assert scan.count("Exchange") == 1 and scan.count("Sort [") == 1  # the new rows alone are shuffled and sorted


def bits(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def test_links_of_rows_without_ids(spark, monkeypatch):
    """A and C meet by B alone, which has no id; two rows of one id have texts that don't meet."""
    prints = {"A": 0, "B": 0b111, "C": 0b111111, "D": 0xFFFF << 40, "E": 0xFFFF << 20}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size=3, doc_id="doc_id", text="text": spark.createDataFrame([(r[doc_id], bits(prints[r[text]])) for r in docs.select(doc_id, text).collect()], f"doc_id {docs.select(doc_id).schema[0].dataType.simpleString()}, fp long"))
    docs = saved(spark.createDataFrame([(5, "A"), (None, "B"), (2, "C"), (7, "D"), (7, "E"), (None, "E")], "doc_id long, text string"))
    got = Counter((r.doc_id, r.component) for r in simhash.near_groups(docs).collect())
    assert got == Counter([(5, 2), (None, 2), (2, 2), (7, 7), (7, 7), (None, 7)])
    nobody = saved(spark.createDataFrame([(None, "A"), (None, "B"), (1, "D")], "doc_id long, text string"))
    assert Counter((r.doc_id, r.component) for r in simhash.near_groups(nobody).collect()) == Counter([(None, None), (None, None), (1, 1)])


def test_near_copies(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and len({r._row for r in kept.collect()}) == kept.count() == 3
    assert {r.doc_id for r in kept.collect()} == {1, 2}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None), (None, "http://a.com/de/")], "page_id long, url string")
    got = Counter((r.page_id, r.verdict, r.rule) for r in url_filter.judge_urls(pages.withColumnRenamed("page_id", "_row"), url_filter.rule_table(spark), keys=("_row",)).withColumnRenamed("_row", "page_id").collect())
    assert got == Counter([(1, "allow", "org/"), (1, "allow", "org/"), (None, "allow", None), (None, "block", "com/de/")])


def test_bytes_that_are_no_utf8(spark):
    """Each operator on bytes reads them as they are; for those on tokens they count as replacement characters."""
    data = [b"\xff\xfe", LONG.encode() + b" \xc3", b"x" + LONG.encode() + b" \xc3", "caf\u00e9".encode()]
    rows = saved(spark.createDataFrame(list(enumerate(data)), "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text")))
    spans = {r.doc_id: r for r in suffix_dedup.removed_spans(rows).collect()}
    assert [spans[i].n_bytes for i in range(4)] == [len(d) for d in data] and spans[2].n_removed == len(data[1]) and spans[2].kept_sha256 == hashlib.sha256(b"x").hexdigest()
    streams = {r.doc_id: r.payload_sha256 for r in transport_stream.described(transport_stream.with_streams(rows)).collect()}
    assert streams == {i: hashlib.sha256(d.ljust(-(-len(d) // 192) * 192)).hexdigest() for i, d in enumerate(data)}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(rows).collect()} == {i: simhash.fingerprint(d) for i, d in enumerate(data)}
    encoder = Encoder.get()
    sizes = Counter()
    for r in packing.pack(rows).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(encoder.encode(d.decode("utf-8", "replace"))) // 4 + 1 for i, d in enumerate(data)}
    blocks, order = token_counts.flat_files(rows)
    assert token_counts.document_spans(blocks).join(order, ["file", "doc_index"]).count() == 4


def test_ids_at_both_ends_and_no_tables_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    ids = [-(1 << 63), (1 << 63) - 1, 0, -5, None]
    got = exact_dedup.dedup(saved(spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string"))).collect()
    assert {r.keep_id for r in got} == {-(1 << 63)} and [r.doc_id for r in got if r.kept] == [-(1 << 63)]
    assert {t.name for t in spark.catalog.listTables()} == before
