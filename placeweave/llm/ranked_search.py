"""Ranked lexical search: an index of documents in shards, each a matrix of precomputed impacts by term and document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import raw_texts, saved, shared_dir, table, text_batches
from .hashed import byte_values, plain_hashes

#: Bytes of texts in a shard, about.
SHARD_BYTES = 8 << 20
#: Different terms of the queries, each counted in each query, that are sent to all tasks at once, about.
BLOCK_TERMS = 1 << 20
#: Groups that the shards' best documents are merged in before the last merge.
GROUPS = 256
#: Terms are of letters, digits and what is beyond ASCII; A-Z count as a-z.
TERM = byte_values(bytes(b for b in range(128) if not chr(b).isalnum()))
_SHARD = "held long, total long, ids array<long>, terms binary, starts binary, docs binary, impacts binary"


def _norms(lengths: np.ndarray, held: int, total: int) -> np.ndarray:
    """What a document's length adds to a term's occurrences in a document, for each of ``lengths``; exact at any size."""
    size, of = np.unique(lengths, return_inverse=True)
    return np.array([10 + 90 * n * held // total for n in size.tolist()], np.int64)[of]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        n = plain_hashes(raw_texts(batch.column(0)), TERM)[1]
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["held", "total"])


def _shard(ids: list[int | None], texts: list[bytes], held: int, total: int) -> pa.RecordBatch:
    """One row: the documents in ascending order of their ids, and for each term a row of documents and impacts."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    term, n = plain_hashes([texts[i] for i in order], TERM)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    by = np.argsort(term.view(np.uint64), kind="stable")
    term, doc = term[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(term)))
    term, doc = term[first], doc[first]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * _norms(n, held, total)[doc]) if len(doc) else tf
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else first
    matrix = [term[starts], np.append(starts, len(term)), doc.astype(np.int32), impact.astype(np.int32)]
    row = [[int((n > 0).sum())], [int(n.sum())], pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *[pa.array([a.tobytes()], pa.binary()) for a in matrix]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["held", "total", "ids", "terms", "starts", "docs", "impacts"])


def _shards(batches: Iterator[pa.RecordBatch], held: int, total: int, most: int) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    for batch in text_batches(batches, most):
        new = raw_texts(batch.column(1))
        ids, texts, size = [*ids, *batch.column(0).to_pylist()], [*texts, *new], size + sum(map(len, new))
        if size >= most:
            yield _shard(ids, texts, held, total)
            ids, texts, size = [], [], 0
    if ids:
        yield _shard(ids, texts, held, total)


@dataclass
class Index:
    """Shards, one a row, in a folder that outlives the session; ``held`` documents have terms, ``total`` of them with repeats."""

    shards: DataFrame
    held: int
    total: int

    @staticmethod
    def build(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int | None = None) -> Index:
        """From all rows of ``docs``, whose texts are read twice: lengths come first, for impacts rest on their mean.

        Null, empty and termless texts count for nothing and are never found.
        Rows that repeat an id are documents of their own; null ids come last
        among equal scores. Terms are known by 64-bit hashes of their bytes,
        valid UTF-8 or not. An empty table makes an index that finds nothing.
        """
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        found = rows.select("text").mapInArrow(_sizes, "held long, total long").agg(F.sum("held"), F.sum("total")).first()
        held, total, most = found[0] or 0, found[1] or 0, shard_bytes or SHARD_BYTES
        path = path or shared_dir(docs.sparkSession)
        rows.mapInArrow(lambda b: _shards(b, held, total, most), _SHARD).write.option("compression", "zstd").parquet(path)
        return Index.open(docs.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        shards = spark.read.schema(_SHARD).parquet(path)
        held, total = shards.agg(F.sum("held"), F.sum("total")).first()
        return Index(shards, held or 0, total or 0)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        term, n = plain_hashes(raw_texts(batch.column(2)), TERM)
        each = [np.unique(t).tolist() for t in np.split(term, np.cumsum(n)[:-1])] if len(n) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, pa.list_(pa.int64()))], ["item", "item_id", "terms"])


@dataclass
class Block:
    """Queries as a task needs them: each one's row and id, where its terms are, and all terms in order with their weights."""

    items: list[int]
    item_ids: list[int | None]
    ends: np.ndarray
    of: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _places(terms: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where in ``terms``, which ascend as unsigned numbers, each of ``sought`` is, or -1."""
    if not len(terms):
        return np.full(len(sought), -1)
    at = np.minimum(np.searchsorted(terms.view(np.uint64), sought.view(np.uint64)), len(terms) - 1)
    return np.where(terms[at] == sought, at, -1)


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    sought = shared.value
    df = np.zeros(len(sought), np.int64)
    for batch in batches:
        for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
            at = _places(np.frombuffer(terms.as_buffer(), np.int64), sought)
            sizes = np.append(np.diff(np.frombuffer(starts.as_buffer(), np.int64)), 0)
            df += sizes[at]  # the last size stands for terms that the shard lacks
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], ["term", "df"])


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, of equal ones those of the first places."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        above = np.flatnonzero(scores > max(least, 0))
        return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]) if least > 0 else above
    return np.flatnonzero(scores > 0)


def _best(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    block: Block = shared.value
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column("ids")[row].values
            terms, starts = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("terms", "starts"))
            docs, impacts = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("docs", "impacts"))
            place = _places(terms, block.terms)
            scores = np.zeros(len(ids), np.int64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(np.append(0, block.ends[:-1]).tolist(), block.ends.tolist(), strict=True):
                scores[:] = 0
                for t in block.of[a:b].tolist():
                    if (p := place[t]) >= 0 and block.weights[t]:
                        here = slice(starts[p], starts[p + 1])
                        scores[docs[here]] += block.weights[t] * impacts[here].astype(np.int64)
                found = top(scores, k)
                out.append((found, scores[found]))
            n = [len(found) for found, _ in out]
            at = np.concatenate([found for found, _ in out])
            columns = [pa.array(np.repeat(block.items, n)), pa.array(block.item_ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))), ids.take(pa.array(at)), pa.array(np.concatenate([s for _, s in out]))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_terms: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents of the highest score above 0 for each row of ``queries``.

    Equal scores rank by ascending doc_id. Null and termless queries find
    nothing; rows that repeat an id are queries of their own. Queries are
    sent to the shards in blocks of about ``block_terms`` terms; each shard
    adds the impacts of a query's terms, term after term, and passes on its
    best ``k``. The shards' best are merged in groups, and the groups' at last.
    """
    spark = queries.sparkSession
    asked = queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    asked = saved(asked.mapInArrow(_query_terms, "item long, item_id long, terms array<long>").filter(F.size("terms") > 0))
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // (block_terms or BLOCK_TERMS)
    out = [spark.createDataFrame([], "item long, item_id long, doc_id long, score long, part int")]
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        lists = rows["terms"].combine_chunks()
        terms, of = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        terms = terms.view(np.int64)
        sought = spark.sparkContext.broadcast(terms)
        counts = index.shards.select("terms", "starts").mapInArrow(lambda x, s=sought: _frequencies(x, s), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        for t, df in zip(counts["term"].to_pylist(), counts["df"].to_pylist(), strict=True):
            weights[t] = math.floor(1000 * math.log((2 * index.held + 2) / (2 * df + 1)))
        ends = np.cumsum(lists.value_lengths().to_numpy())
        shared = spark.sparkContext.broadcast(Block(rows["item"].to_pylist(), rows["item_id"].to_pylist(), ends, of, terms, weights))
        found = index.shards.select("ids", "terms", "starts", "docs", "impacts").mapInArrow(lambda x, s=shared: _best(x, s, k), "item long, item_id long, doc_id long, score long")
        out.append(found.withColumn("part", F.spark_partition_id() % GROUPS))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    first = _ranked(found, ["item", "part"], k).drop("rank")
    return _ranked(first, ["item"], k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item."""
    return search(Index.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
m AS (SELECT doc_id, 10 + (90 * n * docs) // len AS m FROM n, g),
t AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
