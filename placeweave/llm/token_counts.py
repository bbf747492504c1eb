"""Token counts of documents in flat token files, found by scanning for the end-of-document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import raw_texts, saved, table, text_batches
from .tokens import Encoder

#: The separator of the 50k vocabulary; no text has it, since strings of special tokens are encoded as ordinary text here.
END_ID = 50256
BLOCK_TOKENS = 1 << 16
#: Blocks whose sums are scanned together; their totals are scanned above them.
GROUP = 4096


def _flat(batches: Iterator[pa.RecordBatch], block: int, end: int, paths: tuple[str | None, str | None]) -> Iterator[pa.RecordBatch]:
    """Blocks of the partition's token file, of ``block`` tokens each but the last, and the documents in their order."""
    encoder, file, rest, n, nth = Encoder.get(*paths, escaped=True), TaskContext.get().partitionId(), [], 0, 0
    stop = np.array([end], "<u2").tobytes()

    def out(data: list[bytes], ids: list[int | None], first: int) -> pa.RecordBatch:
        count = len(data) + len(ids)
        numbers = [*range(n - len(data), n), *range(first, first + len(ids))]
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * count, pa.int32()), pa.array(numbers, pa.int64()), pa.array([*data, *[None] * len(ids)], pa.binary()), pa.array([*[None] * len(data), *ids], pa.int64())],
            ["file", "n", "data", "doc_id"],
        )

    for batch in text_batches(batches):
        for text in raw_texts(batch.column(1)):
            rest += [np.frombuffer(encoder.encode(text.decode("utf-8", "replace")), "<u4").astype("<u2").tobytes(), stop]
        joined = b"".join(rest)
        full = len(joined) // (2 * block)
        cut = [joined[2 * block * i : 2 * block * (i + 1)] for i in range(full)]
        rest, n = [joined[2 * block * full :]], n + full
        yield out(cut, batch.column(0).to_pylist(), nth)
        nth += batch.num_rows
    if rest and rest[0]:
        n += 1
        yield out(rest, [], nth)


def flat_files(docs: DataFrame, block: int = BLOCK_TOKENS, end: int = END_ID, paths: tuple[str | None, str | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """Token files of the documents, one a partition: their blocks (file, block, data) without regard to documents, and the order (file, doc_index, doc_id).

    Tokens are little-endian unsigned 16-bit ids, each document followed by
    ``end``. A null text counts as empty; rows that repeat an id, or have
    none, are documents of their own. An empty table gives no blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = saved(rows.mapInArrow(lambda b: _flat(b, block, end, paths), "file int, n long, data binary, doc_id long").withColumn("order", F.col("data").isNull()))
    return out.filter("not order").select("file", F.col("n").alias("block"), "data"), out.filter("order").select("file", F.col("n").alias("doc_index"), "doc_id")


#: Files of at most so many bytes are read as one row each before they are cut; larger ones record by record.
WHOLE_FILE = 64 << 20


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            view = data.as_buffer()
            blocks = [view[at : at + size].to_pybytes() for at in range(0, view.size, size)]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], ["file", "block", "data"])


def read_flat(spark: SparkSession, path: str, width: int = 2, most: int = BLOCK_TOKENS) -> tuple[DataFrame, dict[int, str]]:
    """(file, block, data) of a flat token file, or of all in a folder, in any store that Spark reads; and the files' names by their numbers.

    Files of up to WHOLE_FILE bytes are cut into blocks of ``most`` tokens and
    a rest. A larger one is read by many tasks in records of equal lengths,
    the largest divisor of its tokens up to ``most``: a prime number of tokens
    gives records of one, which is slow. Empty files have no number. A file
    that isn't a whole number of tokens is refused.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()  # what the driver lists anyway
    for r in listed:
        if r.length % width:
            raise ValueError(f"{r.path} has {r.length} bytes, not a whole number of {width}-byte tokens")
    names = {i: r.path for i, r in enumerate(listed)}
    small = [(i, r.path) for i, r in enumerate(listed) if 0 < r.length <= WHOLE_FILE]
    blocks = spark.createDataFrame([], "file int, block long, data binary")
    if small:
        numbers = spark.createDataFrame(small, "file int, path string")
        whole = spark.read.format("binaryFile").load([p for _, p in small]).join(F.broadcast(numbers), "path").select("file", "content")
        blocks = whole.mapInArrow(lambda b: _cut(b, most * width), "file int, block long, data binary")
    for i, r in enumerate(listed):
        if r.length > WHOLE_FILE:
            tokens = r.length // width
            each = next(d for d in range(min(most, tokens), 0, -1) if tokens % d == 0)
            records = spark.sparkContext.binaryRecords(r.path, each * width).zipWithIndex().map(lambda x, i=i: (i, x[1], bytearray(x[0])))
            blocks = blocks.unionByName(records.toDF("file int, block long, data binary"))
    return blocks, names


def _search(batches: Iterator[pa.RecordBatch], end: int, width: int) -> Iterator[pa.RecordBatch]:
    kind = f"<u{width}"
    for batch in batches:
        found = [(np.frombuffer(x, kind) == end).nonzero()[0].astype(np.int32) for x in batch.column(2).to_pylist()]
        sizes = [len(x) // width for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file", "block", "tokens", "at"])


def document_spans(blocks: DataFrame, end: int = END_ID, width: int = 2) -> DataFrame:
    """(file, doc_index, start, n_tokens, complete) of each document in flat token files.

    Each block is searched for ``end`` by itself. Sums over the blocks before
    it, in groups and over groups, then give the tokens and documents before
    it and where the document open at its start began. ``n_tokens`` leaves
    the separator out. Tokens after the last separator of a file are one
    document that isn't complete. Null data count as empty.
    """
    filled = blocks.select("file", "block", F.coalesce("data", F.lit(b"")).alias("data"))
    found = saved(filled.mapInArrow(lambda b: _search(b, end, width), "file int, block long, tokens long, at array<int>"))
    last = F.when(F.size("at") > 0, F.element_at("at", -1))
    sums = found.select("file", "block", "tokens", F.size("at").cast("long").alias("docs"), last.alias("last"), F.floor(F.col("block") / GROUP).alias("group"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumns({"t": F.coalesce(F.sum("tokens").over(inside), F.lit(0)), "d": F.coalesce(F.sum("docs").over(inside), F.lit(0))})
    local = local.withColumn("open", F.max(F.col("t") + F.col("last") + 1).over(inside))
    totals = local.groupBy("file", "group").agg(F.sum("tokens").alias("gt"), F.sum("docs").alias("gd"), F.max(F.col("t") + F.col("last") + 1).alias("gopen"))
    above = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumns({"bt": F.coalesce(F.sum("gt").over(above), F.lit(0)), "bd": F.coalesce(F.sum("gd").over(above), F.lit(0))})
    bases = bases.withColumn("bopen", F.coalesce(F.max(F.col("bt") + F.col("gopen")).over(above), F.lit(0))).select("file", "group", "bt", "bd", "bopen")
    carried = saved(local.join(bases, ["file", "group"]).select(
        "file", "block", "tokens", "docs", "last", (F.col("bt") + F.col("t")).alias("base"), (F.col("bd") + F.col("d")).alias("docs_before"), F.coalesce(F.col("bt") + F.col("open"), "bopen").alias("open"),
    ))
    each = found.select("file", "block", "at").join(carried.select("file", "block", "base", "docs_before", "open"), ["file", "block"])
    i = F.col("i")
    spans = each.select("file", "base", "docs_before", "open", "at", F.posexplode("at").alias("i", "stop")).select(
        "file", (F.col("docs_before") + i).alias("doc_index"),
        F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.element_at("at", F.greatest(i, F.lit(1))) + 1).alias("start"), (F.col("base") + F.col("stop")).alias("stop"),
    )
    whole = spans.select("file", "doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = carried.groupBy("file").agg(F.max(F.col("base") + F.col("tokens")).alias("stop"), F.max(F.greatest("open", F.coalesce(F.col("base") + F.col("last") + 1, F.lit(0)))).alias("start"), F.max(F.col("docs_before") + F.col("docs")).alias("doc_index"))
    tail = ends.filter("stop > start").select("file", "doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(tail)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, doc_index, start, n_tokens, complete) of each document, read back from flat token files of the whole table."""
    blocks, order = flat_files(table(spark, sf_dir, "documents"))
    return document_spans(blocks).join(order, ["file", "doc_index"]).select("doc_id", "file", "doc_index", "start", "n_tokens", "complete")
