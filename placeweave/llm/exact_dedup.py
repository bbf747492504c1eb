"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, join_hot, saved, shared_dir, table


#: Batches that the documents of one call are fed to the index in.
BATCHES = 3
#: Files a bucket has when the index is compacted: with one file each, its order spares the joins a sort.
MOST_FILES = 8
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestIndex:
    """A table (digest, keep_id, keep_row, run) bucketed and sorted by digest; ``path`` outlives the session.

    ``add(firsts)`` finds what is new by a sort-merge anti-join, for which the
    index needs no shuffle, and appends it. Files pile up in a bucket with
    each batch; ``compact`` writes the table anew as the next generation, a
    folder under ``path``, with one sorted file a bucket. Open an existing
    path with the same number of buckets to go on in a later session. One
    session at a time may add. ``close`` takes the table out of the catalog.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or shared_dir(spark)
        self._open(max(self._generations(), default=0))

    def _folder(self):  # noqa: ANN202
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return top, top.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        """Generations that were written whole."""
        top, store = self._folder()
        found = store.listStatus(top) if store.exists(top) else []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return [int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit() and (f.getPath().getName() == "0" or store.exists(path(f.getPath(), "_SUCCESS")))]

    def _open(self, generation: int) -> None:
        self.generation, self.name = generation, f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, run BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{generation}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> int:
        """The most files that a bucket has."""
        return max(Counter(f.rpartition("_")[2] for f in self.table().inputFiles()).values(), default=0)

    def add(self, firsts: DataFrame) -> None:
        """Append the rows (digest, keep_id, keep_row, run), one for each digest, whose digest the index lacks."""
        with _ordered(self.spark):
            new = firsts.select("digest", "keep_id", "keep_row", "run").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
            # The anti-join reads the folder it appends to, so its rows are written down first.
            new = saved(new)
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        if self.files() >= MOST_FILES:
            self.compact()

    def compact(self) -> None:
        """One sorted file a bucket, in a new generation; the old one is deleted when that is whole."""
        old, last = self.name, self.generation
        # Read as plain files: of a bucketed table the repartition would be left out.
        rows = self.spark.read.schema(self.table().schema).parquet(f"{self.path}/{last}")
        self._open(last + 1)
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.spark.sql(f"DROP TABLE {old}")
        _, store = self._folder()
        store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{last}"), True)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@contextmanager
def _ordered(spark: SparkSession) -> Iterator[None]:
    """Plans made inside trust the order of a bucket that is one file."""
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digest``, that of the text with each run of white space replaced by one space; null counts as empty."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256)))


def dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text", row: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row (doc_id, row, digest, keep_id, group_size, kept) for each document.

    The documents are fed to the index in ``batches`` in the order of their
    ids, and what the index lacks of each batch is kept: of equal texts so
    the smallest ``doc_id`` stays, or none if the index knew the digest from
    an earlier call. Null texts equal empty ones. Of rows that repeat the
    smallest id the first as they are read stays; null ids come last, so one
    stays only where its group has no other. ``group_size`` counts this call.
    An empty table gives no rows. ``row`` names a column that tells the rows
    apart; without it they are numbered as they are read. Other columns are
    not read.
    """
    own, index = index is None, index or DigestIndex(docs.sparkSession)
    run = uuid.uuid4().int >> 66  # row numbers of earlier calls never match
    id_ = F.col(doc_id).cast("long")
    least, most = docs.agg(F.min(id_), F.max(id_)).first()
    share = (id_.cast("double") - F.lit(float(least or 0))) * batches / (float((most or 0) - (least or 0)) + 1)
    batch = F.coalesce(F.least(F.floor(share), F.lit(batches - 1)), F.lit(batches - 1)).cast("int")
    keyed = docs.select(id_.alias("doc_id"), F.col(text).alias("_text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), batch.alias("batch"))
    rows = saved(with_digest(keyed, "_text").drop("_text"), ("batch",))
    for k in range(batches):
        first = rows.filter(F.col("batch") == k).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"))
        index.add(first.select("digest", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row"), F.lit(run).alias("run")))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    with _ordered(docs.sparkSession):
        stays = saved(sizes.join(index.table().hint("merge"), "digest"))
    if own:
        index.close()
    kept = (F.col("run") == run) & (F.col("row") == F.col("keep_row"))
    return join_hot(rows, stays, "digest", "group_size").select("doc_id", "row", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; see :func:`dedup`."""
    row = free_name(docs, "_row")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = dedup(numbered, doc_id=doc_id, text=text, row=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each document, by way of a new index."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""
