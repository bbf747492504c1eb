"""What the operators share: a folder that all executors see, and joins on keys with hot values."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular expression's class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key counts as hot when it has more than one row in so many; so there are fewer hot keys than this.
HOT_KEYS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of its own for each call, under spark.checkpoint.dir.

    Where the cluster names no such folder, a local master gets one under
    the temp folder; any other master is refused, since its executors would
    not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def tidied(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more, on which Spark deletes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column, by: int) -> Column:
    """Whether the crc32 of the id as text leaves no remainder by ``by``; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(by)) == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner equi-join of many rows with one row a key, safe for hot keys.

    ``right`` has one row for each value of ``key``, and in ``weight`` how
    many rows of ``left`` have it. Keys with more than one in HOT_KEYS of all
    rows are fewer than HOT_KEYS, so they are broadcast; the others meet in a
    shuffle, where none has a large share. Both inputs are read twice: pass
    saved tables.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * HOT_KEYS > total)
    cold = right.filter(F.col(weight) * HOT_KEYS <= total)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has at most ``most`` bytes or one row: very long texts do not pile up."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        half = batch.num_rows // 2
        yield from text_batches(iter([batch.slice(0, half), batch.slice(half)]), most)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The bytes of a string column, valid UTF-8 or not; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def count_threshold(rows: DataFrame, count: str, most: int, least: int = 1) -> int:
    """The smallest power of two times ``least`` that ``count`` reaches in at most ``most`` rows."""
    power = F.floor(F.log2(F.col(count) / least)).cast("int")
    steps = rows.filter(F.col(count) >= least).groupBy(power.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 63 rows
    total, k = 0, max((r.k for r in steps), default=0) + 1
    for r in sorted(steps, key=lambda r: -r.k):
        total += r.n
        if total > most:
            return least << k
        k = r.k
    return least
