"""Answers of a place source that outlive the session, so that it is asked for each address once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.storage import saved, shared_dir, tasks_for

_FOUND = "struct<location:string,level:string,formatted_address:string>"


class LookupMemo:
    """A folder with what a source answered to each (address_key, city), and with what it didn't know.

    ``answers`` looks up by an anti-join what isn't known yet, and writes each
    call's answers to a folder of its own, whole or not at all; ``known`` reads
    them all, with the number of the call. A city that wasn't given is the
    empty string. Sessions may share a path if one at a time calls ``answers``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_dir(spark)

    def _calls(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(self.path)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [f.getPath() for f in store.listStatus(top)] if store.exists(top) else []
        return sorted(int(f.getName().partition("=")[2]) for f in folders if f.getName().startswith("call=") and store.exists(path(f, "_SUCCESS")))

    def known(self) -> DataFrame:
        """(address_key, city, found, call); ``found`` is null where the source had nothing."""
        schema = f"address_key string, city string, found {_FOUND}, call int"
        folders = [f"{self.path}/call={n}" for n in self._calls()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

    def answers(self, asked: DataFrame, source: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
        """(address_key, city, found) of what is asked for and found; ``source`` gives such rows for those of (address_key, city) that no call before knew.

        ``rows`` is how many are asked for at most, which is counted if it isn't given.
        """
        key = ["address_key", "city"]
        rows = asked.count() if rows is None else rows
        dealt = lambda df: df.repartition(tasks_for(rows + self.known().count()), *key)
        asked = dealt(asked.select("address_key", F.coalesce("city", F.lit("")).alias("city"))).distinct()
        new = saved(asked.join(dealt(self.known()), key, "left_anti"))
        if not new.isEmpty():
            number = max(self._calls(), default=0) + 1
            got = source(new).select("address_key", "city", F.col("found").cast(_FOUND).alias("found"))
            dealt(new).join(dealt(got), key, "left").write.mode("overwrite").parquet(f"{self.path}/call={number}")
        return dealt(self.known().filter("found is not null")).join(dealt(asked), key, "left_semi").drop("call")
