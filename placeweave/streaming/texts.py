"""Texts to geometries as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeweave.engine import Engine

RESULT = "query_id {kind}, geom binary, kind string, status string, batch long"


def evaluate_stream(engine: Engine, texts: DataFrame, path: str, mode: str = "permissive") -> StreamingQuery:
    """Evaluate a stream of (query_id, text), all that is there now, and write the rows of :meth:`Engine.evaluate` below ``path``.

    Each batch has a folder of its own, which a batch that is tried again
    replaces, so after a restart from the state below ``path`` no row is
    missing and none is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.evaluate(batch, mode).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def results(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(query_id, geom, kind, status, batch) of all batches that :func:`evaluate_stream` has written below ``path``."""
    return spark.read.schema(RESULT.format(kind=kind)).parquet(f"{path}/rows").select("query_id", "geom", F.col("kind"), "status", "batch")
