"""Boxes beside points of an event stream: stateless, so that a batch and a stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.columns import km_to_degrees, side_box
from placeweave.storage import shared_dir


def beside(events: DataFrame, direction: str = "north", km: float = 3.0) -> DataFrame:
    """(event_id, minx, miny, maxx, maxy) of the box of ``km`` depth on one side of a unit box at each event's place."""
    lon, lat = 100 + F.pmod("user_id", F.lit(1000)) / 100, 20 + F.pmod(F.col("user_id") * 7, F.lit(1000)) / 100
    box = side_box(F.lit(direction), lon, lat, lon + 1, lat + 1, km_to_degrees(F.lit(km), lat + 0.5))
    return events.select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(box, ("minx", "miny", "maxx", "maxy"), strict=True)])


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`beside` of the events read as a stream of all that is there now, and written to a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = beside(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    path = shared_dir(spark)
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start(f"{path}/rows", format="parquet", outputMode="append").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")
