"""Coastlines from a GeoJSON feature collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import kernel as K
from placeweave.sources.geojson import read_features


def read_coastline(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(geom) of each feature that has a geometry: of feature collections, or with ``lines`` of a file with one feature a line; many tasks read one file."""
    K.register(spark)
    shapes = spark.read.text(path).select(F.get_json_object("value", "$.geometry").alias("geometry")) if lines else read_features(spark, path)
    return shapes.select(K.from_geojson("geometry").alias("geom")).filter("geom is not null")
