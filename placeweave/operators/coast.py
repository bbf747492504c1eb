"""Coastlines in areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions import kernel as K
from placeweave.operators.spatial import spatial_pairs

#: Segments of a piece of a line.
SEGMENTS = 64
#: Parts in which many geometries of one key are dissolved before these are.
SALTS = 64


def dissolved(rows: DataFrame, keys: list[str], geom: str) -> DataFrame:
    """(keys, geom): the union of each key's geometries, first in SALTS parts, so that a key with many of them isn't one task's."""
    parts = rows.groupBy(*keys, F.pmod(F.xxhash64(geom), F.lit(SALTS)).alias("salt")).agg(F.collect_list(geom).alias("many")).select(*keys, K.call("Union", "many").alias(geom))
    return parts.groupBy(*keys).agg(F.collect_list(geom).alias("many")).select(*keys, K.call("Union", "many").alias(geom))


def cut_lines(lines: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(geom): ``lines`` in pieces of at most ``segments`` segments, so that a long coast meets an area with what is near it alone."""
    K.register(lines.sparkSession)
    return lines.select(F.explode(K.call("Pieces", "geom", F.lit(segments))).alias("geom"))


def coast_lines(areas: DataFrame, coastline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coast): what of ``coastline`` (geom) lies in each area (keys, geom), in lines as long as can be; areas without any have no row."""
    pieces = spatial_pairs(areas, coastline.select("geom")).select(*keys, K.call("Intersection", "r_geom", "l_geom").alias("piece"))
    return dissolved(pieces, keys, "piece").select(*keys, K.call("Merged", "piece").alias("coast"))
