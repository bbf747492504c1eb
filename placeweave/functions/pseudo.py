"""Boundaries for places of which only a centre is known: star-shaped polygons drawn from a generator seeded by the centre."""

from __future__ import annotations

from pyspark.sql import Column

from placeweave.functions import kernel as K


def place_boundary(lon: Column, lat: Column, radius: Column) -> Column:
    """GeoJSON of 7 to 12 corners; null where any argument is."""
    return K.to_geojson(K.call("DrawnPlace", lon, lat, radius))


def lookup_boundary(lon: Column, lat: Column, radius: Column) -> Column:
    """GeoJSON of 10 corners; null where any argument is."""
    return K.to_geojson(K.call("DrawnLookup", lon, lat, radius))
