"""The engine from SQL: functions on geometries and trees, and its tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from placeweave.engine import TABLES, Engine
from placeweave.functions import columns as C
from placeweave.functions import kernel as K

#: Scalar functions: arguments, type, and the expression that they stand for.
FUNCTIONS = {
    "place_km_to_degrees": ("km DOUBLE, lat DOUBLE", "DOUBLE", f"greatest(km / {C.KM_PER_DEGREE}D, km / ({C.KM_PER_DEGREE}D * cos(radians(abs(lat))) + 1e-10D))"),
    "place_area": ("geom BINARY", "DOUBLE", "place_Measures(geom)[6]"),
    "place_length": ("geom BINARY", "DOUBLE", "place_Measures(geom)[7]"),
    "place_near": ("geom BINARY, km DOUBLE", "BINARY", "place_Buffer(geom, place_km_to_degrees(km, place_Measures(geom)[5]))"),
    "place_box": ("minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE", "BINARY", "place_FromGeoJson(format_string('{\"type\":\"Polygon\",\"coordinates\":[[[%1$s,%2$s],[%3$s,%2$s],[%3$s,%4$s],[%1$s,%4$s],[%1$s,%2$s]]]}', string(minx), string(miny), string(maxx), string(maxy)))"),
}
NODES = "node_id STRING, parent_id STRING, role STRING, ordinal INT, depth INT, post INT, kids INT, js STRING"


def register(spark: SparkSession, engine: Engine | None = None) -> None:
    """Temporary functions of a session: the kernel's (place_Buffer ...), those above, and the table function place_tree_nodes(tree).

    The tables that ``engine`` has become views: place_gazetteer,
    place_districts, place_osm_elements, place_responses and place_coastline.
    """
    K.register(spark)
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION place_tree_nodes(tree STRING) RETURNS TABLE({NODES}) RETURN SELECT * FROM inline(place_Nodes(tree))")
    for name in [*TABLES, "coastline"] if engine is not None else []:
        if (rows := getattr(engine, name)) is not None:
            rows.createOrReplaceTempView(f"place_{name}")
