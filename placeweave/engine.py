"""Texts to geometries, a table at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import columns as C
from placeweave.functions import kernel as K
from placeweave.operators.memo import LookupMemo
from placeweave.operators.resolve import enrich, places_of, resolve
from placeweave.plans.evaluate import evaluate_nodes
from placeweave.plans.flatten import flatten
from placeweave.sources.answers import ANSWERS, READERS
from placeweave.sources.coastline import read_coastline
from placeweave.sources.geojson import write_features_as_collections
from placeweave.sources.parser import called, phrase_tree, recorded
from placeweave.storage import saved

# Zoom of a map, and its layers' colours and widths.
_PAGE = (
    '<!DOCTYPE html><html><head><meta charset="utf-8"><link rel="stylesheet" href="https://unpkg.com/leaflet/dist/leaflet.css">'
    '<script src="https://unpkg.com/leaflet/dist/leaflet.js"></script></head><body><div id="map" style="height:100vh"></div><script>'
    'var map=L.map("map").setView([%s,%s],6);L.tileLayer("https://tile.openstreetmap.org/{z}/{x}/{y}.png").addTo(map);'
    "var style=%s;L.geoJSON(%s,{style:style}).addTo(map);map.fitBounds([[%s,%s],[%s,%s]]);</script></body></html>"
)


#: Tables that an engine reads from a folder.
TABLES = {
    "gazetteer": "address_key string, city string, position int, location string, level string, formatted_address string",
    "districts": "keyword string, position int, name string, adcode string, level string, polyline string",
    "osm_elements": "osm_type string, name string, tags map<string,string>, geometry string",
    "responses": "text string, response string",
}


@dataclass
class Engine:
    """Tables that stand for a language model and map services; any may be left out."""

    gazetteer: DataFrame | None = None
    districts: DataFrame | None = None
    osm_elements: DataFrame | None = None
    coastline: DataFrame | None = None
    responses: DataFrame | None = None
    #: Asked for each text's tree in place of recorded answers and phrases.
    parser: Callable[[str], str] | None = None
    #: What the gazetteer answered in earlier calls.
    memo: LookupMemo | None = None

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> Engine:
        """From the tables that a folder has under the names above: Parquet (name.parquet), JSON lines (name.json), and coastline.geojson.

        Where a table isn't there, recorded answers of its service are read
        (see sources/answers.py).
        """
        path = spark._jvm.org.apache.hadoop.fs.Path
        store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda name: store.exists(path(folder, name))

        def read(name: str, schema: str) -> DataFrame | None:
            if there(f"{name}.parquet"):
                return spark.read.parquet(f"{folder}/{name}.parquet")
            return spark.read.schema(schema).json(f"{folder}/{name}.json") if there(f"{name}.json") else None

        found = {}
        for name, schema in TABLES.items():
            rows = read(name, schema)
            if rows is None and name in ANSWERS and (answers := read(*ANSWERS[name])) is not None:
                rows = READERS[name](answers)
            found[name] = rows
        if there("coastline.geojson"):
            found["coastline"] = read_coastline(spark, f"{folder}/coastline.geojson")
        return cls(**found)

    def parse(self, queries: DataFrame) -> DataFrame:
        """``plan_nodes`` of (query_id, text), by the parser if there is one, by recorded answers if there are any, else by phrases."""
        if self.parser is not None:
            return flatten(called(queries, self.parser))
        trees = recorded(queries, self.responses) if self.responses is not None else queries.select("query_id", phrase_tree(F.col("text")).alias("tree"))
        return flatten(trees)

    def evaluate_nodes(self, nodes: DataFrame, mode: str = "permissive") -> DataFrame:
        """(query_id, geom, kind, status); leaves are resolved by the tables that there are. ``mode`` is that of :func:`plans.evaluate.evaluate_nodes`."""
        found, given = None, (self.gazetteer, self.districts, self.osm_elements)
        if any(t is not None for t in given):
            nodes = saved(nodes)
            found = saved(enrich(nodes, saved(resolve(places_of(nodes), *given, self.memo))))
        return evaluate_nodes(nodes, self.coastline, found, mode)

    def evaluate(self, queries: DataFrame, mode: str = "permissive") -> DataFrame:
        return self.evaluate_nodes(self.parse(queries), mode)


def features(geoms: DataFrame) -> DataFrame:
    """(query_id, feature): GeoJSON features of the queries that succeeded."""
    return geoms.filter("status is null").select("query_id", C.feature_json(K.to_geojson("geom")).alias("feature"))


def write_features(geoms: DataFrame, path: str) -> None:
    """One feature a line."""
    features(geoms).select("feature").write.text(path)


def write_collections(geoms: DataFrame, path: str) -> None:
    """Files of one feature collection each, as many as there are partitions."""
    write_features_as_collections(features(geoms).select("feature"), path)


def write_maps(geoms: DataFrame, path: str) -> None:
    """A page for each query that succeeded, in a folder of its name."""
    map_pages(geoms).withColumn("query", F.col("query_id").cast("string")).select("query", F.col("html").alias("value")).write.partitionBy("query").text(path)


def summaries(geoms: DataFrame) -> DataFrame:
    """(query_id, summary): type, centroid and bounds of each geometry."""
    m = geoms.filter("status is null").withColumn("m", K.measures("geom"))
    return m.select("query_id", F.format_string("%s, centre (%.4f, %.4f), bounds (%s, %s, %s, %s)", "kind", "m.cx", "m.cy", "m.minx", "m.miny", "m.maxx", "m.maxy").alias("summary"))


def map_pages(geoms: DataFrame) -> DataFrame:
    """(query_id, html): a page with a map that shows the geometry in the style of its type."""
    m = geoms.filter("status is null").withColumn("m", K.measures("geom"))
    line = F.col("kind").isin("LineString", "MultiLineString")
    style = F.when(line, '{"color":"#ff4400","weight":4,"opacity":0.8}').otherwise('{"fillColor":"#ff7800","fillOpacity":0.4,"color":"#ff4400","weight":2}')
    return m.select("query_id", F.format_string(_PAGE, F.col("m.cy").cast("string"), F.col("m.cx").cast("string"), style, K.to_geojson("geom"), *[F.col(f"m.{c}").cast("string") for c in ("miny", "minx", "maxy", "maxx")]).alias("html"))
