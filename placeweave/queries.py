"""The queries of the spatial engine, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.engine import Engine
from placeweave.functions import columns as C
from placeweave.functions import kernel as K
from placeweave.functions.pseudo import lookup_boundary, place_boundary
from placeweave.operators import resolve as R
from placeweave.operators.memo import LookupMemo
from placeweave.operators.spatial import spatial_pairs
from placeweave.plans.evaluate import evaluate_trees
from placeweave.plans.flatten import flatten
from placeweave.sources.answers import ANSWERS
from placeweave.sources.examples import EXAMPLES
from placeweave.sources.geojson import read_features, write_features_as_collections
from placeweave.sources.parser import phrase_tree
from placeweave.sql import register
from placeweave.storage import shared_dir
from placeweave.streaming.directional import beside, streamed
from placeweave.streaming.texts import evaluate_stream, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fragments of SQL: the area of a unit circle of 64 corners, degrees of km at lat, the nations' boxes.
ROUND = "(32 * sin(pi() / 32))"
BOXES = "b AS (SELECT n_nationkey AS k, 100.0::DOUBLE + 2 * (n_nationkey % 5) AS x, 20.0::DOUBLE + 2 * (n_nationkey // 5) AS y FROM nation)"


def deg(km: str, lat: str) -> str:
    return f"greatest({km}::DOUBLE / 111.32::DOUBLE, {km}::DOUBLE / (111.32::DOUBLE * cos(radians(abs({lat}))) + 1e-10::DOUBLE))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def node(kind: str, **parts: Column | str | float) -> Column:
    """JSON text of a node; values that aren't columns are written as they are."""
    inner = [F.concat(F.lit(f',"{k}":'), v if isinstance(v, Column) else F.lit(json.dumps(v))) for k, v in parts.items()]
    return F.concat(F.lit(f'{{"node_type":"{kind}"'), *inner, F.lit("}"))


def leaf(x: Column, y: Column, w: float = 2.0, h: float = 2.0) -> Column:
    return node("NamedPlace", _polygon=C.box_json(x, y, x + w, y + h))


def listed(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y, here, east): each nation's key, the lower left corner of its box, and leaves of it and of the box to its east."""
    x, y = F.lit(100.0) + 2 * (F.col("n_nationkey") % 5), F.lit(20.0) + 2 * F.floor(F.col("n_nationkey") / 5)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), x.alias("x"), y.cast("double").alias("y"))
    return rows.withColumns({"here": leaf(F.col("x"), F.col("y")), "east": leaf(F.col("x") + 2, F.col("y"))})


def straight_coast(spark: SparkSession) -> DataFrame:
    K.register(spark)
    return spark.range(1).select(K.from_geojson(F.lit('{"type":"LineString","coordinates":[[90,20],[120,20]]}')).alias("geom"))


def measured(spark: SparkSession, rows: DataFrame, tree: Column, *wanted: str, coast: bool = False, digits: int = 6) -> DataFrame:
    """(k, status, wanted measures) of a tree for each nation."""
    K.register(spark)
    done = evaluate_trees(rows.select(F.col("k").alias("query_id"), tree.alias("tree")), straight_coast(spark) if coast else None)
    m = done.withColumn("m", K.measures("geom"))
    return m.select(F.col("query_id").alias("k"), "status", *[F.round(f"m.{w}", digits).alias(w) for w in wanted])


def simple(name: str, tree: Callable[[], Column], sql: str, *wanted: str, coast: bool = False) -> None:
    """Register a query of one tree for each nation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measured(spark, nations(spark, sf_dir), tree(), *wanted, coast=coast)

    QUERIES[name] = run
    SQL[name] = f"WITH {BOXES} SELECT k, NULL::VARCHAR AS status, {sql} FROM b"


HERE, EAST = lambda: F.col("here"), lambda: F.col("east")
SHIFT = lambda dx, dy: leaf(F.col("x") + dx, F.col("y") + dy)
D = lambda km: f"({deg(km, 'y + 1')})"
R2 = 0.005

simple("named_place", HERE, "round(x, 6) AS minx, round(y, 6) AS miny, round(x + 2, 6) AS maxx, round(y + 2, 6) AS maxy, round(x + 1, 6) AS cx, round(y + 1, 6) AS cy, 4.0::DOUBLE AS area", "minx", "miny", "maxx", "maxy", "cx", "cy", "area")
for _km in (1, 3, 5):
    simple(f"buffer_{_km}km", lambda km=_km: node("Buffer", distance_km=km, child_node=HERE()), f"round(4 + 8 * {D(str(_km))} + {ROUND} * {D(str(_km))} * {D(str(_km))}, 6) AS area, round(x - {D(str(_km))}, 6) AS minx, round(y + 2 + {D(str(_km))}, 6) AS maxy", "area", "minx", "maxy")
simple("buffer_default", lambda: node("Buffer", child_node=HERE()), f"round(4 + 8 * {D('1')} + {ROUND} * {D('1')} * {D('1')}, 6) AS area", "area")
for _side, _box in {
    "north": ("x", "y + 2", "x + 2", "y + 2 + {d}"), "south": ("x", "y - {d}", "x + 2", "y"), "east": ("x + 2", "y", "x + 2 + {d}", "y + 2"), "west": ("x - {d}", "y", "x", "y + 2"),
}.items():
    simple(
        f"directional_{_side}", lambda s=_side: node("DirectionalConstraint", direction=s, max_distance_km=5, child_node=HERE()),
        ", ".join(f"round({e.format(d=D('5'))}, 6) AS {n}" for e, n in zip(_box, ("minx", "miny", "maxx", "maxy"), strict=True)), "minx", "miny", "maxx", "maxy",
    )
simple("directional_default_3km", lambda: node("DirectionalConstraint", child_node=HERE()), f"round(y + 2, 6) AS miny, round(y + 2 + {D('3')}, 6) AS maxy", "miny", "maxy")
simple("intersection_adjacent", lambda: node("Intersection", child_nodes=listed(HERE(), EAST())), f"round(2 * {R2}::DOUBLE * 2 + {ROUND} * {R2}::DOUBLE * {R2}::DOUBLE, 6) AS area", "area")
simple("intersection_overlap", lambda: node("Intersection", child_nodes=listed(HERE(), SHIFT(1, 1))), f"round((1 + 2 * {R2}::DOUBLE) * (1 + 2 * {R2}::DOUBLE) - 2 * ({R2}::DOUBLE * {R2}::DOUBLE - {ROUND} * {R2}::DOUBLE * {R2}::DOUBLE / 4), 6) AS area", "area")
simple(
    "compound_direction_corner", lambda: node("Intersection", child_nodes=listed(*[node("DirectionalConstraint", direction=d, max_distance_km=5, child_node=HERE()) for d in ("north", "west")])),
    f"round(x - {R2}::DOUBLE, 6) AS minx, round(y + 2 - {R2}::DOUBLE, 6) AS miny, round(x + {R2}::DOUBLE, 6) AS maxx, round(y + 2 + {R2}::DOUBLE, 6) AS maxy", "minx", "miny", "maxx", "maxy",
)
simple("union_area", lambda: node("Union", child_nodes=listed(HERE(), SHIFT(1, 1))), "7.0::DOUBLE AS area", "area")
simple("difference_area", lambda: node("Difference", child_node_1=HERE(), child_node_2=SHIFT(1, 1)), "3.0::DOUBLE AS area", "area")
simple("between_area", lambda: node("Between", child_node_1=HERE(), child_node_2=SHIFT(6, 4)), "16.0::DOUBLE AS area", "area")
simple("border_between_area", lambda: node("BorderBetween", child_node_1=HERE(), child_node_2=EAST()), f"round(4 * {D('3.5')} + {ROUND} * {D('3.5')} * {D('3.5')}, 6) AS area", "area")
simple("border_of_length", lambda: node("BorderOf", child_node=HERE()), "8.0::DOUBLE AS length", "length")
simple("coast_of_length", lambda: node("CoastOf", child_node=HERE()), f"CASE WHEN y = 20 THEN round(2 + 2 * {D('2')}, 6) END AS length", "length", coast=True)
simple(
    "off_coast_area", lambda: node("OffTheCoastOf", distance_km=10, child_node=HERE()),
    f"CASE WHEN y = 20 THEN round(2 * (2 + 2 * {D('2')}) * {D('10')} + {ROUND} * {D('10')} * {D('10')} - 2 * {D('10')}, 6) END AS area", "area", coast=True,
)
for _name in ("coast_of_length", "off_coast_area"):  # the coast is along the lowest row of boxes, the others have none
    SQL[_name] = SQL[_name].replace("NULL::VARCHAR AS status", "CASE WHEN y > 20 THEN 'E14' END AS status")
simple("nested_intersections", lambda: node("Intersection", child_nodes=listed(node("Union", child_nodes=listed(HERE(), EAST())), node("Difference", child_node_1=HERE(), child_node_2=SHIFT(1, 0)))), f"round((1 + 2 * {R2}::DOUBLE) * (2 + 2 * {R2}::DOUBLE) - 4 * ({R2}::DOUBLE * {R2}::DOUBLE - {ROUND} * {R2}::DOUBLE * {R2}::DOUBLE / 4), 6) AS area", "area")


@query(f"SELECT c_custkey AS k, round({deg('3.5', 'lat')}, 9) AS d FROM (SELECT c_custkey, 20 + ((c_custkey * 29) % 1000) / 100.0::DOUBLE AS lat FROM customer)")
def km_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = 20 + F.col("c_custkey") * 29 % 1000 / 100.0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(C.km_to_degrees(F.lit(3.5), lat), 9).alias("d"))


# Trees that fail, and how.
_BOX = {"_polygon": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}
_FAR = {"_polygon": {"type": "Polygon", "coordinates": [[[9, 9], [10, 9], [10, 10], [9, 10], [9, 9]]]}}
_NEXT = {"_polygon": {"type": "Polygon", "coordinates": [[[2, 0], [4, 0], [4, 2], [2, 2], [2, 0]]]}}
FAILING: dict[str, tuple[str, str]] = {
    "not json": ("E1", "here"), "no centre": ("E2", json.dumps({"name": "x"})), "unknown type": ("E3", '{"node_type":"Rotate"}'),
    "bad direction": ("E4", json.dumps({"node_type": "DirectionalConstraint", "direction": "northwest", "child_node": _BOX})),
    "child before direction": ("E5", '{"node_type":"DirectionalConstraint","direction":"northwest"}'), "empty child": ("E5", '{"node_type":"Buffer","child_node":{}}'),
    "disjoint": ("E6", json.dumps({"node_type": "Intersection", "child_nodes": [_BOX, _FAR]})), "lone intersection": ("E7", json.dumps({"node_type": "Intersection", "child_nodes": [_BOX]})),
    "lone union": ("E8", json.dumps({"node_type": "Union", "child_nodes": [_BOX]})), "no coastline": ("E9", '{"node_type":"CoastOf"}'),
    "nothing between": ("E10", json.dumps({"node_type": "Between", "child_node_1": _BOX, "child_node_2": _NEXT})), "nothing left": ("E11", json.dumps({"node_type": "Difference", "child_node_1": _BOX, "child_node_2": _BOX})),
    "no border": ("E12", json.dumps({"node_type": "BorderBetween", "child_node_1": _BOX, "child_node_2": _FAR})), "null argument": ("E_NULL_ARG", json.dumps({"node_type": "Buffer", "distance_km": None, "child_node": _BOX})),
    "no boundary": ("E13", json.dumps({"node_type": "BorderOf", "child_node": {"node_type": "BorderOf", "child_node": _BOX}})),
    "from below": ("E3", json.dumps({"node_type": "Buffer", "child_node": {"node_type": "Union", "child_nodes": [_BOX, {"node_type": "Rotate"}]}})),
}


# Trees that fail where there is a coastline: the straight one, which ends at 120 degrees east.
_AT_COAST = {"_polygon": {"type": "Polygon", "coordinates": [[[100, 19.99], [102, 19.99], [102, 20.01], [100, 20.01], [100, 19.99]]]}}
FAILING_AT_COAST: dict[str, tuple[str, str]] = {
    "coast is far": ("E14", json.dumps({"node_type": "CoastOf", "child_node": _BOX})), "nothing off a far coast": ("E14", json.dumps({"node_type": "OffTheCoastOf", "child_node": _BOX})),
    "nothing is off": ("E15", json.dumps({"node_type": "OffTheCoastOf", "distance_km": 0, "child_node": _AT_COAST})), "coast of nothing": ("E5", '{"node_type":"CoastOf"}'),
    "unresolved": ("E2", json.dumps({"node_type": "CoastOf", "child_node": {"name": "nowhere"}})),
}


def _for_regions(spark: SparkSession, sf_dir: str, trees: dict[str, tuple[str, str]]) -> DataFrame:
    """(query_id, tree) of each tree for each region."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v[1]).alias("tree")) for k, v in trees.items()])
    return table(spark, sf_dir, "region").select("r_name", F.inline(each)).select(F.concat_ws("/", "r_name", "k").alias("query_id"), "tree")


@query("SELECT r_name || '/' || k AS query_id, status FROM region, (VALUES " + ", ".join(f"('{k}', '{v[0]}')" for k, v in (FAILING | FAILING_AT_COAST).items()) + ") t(k, status)")
def error_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way to fail, for each region; what finds no source (E16 of the sources) has no place (E2)."""
    at_coast = Engine(coastline=straight_coast(spark), osm_elements=_osm(spark, sf_dir))
    inland = evaluate_trees(_for_regions(spark, sf_dir, FAILING))
    return inland.unionByName(at_coast.evaluate_nodes(flatten(_for_regions(spark, sf_dir, FAILING_AT_COAST)))).select("query_id", "status")


@query(f"WITH {BOXES} SELECT k, NULL::VARCHAR AS status, 4.0::DOUBLE AS area FROM b")
def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of a box with itself, 3 levels deep, and every fifth 300."""
    rows = nations(spark, sf_dir)
    levels = F.when(F.col("k") % 5 == 3, 300).otherwise(3)
    grown = F.aggregate(F.sequence(F.lit(1), levels), F.col("here"), lambda t, i: node("Union", child_nodes=listed(t, F.col("here"))))
    return measured(spark, rows, grown, "area")


@query("SELECT n_nationkey AS query_id, count(*)::BIGINT AS nodes, 2 AS deepest, 2::BIGINT AS places FROM nation, range(4) GROUP BY ALL")
def flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nations(spark, sf_dir).select(F.col("k").alias("query_id"), node("Buffer", child_node=node("Union", child_nodes=listed(HERE(), EAST()))).alias("tree"))
    return flatten(rows).groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.count_if(F.col("node_type") == "NamedPlace").alias("places"))


# Chinese names that the look-up has to give, and None where it has none.
_ASKED = {"Beijing": "北京", "beijing": "北京", "BEIJING": "北京", "Tibet": "西藏", "tibet": None, "Asia": "亚洲", "ASIA": "亚洲", "Inner Mongolia": "内蒙古", "广东": None, "": None, "Hong Kong": "香港", "HONG KONG": "香港", "neimenggu": "内蒙古", "Shaanxi": "陕西", "shanxi": "山西", "Tianjin": None, "China": "中国"}


@query(f"SELECT n_nationkey AS k, r_name AS region, CASE r_name WHEN 'ASIA' THEN '亚洲' END AS region_chinese, a AS name, c AS chinese FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES " + ", ".join(f"({i}, '{k}', {repr(v) if v else 'NULL'})" for i, (k, v) in enumerate(_ASKED.items())) + f") t(i, a, c) ON n_nationkey % {len(_ASKED)} = i")
def translate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("n_nationkey") % len(_ASKED) + 1).cast("int"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("region"), asked.alias("name"))
    return rows.select("k", "region", C.chinese_name(F.col("region")).alias("region_chinese"), "name", C.chinese_name(F.col("name")).alias("chinese"))


_LEVELS = ["兴趣点", "门牌号", "村庄", "乡镇", "区县", "市", "省", "国家"]
_PLACES = "p AS (SELECT c_custkey AS k, c_name AS name, r_name AS region, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_LEVEL_SQL = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LEVELS)) + " END"
# Scores and radii of the eight levels.
_SCORE_SQL = "CASE level WHEN '门牌号' THEN 1 WHEN '兴趣点' THEN 2 WHEN '村庄' THEN 3 WHEN '乡镇' THEN 4 WHEN '区县' THEN 5 WHEN '市' THEN 6 WHEN '省' THEN 7 WHEN '国家' THEN 8 END"
_RADIUS_SQL = "CASE level WHEN '兴趣点' THEN 0.15 WHEN '门牌号' THEN 0.1 WHEN '村庄' THEN 0.5 WHEN '乡镇' THEN 2.0 WHEN '区县' THEN 5.0 WHEN '市' THEN 20.0 WHEN '省' THEN 50.0 WHEN '国家' THEN 100.0 END"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places in a country (their nation) and region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("r_name").alias("in_region"), F.col("n_name").alias("in_country")).withColumn("place", R._key())


def _gazetteer(customers: DataFrame) -> DataFrame:
    """Two entries a customer: in its region with one level, and without city with another; each fourth of the latter lies elsewhere."""
    k = F.col("k")
    level = lambda c: F.element_at(F.array(*map(F.lit, _LEVELS)), (c % 8 + 1).cast("int"))
    at = lambda d: F.concat((100 + k * 61 % 1000 / 100.0 + d).cast("string"), F.lit(","), (20 + k * 29 % 1000 / 100.0).cast("string"))
    address = F.concat("in_region", "in_country", "name")
    one = customers.select(F.col("name").alias("address_key"), F.col("in_region").alias("city"), F.lit(0).alias("position"), at(0.0).alias("location"), level(k).alias("level"), address.alias("formatted_address"))
    two = customers.select(F.col("name").alias("address_key"), F.lit(None).cast("string").alias("city"), F.lit(0).alias("position"), at(1.0).alias("location"), level(k * 3 + 1).alias("level"), F.when(k % 4 == 0, "elsewhere").otherwise(address).alias("formatted_address"))
    return one.unionByName(two)


@query(f"WITH {_PLACES} SELECT k, CASE WHEN region = 'ASIA' THEN 15 ELSE 8 END::BIGINT AS candidates, CASE WHEN region = 'ASIA' THEN '亚洲|ASIA' ELSE region || '|' || country END AS first_cities FROM p")
def geocode_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    found = R.geocode_candidates(c).join(c.select("place", "k"), "place")
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("candidates"), F.concat_ws("|", F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "city"))), 1, 2), lambda x: x["city"])).alias("first_cities"))


@query(
    f"""WITH {_PLACES},
g AS (SELECT k, 2 AS ordinal, {_LEVEL_SQL} AS level, region || country || name AS address, 0.0::DOUBLE AS d, region, country FROM p
      UNION ALL SELECT k, 4, {_LEVEL_SQL.replace('k % 8', '(k * 3 + 1) % 8')}, CASE WHEN k % 4 = 0 THEN 'elsewhere' ELSE region || country || name END, 1.0::DOUBLE, region, country FROM p),
v AS (SELECT *, {_SCORE_SQL} AS score FROM g WHERE contains(lower(address), lower(region)) OR contains(lower(address), lower(country)))
SELECT k, level, address AS found_address, {_RADIUS_SQL}::DOUBLE AS radius_km, round(100 + ((k * 61) % 1000) / 100.0::DOUBLE + d, 6) AS lon
FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY score, ordinal) = 1"""
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    best = R.best_candidate(c.drop("k"), _gazetteer(c)).join(c.select("place", "k"), "place")
    return best.select("k", "level", "found_address", "radius_km", F.round("lon", 6).alias("lon"))


@query(SQL["best_candidate"].replace("SELECT k, level, address AS found_address,", "SELECT k, level, address,").replace(" AS lon", " AS center_lon, round(20 + ((k * 29) % 1000) / 100.0::DOUBLE, 6) AS center_lat"))
def precise_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    found = R.precise_bounds(c.drop("k"), _gazetteer(c)).join(c.select("place", "k"), "place")
    return found.select("k", "level", "address", "radius_km", F.round("center_lon", 6).alias("center_lon"), F.round("center_lat", 6).alias("center_lat"))


def _districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as districts of two kinds, under their own name, and regions with codes."""
    rows = nations(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), "k")
    ring = lambda x, y: F.concat_ws(";", *[F.concat((F.col("x") + a).cast("string"), F.lit(","), (F.col("y") + b).cast("string")) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))])
    code = F.concat((F.col("n_regionkey") + 11).cast("string"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("00"))
    one = rows.select(F.col("n_name").alias("keyword"), F.lit(0).alias("position"), F.concat("n_name", F.lit("市")).alias("name"), code.alias("adcode"), F.lit("city").alias("level"), ring(0, 0).alias("polyline"))
    two = rows.select(F.col("n_name").alias("keyword"), F.lit(1).alias("position"), F.col("n_name").alias("name"), F.lit("990000").alias("adcode"), F.lit("district").alias("level"), F.concat(ring(0, 0), F.lit("|bad|"), ring(1, 1)).alias("polyline"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("keyword"), F.lit(0).alias("position"), F.col("r_name").alias("name"), F.concat((F.col("r_regionkey") + 11).cast("string"), F.lit("0000")).alias("adcode"), F.lit("province").alias("level"), F.lit("").alias("polyline"))
    return one.unionByName(two).unionByName(regions)


def _nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places; odd ones without a region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("in_region"), F.lit(None).cast("string").alias("in_country")).withColumn("place", R._key())


@query("SELECT r_name AS region, (r_regionkey + 11)::VARCHAR || '0000' AS adcode FROM region")
def region_adcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_adcode(table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), _districts(spark, sf_dir))


@query("SELECT n_name AS place, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '市' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'district' END AS level, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS area FROM nation")
def district_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register(spark)
    best = R.district_best(_nation_places(spark, sf_dir), _districts(spark, sf_dir))
    return best.select(F.get_json_object("place", "$.name").alias("place"), "name", "level", F.round(K.measures(K.from_geojson("boundary"))["area"], 6).alias("area"))


@query(
    """SELECT n_nationkey AS k, n_nationkey % 6 = 5 AS malformed, CASE n_nationkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN NULL WHEN 4 THEN 1 ELSE 1 END AS rings,
CASE n_nationkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN 3 ELSE 3 END AS points,
CASE WHEN n_nationkey % 6 <> 3 THEN n_nationkey / 4.0::DOUBLE END AS first_x FROM nation"""
)
def polyline_to_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of six kinds: one ring, two, a point without a comma and an empty ring, nothing, spaces and exponents, a point that is no number."""
    k = F.col("n_nationkey")
    x = (k / 4.0).cast("string")
    ring = F.concat(x, F.lit(",2;3,4;5,6"))
    kinds = [ring, F.concat(ring, F.lit("|7,8;9,10")), F.concat(x, F.lit(",2;bad;3,4|")), F.lit(""), F.concat(x, F.lit(", 2;3e0,4;5,6")), F.concat(x, F.lit(",2;x,y;5,6"))]
    line = F.element_at(F.array(*kinds), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), C.polyline_malformed(line).alias("malformed"), C.polyline_rings(line).alias("r"))
    some = F.col("r").isNotNull()
    return rows.select("k", "malformed", F.when(some, F.size("r")).alias("rings"), F.when(some, F.aggregate("r", F.lit(0), lambda n, r: n + F.size(r))).alias("points"), F.get("r", 0)[0]["x"].alias("first_x"))


@query(
    """SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'district' WHEN 1 THEN 'point after error' ELSE 'osm' END AS source,
CASE WHEN n_nationkey % 3 <> 1 THEN 1.0::DOUBLE END AS area, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey + 0.5::DOUBLE ELSE 0.5::DOUBLE END AS lon FROM nation"""
)
def malformed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of which each third has a boundary with a point that is no number, and each third a map feature alone."""
    K.register(spark)
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "nation")
    places = rows.select(F.col("n_name").alias("name"), none.alias("in_region"), none.alias("in_country")).withColumn("place", R._key())
    line = F.when(k % 3 == 0, "0,0;1,0;1,1;0,1").when(k % 3 == 1, "0,0;1,0;1,one;0,1").otherwise("")
    districts = rows.select(F.col("n_name").alias("keyword"), F.lit(0).alias("position"), F.col("n_name").alias("name"), F.lit("110000").alias("adcode"), F.lit("city").alias("level"), line.alias("polyline"))
    osm = rows.select(F.lit("way").alias("osm_type"), F.col("n_name").alias("name"), F.create_map(F.lit("place"), F.lit("city")).alias("tags"), C.box_json(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("geometry"))
    gazetteer = rows.select(F.col("n_name").alias("address_key"), none.alias("city"), F.lit(0).alias("position"), F.concat((k + 0.5).cast("string"), F.lit(",1")).alias("location"), F.lit("市").alias("level"), F.col("n_name").alias("formatted_address"))
    found = R.resolve(places, gazetteer, districts, osm)
    return found.select(F.get_json_object("place", "$.name").alias("name"), "source", F.round(K.measures(K.from_geojson("boundary"))["area"], 6).alias("area"), F.round("lon", 6).alias("lon"))


_STEPS = "CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '省' WHEN 2 THEN '市' WHEN 3 THEN '区' ELSE '县' END"


@query(f"SELECT n_name AS region, printf('%02d', n_nationkey + 11) || CASE n_nationkey % 3 WHEN 0 THEN '0000' WHEN 1 THEN '0100' ELSE '0101' END AS adcode FROM nation UNION ALL SELECT '北京', '110000' UNION ALL SELECT 'Beijing', '110000'")
def region_adcode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that are found by a suffix, and by the Chinese name with one."""
    rows = _stepped(spark, sf_dir)
    one = spark.range(1).select(F.lit("北京市").alias("keyword"), F.lit(0).alias("position"), F.lit("110000").alias("adcode"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region")).unionByName(spark.range(1).select(F.explode(F.array(F.lit("北京"), F.lit("Beijing"))).alias("region")))
    return R.region_adcode(asked, rows.select("keyword", "position", "adcode").unionByName(one))


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts named by nations with one of five suffixes, with codes of a province, a city and a district."""
    k = F.col("n_nationkey")
    suffix = F.element_at(F.array(*map(F.lit, R.REGION)), (k % 5 + 1).cast("int"))
    code = F.concat((k + 11).cast("string"), F.element_at(F.array(F.lit("0000"), F.lit("0100"), F.lit("0101")), (k % 3 + 1).cast("int")))
    name = F.concat("n_name", suffix)
    return table(spark, sf_dir, "nation").select(k, name.alias("keyword"), F.lit(0).alias("position"), name.alias("name"), code.alias("adcode"))


@query("SELECT s_suppkey AS k, CASE WHEN s_nationkey % 3 = 0 THEN 'own province' WHEN s_nationkey % 3 = 1 THEN 'own city' ELSE 'first of all' END AS name FROM supplier")
def district_soft_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as districts in four places: the region's code keeps two digits, four, or all, which filters nothing; one whose code nothing matches filters nothing either."""
    K.register(spark)
    s, regions = table(spark, sf_dir, "supplier"), _stepped(spark, sf_dir)
    suffixed = regions.select("n_nationkey", F.col("keyword").alias("region"), F.col("adcode").alias("code"))
    rows = s.join(suffixed, s.s_nationkey == suffixed.n_nationkey)
    entries = [("first of all", F.lit("990101")), ("own province", F.concat(F.substring("code", 1, 2), F.lit("9900"))), ("own city", F.concat(F.substring("code", 1, 4), F.lit("99")))]
    kinds = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), c.alias("adcode")) for i, (n, c) in enumerate(entries)])
    # Of a city's code the entry of the province alone doesn't match; a whole code is no prefix.
    each = rows.select(F.col("s_name").alias("keyword"), F.inline(kinds)).withColumns({"level": F.lit("city"), "polyline": F.lit("0,0;1,0;1,1")})
    own = regions.select("keyword", "position", "name", "adcode", F.lit("province").alias("level"), F.lit("").alias("polyline"))
    places = rows.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("region").alias("in_region"), F.lit(None).cast("string").alias("in_country")).withColumn("place", R._key())
    best = R.district_best(places.drop("k"), each.unionByName(own.select(*each.columns)))
    return best.join(places.select("place", "k"), "place").select("k", "name")


def _osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as map features of four kinds of tags and three of geometry."""
    k = F.col("s_suppkey")
    x, y = 100 + k * 37 % 1000 / 100.0, 20 + k * 53 % 1000 / 100.0
    line = F.concat(F.lit('{"type":"LineString","coordinates":'), F.regexp_extract(C.box_json(x, y, x + 1, y + 1), r"\[(\[\[.*\]\])\]", 1), F.lit("}"))
    shape = F.when(k % 3 == 0, C.box_json(x, y, x + 1, y + 1)).when(k % 3 == 1, line).otherwise('{"type":"Point","coordinates":[1,2]}')
    key = F.element_at(F.array(*map(F.lit, ("place", "boundary", "amenity", "shop"))), (k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("node", "way", "relation"))), (k % 5 % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(kind.alias("osm_type"), F.col("s_name").alias("name"), F.create_map(key, F.lit("administrative")).alias("tags"), shape.alias("geometry"), k.alias("k"))


_OSM_SQL = "s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey % 5 % 3 = 2) OR (s_suppkey % 4 = 2 AND s_suppkey % 5 % 3 IN (1, 2))"


@query(f"SELECT s_suppkey AS k FROM supplier WHERE {_OSM_SQL}")
def osm_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _osm(spark, sf_dir).filter(R.osm_wanted()).select("k")


@query(f"SELECT s_name AS name, 1.0::DOUBLE AS area FROM supplier WHERE ({_OSM_SQL}) AND s_suppkey % 3 < 2")
def osm_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register(spark)
    return R.osm_boundary(_osm(spark, sf_dir)).select("name", F.round(K.measures(K.from_geojson("boundary"))["area"], 6).alias("area"))


@query(
    f"""WITH {_PLACES} SELECT 'district' AS source, (SELECT count(*) FROM nation) AS places UNION ALL
SELECT 'osm', count(*) FROM supplier WHERE ({_OSM_SQL}) AND s_suppkey % 3 < 2 UNION ALL SELECT 'point', count(*) FROM p"""
)
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir)
    none = F.lit(None).cast("string")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), none.alias("in_region"), none.alias("in_country")).withColumn("place", R._key())
    places = _nation_places(spark, sf_dir).unionByName(customers.drop("k")).unionByName(suppliers)
    return R.resolve(places, _gazetteer(customers), _districts(spark, sf_dir), _osm(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("places"))


@query(
    f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 + 1.5::DOUBLE ELSE CASE {_LEVEL_SQL.replace('k % 8', 'c_custkey % 8')} WHEN '兴趣点' THEN 0.15 WHEN '门牌号' THEN 0.15 WHEN '村庄' THEN 0.5 WHEN '乡镇' THEN 2.0 ELSE 0.5 END::DOUBLE END AS radius_km FROM customer"""
)
def effective_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii of customers of eight levels: given, null and 0."""
    k = F.col("c_custkey")
    given = F.when(k % 3 == 0, k % 7 + 1.5).when(k % 3 == 1, 0.0)
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), C.effective_radius_km(level, given).alias("radius_km"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS bare FROM conversations""")
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit(" ```json\n"), "text", F.lit("\n```\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.strip_fence(fenced).alias("bare"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'marker:red' WHEN 1 THEN 'line:#ff4400;weight:4;opacity:0.8' WHEN 2 THEN 'line:#ff4400;weight:4;opacity:0.8' ELSE 'fill:#ff7800;opacity:0.4;line:#ff4400;weight:2' END AS style FROM nation")
def map_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of geometries made from each nation's box: a corner, an edge, two edges, the box, and two boxes."""
    K.register(spark)
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    edge = F.concat(F.lit("[["), x, F.lit(","), y, F.lit("],["), x, F.lit(",0]]"))
    js = lambda kind, at: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), at, F.lit("}"))
    box = C.box_json(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 2)
    rings = F.concat(F.lit("["), F.get_json_object(box, "$.coordinates"), F.lit("]"))
    shapes = [js("Point", F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))), js("LineString", edge), js("MultiLineString", F.concat(F.lit("["), edge, F.lit("]"))), box, js("MultiPolygon", rings)]
    shape = F.element_at(F.array(*shapes), (F.col("k") % 5 + 1).cast("int"))
    return nations(spark, sf_dir).select("k", C.map_style(K.call("Kind", K.from_geojson(shape))).alias("style"))


@query(f"WITH {BOXES} SELECT k, 'Feature' AS type, '查询区域' AS name, 'Polygon' AS kind, 5::BIGINT AS corners FROM b")
def feature_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeweave.engine import features

    done = evaluate_trees(nations(spark, sf_dir).select(F.col("k").alias("query_id"), F.col("here").alias("tree")))
    js = lambda p: F.get_json_object("feature", p)
    corners = F.size(F.from_json(js("$.geometry.coordinates[0]"), "array<array<double>>")).cast("long")
    return features(done).select(F.col("query_id").alias("k"), js("$.type").alias("type"), js("$.properties.name").alias("name"), js("$.geometry.type").alias("kind"), corners.alias("corners"))


@query(f"WITH {BOXES}, s AS (SELECT s_suppkey, 100 + ((s_suppkey * 37) % 1000) / 100.0::DOUBLE AS lon, 20 + ((s_suppkey * 53) % 1000) / 100.0::DOUBLE AS lat FROM supplier) SELECT s_suppkey, k FROM s JOIN b ON lon BETWEEN x AND x + 2 AND lat BETWEEN y AND y + 2")
def spatial_join_supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register(spark)
    k = F.col("s_suppkey")
    at = F.concat(F.lit('{"type":"Point","coordinates":['), (100 + k * 37 % 1000 / 100.0).cast("string"), F.lit(","), (20 + k * 53 % 1000 / 100.0).cast("string"), F.lit("]}"))
    points = table(spark, sf_dir, "supplier").select("s_suppkey", K.from_geojson(at).alias("geom"))
    boxes = nations(spark, sf_dir).select("k", K.from_geojson(C.box_json(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 2)).alias("geom"))
    return spatial_pairs(points, boxes).select("s_suppkey", "k")


#: Phrases about A and B, and the tree's type, side, distance, the places of its children, and those of grandchildren.
_PHRASES = [
    ("A除了B", "Difference", None, None, "A,B"), ("A不包括B", "Difference", None, None, "A,B"), ("A除B外", "Difference", None, None, "A,B"), ("A和B的边界", "BorderBetween", None, None, "A,B"),
    ("A和B的交界处", "BorderBetween", None, None, "A,B"), ("A的海岸线", "CoastOf", None, None, "A"), ("A海岸外7.5公里", "OffTheCoastOf", None, 7.5, "A"), ("A的边界", "BorderOf", None, None, "A"),
    ("A和B之间", "Between", None, None, "A,B"), ("A附近4公里", "Buffer", None, 4.0, "A"), ("A附近", "Buffer", None, 3.0, "A"), ("A市周边", "Buffer", None, 50.0, "A市"), ("A省周边", "Buffer", None, 200.0, "A省"),
    ("A东方向", "DirectionalConstraint", "east", None, "A"), ("A北边", "DirectionalConstraint", "north", None, "A"), ("A西南方向", "Intersection", "south,west", None, "A,A"), ("A和B", "Union", None, None, "A,B"), ("A", "NamedPlace", None, None, ""),
]
_PHRASE_SQL = ", ".join("(" + ", ".join([str(i), *["NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in row]]) + ")" for i, row in enumerate(_PHRASES))


_FILLED = "replace(replace(replace({}, 'A', '@'), 'B', n_name), '@', lower(r_name))"


@query(f"SELECT n_name || '/' || {_FILLED.format('t')} AS text, node_type, sides, distance_km, {_FILLED.format('places')} AS places FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES {_PHRASE_SQL}) p(i, t, node_type, sides, distance_km, places) ON true")
def phrase_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each kind about each nation and its region: types, arguments and the order of children."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    each = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", F.lower("r_name").alias("r"), F.explode(F.array(*[F.lit(p[0]) for p in _PHRASES])).alias("t"))
    text = F.replace(F.replace(F.replace("t", F.lit("A"), F.lit("@")), F.lit("B"), F.col("n_name")), F.lit("@"), F.col("r"))
    nodes = flatten(each.select(F.concat_ws("/", "n_name", text).alias("query_id"), phrase_tree(text).alias("tree")))
    root, inner = nodes.filter("depth = 0"), nodes.filter("depth > 0")
    listed_ = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", c))), lambda x: x[c]), ",")
    sides = nodes.filter("direction is not null").groupBy("query_id").agg(listed_("direction").alias("sides"))
    places = inner.filter("node_type = 'NamedPlace'").groupBy("query_id").agg(listed_("name").alias("places"))
    return root.join(sides, "query_id", "left").join(places, "query_id", "left").select(F.col("query_id").alias("text"), "node_type", "sides", "distance_km", F.coalesce("places", F.lit("")).alias("places"))


@query("SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 5 > 2 THEN 'E1' END AS status, CASE WHEN n_nationkey % 5 <= 2 THEN 'Polygon' END AS kind FROM nation")
def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about nations in three kinds of fences, in words, and none."""
    K.register(spark)
    rows = nations(spark, sf_dir)
    tree = node("Buffer", distance_km=3, child_node=F.col("here"))
    k = F.col("k")
    answer = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), tree, F.lit("\n```"))).when(k % 5 == 1, F.concat(F.lit("```\n"), tree, F.lit("```"))).when(k % 5 == 2, tree).when(k % 5 == 3, "sorry")
    answers = rows.filter(k % 5 < 4).select(F.concat(F.lit("near "), k.cast("string")).alias("text"), answer.alias("response"))
    asked = rows.select(k.alias("query_id"), F.concat(F.lit("near "), k.cast("string")).alias("text"))
    return Engine(responses=answers).evaluate(asked).select("query_id", "status", "kind")


@query(f"SELECT n_name || '/' || i AS query_id, root, nodes, places FROM nation, (VALUES " + ", ".join(f"({i}, '{e.root}', {e.nodes}, '{e.places}')" for i, e in enumerate(EXAMPLES)) + ") e(i, root, nodes, places)")
def worked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve recorded answers, asked for each nation: root type, number of nodes, and places."""
    answers = F.array(*[F.struct(F.lit(e.text).alias("text"), F.lit(f"```json\n{json.dumps(e.tree, ensure_ascii=False)}\n```").alias("response"), F.lit(i).alias("i")) for i, e in enumerate(EXAMPLES)])
    responses = spark.range(1).select(F.inline(answers))
    asked = table(spark, sf_dir, "nation").select("n_name", F.inline(answers)).select(F.concat_ws("/", "n_name", "i").alias("query_id"), "text")
    nodes = Engine(responses=responses).parse(asked)
    names = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("node_id", "name")), lambda x: x["name"].isNotNull())), lambda x: x["name"]), ",")
    return nodes.groupBy("query_id").agg(F.max(F.when(F.col("depth") == 0, F.col("node_type"))).alias("root"), F.count(F.lit(1)).alias("nodes"), names.alias("places"))


@query(
    f"""WITH p AS (SELECT n_nationkey AS k, 100.0::DOUBLE + 2 * (n_nationkey % 5) AS x, 20.0::DOUBLE + 2 * (n_nationkey // 5) AS y FROM nation),
q AS (SELECT k, k % 2 = 0 AS one, {deg('2.0', 'CASE WHEN k % 2 = 0 THEN y + 0.5 ELSE y + 1 END')} AS d FROM p),
s AS (SELECT s_suppkey AS k, {deg('2.0', '20.5 + ((s_suppkey * 53) % 1000) / 100.0::DOUBLE')} AS d FROM supplier WHERE ({{OSM}}) AND s_suppkey % 3 < 2)
SELECT 'nation ' || k AS query_id, NULL::VARCHAR AS status, round(CASE WHEN one THEN 1 + 4 * d + {ROUND} * d * d ELSE 2 + 8 * d + 2 * {ROUND} * d * d - (2 * d * d + {ROUND} * d * d / 2) END, 6) AS area FROM q
UNION ALL SELECT 'supplier ' || k, NULL, round(1 + 4 * d + {ROUND} * d * d, 6) FROM s
UNION ALL SELECT 'supplier ' || s_suppkey, 'E2', NULL FROM supplier WHERE NOT (({{OSM}}) AND s_suppkey % 3 < 2)""".replace("{OSM}", _OSM_SQL)
)
def text_to_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about nations and suppliers, through phrases, districts and map features, to areas; what no source has is E2."""
    K.register(spark)
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    text = lambda name: F.concat(name, F.lit("附近2公里")).alias("text")
    asked = n.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("query_id"), text("n_name")).unionByName(s.select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("query_id"), text("s_name")))
    # Even nations have one district that isn't their own name, odd ones two of which the district of their name wins.
    d = _districts(spark, sf_dir).join(n.select(F.col("n_name").alias("keyword"), "n_nationkey"), "keyword", "left").filter("n_nationkey is null or n_nationkey % 2 = 1 or position = 0").drop("n_nationkey")
    done = Engine(districts=d, osm_elements=_osm(spark, sf_dir)).evaluate(asked)
    return done.select("query_id", "status", F.round(K.measures("geom")["area"], 6).alias("area"))


@query("SELECT s_suppkey, true AS closed, true AS simple, true AS corners, true AS distances FROM supplier")
def pseudo_boundary_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both drawn boundaries of each supplier are closed, enclose their centre's surroundings once, and have the corners and distances that they may have."""
    K.register(spark)
    k, km = F.col("s_suppkey"), F.lit(0.5)
    lon, lat = 100 + k * 37 % 1000 / 100.0, 20 + k * 53 % 1000 / 100.0
    rows = table(spark, sf_dir, "supplier").select(k, lon.alias("lon"), lat.alias("lat"), place_boundary(lon, lat, km).alias("a"), lookup_boundary(lon, lat, km).alias("b"))
    ring = lambda c: F.from_json(F.get_json_object(c, "$.coordinates[0]"), "array<array<double>>")
    rows = rows.withColumns({"ra": ring("a"), "rb": ring("b"), "d": C.km_to_degrees(km, F.col("lat"))})
    far = lambda r, least, most: F.forall(r, lambda p: F.hypot(p[0] - F.col("lon"), p[1] - F.col("lat")).between(F.col("d") * (least - 1e-6), F.col("d") * (most + 1e-6)))
    closed = lambda r: F.element_at(r, 1) == F.element_at(r, -1)
    simple_ = lambda c: K.measures(K.call("Buffer", K.from_geojson(c), F.lit(0.0)))["area"] / K.measures(K.from_geojson(c))["area"]
    return rows.select(
        "s_suppkey", (closed(F.col("ra")) & closed(F.col("rb"))).alias("closed"), (F.abs(simple_("a") - 1) + F.abs(simple_("b") - 1) < 1e-9).alias("simple"),
        (F.size("ra").between(8, 13) & (F.size("rb") == 11)).alias("corners"), (far(F.col("ra"), 0.7, 1.3) & far(F.col("rb"), 0.75, 1.25)).alias("distances"),
    )


@query()
def pseudo_boundary_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register(spark)
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, place_boundary(100 + k * 37 % 1000 / 100.0, 20 + k * 53 % 1000 / 100.0, F.lit(0.5)).alias("boundary"))


@query()
def pseudo_boundary_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register(spark)
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, lookup_boundary(100 + k * 37 % 1000 / 100.0, 20 + k * 53 % 1000 / 100.0, F.lit(0.5)).alias("boundary"))


_BESIDE = f"""WITH e AS (SELECT event_id, 100 + (user_id % 1000) / 100.0::DOUBLE AS lon, 20 + ((user_id * 7) % 1000) / 100.0::DOUBLE AS lat FROM events)
SELECT event_id, round(lon, 6) AS minx, round(lat + 1, 6) AS miny, round(lon + 1, 6) AS maxx, round(lat + 1 + {deg('3.0', 'lat + 0.5')}, 6) AS maxy FROM e"""


@query(_BESIDE)
def directional_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside(table(spark, sf_dir, "events"))


@query(_BESIDE)
def streaming_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir)


@query(
    f"""WITH {BOXES}, c AS (SELECT 100 + ((c_custkey * 61) % 1000) / 100.0::DOUBLE AS lon, 20 + ((c_custkey * 29) % 1000) / 100.0::DOUBLE AS lat FROM customer)
SELECT k, count(lon) AS customers FROM b LEFT JOIN c ON sqrt(pow(lon - (x + 2), 2) + pow(greatest(y - lat, lat - (y + 2), 0), 2)) <= {deg('3.5', 'y + 1')} WHERE k % 5 < 4 GROUP BY k"""
)
def border_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within the strip along each border between a nation and its eastern neighbour."""
    K.register(spark)
    rows = nations(spark, sf_dir).filter(F.col("k") % 5 < 4)
    strips = evaluate_trees(rows.select(F.col("k").alias("query_id"), node("BorderBetween", child_node_1=HERE(), child_node_2=EAST()).alias("tree"))).select(F.col("query_id").alias("k"), "geom")
    c = F.col("c_custkey")
    at = F.concat(F.lit('{"type":"Point","coordinates":['), (100 + c * 61 % 1000 / 100.0).cast("string"), F.lit(","), (20 + c * 29 % 1000 / 100.0).cast("string"), F.lit("]}"))
    points = table(spark, sf_dir, "customer").select("c_custkey", K.from_geojson(at).alias("geom"))
    inside = spatial_pairs(strips, points).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return strips.join(inside, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("customers"))


@query(f"WITH {BOXES} SELECT k, round(4 + 8 * {D('5')} + {ROUND} * {D('5')} * {D('5')}, 6) AS area FROM b")
def failfast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of all nations where a failure would fail the job."""
    K.register(spark)
    trees = nations(spark, sf_dir).select(F.col("k").alias("query_id"), node("Buffer", distance_km=5, child_node=F.col("here")).alias("tree"))
    return evaluate_trees(trees, mode="failfast").select(F.col("query_id").alias("k"), F.round(K.measures("geom")["area"], 6).alias("area"))


@query(
    f"""WITH {_PLACES}, c AS (SELECT k, CASE WHEN region = 'ASIA' THEN 15 ELSE 8 END AS candidates FROM p)
SELECT CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS call, sum(candidates)::BIGINT AS lookups, 2 * count(*)::BIGINT AS found FROM c GROUP BY ALL"""
)
def memo_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups that a gazetteer is asked for when even customers are resolved, then all, then all again: each address once."""
    memo, c = LookupMemo(spark), _customers(spark, sf_dir)
    gazetteer = _gazetteer(c)
    for asked in (c.filter("k % 2 = 0"), c, c):
        R.best_candidate(asked.drop("k"), gazetteer, memo)
    return memo.known().groupBy("call").agg(F.count(F.lit(1)).alias("lookups"), F.count("found").alias("found"))


@query(f"WITH {BOXES} SELECT k, 4::BIGINT AS nodes, 2 AS deepest, round(2 * (4 + 8 * {D('3')} + {ROUND} * {D('3')} * {D('3')}), 6) AS area, 8.0::DOUBLE AS length FROM b")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of two boxes a nation, taken apart and measured in SQL alone."""
    register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("placeweave_nation")
    return spark.sql(
        """WITH b AS (SELECT n_nationkey AS k, double(100 + 2 * (n_nationkey % 5)) AS x, double(20 + 2 * (n_nationkey div 5)) AS y FROM placeweave_nation),
        t AS (SELECT k, format_string('{"node_type":"Buffer","child_node":{"node_type":"Union","child_nodes":[{"_polygon":%s},{"_polygon":%s}]}}',
                                      place_ToGeoJson(place_box(x, y, x + 2, y + 2)), place_ToGeoJson(place_box(x + 5, y, x + 7, y + 2))) AS tree FROM b),
        n AS (SELECT k, depth, place_FromGeoJson(get_json_object(js, '$._polygon')) AS geom FROM t, LATERAL place_tree_nodes(tree))
        SELECT k, count(*) AS nodes, max(depth) AS deepest, round(sum(place_area(place_near(geom, 3D))), 6) AS area, round(max(place_length(place_Boundary(geom))), 6) AS length FROM n GROUP BY k"""
    )


@query(
    f"""WITH s AS (SELECT s_suppkey AS k, {deg('2.0', '20.5 + ((s_suppkey * 53) % 1000) / 100.0::DOUBLE')} AS d FROM supplier WHERE ({_OSM_SQL}) AND s_suppkey % 3 < 2)
SELECT k, NULL::VARCHAR AS status, round(1 + 4 * d + {ROUND} * d * d, 6) AS area FROM s UNION ALL SELECT s_suppkey, 'E2', NULL FROM supplier WHERE NOT (({_OSM_SQL}) AND s_suppkey % 3 < 2)"""
)
def streaming_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about suppliers as a stream, through phrases and map features, to areas; what no source has is E2."""
    schema = table(spark, sf_dir, "supplier").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "supplier.parquet").parquet(sf_dir)
    path = shared_dir(spark)
    texts = rows.select(F.col("s_suppkey").alias("query_id"), F.concat("s_name", F.lit("附近2公里")).alias("text"))
    evaluate_stream(Engine(osm_elements=_osm(spark, sf_dir)), texts, path).awaitTermination()
    return results(spark, path, "bigint").select(F.col("query_id").alias("k"), "status", F.round(K.measures("geom")["area"], 6).alias("area"))


# Lon, lat, radius in km; sides, first corner and area of a boundary drawn for a place, first corner and area of one drawn for a look-up.
_DRAWN = [
    (113.937, 22.533, 0.15, 8, 113.93834663262746, 22.53273133045951, 5.580639708568924e-06, 113.93819416037405, 22.533328218261392, 5.943597443547333e-06),
    (116.3975, 39.9087, 0.5, 7, 116.40194090846154, 39.909730764654356, 1.0007636592490599e-04, 116.40188385976666, 39.90753771165595, 8.35231594464858e-05),
    (2.2, 46.6, 100.0, 10, 3.8187149069256265, 46.808654935849766, 5.165427831327374, 3.4206906604496456, 46.80713629147941, 5.306343439796681),
    (-58.4, -34.6, 20.0, 11, -58.21400372821584, -34.63342101443431, 0.1335736440206574, -58.17275758522072, -34.61961972083953, 0.15649603070028206),
]
_DRAWN_SQL = ", ".join(f"({i}, {sides}, " + ", ".join(f"round({v!r}::DOUBLE, 9)" for v in rest) + ")" for i, (_, _, _, sides, *rest) in enumerate(_DRAWN))


@query(f"SELECT s_suppkey, sides_a, x_a, y_a, area_a, 10 AS sides_b, x_b, y_b, area_b FROM supplier JOIN (VALUES {_DRAWN_SQL}) g(i, sides_a, x_a, y_a, area_a, x_b, y_b, area_b) ON s_suppkey % 4 = i")
def pseudo_boundary_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both drawn boundaries of four known places, dealt to the suppliers: sides, first corner, area."""
    K.register(spark)
    place = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("lon", "lat", "km"), row, strict=False)]) for row in _DRAWN]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", place.alias("p"))
    for x, draw in (("a", place_boundary), ("b", lookup_boundary)):
        rows = rows.withColumn(x, draw(F.col("p.lon"), F.col("p.lat"), F.col("p.km"))).withColumn(f"ring_{x}", F.from_json(F.get_json_object(x, "$.coordinates[0]"), "array<array<double>>"))
    wanted = lambda x: [(F.size(f"ring_{x}") - 1).alias(f"sides_{x}"), F.round(F.col(f"ring_{x}")[0][0], 9).alias(f"x_{x}"), F.round(F.col(f"ring_{x}")[0][1], 9).alias(f"y_{x}"), F.round(K.measures(K.from_geojson(x))["area"], 9).alias(f"area_{x}")]
    return rows.select("s_suppkey", *wanted("a"), *wanted("b"))


# The draws themselves: a Mersenne Twister seeded by an array of one number. The state is filled, mixed with the seed (1..623, then 1 again) and mixed once more (2..623, then 1), each by a scan.
_TWISTER_SQL = f"""WITH RECURSIVE
s AS (SELECT s_suppkey, 100 + ((s_suppkey * 37) % 1000) / 100.0::DOUBLE AS lon, 20 + ((s_suppkey * 53) % 1000) / 100.0::DOUBLE AS lat FROM supplier),
p AS (SELECT *, trunc(lon * 10000 + lat * 10000)::UBIGINT AS seed FROM s),
filled(i, x) AS (SELECT 0, 19650218::UBIGINT UNION ALL SELECT i + 1, (1812433253::UBIGINT * xor(x, x >> 30) + i + 1) & 4294967295 FROM filled WHERE i < 623),
f AS (SELECT list(x ORDER BY i) AS xs FROM filled),
one(seed, i, x, x1) AS (
  SELECT DISTINCT seed, 0, xs[1], 0::UBIGINT FROM p, f
  UNION ALL SELECT seed, i + 1, n, CASE WHEN i = 0 THEN n ELSE x1 END FROM (
    SELECT seed, i, x1, (xor(CASE WHEN i = 623 THEN x1 ELSE xs[i + 2] END, xor(x, x >> 30) * 1664525::UBIGINT) + seed) & 4294967295 AS n FROM one, f WHERE i < 624)),
mixed AS (SELECT seed, list(x ORDER BY i) AS xs FROM one GROUP BY seed),
two(seed, i, x, xs) AS (
  SELECT seed, 1, xs[625], xs FROM mixed
  UNION ALL SELECT seed, i + 1, (xor(xs[CASE WHEN i = 623 THEN 625 ELSE i + 2 END], xor(x, x >> 30) * 1566083941::UBIGINT) + 4294967296 - CASE WHEN i = 623 THEN 1 ELSE i + 1 END) & 4294967295, xs FROM two WHERE i < 624),
state AS (SELECT seed, list(x ORDER BY i) AS y FROM two WHERE i > 1 GROUP BY seed),
held AS (SELECT seed, k, CASE WHEN k = 0 THEN 2147483648::UBIGINT WHEN k = 1 THEN y[623] ELSE y[k - 1] END AS v FROM state, range(624) r(k)),
turned AS (
  SELECT a.seed, a.k, (a.v & 2147483648::UBIGINT) | (b.v & 2147483647::UBIGINT) AS u, c.v AS far
  FROM held a JOIN held b ON b.seed = a.seed AND b.k = a.k + 1 JOIN held c ON c.seed = a.seed AND c.k = a.k + 397 WHERE a.k < 100),
t0 AS (SELECT seed, k, xor(xor(far, u >> 1), (u & 1) * 2567483615::UBIGINT) AS w FROM turned),
t1 AS (SELECT seed, k, xor(w, w >> 11) AS w FROM t0),
t2 AS (SELECT seed, k, xor(w, (w << 7) & 2636928640::UBIGINT) AS w FROM t1),
t3 AS (SELECT seed, k, xor(w, (w << 15) & 4022730752::UBIGINT) AS w FROM t2),
t4 AS (SELECT seed, k, xor(w, w >> 18) AS w FROM t3),
sides AS (SELECT seed, min(k) AS skipped, 7 + (arg_min(w, k) >> 29)::INT AS n FROM t4 WHERE (w >> 29) < 6 GROUP BY seed),
words AS (SELECT seed, list(w ORDER BY k) AS w FROM t4 GROUP BY seed),
c AS (
  SELECT s_suppkey, lon, lat, 'a' AS drawing, i, n, skipped + 1 + 4 * i AS o, w FROM p JOIN words USING (seed) JOIN sides USING (seed), range(12) r(i) WHERE i < n
  UNION ALL SELECT s_suppkey, lon, lat, 'b', i, 10, 4 * i, w FROM p JOIN words USING (seed), range(10) r(i)),
d AS (SELECT *, ((w[o + 1] >> 5) * 67108864::DOUBLE + (w[o + 2] >> 6)) / 9007199254740992 AS first, ((w[o + 3] >> 5) * 67108864::DOUBLE + (w[o + 4] >> 6)) / 9007199254740992 AS second FROM c),
e AS (
  SELECT s_suppkey, drawing, i, lon, lat, 2 * pi() * i / n + CASE drawing WHEN 'a' THEN first * 0.5 - 0.25 ELSE second * 0.6 - 0.3 END AS angle,
  {deg("0.5", "lat")} * CASE drawing WHEN 'a' THEN 0.7 + second * 0.6 ELSE 0.75 + first * 0.5 END AS far FROM d)
SELECT s_suppkey, drawing, i::INT AS corner, round(lon + far * cos(angle), 8) AS x, round(lat + far * sin(angle), 8) AS y FROM e"""


@query(_TWISTER_SQL)
def pseudo_boundary_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corner of both boundaries drawn for each supplier, in the order drawn."""
    K.register(spark)
    k, km = F.col("s_suppkey"), F.lit(0.5)
    lon, lat = 100 + k * 37 % 1000 / 100.0, 20 + k * 53 % 1000 / 100.0
    both = F.create_map(F.lit("a"), place_boundary(lon, lat, km), F.lit("b"), lookup_boundary(lon, lat, km))
    rings = table(spark, sf_dir, "supplier").select(k, F.explode(both).alias("drawing", "boundary"))
    ring = F.from_json(F.get_json_object("boundary", "$.coordinates[0]"), "array<array<double>>")
    corners = rings.select("s_suppkey", "drawing", F.posexplode(F.slice(ring, 1, F.size(ring) - 1)).alias("corner", "at"))
    return corners.select("s_suppkey", "drawing", "corner", F.round(F.col("at")[0], 8).alias("x"), F.round(F.col("at")[1], 8).alias("y"))


@query(
    """SELECT s_nationkey AS nation, count(*) AS features, sum(s_suppkey)::BIGINT AS ids, sum(length(s_name) + 12)::BIGINT AS letters,
count(*) FILTER (s_suppkey % 10 <> 0) AS lines, sum(CASE WHEN s_suppkey % 10 <> 0 THEN 1 + s_suppkey % 7 END)::DOUBLE AS length FROM supplier GROUP BY 1"""
)
def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as features with awkward texts, some without a geometry, written to collections and read back."""
    K.register(spark)
    s = table(spark, sf_dir, "supplier")
    line = F.format_string('{"type":"LineString","coordinates":[[%1$d,0],[%1$d,%2$d]]}', F.col("s_nationkey") + 100, 1 + F.col("s_suppkey") % 7)
    properties = F.to_json(F.struct("s_suppkey", "s_nationkey", F.concat("s_name", F.lit(' }"]{[\\"},北京')).alias("s_name")))
    path = shared_dir(spark)
    write_features_as_collections(s.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.when(F.col("s_suppkey") % 10 != 0, line).otherwise("null"), F.lit("}"))), path)
    rows = read_features(spark, path, "s_suppkey long, s_nationkey long, s_name string").withColumn("m", K.measures(K.from_geojson("geometry")))
    wanted = F.count(F.lit(1)).alias("features"), F.sum("properties.s_suppkey").alias("ids"), F.sum(F.length("properties.s_name")).alias("letters"), F.count("geometry").alias("lines"), F.sum("m.length").alias("length")
    return rows.groupBy(F.col("properties.s_nationkey").alias("nation")).agg(*wanted)


def _answers(rows: DataFrame, keys: list[str], member: str, wanted: list[str]) -> DataFrame:
    """Rows of a table as the answers that gave them, one for each key."""
    objects = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*wanted).alias("o")))), lambda r: r["o"])
    body = F.to_json(F.struct(F.lit("1").alias("status"), objects.alias(member)))
    return rows.groupBy(*keys).agg(body.alias("body"))


@query(SQL["source_fallback"])
def recorded_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of source_fallback, by an engine over a folder of recorded answers of the services."""
    customers, none, folder = _customers(spark, sf_dir), F.lit(None).cast("string"), shared_dir(spark)
    elements = _osm(spark, sf_dir).select("name", F.concat(F.lit('{"type":"'), "osm_type", F.lit('","tags":'), F.to_json("tags"), F.lit(',"geometry":'), "geometry", F.lit("}")).alias("e"))
    answers = {
        "gazetteer": _answers(_gazetteer(customers), ["address_key", "city"], "geocodes", ["location", "level", "formatted_address"]),
        "districts": _answers(_districts(spark, sf_dir), ["keyword"], "districts", ["name", "adcode", "level", "polyline"]),
        "osm_elements": elements.groupBy("name").agg(F.concat(F.lit('{"elements":['), F.array_join(F.collect_list("e"), ","), F.lit("]}")).alias("body")),
    }
    for name, rows in answers.items():
        rows.write.json(f"{folder}/{ANSWERS[name][0]}.json")
    engine = Engine.of_tables(spark, folder)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), none.alias("in_region"), none.alias("in_country")).withColumn("place", R._key())
    places = _nation_places(spark, sf_dir).unionByName(customers.drop("k")).unionByName(suppliers)
    return R.resolve(places, engine.gazetteer, engine.districts, engine.osm_elements).groupBy("source").agg(F.count(F.lit(1)).alias("places"))
