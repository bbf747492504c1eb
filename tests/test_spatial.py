import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeweave.functions import kernel as K
from placeweave.functions.pseudo import lookup_boundary, place_boundary
from placeweave.operators import coast as coast_module
from placeweave.operators import spatial
from placeweave.plans.evaluate import evaluate_trees
from placeweave.plans.flatten import flatten
from placeweave.queries import FAILING


def box(a, b, c, d):
    return {"_polygon": {"type": "Polygon", "coordinates": [[[a, b], [c, b], [c, d], [a, d], [a, b]]]}}


A, B, C, D = box(100, 20, 102, 22), box(102, 20, 104, 22), box(106, 26, 108, 28), box(101, 21, 103, 23)
GOLDEN = {
    "buffer": ({"node_type": "Buffer", "distance_km": 5, "child_node": A}, "area", 4.392148699460),
    "border": ({"node_type": "BorderBetween", "child_node_1": A, "child_node_2": B}, "area", 0.138268457738),
    "between": ({"node_type": "Between", "child_node_1": A, "child_node_2": C}, "area", 20.0),
    "union": ({"node_type": "Union", "child_nodes": [A, B]}, "area", 8.0),
    "difference": ({"node_type": "Difference", "child_node_1": A, "child_node_2": D}, "area", 3.0),
    "intersection": ({"node_type": "Intersection", "child_nodes": [A, D]}, "area", 1.020089206856),
    "outline": ({"node_type": "BorderOf", "child_node": A}, "length", 8.0),
    "coast": ({"node_type": "CoastOf", "child_node": A}, "length", 2.038488860713),
    "off coast": ({"node_type": "OffTheCoastOf", "distance_km": 10, "child_node": A}, "area", 0.228891634889),
}


def test_golden_measures(spark):
    K.register(spark)
    trees = spark.createDataFrame([(k, json.dumps(v[0])) for k, v in GOLDEN.items()], "query_id string, tree string")
    coast = spark.range(1).select(K.from_geojson(F.lit('{"type":"LineString","coordinates":[[90,20],[120,20]]}')).alias("geom"))
    got = {r.query_id: r.m for r in evaluate_trees(trees, coast).select("query_id", K.measures("geom").alias("m")).collect()}
    for k, (_, what, value) in GOLDEN.items():
        assert got[k][what] == pytest.approx(value, rel=1e-9), k


def test_status_codes(spark):
    trees = spark.createDataFrame([(k, v[1]) for k, v in FAILING.items()], "query_id string, tree string")
    assert {r.query_id: r.status for r in evaluate_trees(trees).collect()} == {k: v[0] for k, v in FAILING.items()}


def test_empty_table(spark):
    assert evaluate_trees(spark.createDataFrame([], "query_id string, tree string")).count() == 0


def degrees(km, lat):
    return max(km / 111.32, km / (111.32 * math.cos(math.radians(abs(lat))) + 1e-10))


def ring_by_place(lon, lat, radius):
    draw, size = random.Random(int(lon * 1e4 + lat * 1e4)), degrees(radius, lat)
    n, out = draw.randint(7, 12), []
    for i in range(n):
        turn = 2 * math.pi * i / n + draw.uniform(-0.25, 0.25)
        far = size * (0.7 + draw.random() * 0.6)
        out.append((lon + far * math.cos(turn), lat + far * math.sin(turn)))
    return [*out, out[0]]


def ring_by_lookup(lon, lat, radius):
    draw, out = random.Random(int(lon * 1e4 + lat * 1e4)), []
    for i in range(10):
        far = degrees(radius * (0.75 + draw.random() * 0.5), lat)
        turn = 2 * math.pi * i / 10 + draw.uniform(-0.3, 0.3)
        out.append((lon + far * math.cos(turn), lat + far * math.sin(turn)))
    return [*out, out[0]]


def test_drawn_boundaries(spark):
    """The kernel's draws are those of the standard library's generator, for seeds of either sign and of more than 32 bits."""
    assert ring_by_place(113.937, 22.533, 0.15)[0] == pytest.approx((113.93834663262746, 22.53273133045951), rel=1e-12)
    assert ring_by_lookup(-58.4, -34.6, 20)[0] == pytest.approx((-58.17275758522072, -34.61961972083953), rel=1e-12)
    assert len(ring_by_place(2.2, 46.6, 100)) == 11
    draw = random.Random(1)
    rows = [(draw.uniform(-180, 180), draw.uniform(-89, 89), draw.uniform(0.1, 100)) for _ in range(200)] + [(0.0, 0.0, 1.0), (9e8, 10.0, 1.0), (-9e8, 10.0, 2.0)]
    K.register(spark)
    args = [F.col(c) for c in ("lon", "lat", "km")]
    got = spark.createDataFrame(rows, "lon double, lat double, km double").select(*args, place_boundary(*args).alias("a"), lookup_boundary(*args).alias("b")).collect()
    for r in got:
        for text, ring in ((r.a, ring_by_place), (r.b, ring_by_lookup)):
            want = ring(r.lon, r.lat, r.km)
            corners = json.loads(text)["coordinates"][0]
            assert len(corners) == len(want)
            assert [x for p in corners for x in p] == pytest.approx([x for p in want for x in p], rel=1e-13)


def test_deep_and_wide_trees(spark):
    deep = A
    for i in range(300):
        deep = {"node_type": "Union", "child_nodes": [deep, B]} if i % 2 else {"node_type": "Difference", "child_node_1": deep, "child_node_2": C}
    wide = {"node_type": "Union", "child_nodes": [box(i, 0, i + 1, 1) for i in range(400)]}
    mixed = {"node_type": "Difference", "child_node_1": {"node_type": "Union", "child_nodes": [A, 3, None, {}, "x", B]}, "child_node_2": {"node_type": "Intersection", "child_nodes": [A, A]}, "child_node": {"node_type": "Rotate"}}
    trees = spark.createDataFrame([(k, json.dumps(v)) for k, v in {"deep": deep, "wide": wide, "mixed": mixed}.items()] + [("cut", json.dumps(deep)[:-1]), ("twice", json.dumps(A) * 2), ("list", "[1]"), (None, json.dumps(A))], "query_id string, tree string")
    got = {r.query_id: (r.status, r.area) for r in evaluate_trees(trees).select("query_id", "status", K.measures("geom")["area"].alias("area")).collect()}
    assert got["deep"] == (None, pytest.approx(8.0)) and got["wide"] == (None, pytest.approx(400.0)) and got[None] == (None, 4.0)
    assert got["mixed"] == (None, pytest.approx(4 - 2 * 0.005))  # children that a type doesn't take are no part of it
    assert [got[k][0] for k in ("cut", "twice", "list")] == ["E1"] * 3
    nodes = {(r.query_id, r.node_id): r for r in flatten(trees.filter("query_id in ('mixed', 'deep')")).collect()}
    assert sum(q == "deep" for q, _ in nodes) == 601 and max(r.depth for r in nodes.values()) == 300
    assert [nodes["mixed", n].post for n in ("0.1.10", "0.1.15", "0.1")] == sorted(nodes["mixed", n].post for n in ("0.1.10", "0.1.15", "0.1")) and nodes["mixed", "0"].kids == 3


def test_coasts_inside_coasts(spark):
    """A coast of what lies off a coast, beside a coast that there isn't, and one of a failing child."""
    K.register(spark)
    coast = spark.range(1).select(K.from_geojson(F.lit('{"type":"LineString","coordinates":[[90,20],[120,20]]}')).alias("geom"))
    off = {"node_type": "OffTheCoastOf", "distance_km": 10, "child_node": A}
    trees = {"twice": {"node_type": "CoastOf", "child_node": {"node_type": "Buffer", "distance_km": 0, "child_node": off}}, "off": off, "far": {"node_type": "Union", "child_nodes": [off, {"node_type": "CoastOf", "child_node": C}]},
             "both": {"node_type": "Union", "child_nodes": [{"node_type": "CoastOf", "child_node": A}, {"node_type": "CoastOf", "child_node": B}]}, "bad": {"node_type": "CoastOf", "child_node": {"name": "x"}}, "plain": A}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in trees.items()], "query_id string, tree string")
    got = {r.query_id: r for r in evaluate_trees(rows, coast).select("query_id", "status", K.measures("geom").alias("m")).collect()}
    assert {k: r.status for k, r in got.items()} == {"twice": None, "off": None, "far": "E14", "both": None, "bad": "E2", "plain": None}
    d2, d10 = degrees(2, 21), degrees(10, 21)
    assert got["both"].m.length == pytest.approx(4 + 2 * d2)  # what both have in common counts once
    assert got["twice"].m.length == pytest.approx(2 + 2 * d2 + 2 * d10 + 2 * degrees(2, got["off"].m.cy), rel=1e-4)


def test_failfast(spark):
    trees = spark.createDataFrame([("good", json.dumps(A)), ("bad", '{"node_type":"Rotate"}')], "query_id string, tree string")
    assert [r.query_id for r in evaluate_trees(trees.filter("query_id = 'good'"), mode="failfast").collect()] == ["good"]
    for use in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("query_id").collect()):
        with pytest.raises(Exception, match="query bad failed: E3"):
            use(evaluate_trees(trees, mode="failfast"))
    with pytest.raises(ValueError, match="mode"):
        evaluate_trees(trees, mode="slow")


def shapes(n, seed):
    """Points and boxes of very different sizes, 90 % of them in one spot."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (draw.uniform(10, 10.01), draw.uniform(10, 10.01)) if draw.random() < 0.9 else (draw.uniform(-180, 180), draw.uniform(-80, 80))
        size = draw.choice([0, 0, 1e-4, 1e-3, 0.1, 3, 100])
        out.append((i, x, y, x + size, y + size * draw.random()))
    return [*out, (n, 10.0, 10.0, 10.0, 10.0), (n + 1, 10.0, 10.0, 10.0, 10.0), (n + 2, -1.0, -1.0, 1.0, 1.0), (n + 3, 0.0, 0.0, 0.0, 0.0), (n + 4, 1.0, 1.0, 3e10, 3e10)]


@pytest.mark.parametrize("few", [10**9, 0])
def test_spatial_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    monkeypatch.setattr(spatial, "HOT_KEYS", 16)
    K.register(spark)
    left, right = shapes(300, 1), shapes(200, 2)
    point = lambda r: {"type": "Point", "coordinates": r[1:3]} if r[1:3] == r[3:] else {"type": "LineString", "coordinates": [r[1:3], r[3:]]} if r[2] == r[4] else box(*r[1:])["_polygon"]
    frame = lambda rows, name: spark.createDataFrame([(r[0], json.dumps(point(r))) for r in rows] + [(None, None), (-1, '{"type":"Polygon","coordinates":[]}')], f"{name} int, g string").select(name, K.from_geojson("g").alias("geom"))
    got = Counter((r.a, r.b) for r in spatial.spatial_pairs(frame(left, "a"), frame(right, "b")).collect())
    want = Counter((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert got == want and len(want) > 5000
    assert spatial.spatial_pairs(frame([], "a"), frame(right, "b")).count() == 0


def test_hot_cells_are_cut(spark, monkeypatch):
    """90 % of the points are in one cell of the boxes': no task gets more than a few times the median of the joined rows."""
    monkeypatch.setattr(spatial, "FEW", 0)
    rows = spark.range(40000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 1000).alias("cell"), F.col("id").alias("p"))
    cells = spark.range(1000).select(F.col("id").alias("cell"), (F.col("id") * 3).alias("q"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "16", "-1"), strict=True):
            spark.conf.set(k, v)
        joined = spatial.spread_join(spatial.saved(rows), spatial.saved(cells), ["cell"])
        sizes = sorted(r.n for r in joined.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        assert sum(sizes) == joined.select("p", "q").distinct().count() == 40000
        assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_jagged_coast(spark):
    """A coast of 100,000 segments along a parallel, of which an area of two degrees has the 15th part."""
    K.register(spark)
    step, high = 0.0003, 0.0002
    line = {"type": "LineString", "coordinates": [[90 + i * step, 20 + high * (i % 2)] for i in range(100_001)]}
    coast = coast_module.cut_lines(spark.createDataFrame([(json.dumps(line),)], "g string").select(K.from_geojson("g").alias("geom")))
    assert coast.count() == -(-100_000 // coast_module.SEGMENTS)
    areas = spark.createDataFrame([(k, json.dumps(box(x, y, x + 2, y + 2)["_polygon"])) for k, x, y in ((1, 99.0, 19.0), (2, 101.4, 19.0), (3, 100.0, 40.0))], "k int, g string").select("k", K.from_geojson("g").alias("geom"))
    got = {r.k: r for r in coast_module.coast_lines(areas, coast, ["k"]).select("k", K.measures("coast")["length"].alias("length"), K.call("Kind", "coast").alias("kind")).collect()}
    want = 2 / step * math.hypot(step, high)
    assert set(got) == {1, 2} and all(r.length == pytest.approx(want, rel=1e-9) and r.kind == "LineString" for r in got.values())
