"""Texts to geometries through tables, a callable, and the command line; drawn boundaries; what fails alone."""

import json

import pytest
from pyspark.sql import functions as F

from placeweave.__main__ import main
from placeweave.engine import TABLES, Engine, write_features, write_maps
from placeweave.functions import kernel as K
from placeweave.functions.columns import polyline_malformed, polyline_rings
from placeweave.functions.pseudo import lookup_boundary, place_boundary
from placeweave.operators.memo import LookupMemo
from placeweave.plans.evaluate import evaluate_trees
from placeweave.sources.examples import EXAMPLES
from placeweave.sources.parser import phrase_tree
from placeweave.sql import register
from placeweave.streaming.texts import evaluate_stream, results

# Golden values: lon, lat, radius in km; sides, first corner and area of both boundaries.
DRAWN = [
    (113.937, 22.533, 0.15, 8, (113.93834663262746, 22.53273133045951), 5.580639708568924e-06, (113.93819416037405, 22.533328218261392), 5.943597443547333e-06),
    (116.3975, 39.9087, 0.5, 7, (116.40194090846154, 39.909730764654356), 1.0007636592490599e-04, (116.40188385976666, 39.90753771165595), 8.35231594464858e-05),
    (2.2, 46.6, 100.0, 10, (3.8187149069256265, 46.808654935849766), 5.165427831327374, (3.4206906604496456, 46.80713629147941), 5.306343439796681),
    (-58.4, -34.6, 20.0, 11, (-58.21400372821584, -34.63342101443431), 0.1335736440206574, (-58.17275758522072, -34.61961972083953), 0.15649603070028206),
]
SQUARE = json.dumps({"node_type": "NamedPlace", "_polygon": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}})


def test_drawn_boundaries(spark):
    K.register(spark)
    rows = spark.createDataFrame([r[:3] for r in DRAWN] + [(None, 1.0, 1.0)], "lon double, lat double, km double")
    args = [F.col(c) for c in ("lon", "lat", "km")]
    got = {r.lon: r for r in rows.select("lon", place_boundary(*args).alias("a"), lookup_boundary(*args).alias("b")).select("*", K.measures(K.from_geojson("a"))["area"].alias("area_a"), K.measures(K.from_geojson("b"))["area"].alias("area_b")).collect()}
    assert got[None].a is None and got[None].b is None
    for lon, _, _, sides, first_a, area_a, first_b, area_b in DRAWN:
        ring_a, ring_b = (json.loads(x)["coordinates"][0] for x in (got[lon].a, got[lon].b))
        assert (len(ring_a), len(ring_b)) == (sides + 1, 11) and ring_a[0] == ring_a[-1] and ring_b[0] == ring_b[-1]
        assert tuple(ring_a[0]) == pytest.approx(first_a, rel=1e-12) and tuple(ring_b[0]) == pytest.approx(first_b, rel=1e-12)
        assert (got[lon].area_a, got[lon].area_b) == (pytest.approx(area_a, rel=1e-9), pytest.approx(area_b, rel=1e-9))


def tables(spark):
    rows = {
        "gazetteer": [("point", None, 0, "10,20", "市", None), ("broken", None, 0, "30,40", "兴趣点", None), ("bad", None, 0, "x,y", None, None)],
        "districts": [("square", 0, "square", "1", "city", "0,0;1,0;1,1;0,1"), ("broken", 0, "broken", "1", "city", "0,0;1,zero;1,1")],
        "osm_elements": [("way", "feature", {"place": "town"}, json.dumps({"type": "LineString", "coordinates": [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]})), ("way", "feature", {"place": "town"}, "{"), ("node", "feature", {"shop": "x"}, None)],
    }
    return {k: spark.createDataFrame(v, TABLES[k]) for k, v in rows.items()}


def test_sources_by_text(spark):
    names = ["square", "feature", "point", "broken", "bad", "unknown"]
    asked = spark.createDataFrame([(n, n) for n in names] + [("null", None)], "query_id string, text string")
    got = {r.query_id: r for r in Engine(**tables(spark)).evaluate(asked).select("query_id", "status", K.measures("geom").alias("m")).collect()}
    assert [got[n].status for n in [*names, "null"]] == [None, None, None, None, "E2", "E2", "E2"]
    assert (got["square"].m.area, got["feature"].m.area) == (1.0, 4.0)
    assert got["point"].m.cx == pytest.approx(10, abs=0.3) and got["broken"].m.cy == pytest.approx(40, abs=0.3)
    some = Engine(districts=tables(spark)["districts"]).evaluate(asked).filter("status is null").collect()
    assert [r.query_id for r in some] == ["square"]


def test_malformed_polylines(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["1,2;3,4;5,6", "1,2;x,4", "1,2;3", "", None, "1,2|3,", "1e1, 2 ;3,4"])], "i int, p string")
    got = {r.i: r for r in rows.select("i", polyline_malformed(F.col("p")).alias("bad"), polyline_rings(F.col("p")).alias("r")).collect()}
    assert [got[i].bad for i in range(7)] == [False, True, False, False, False, True, False]
    assert [r and sum(map(len, r)) for r in (got[i].r for i in (0, 2, 3, 4, 6))] == [3, 1, None, None, 2]


def test_deep_trees_and_what_fails_alone(spark):
    deep = SQUARE
    for _ in range(40):
        deep = json.dumps({"node_type": "Buffer", "distance_km": 0, "child_node": json.loads(deep)})
    trees = spark.createDataFrame([("deep", deep), ("flat", SQUARE), ("null", None), ("text", "no tree")], "query_id string, tree string")
    assert {r.query_id: r.status for r in evaluate_trees(trees).collect()} == {"deep": None, "flat": None, "null": "E1", "text": "E1"}


def test_memo(spark, tmp_path):
    """A second session asks the gazetteer for nothing, also not for what it hadn't; what it knows outlives the source."""
    given, path = tables(spark), str(tmp_path / "memo")
    asked = spark.createDataFrame([(n, n) for n in ("point", "unknown", "bad")], "query_id string, text string")
    first = {r.query_id: r.status for r in Engine(gazetteer=given["gazetteer"], memo=LookupMemo(spark, path)).evaluate(asked).collect()}
    assert first == {"point": None, "unknown": "E2", "bad": "E2"}
    known = LookupMemo(spark, path).known()
    assert known.select("call").distinct().count() == 1 and known.filter("address_key = 'unknown' and found is null").count() == 1
    later = Engine(gazetteer=given["gazetteer"].limit(0), memo=LookupMemo(spark, path))
    assert {r.query_id: r.status for r in later.evaluate(asked).collect()} == first and LookupMemo(spark, path)._calls() == [1]
    more = spark.createDataFrame([("x", "point"), ("y", "new")], "query_id string, text string")
    assert {r.query_id: r.status for r in later.evaluate(more).collect()} == {"x": None, "y": "E2"}
    assert {r.address_key for r in LookupMemo(spark, path).known().filter("call = 2").collect()} >= {"new"} and not LookupMemo(spark, path).known().filter("call = 2 and address_key = 'point'").count()


def test_stream_of_texts_after_a_restart(spark, tmp_path):
    given, names = tables(spark), ["square", "feature", "point", "unknown", "broken", "bad"]
    for i in range(0, 6, 2):
        spark.createDataFrame([(n, n) for n in names[i : i + 2]], "query_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    asked = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls = []

    class Failing(Engine):
        def evaluate(self, queries, mode="permissive"):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost")
            return super().evaluate(queries, mode)

    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        evaluate_stream(Failing(**given), stream, path).awaitTermination()
    assert results(spark, path).count() == 2
    evaluate_stream(Failing(**given), stream, path).awaitTermination()
    rows = lambda df: sorted((r.query_id, r.status, r.kind, r.area) for r in df.select("query_id", "status", "kind", F.round(K.measures("geom")["area"], 9).alias("area")).collect())
    assert repr(rows(results(spark, path))) == repr(rows(Engine(**given).evaluate(asked))) and len(calls) == 4


def test_sql_views_and_functions(spark):
    register(spark, Engine(**tables(spark)))
    assert spark.sql("SELECT count(*) FROM place_gazetteer").first()[0] == 3
    row = spark.sql("SELECT place_area(place_box(0D, 0D, 2D, 1D)), place_length(place_Boundary(place_box(0D, 0D, 2D, 1D))), place_km_to_degrees(111.32D, 0D), place_area(NULL)").first()
    assert tuple(row) == (2.0, 6.0, pytest.approx(1.0), None)
    assert spark.sql(f"SELECT node_id, kids FROM place_tree_nodes('{SQUARE}')").collect() == [("0", 0)]


def test_parser_as_a_callable(spark):
    def parser(text):
        if text == "fails":
            raise ValueError(text)
        return f"```json\n{SQUARE}\n```" if text == "square" else None

    asked = spark.createDataFrame([(1, "square"), (2, "fails"), (3, "none"), (4, None)], "query_id int, text string")
    assert {r.query_id: r.status for r in Engine(parser=parser).evaluate(asked).collect()} == {1: None, 2: "E1", 3: "E1", 4: "E1"}


def test_examples(spark):
    responses = spark.createDataFrame([(e.text, json.dumps(e.tree)) for e in EXAMPLES], "text string, response string")
    coast = spark.range(1).select(F.lit('{"type":"LineString","coordinates":[[-20,46],[30,46]]}').alias("g"))
    K.register(spark)
    engine = Engine(responses=responses, coastline=coast.select(K.from_geojson("g").alias("geom")))
    asked = spark.createDataFrame([(i, e.text) for i, e in enumerate(EXAMPLES)], "query_id int, text string")
    got = {r.query_id: r for r in engine.evaluate(asked).collect()}
    assert [e.root for e in EXAMPLES].count("NamedPlace") == 4 and len(got) == 12
    assert {i for i, r in got.items() if r.status} <= {4, 8} and got[10].kind in ("LineString", "MultiLineString")


def test_phrases_with_places_in_provinces(spark):
    rows = spark.createDataFrame([("广东省深圳附近",), ("广东省除了深圳",)], "t string").select("t", phrase_tree(F.col("t")).alias("tree"))
    got = {r.t: json.loads(r.tree) for r in rows.collect()}
    assert got["广东省深圳附近"] == {"node_type": "Buffer", "distance_km": 3.0, "child_node": {"node_type": "NamedPlace", "name": "深圳", "in_region": "广东", "in_country": "中国"}}
    assert [got["广东省除了深圳"][k]["name"] for k in ("child_node_1", "child_node_2")] == ["广东省", "深圳"]


def test_command_line_and_files(spark, tmp_path, capsys):
    for name, rows in tables(spark).items():
        rows.write.parquet(str(tmp_path / "tables" / f"{name}.parquet"))
    (tmp_path / "tables" / "coastline.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-1,0],[3,0]]}}]}')
    out = tmp_path / "out"
    assert main(["--tables", str(tmp_path / "tables"), "--out", str(out), "square附近2公里"]) == 0
    feature = json.loads((out / "output.geojson").read_text("utf-8"))
    assert feature["geometry"]["type"] == "Polygon" and "Polygon, centre (0.5000, 0.5000)" in capsys.readouterr().out
    assert "fitBounds" in (out / "map.html").read_text("utf-8")
    assert main(["--tables", str(tmp_path / "tables"), "--out", str(out), "feature的海岸线"]) == 0
    assert json.loads((out / "output.geojson").read_text("utf-8"))["geometry"]["type"] == "LineString"
    assert main(["nowhere"]) == 1 and "E2" in capsys.readouterr().out
    assert main([]) == 1
    done = Engine(**tables(spark)).evaluate(spark.createDataFrame([("a", "square"), ("b", "unknown")], "query_id string, text string"))
    write_maps(done, str(tmp_path / "maps"))
    write_features(done, str(tmp_path / "features"))
    assert [p.name for p in (tmp_path / "maps").iterdir() if p.is_dir()] == ["query=a"]
    assert spark.read.text(str(tmp_path / "features")).count() == 1
