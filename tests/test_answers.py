"""Recorded answers of services: whole, empty, failed, broken."""

import json

from placeweave import storage
from placeweave.engine import Engine
from placeweave.functions import kernel as K
from placeweave.operators import resolve as R
from placeweave.operators.memo import LookupMemo
from placeweave.sources.answers import district_answers, geocode_answers, osm_answers


def test_geocode_answers(spark):
    one = {"location": "1,2", "level": "市", "formatted_address": "here"}
    bodies = [
        ("a", {"status": "1", "geocodes": [one, one | {"location": "3,4"}]}), ("failed", {"status": "0", "info": "KEY", "geocodes": [one]}), ("none", {"status": "1", "geocodes": []}),
        ("absent", {"status": "1"}), ("odd", {"status": "1", "geocodes": [one | {"level": []}]}), ("bare", {"status": "1", "geocodes": [{"location": "5,6"}]}),
    ]
    rows = spark.createDataFrame([(a, None, json.dumps(b)) for a, b in bodies] + [("broken", None, '{"status":"1","geo'), ("null", None, None)], "address_key string, city string, body string")
    got = {(r.address_key, r.position): (r.location, r.level, r.formatted_address) for r in geocode_answers(rows).collect()}
    assert got == {("a", 0): ("1,2", "市", "here"), ("a", 1): ("3,4", "市", "here"), ("odd", 0): (None, "[]", "here"), ("bare", 0): ("5,6", None, None)}
    places = spark.createDataFrame([(n, None, None) for n in ("a", "failed", "odd", "bare")], "name string, in_region string, in_country string").withColumn("place", R._key())
    best = R.best_candidate(places, geocode_answers(rows)).collect()
    assert sorted((r.lon, r.lat, r.level) for r in best) == [(1.0, 2.0, "市"), (5.0, 6.0, "兴趣点")]


def test_district_answers(spark):
    ring = "0,0;2,0;2,2;0,2"
    bodies = [
        ("A", {"status": "1", "districts": [{"name": "A", "adcode": [], "level": "city", "polyline": []}, {"name": "A", "adcode": "110000", "level": "city", "polyline": ring}]}),
        ("A市", {"status": "1", "districts": [{"name": "A市", "adcode": "120000", "level": "province"}]}), ("B", {"status": "0", "districts": [{"name": "B", "polyline": ring}]}),
    ]
    rows = district_answers(spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies], "keyword string, body string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("A", 0, "A", "", "city", ""), ("A", 1, "A", "110000", "city", ring), ("A市", 0, "A市", "120000", "province", "")]
    regions = spark.createDataFrame([("A",)], "region string")
    assert [r.adcode for r in R.region_adcode(regions, rows).collect()] == ["120000"], "only an answer's first district gives a region's code"


def test_osm_answers(spark):
    K.register(spark)
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    elements = [{"type": "way", "tags": {"leisure": "park"}, "geometry": square}, {"type": "way", "tags": {"leisure": "park"}, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "node", "tags": {"place": "x"}}]
    rows = osm_answers(spark.createDataFrame([("p", json.dumps({"elements": elements})), ("q", '{"elements":[]}'), ("r", "<html>"), ("s", None)], "name string, body string"))
    assert [r.osm_type for r in rows.collect()] == ["way", "way", "node"]
    assert [r.name for r in R.osm_boundary(rows).collect()] == ["p"]


def test_an_engine_over_answers(spark, tmp_path):
    """A table goes before recorded answers; both are read from one folder."""
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    body = json.dumps({"elements": [{"type": "way", "tags": {"leisure": "park"}, "geometry": square}]})
    (tmp_path / "osm_answers.json").write_text(json.dumps({"name": "park", "body": body}))
    (tmp_path / "geocode_answers.json").write_text(json.dumps({"address_key": "spot", "city": None, "body": json.dumps({"status": "1", "geocodes": [{"location": "9,9"}]})}))
    (tmp_path / "gazetteer.json").write_text(json.dumps({"address_key": "spot", "position": 0, "location": "1,2", "level": "市"}))
    engine = Engine.of_tables(spark, str(tmp_path))
    assert engine.districts is None and [r.location for r in engine.gazetteer.collect()] == ["1,2"]
    done = engine.evaluate(spark.createDataFrame([("a", "park附近2公里"), ("b", "nowhere附近2公里")], "query_id string, text string"))
    assert {r.query_id: (r.kind, r.status) for r in done.collect()} == {"a": ("Polygon", None), "b": (None, "E2")}


def test_more_places_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """Look-ups of many places are spread by their number, with the same result, so that no task holds more as tables grow."""
    n = "concat('p', id)"
    places = spark.range(300).selectExpr(f"{n} AS name", "'ASIA' AS in_region", "string(null) AS in_country").withColumn("place", R._key())
    gazetteer = spark.range(300).selectExpr(f"{n} AS address_key", "IF(id % 2 = 0, 'ASIA', null) AS city", "0 AS position", "concat(id, ',1') AS location", "'市' AS level", "'ASIA' AS formatted_address")
    districts = spark.range(300).selectExpr(f"{n} AS keyword", "0 AS position", f"{n} AS name", "'1' AS adcode", "'city' AS level", "'0,0;1,0;1,1' AS polyline")
    runs = {
        "plain": lambda: R.best_candidate(places, gazetteer).select("place", "lon", "lat", "level"),
        "memo": lambda: R.best_candidate(places, gazetteer, LookupMemo(spark, str(tmp_path / str(len(list(tmp_path.iterdir())))))).select("place", "lon", "lat", "level"),
        "districts": lambda: R.district_best(places, districts).select("place", "boundary", "level"),
    }
    few = {k: sorted(run().collect()) for k, run in runs.items()}
    monkeypatch.setattr(storage, "TASK_ROWS", 300)
    for k, run in runs.items():
        many = run()
        assert sorted(many.collect()) == few[k] and len(few[k]) == 300, k
        assert many.rdd.getNumPartitions() > 10, k
