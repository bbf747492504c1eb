"""The reader of feature collections against Python's own JSON reader."""

import json
import random

import pytest

from placeweave.sources.coastline import read_coastline
from placeweave.sources.geojson import read_features, write_features_as_collections

#: Strings that look like structure.
ODD = ["", "plain", '} ] {"type":"Feature"}', "\\", '\\"', 'quote " brace { \\" [', "ü 北京 }", "tab\tline\n}"]


def made(seed: int, many: int) -> dict:
    r = random.Random(seed)
    features = []
    for i in range(many):
        line = [[round(r.uniform(-180, 180), 4), round(r.uniform(-80, 80), 4)] for _ in range(r.choice([2, 2, 3, 40, 400]))]
        features.append({"type": "Feature", "id": i, "properties": {"n": i, "name": r.choice(ODD), "deep": {"a": [{"b": "]"}]}}, "geometry": None if i % 11 == 5 else {"type": "LineString", "coordinates": line}})
    return {"type": "FeatureCollection", "name": 'x } "', "crs": {"type": "name", "properties": {"name": "a{"}}, "others": [{"no": "feature"}], "features": features, "after": [1, {"c": {}}]}


def as_rows(rows) -> list[tuple]:
    return sorted((r.properties.n, r.properties.name, json.dumps(json.loads(r.geometry)) if r.geometry else None) for r in rows)


def expected(*collections: dict) -> list[tuple]:
    return sorted((f["properties"]["n"], f["properties"]["name"], json.dumps(f["geometry"]) if f["geometry"] else None) for c in collections for f in c["features"])


@pytest.fixture
def split(spark):
    """Splits of so many bytes."""

    def at(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield at
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [700, 5_000, 100_000_000])
@pytest.mark.parametrize("indent", [None, 1])
def test_features_over_splits(spark, split, tmp_path, size, indent):
    """Features and strings that go over one edge or several, in two files, one of them of two collections."""
    a, b, c = made(1, 30), made(2, 25), made(3, 4)
    (tmp_path / "one.geojson").write_text(json.dumps(a, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.geojson").write_text(json.dumps(b, indent=indent) + "\n" + json.dumps(c, indent=indent) + "\n")
    split(size)
    got = read_features(spark, str(tmp_path), "n int, name string").collect()
    assert as_rows(got) == expected(a, b, c)


def test_small_batches(spark, split, tmp_path):
    """A split's pieces in many batches."""
    a = made(4, 60)
    (tmp_path / "one.geojson").write_text(json.dumps(a))
    split(20_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert as_rows(read_features(spark, str(tmp_path), "n int, name string").collect()) == expected(a)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_several_tasks_read_one_file(spark, split, tmp_path):
    (tmp_path / "one.geojson").write_text(json.dumps(made(5, 200)))
    split(10_000)
    text = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert text.rdd.getNumPartitions() > 4
    assert read_coastline(spark, str(tmp_path)).count() == sum(f["geometry"] is not None for f in made(5, 200)["features"])


def test_nothing_and_broken(spark, tmp_path):
    """An empty file, a collection of nothing, one that breaks off in a feature, and properties as text."""
    (tmp_path / "empty.geojson").write_text("")
    (tmp_path / "none.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "broken.geojson").write_text('{"features":[{"type":"Feature","properties":{"n":7}},{"type":"Feature","properties":{"n":8')
    got = read_features(spark, str(tmp_path)).collect()
    assert [(r.geometry, r.properties) for r in got] == [(None, '{"n":7}')]


def test_collections_written(spark, tmp_path):
    """Each file is a collection on its own, also one of nothing."""
    features = made(6, 9)["features"]
    rows = spark.createDataFrame([(json.dumps(f),) for f in features] + [(None,)], "feature string").coalesce(1)
    write_features_as_collections(rows, str(tmp_path / "one"))
    write_features_as_collections(rows.filter("length(feature) < 0"), str(tmp_path / "none"))
    read = lambda name: [json.loads(p.read_text("utf-8")) for p in (tmp_path / name).glob("part-*")]
    assert [c["features"] for c in read("one")] == [features]
    assert all(c["features"] == [] for c in read("none"))
