"""Recorded answers of map services, as they came over HTTP, to the tables that places are looked up in.

Each row has what was asked for and the body of the answer. A body that isn't
JSON, says that it failed, or found nothing gives no rows, as a failed request does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and columns of the recorded answers that stand for a table.
ANSWERS = {
    "gazetteer": ("geocode_answers", "address_key string, city string, body string"),
    "districts": ("district_answers", "keyword string, body string"),
    "osm_elements": ("osm_answers", "name string, body string"),
}


def _given(field: str) -> Column:
    """A text of an answer; services write an empty list where they have none."""
    return F.when(~F.col(field).startswith("["), F.col(field))


def _listed(answers: DataFrame, keys: list[str], member: str, fields: str) -> DataFrame:
    """The objects of one list in each answer with status 1, with their place in it."""
    body = F.from_json("body", f"status string, {member} array<struct<{fields}>>")
    return answers.select(*keys, body.alias("b")).filter("b.status = '1'").select(*keys, F.posexplode(f"b.{member}").alias("position", "o")).select(*keys, "position", "o.*")


def geocode_answers(answers: DataFrame) -> DataFrame:
    """``gazetteer`` of (address_key, city, body); an answer whose level is a list has no location, so that nothing is found by it."""
    rows = _listed(answers, ["address_key", "city"], "geocodes", "location string, level string, formatted_address string")
    usable = F.coalesce(~F.col("level").startswith("["), F.lit(True))
    return rows.select("address_key", "city", "position", F.when(usable, _given("location")).alias("location"), "level", "formatted_address")


def district_answers(answers: DataFrame) -> DataFrame:
    """``districts`` of (keyword, body), with boundaries or without; missing texts are empty."""
    rows = _listed(answers, ["keyword"], "districts", "name string, adcode string, level string, polyline string")
    return rows.select("keyword", "position", "name", *[F.coalesce(_given(c), F.lit("")).alias(c) for c in ("adcode", "level", "polyline")])


def osm_answers(answers: DataFrame) -> DataFrame:
    """``osm_elements`` of (name, body): the elements under the name that was asked for; a geometry that isn't GeoJSON is passed over later."""
    elements = F.from_json(F.get_json_object("body", "$.elements"), "array<string>")
    rows = answers.select("name", F.explode(elements).alias("e"))
    part = lambda path: F.get_json_object("e", path)
    return rows.select(part("$.type").alias("osm_type"), "name", F.from_json(part("$.tags"), "map<string,string>").alias("tags"), part("$.geometry").alias("geometry"))


READERS = {"gazetteer": geocode_answers, "districts": district_answers, "osm_elements": osm_answers}
