"""Texts to trees: recorded model answers, or rules for plain phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.columns import strip_fence

# Suggested distances in km, near a landmark, between cities, and between provinces.
NEARBY_KM, CITY_KM, PROVINCE_KM = 3.0, 50.0, 200.0


def suggested_km(name: Column) -> Column:
    """The distance that "near" means without a number, by the kind of place that a name ends with."""
    return F.when(name.rlike("(省|自治区)$"), PROVINCE_KM).when(name.rlike("市$"), CITY_KM).otherwise(NEARBY_KM)


def called(queries: DataFrame, parser: Callable[[str], str]) -> DataFrame:
    """(query_id, tree) from what ``parser`` answers to each text, with or without a fence; its exceptions, and null texts, fail as E1."""

    def answer(text: str | None) -> str:
        try:
            return (parser(text) if text is not None else "") or ""
        except Exception:  # noqa: BLE001  the row says so
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([answer(t) for t in b.column(1).to_pylist()], pa.string())], ["query_id", "tree"])

    rows = queries.select("query_id", F.col("text").cast("string"))
    found = rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, tree string")
    return found.select("query_id", strip_fence(F.col("tree")).alias("tree"))


def recorded(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, tree) from what a model answered to the same text; without an answer, or with one that isn't JSON, the tree fails as E1."""
    answers = responses.groupBy("text").agg(F.first("response").alias("response"))
    return queries.join(answers, "text", "left").select("query_id", F.coalesce(strip_fence(F.col("response")), F.lit("")).alias("tree"))


def _place(name: Column) -> Column:
    """A leaf; what follows the name of a province is a place in it, in China."""
    name = F.trim(name)
    inner = F.regexp_extract(name, "^(.+?)(省|自治区)(.+)$", 3)
    nested = F.to_json(F.struct(F.lit("NamedPlace").alias("node_type"), inner.alias("name"), F.regexp_extract(name, "^(.+?)(省|自治区)(.+)$", 1).alias("in_region"), F.lit("中国").alias("in_country")))
    return F.when(inner != "", nested).otherwise(F.to_json(F.struct(F.lit("NamedPlace").alias("node_type"), name.alias("name"))))


def _node(kind: str, **parts: Column) -> Column:
    inner = [F.concat(F.lit(f',"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit(f'{{"node_type":"{kind}"'), *inner, F.lit("}"))


def phrase_tree(text: Column) -> Column:
    """The tree of a phrase in one of the known forms, else of a place of that name.

    Forms, first match: all but a part; the border between two; the coast
    and what lies off it; one's border; between two; nearby, within a
    distance; a direction, or two; two places together.
    """
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    out = None
    sides = {"东": "east", "南": "south", "西": "west", "北": "north"}
    compass = F.create_map(*[F.lit(x) for pair in sides.items() for x in pair])
    side = lambda of, which: _node("DirectionalConstraint", direction=F.concat(F.lit('"'), compass[which], F.lit('"')), child_node=_place(of))
    two = lambda kind, p: _node(kind, child_node_1=_place(part(p, 1)), child_node_2=_place(part(p, 2)))
    many = lambda a, b: F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    km = lambda c, else_: F.coalesce(c.try_cast("double"), else_).cast("string")
    rules = [
        (p := r"^(.+?)(?:除了|不包括)(.+)$", two("Difference", p)),
        (p := r"^(.+?)除(.+)外$", two("Difference", p)),
        (p := r"^(.+?)和(.+?)的(?:边界|交界处?)$", two("BorderBetween", p)),
        (p := r"^(.+?)的海岸线$", _node("CoastOf", child_node=_place(part(p, 1)))),
        (p := r"^(.+?)海岸外([0-9.]+)公里$", _node("OffTheCoastOf", distance_km=km(part(p, 2), F.lit(NEARBY_KM)), child_node=_place(part(p, 1)))),
        (p := r"^(.+?)的边界$", _node("BorderOf", child_node=_place(part(p, 1)))),
        (p := r"^(.+?)和(.+?)之间$", two("Between", p)),
        (p := r"^(.+?)(?:附近|周边|范围内)([0-9.]*)(?:公里)?$", _node("Buffer", distance_km=km(part(p, 2), suggested_km(F.trim(part(p, 1)))), child_node=_place(part(p, 1)))),
        (p := r"^(.+?)([东西])([南北])方向$", _node("Intersection", child_nodes=many(side(part(p, 1), part(p, 3)), side(part(p, 1), part(p, 2))))),
        (p := r"^(.+?)([东南西北])(?:方向|边|面)$", side(part(p, 1), part(p, 2))),
        (p := r"^(.+?)和(.+)$", _node("Union", child_nodes=many(_place(part(p, 1)), _place(part(p, 2))))),
    ]
    for pattern, tree in rules:
        out = F.when(text.rlike(pattern), tree) if out is None else out.when(text.rlike(pattern), tree)
    return out.otherwise(_place(text))
