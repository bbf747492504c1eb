"""Spatial expression trees as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions import kernel as K


def flatten(trees: DataFrame) -> DataFrame:
    """``plan_nodes`` from (query_id, tree), the tree as JSON text: a row for each node, with its parent, role and arguments.

    Text that isn't a JSON object gives one node of type null. Whether a key
    was given is kept apart from its value, for an explicit null is an error
    where an absent key means the default. Each text is read once, however
    deep its tree is; ``post`` numbers a tree's nodes so that children, in
    their order, come before their parent, which has ``kids`` of them.
    """
    K.register(trees.sparkSession)
    rows = trees.select("query_id", F.inline(K.call("Nodes", F.col("tree").cast("string"))))
    keys = F.json_object_keys("js")
    text = lambda k: F.get_json_object("js", f"$.{k}").alias(k.lstrip("_"))
    number = lambda k: F.get_json_object("js", f"$.{k}").try_cast("double").alias(k)
    return rows.select(
        "query_id", "node_id", "parent_id", "role", "ordinal", "depth", "post", "kids",
        F.when(keys.isNull(), None).otherwise(F.coalesce(F.get_json_object("js", "$.node_type"), F.lit("NamedPlace"))).alias("node_type"),
        text("name"), text("in_region"), text("in_country"), text("in_continent"), text("direction"), F.get_json_object("js", "$._polygon").alias("inline_geojson"), F.get_json_object("js", "$._amap_level").alias("level"),
        number("center_lon"), number("center_lat"), number("radius_km"), number("distance_km"), number("max_distance_km"),
        *[F.coalesce(F.array_contains(keys, k), F.lit(False)).alias(f"has_{k}") for k in ("distance_km", "max_distance_km", "direction")],
    )
