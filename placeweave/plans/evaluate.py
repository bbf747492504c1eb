"""Evaluation of spatial expression trees: each tree is a row, folded over its nodes from the leaves to the root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import columns as C
from placeweave.functions import kernel as K
from placeweave.operators.coast import coast_lines, cut_lines
from placeweave.plans.flatten import flatten
from placeweave.storage import saved

INTERSECTION_BUFFER = 0.005
BORDER_KM, COAST_KM = 3.5, 2.0
ONE_CHILD = ("Buffer", "DirectionalConstraint", "BorderOf", "CoastOf", "OffTheCoastOf")
TWO_CHILDREN = ("Between", "Difference", "BorderBetween")
MANY_CHILDREN = ("Intersection", "Union")
COASTAL = ("CoastOf", "OffTheCoastOf")
#: Arguments with a default, by node type.
DEFAULTS = {"Buffer": ("distance_km", 1.0), "DirectionalConstraint": ("max_distance_km", 3.0), "OffTheCoastOf": ("distance_km", 10.0)}
#: The status of a node that waits for its coast, and of those above it.
WAITS = "waits"
#: What becomes of a tree's failure: a status of its row, or an error of the job.
MODES = ("permissive", "failfast")
_VALUE = "struct<role:string,ordinal:int,geom:binary,status:string>"
_STATE = f"struct<stack:array<{_VALUE}>,asks:array<struct<node_id:string,geom:binary>>>"
#: What a node brings to the fold.
_NODE = ("post", "node_id", "role", "ordinal", "kids", "node_type", "direction", "distance_km", "max_distance_km", "has_distance_km", "has_max_distance_km", "has_direction", "geom", "status")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named; Spark shares no common parts inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _status(n: Column, p: Column, coast: bool) -> Column:
    """The first error that a node has of itself or from the children that its type takes; null if none."""
    t, kids = n["node_type"], p["kids"]
    missing = (t.isin(*ONE_CHILD) & p["c"].isNull()) | (t.isin(*TWO_CHILDREN) & (p["a"].isNull() | p["b"].isNull()))
    null_arg = F.lit(False)
    for name, (arg, _) in DEFAULTS.items():
        null_arg = null_arg | ((t == name) & n[f"has_{arg}"] & n[arg].isNull())
    bad_direction = (t == "DirectionalConstraint") & n["has_direction"] & ~F.coalesce(n["direction"].isin(*C.DIRECTIONS), F.lit(False))
    used = lambda role: F.when(t.isin(*ONE_CHILD), role == "child_node").when(t.isin(*TWO_CHILDREN), role.startswith("child_node_")).otherwise(role == "child_nodes")
    first = F.filter(kids, lambda k: k["status"].isNotNull() & used(k["role"]))
    return (
        F.when(t.isNull(), "E1")
        .when(~t.isin("NamedPlace", *ONE_CHILD, *TWO_CHILDREN, *MANY_CHILDREN), "E3")
        .when(t.isin(*COASTAL) & F.lit(not coast), "E9")
        .when(missing, "E5").when(bad_direction, "E4")
        .when((t == "Intersection") & (F.size(p["many"]) < 2), "E7").when((t == "Union") & (F.size(p["many"]) < 2), "E8")
        .when(F.size(first) > 0, F.get(first, F.lit(0))["status"]).when(null_arg, "E_NULL_ARG")
    )


def _arg(n: Column, name: str) -> Column:
    key, default = DEFAULTS[name]
    return F.when(n[f"has_{key}"], n[key]).otherwise(F.lit(default))


def _grown(geom: Column, km: Column) -> Column:
    return _let(geom, lambda g: K.call("Buffer", g, C.km_to_degrees(km, K.measures(g)["cy"])))


def _geometry(n: Column, p: Column, coast: Column | None) -> Column:
    """What a node without an error is, by its type; branches that don't apply aren't worked out."""
    t, c, a, b, many = n["node_type"], p["c"]["geom"], p["a"]["geom"], p["b"]["geom"], p["many"]
    border = F.lit(BORDER_KM)
    side = F.when(n["has_direction"], n["direction"]).otherwise("north")
    beside = _let(K.measures(c), lambda m: K.from_geojson(C.box_json(*C.side_box(side, m["minx"], m["miny"], m["maxx"], m["maxy"], C.km_to_degrees(_arg(n, "DirectionalConstraint"), m["cy"])))))
    wide = lambda g: K.call("Buffer", g, F.lit(INTERSECTION_BUFFER))
    folded = F.aggregate(many, F.lit(None).cast("binary"), lambda s, g: F.when(s.isNull(), wide(g)).otherwise(K.call("Intersection", s, wide(g))))
    geom = (
        F.when(t == "NamedPlace", n["geom"]).when(t == "Buffer", _grown(c, _arg(n, "Buffer"))).when(t == "DirectionalConstraint", beside)
        .when(t == "Intersection", folded).when(t == "Union", K.call("Union", many))
        .when(t == "Between", K.call("Between", a, b)).when(t == "Difference", K.call("Difference", a, b))
        .when(t == "BorderBetween", K.call("Intersection", _grown(a, border), _grown(b, border))).when(t == "BorderOf", K.call("Boundary", c))
    )
    if coast is None:
        return geom
    off = K.call("Difference", K.call("Buffer", coast, C.km_to_degrees(_arg(n, "OffTheCoastOf"), K.measures(c)["cy"])), c)
    return geom.when(t == "CoastOf", coast).when(t == "OffTheCoastOf", off)


def _value(n: Column, kids: Column, coasts: Column | None) -> Column:
    """(geom, status) of a node from those of its children; a coastal node whose coast isn't in ``coasts`` yet waits."""
    one = lambda role: F.get(F.filter(kids, lambda k: k["role"] == role), F.lit(0))
    many = F.transform(F.filter(kids, lambda k: k["role"] == "child_nodes"), lambda k: k["geom"])
    parts = F.struct(kids.alias("kids"), one("child_node").alias("c"), one("child_node_1").alias("a"), one("child_node_2").alias("b"), many.alias("many"))
    t = n["node_type"]
    coastal = t.isin(*COASTAL)
    code = F.when(t == "Intersection", "E6").when(t == "Between", "E10").when(t == "Difference", "E11").when(t == "BorderBetween", "E12").when(t == "BorderOf", "E13").when(t == "OffTheCoastOf", "E15")

    def settled(p: Column, early: Column) -> Column:
        coast = coasts[n["node_id"]] if coasts is not None else None
        if coast is not None:
            early = F.coalesce(early, F.when(coastal & ~F.map_contains_key(coasts, n["node_id"]), WAITS).when(coastal & coast.isNull(), "E14"))
        found = F.struct(early.alias("early"), F.when(early.isNull(), _geometry(n, p, coast)).alias("geom"))
        return _let(found, lambda f: _late(f))

    def _late(f: Column) -> Column:
        late = F.when(f["geom"].isNull(), "E_UNSUPPORTED").when(K.call("Empty", f["geom"]), code)
        return _let(F.coalesce(f["early"], late), lambda s: F.struct(F.when(s.isNull(), f["geom"]).alias("geom"), s.alias("status"), f["early"].alias("early")))

    place = F.struct(F.when(n["status"].isNull(), n["geom"]).alias("geom"), n["status"].alias("status"), F.lit(None).cast("string").alias("early"))
    node = _let(parts, lambda p: _let(_status(n, p, coasts is not None), lambda early: settled(p, early)))
    return F.when(t == "NamedPlace", place).otherwise(node)


def _folded(nodes: Column, coasts: Column | None) -> Column:
    """The root's value, and what coastal nodes ask for: a tree's nodes in the order of evaluation meet a stack of what is done and not yet used."""

    def step(state: Column, n: Column) -> Column:
        have = F.size(state["stack"]) - n["kids"]
        kids, rest = F.slice(state["stack"], have + 1, n["kids"]), F.slice(state["stack"], F.lit(1), have)

        def pushed(v: Column) -> Column:
            done = F.struct(n["role"].alias("role"), n["ordinal"].alias("ordinal"), v["geom"].alias("geom"), v["status"].alias("status"))
            asks = state["asks"]
            if coasts is not None:
                near = F.struct(n["node_id"].alias("node_id"), _grown(F.get(kids, F.lit(0))["geom"], F.lit(COAST_KM)).alias("geom"))
                waits = n["node_type"].isin(*COASTAL) & (v["status"] == WAITS) & F.get(kids, F.lit(0))["status"].isNull()
                asks = F.when(waits, F.concat(asks, F.array(near))).otherwise(asks)
            return F.struct(F.concat(rest, F.array(done)).alias("stack"), asks.alias("asks"))

        return _let(_value(n, kids, coasts), pushed)

    start = F.struct(F.array().cast(f"array<{_VALUE}>").alias("stack"), F.array().cast("array<struct<node_id:string,geom:binary>>").alias("asks"))
    return F.aggregate(nodes, start, lambda s, n: step(s, n).cast(_STATE))


def evaluate_nodes(nodes: DataFrame, coastline: DataFrame | None = None, boundaries: DataFrame | None = None, mode: str = "permissive") -> DataFrame:
    """(query_id, geom, kind, status) of each tree's root from ``plan_nodes``.

    ``boundaries`` has (query_id, node_id, boundary, lon, lat, radius_km,
    level) for leaves that a resolver found. A failing node carries a status
    code, which its parents pass on; geometries that an operation can't take
    give E_UNSUPPORTED. With ``mode`` "failfast" the first failure fails the
    job, with the query and the code in its message.

    A tree's nodes meet in one row by a shuffle on query_id, and one
    projection folds them, whatever the tree's depth and shape. Only trees
    that ask for a coast are written down: what their coastal nodes ask for
    is looked up together, then they are folded again, once more for each
    coast that is inside another.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    spark = nodes.sparkSession
    K.register(spark)
    rows = _with_places(nodes, boundaries)
    trees = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*_NODE))).alias("nodes"))
    if coastline is None:
        return _roots(trees.select("query_id", _folded(F.col("nodes"), None).alias("f")), mode)
    coastline = saved(cut_lines(coastline))
    known = F.map_from_entries(F.array().cast("array<struct<node_id:string,geom:binary>>"))
    left, out, fold = saved(trees.withColumn("coasts", known)), None, _folded(F.col("nodes"), F.col("coasts")).alias("f")
    while True:
        folded = saved(left.select("query_id", fold))
        done = folded.filter(F.size("f.asks") == 0)
        out = done if out is None else out.unionByName(done)
        asks = folded.select("query_id", F.inline("f.asks"))
        if asks.isEmpty():
            return _roots(out, mode)
        found = asks.drop("geom").join(coast_lines(asks, coastline, ["query_id", "node_id"]), ["query_id", "node_id"], "left")
        more = found.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "coast"))).alias("more"))
        left = saved(left.join(more, "query_id").select("query_id", "nodes", F.map_concat("coasts", "more").alias("coasts")))


def _roots(folded: DataFrame, mode: str) -> DataFrame:
    root = F.get("f.stack", F.lit(0))
    rows = folded.select("query_id", root.alias("r")).select("query_id", "r.geom", K.call("Kind", "r.geom").alias("kind"), "r.status")
    if mode == "permissive":
        return rows
    failure = F.raise_error(F.concat(F.lit("query "), F.coalesce(F.col("query_id").cast("string"), F.lit("null")), F.lit(" failed: "), F.col("status")))
    return rows.filter(F.when(F.col("status").isNotNull(), failure.cast("boolean")).otherwise(F.lit(True)))


def _with_places(rows: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    """Each node, places with their geometry: a boundary if they have one that parses and isn't empty, else one drawn around the centre, else E2."""
    if boundaries is not None:
        found = boundaries.select("query_id", "node_id", F.col("boundary").alias("f_boundary"), F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"), F.col("radius_km").alias("f_radius"), F.col("level").alias("f_level"))
        rows = rows.join(found, ["query_id", "node_id"], "left")
        rows = rows.withColumns({"inline_geojson": F.coalesce("f_boundary", "inline_geojson"), "center_lon": F.coalesce("f_lon", "center_lon"), "center_lat": F.coalesce("f_lat", "center_lat"), "radius_km": F.coalesce("f_radius", "radius_km"), "level": F.coalesce("f_level", "level")})
    place = F.col("node_type") == "NamedPlace"
    drawn = K.call("DrawnPlace", F.col("center_lon"), F.col("center_lat"), C.effective_radius_km(F.col("level"), F.col("radius_km")))
    geom = _let(K.from_geojson(F.when(place, F.col("inline_geojson"))), lambda g: F.when(~K.call("Empty", g), g).when(place, drawn))
    return rows.withColumn("geom", geom).withColumn("status", F.when(place & F.col("geom").isNull(), "E2"))


def evaluate_trees(trees: DataFrame, coastline: DataFrame | None = None, mode: str = "permissive") -> DataFrame:
    """(query_id, geom, kind, status) of (query_id, tree)."""
    return evaluate_nodes(flatten(trees), coastline, mode=mode)
