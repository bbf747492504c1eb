"""Spatial joins by a hierarchy of cells, with hot cells and hot rows cut in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import kernel as K
from placeweave.storage import saved

#: A cell of level n has a side of 2 ** -n degrees; a geometry's level is the deepest, within these, whose cells are no smaller than its bounding box.
COARSEST, FINEST = -40, 20
#: A key is hot when it has more than one in so many of a side's rows; so a side has fewer hot keys than this.
HOT_KEYS = 1024
#: Rows of both sides together that are joined without a search for hot keys.
FEW = 200_000


def _cut(rows: DataFrame, keys: list[str], parts: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Rows with the hot keys' ``parts``: each row is in one part of its own side, and in all of the other side's."""
    joined = rows.join(F.broadcast(parts), keys, "left")
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(mine, F.lit(1)))
    return joined.withColumn(f"_{mine}", own).withColumn(f"_{theirs}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(theirs, F.lit(1)) - 1))).drop(mine, theirs)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` of two tables that are saved or quickly read again, safe for keys that a large share of either side has.

    A key with n of a side's N rows is cut into n * HOT_KEYS / N parts there
    if that is more than one, and the other side's rows of that key go to each
    part. Hot keys are fewer than 2 * HOT_KEYS, so they are broadcast.
    """
    counts = [side.agg(F.count(F.lit(1))).first()[0] for side in (left, right)]
    if sum(counts) <= FEW:
        return left.join(right, keys)
    hot = []
    for side, n, name in zip((left, right), counts, ("parts_l", "parts_r"), strict=True):
        parts = F.ceil(F.count(F.lit(1)) * HOT_KEYS / F.lit(max(n, 1)))
        hot.append(side.groupBy(*keys).agg(parts.alias(name)).filter(F.col(name) > 1))
    parts = saved(hot[0].join(hot[1], keys, "full_outer").select(*keys, F.coalesce("parts_l", F.lit(1)).alias("parts_l"), F.coalesce("parts_r", F.lit(1)).alias("parts_r")))
    a = _cut(left, keys, parts, "parts_l", "parts_r")
    b = _cut(right, keys, parts, "parts_r", "parts_l")
    return a.join(b, [*keys, "_parts_l", "_parts_r"]).drop("_parts_l", "_parts_r")


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def _numbered(rows: DataFrame, geom: str, name: str) -> DataFrame:
    """``rows`` saved with a number, ``geom`` in place of its column "geom", the bounding box, and ``own``, the box's level; null for no box."""
    rows = rows.withColumnRenamed("geom", geom).withColumn(name, F.monotonically_increasing_id()).withColumn("_m", K.measures(geom))
    rows = rows.withColumn("_box", F.when(F.col("_m.minx").isNotNull(), F.struct("_m.minx", "_m.miny", "_m.maxx", "_m.maxy"))).drop("_m")
    size = F.greatest(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"))
    level = F.when(size > 0, F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), F.floor(-F.log2(size))))).otherwise(FINEST)
    return saved(rows.withColumn("_own", F.when(F.col("_box").isNotNull(), level.cast("int"))))


def _cells(boxes: DataFrame, name: str, box: str, above: list[int], strict: bool, own_first: bool) -> DataFrame:
    """(cell, name, box): each box in the cells that it touches, at most four a level: at its own level, and at each of the other side's levels above.

    ``turn`` tells the two ways to meet apart: the left side at its own level
    and the right one at a level no finer than its own, or the right side at
    its own level and the left one at a coarser one.
    """
    own = F.array(F.struct(F.lit(0 if own_first else 1).alias("turn"), F.col("_own").alias("level")))
    higher = [F.when(F.lit(n) < F.col("_own") if strict else F.lit(n) <= F.col("_own"), F.struct(F.lit(1 if own_first else 0).alias("turn"), F.lit(n).alias("level"))) for n in above]
    at = F.concat(own, F.filter(F.array(*higher), lambda x: x.isNotNull())) if higher else own
    rows = boxes.filter("_own is not null").select(name, "_box", "_own", F.explode(at).alias("at")).withColumn("s", _side(F.col("at.level")))
    span = lambda a, b: F.sequence(F.floor(F.col(f"_box.{a}") / F.col("s")), F.floor(F.col(f"_box.{b}") / F.col("s")))
    return rows.select("*", F.explode(span("minx", "maxx")).alias("cell_x")).select("*", F.explode(span("miny", "maxy")).alias("cell_y")).select("at.turn", "at.level", "cell_x", "cell_y", name, F.col("_box").alias(box))


def spatial_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose geometries intersect, each once: (left columns, right columns), where ``geom`` is l_geom and r_geom.

    Rows meet by equality of cells, at the level of the one of the larger box,
    so that a cell holds what is of about its size or finer; neither side is
    broadcast by demand. A pair counts in the cell that has the lower left
    corner of what the two boxes share. Cells hold boxes and row numbers only:
    pairs whose boxes meet find their rows again by number, and only then are
    geometries compared. Null and empty geometries meet nothing; rows that
    repeat are rows of their own. Columns of both sides need different names.
    """
    K.register(left.sparkSession)
    a, b = _numbered(left, "l_geom", "_l"), _numbered(right, "r_geom", "_r")
    found = a.select(F.lit("l").alias("side"), "_own").unionByName(b.select(F.lit("r").alias("side"), "_own")).filter("_own is not null").distinct().collect()  # at most FINEST - COARSEST + 1 a side
    levels = {side: sorted(r._own for r in found if r.side == side) for side in "lr"}
    met = spread_join(_cells(a, "_l", "lb", levels["r"], True, True), _cells(b, "_r", "rb", levels["l"], False, False), ["turn", "level", "cell_x", "cell_y"])
    s = _side(F.col("level"))
    own = (F.col("cell_x") == F.floor(F.greatest("lb.minx", "rb.minx") / s)) & (F.col("cell_y") == F.floor(F.greatest("lb.miny", "rb.miny") / s))
    boxes = (F.col("lb.minx") <= F.col("rb.maxx")) & (F.col("rb.minx") <= F.col("lb.maxx")) & (F.col("lb.miny") <= F.col("rb.maxy")) & (F.col("rb.miny") <= F.col("lb.maxy"))
    pairs = saved(met.filter(own & boxes).select("_l", "_r"))
    whole = spread_join(pairs, a.drop("_box", "_own"), ["_l"])
    if pairs.count() > FEW:
        whole = saved(whole)  # counted, and read again
    whole = spread_join(whole, b.drop("_box", "_own"), ["_r"])
    return whole.filter(K.call("Intersects", "l_geom", "r_geom")).drop("_l", "_r")
