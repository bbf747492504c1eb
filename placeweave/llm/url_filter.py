"""URL allow and block rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Hex digits of the digest that the join uses; the rest is compared after it.
PREFIX_DIGITS = 8
#: Rules that are broadcast; a larger table meets the expressions in a shuffle.
BROADCAST_RULES = 100_000

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end; then the path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    return lower_ascii(host), F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise(F.lit(""))


def hashed(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with digest and ``rank``, higher for the rule that wins.

    The longest expression wins, then the longest host, then block over allow.
    The same host and path twice leaves the stricter verdict. Rules with a
    null or empty host, or whose path doesn't start with ``/``, fit no url.
    """
    expr = F.concat("host", "path")
    return (
        rules.withColumn("host", lower_ascii(F.col("host")))
        .filter((F.length("host") > 0) & F.startswith("path", F.lit("/")))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            F.sha2(expr, 256).alias("digest"), F.substring(F.sha2(expr, 256), 1, PREFIX_DIGITS).alias("prefix"), expr.alias("rule"), "verdict",
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
            (F.length(expr).cast("long") * (1 << 20) + F.length("host")).alias("rank"),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keys: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keys``, host, path, rule and verdict of each row.

    Each url is expanded into the host suffixes and path prefixes of those
    label counts and lengths that rules have; the expressions meet the rules
    by an equi-join on a short hash prefix, full digests are compared, and the
    rule of the highest rank gives the verdict, ``default`` where none fits.
    A null url, or one without ``://``, has an empty host and path. Each row
    gives one row, repeated ones and those with null keys too. An empty table
    gives no rows; without rules all get the default. Extra columns are not read.
    """
    found = hashed(rules)
    shapes = [[r.labels, r.path_length] for r in found.select("labels", "path_length").distinct().collect()]  # pairs of small numbers, however many rules
    found = found.select("prefix", "digest", F.struct("rank", "rule", "verdict").alias("_fit"))
    if found.count() <= BROADCAST_RULES:
        found = F.broadcast(found)
    host, path = url_parts(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_labels", F.size(F.split("_host", r"\.")))
    known = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in sorted(shapes)])), "array<struct<n:int,m:int>>")
    there = F.filter(known, lambda s: (F.col("_labels") >= s["n"]) & (F.length("_path") >= s["m"]))
    rows = rows.withColumn("_shape", F.explode_outer(there))  # a row without any keeps one null, which fits no rule
    each = rows.withColumn("_digest", F.sha2(F.expr("concat(substring_index(_host, '.', -_shape.n), substring(_path, 1, _shape.m))"), 256))
    pairs = each.join(found, (F.substring("_digest", 1, PREFIX_DIGITS) == F.col("prefix")) & (F.col("_digest") == F.col("digest")), "left")
    # The expressions of a row are in one partition, so all but one row each end in the partial aggregate.
    own = ["_row", *[f"_k{i}" for i in range(len(keys))], "_host", "_path"]
    best = pairs.groupBy(*own).agg(F.max("_fit").alias("_fit"))
    named = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    return best.select(*named, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A few rules as a DataFrame, made by SQL functions alone."""
    one = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*one)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page by RULES."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def _op5_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    host = f"translate(host, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {values}),
a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT r, page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT r, page_id, {host} AS host, path FROM b),
f AS (SELECT c.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM c LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE k = 1
"""


OP5_SQL = _op5_sql()

__all__ = ["BROADCAST_RULES", "OP5_SQL", "RULES", "hashed", "judge_urls", "op5_url_filter", "rule_table", "url_parts"]
