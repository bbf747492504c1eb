"""``python -m placeweave [--tables FOLDER] [--out FOLDER] TEXT...``: evaluate one description; writes output.geojson and map.html.

FOLDER has the tables that places are looked up in (see Engine.of_tables). It
may be named by spark.placeweave.tables or PLACEWEAVE_TABLES as well. Ends
with 1, and the status, where the description has no geometry.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from placeweave.engine import Engine, features, map_pages, summaries
from placeweave.storage import saved


def main(argv: list[str]) -> int:
    asked = argparse.ArgumentParser(prog="placeweave", description=__doc__)
    asked.add_argument("--tables")
    asked.add_argument("--out", default=".")
    asked.add_argument("text", nargs="*")
    given = asked.parse_args(argv)
    if not given.text:
        asked.print_help()
        return 1
    spark = SparkSession.builder.getOrCreate()
    folder = given.tables or spark.conf.get("spark.placeweave.tables", None) or os.environ.get("PLACEWEAVE_TABLES")
    engine = Engine.of_tables(spark, folder) if folder else Engine()
    rows = saved(engine.evaluate(spark.createDataFrame([("0", " ".join(given.text))], "query_id string, text string")))
    status = rows.first()["status"]
    if status:
        print(status)
        return 1
    Path(given.out).mkdir(parents=True, exist_ok=True)
    Path(given.out, "output.geojson").write_text(features(rows).first()["feature"], "utf-8")
    Path(given.out, "map.html").write_text(map_pages(rows).first()["html"], "utf-8")
    print(summaries(rows).first()["summary"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
