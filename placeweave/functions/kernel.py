"""Geometry functions on WKB columns: JTS, which comes with Spark, called from Java functions."""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
from pathlib import Path

import pyspark
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructType

SOURCE = Path(__file__).parent / "java" / "PlaceKernel.java"
NODE = StructType().add("node_id", StringType()).add("parent_id", StringType()).add("role", StringType()).add("ordinal", IntegerType()).add("depth", IntegerType()).add("post", IntegerType()).add("kids", IntegerType()).add("js", StringType())
FUNCTIONS = {
    "FromGeoJson": BinaryType(), "ToGeoJson": StringType(), "Buffer": BinaryType(), "Intersection": BinaryType(), "Difference": BinaryType(),
    "Intersects": BooleanType(), "Between": BinaryType(), "Union": BinaryType(), "Boundary": BinaryType(), "Measures": ArrayType(DoubleType()),
    "Kind": StringType(), "Empty": BooleanType(), "Areal": BinaryType(), "Pieces": ArrayType(BinaryType()), "Merged": BinaryType(),
    "Nodes": ArrayType(NODE), "DrawnPlace": BinaryType(), "DrawnLookup": BinaryType(),
}


def jar() -> str:
    """The compiled kernel, built once for each state of its source."""
    stamp = hashlib.sha256(SOURCE.read_bytes()).hexdigest()[:16]
    folder = Path(tempfile.gettempdir()).resolve() / f"placeweave-{stamp}"
    out = folder / "kernel.jar"
    if not out.exists():
        work = Path(tempfile.mkdtemp(prefix="placeweave-build-"))
        jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "*")
        subprocess.run(["javac", "-nowarn", "-cp", jars, "-d", str(work / "classes"), str(SOURCE)], check=True, capture_output=True)
        subprocess.run(["jar", "cf", str(work / "kernel.jar"), "-C", str(work / "classes"), "."], check=True, capture_output=True)
        folder.mkdir(exist_ok=True)
        os.replace(work / "kernel.jar", out)
    return str(out)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, as place_buffer and so on; a second call changes nothing."""
    if spark.catalog.functionExists("place_Buffer"):
        return
    spark.sql(f"ADD JAR '{jar()}'")
    for name, kind in FUNCTIONS.items():
        spark.udf.registerJavaFunction(f"place_{name}", f"PlaceKernel${name}", kind)


def call(name: str, *args: Column | str | float) -> Column:
    return F.call_function(f"place_{name}", *[a if isinstance(a, Column) else F.col(a) if isinstance(a, str) else F.lit(a) for a in args])


def from_geojson(text: Column | str) -> Column:
    return call("FromGeoJson", text)


def to_geojson(geom: Column | str) -> Column:
    return call("ToGeoJson", geom)


def measures(geom: Column | str) -> Column:
    """A struct of the bounding box, centroid, area and length."""
    m = call("Measures", geom)
    names = ("minx", "miny", "maxx", "maxy", "cx", "cy", "area", "length")
    return F.transform(F.array(m), lambda a: F.struct(*[a[i].alias(n) for i, n in enumerate(names)]))[0]
