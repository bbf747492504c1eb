"""Tables written down between the stages of a plan, where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of its own for each call, under spark.checkpoint.dir; only a local master does without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows that a task sorts or groups at once, about.
TASK_ROWS = 1 << 17


def tasks_for(rows: int) -> int:
    """How many tasks ``rows`` are dealt to, so that none holds more as tables grow."""
    return 1 + rows // TASK_ROWS


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
