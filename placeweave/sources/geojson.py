"""Features of GeoJSON collections of any size, each file read by as many tasks as it has splits.

Spark's text reader cuts a file at its closing braces and gives each split its
own pieces. Whether a split starts in a string, and how deep, follows from the
splits before it: a first pass sums each one up for both cases, a fold over a
file's sums (one row a split) gives the states, and a second pass cuts out the
features. Only features that go over the edge of a split meet in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.storage import saved

#: A feature is an object in an array of the outermost object.
LEVEL = 3
_SUMS = "path string, start long, quotes int, plain_rise long, plain_least long, quoted_rise long, quoted_least long"
_STATES = "path string, start long, quoted boolean, level long, owner long"
_PARTS = "path string, owner long, start long, whole boolean, part binary"


def _levels(text: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes outside of strings, else spaces; the change of the level up to each byte; the number of quotes up to it)."""
    raw = np.frombuffer(text, np.uint8)
    if b"\\" in text:
        raw = raw.copy()
        raw[[m.start() + 1 for m in re.finditer(rb"\\.", text, re.DOTALL)]] = 32
    quotes = np.cumsum(raw == 34)
    code = np.where((quotes + quoted) % 2 == 0, raw, 32)
    step = ((code == 123) | (code == 91)).astype(np.int64) - ((code == 125) | (code == 93))
    return code, np.cumsum(step), quotes


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Each batch's pieces by split, in order, as (the split's columns, its text)."""
    for batch in batches:
        columns = batch.to_pydict()
        values = columns.pop("value")
        keys = list(zip(*columns.values()))
        for key, rows in groupby(range(len(values)), keys.__getitem__):
            yield key, b"".join(values[i] + b"}" for i in rows)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}
    for key, text in _runs(batches):
        s = found.setdefault(key, [0, 0, 0, 0, 0])
        for k, case in ((1, False), (3, True)):
            _, change, quotes = _levels(text, case ^ bool(s[0] % 2))
            s[k + 1] = min(s[k + 1], s[k] + int(change.min()))
            s[k] += int(change[-1])
        s[0] += int(quotes[-1])
    rows = [[*key, s[0] % 2, *s[1:]] for key, s in found.items()]
    names = [c.split()[0] for c in _SUMS.split(", ")]
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"quotes": "int32"}), preserve_index=False)


def _states(sums: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of a file; its owner is the split in which the feature that is open there began."""
    quoted, level, owner, out = False, 0, -1, []
    for s in sums.sort_values("start").itertuples():
        out.append((s.path, s.start, quoted, level, owner))
        least, rise = (s.quoted_least, s.quoted_rise) if quoted else (s.plain_least, s.plain_rise)
        if level + least < LEVEL:
            owner = s.start
        quoted, level = quoted ^ bool(s.quotes), level + rise
    return pd.DataFrame(out, columns=["path", "start", "quoted", "level", "owner"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("part", pa.binary())])
    now, out = None, []

    def left() -> list[tuple]:
        """What is open at the end of a split goes on in the next one."""
        return [(now[0], owner, now[1], False, b"".join(pending))] if pending else []

    quoted, level, owner, pending = False, 0, -1, []
    for key, text in _runs(batches):
        if key != now:
            out += left()
            now, (_, _, quoted, level, owner), pending = key, key, []
            head = level >= LEVEL
        code, change, quotes = _levels(text, quoted)
        depth = level + change
        begins = np.flatnonzero((code == 123) & (depth == LEVEL))
        ends = np.flatnonzero((code == 125) & (depth == LEVEL - 1)) + 1
        # Ends come before a begin only for the feature that is open already.
        if level >= LEVEL:
            begins = np.concatenate([[0], begins])
        for begin, end in zip(begins, ends):
            part = b"".join([*pending, text[begin:end]])
            out.append((now[0], owner if head else now[1], now[1], not head, part))
            head, pending = False, []
        if len(begins) > len(ends):
            pending.append(text[begins[-1] :])
            owner = owner if head else now[1]
        quoted, level = quoted ^ bool(quotes[-1] % 2), int(depth[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if now and (out := left()):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_features(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """(geometry string, properties) of each Feature of the feature collections in a file or folder.

    ``properties`` is the schema in which they are read; without it they stay
    JSON text. A file may have several collections one after another. Features
    without a geometry have null, as have members of a feature that are absent.
    What isn't a Feature in an array of the outermost object is left out; of a
    file that breaks off, the features that are complete are read.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    states = text.mapInArrow(_sums, _SUMS).groupBy("path").applyInPandas(_states, _STATES)
    # One row a split is broadcast: the rows of a split have to stay in order.
    rows = text.join(F.broadcast(states), ["path", "start"]).select("path", "start", "quoted", "level", "owner", "value")
    parts = saved(rows.mapInArrow(_parts, _PARTS))
    cut = parts.filter("not whole").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("many"))
    joined = cut.select(F.aggregate("many.part", F.lit(b""), lambda whole, part: F.concat(whole, part)).alias("part"))
    js = parts.filter("whole").select("part").unionByName(joined).select(F.col("part").cast("string").alias("js"))
    feature = js.filter("get_json_object(js, '$.type') = 'Feature'")
    members = F.get_json_object("js", "$.properties")
    return feature.select(F.get_json_object("js", "$.geometry").alias("geometry"), (F.from_json(members, properties) if properties else members).alias("properties"))


def _collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines, between = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"]), ""
    yield lines(['{"type":"FeatureCollection","features":['])
    for batch in batches:
        if batch.num_rows:
            first, *rest = batch.column(0).to_pylist()
            yield lines([between + first, *["," + feature for feature in rest]])
            between = ","
    yield lines(["]}"])


def write_features_as_collections(features: DataFrame, path: str) -> None:
    """A file with one collection for each partition of ``features`` (one column of JSON text), be it of nothing; nothing is shuffled."""
    features.filter(F.col(features.columns[0]).isNotNull()).mapInArrow(_collection, "value string").write.text(path)
