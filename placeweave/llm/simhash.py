"""SimHash near-duplicates: one-wildcard segment signatures, an equality join, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, join_hot, raw_texts, saved, table, text_batches

BITS = 64
#: Fingerprints of one signature that are compared with each other at once; larger groups are cut into blocks, and each pair of blocks is compared.
BLOCK = 1024


def fingerprint(text: str | bytes | None, size: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of the text's word shingles, repeats included; 0 without words. Bytes that are no UTF-8 are bytes of words like any others."""
    words = (text.encode("utf-8", "replace") if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        cuts = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + size - 1 : at + size - 1 + (1 << 16)].tolist(), strict=False)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in cuts]), np.uint8)
        ones += np.unpackbits(hashes).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        found = np.array([fingerprint(t, size) for t in raw_texts(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; a null text has the fingerprint 0, as one without words."""
    kind = docs.schema[doc_id].dataType
    key = F.col(doc_id) if isinstance(kind, StructType) else F.col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(fps: np.ndarray, other: np.ndarray | None, limit: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints within ``limit`` bits of each other as all such links do, in one block or between two."""
    if other is None and len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if (int(fps[0]) ^ int(fps[1])).bit_count() <= limit else []
    right = fps if other is None else other
    names = np.concatenate([fps, right]) if other is not None else fps
    shift = len(fps) if other is not None else 0
    root = np.arange(len(names))
    out = []
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(right ^ fps[i]) <= limit) + shift
        if other is None:
            near = near[near > i]
        if not len(near):
            continue
        mine = root[i]
        new = near[root[near] != mine]
        if len(new):
            _, first = np.unique(root[new], return_index=True)
            out += [(int(fps[i]), int(names[j])) for j in new[first]]
            root[np.isin(root, root[new])] = mine
    return out


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs: list[tuple[int, int]] = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            pairs += _forest(np.array(left, np.int64).view(np.uint64), None if right is None else np.array(right, np.int64).view(np.uint64), limit)
        got = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def signatures(fps: DataFrame, limit: int = 3) -> DataFrame:
    """(sig, fp): one signature for each segment and each bit of it left out.

    ``limit`` differing bits over limit // 2 + 1 segments leave one segment
    with at most one, so two linked fingerprints share a signature.
    """
    segments = limit // 2 + 1
    edges = [BITS * i // segments for i in range(segments + 1)]
    masks = []
    for s in range(segments):
        whole = ((1 << (edges[s + 1] - edges[s])) - 1) << edges[s]
        masks += [(s * BITS + bit, (whole & ~(1 << bit)) - (1 << 64 if whole & ~(1 << bit) >= 1 << 63 else 0)) for bit in range(edges[s], edges[s + 1])]
    table_ = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in masks])
    each = fps.select("fp", F.explode(table_).alias("w"))
    return each.select(F.col("w.i").alias("seg"), F.col("fp").bitwiseAND(F.col("w.m")).alias("part"), "fp")


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the same components as all pairs within ``limit`` bits.

    Fingerprints meet by equality of a signature. Within one, pairs are
    verified by their differing bits, and only a spanning forest is passed on:
    no group emits all its pairs. A group of more than BLOCK fingerprints is
    cut into blocks; each pair of blocks is a row of its own and may be
    compared anywhere, so no group has to fit into one task.
    """
    sig = signatures(fps, limit)
    sizes = sig.groupBy("seg", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Sizes are estimated from before the explosion: without the hint Spark may broadcast all signatures.
    sized = sig.join(sizes.hint("merge"), ["seg", "part"])
    blocks = sized.select("seg", "part", "fp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).alias("block"), F.ceil(F.col("n") / BLOCK).alias("of"))
    packed = blocks.groupBy("seg", "part", "block", "of").agg(F.collect_list("fp").alias("fps"))
    small = packed.filter("of = 1").select(F.col("fps").alias("left"), F.lit(None).cast("array<long>").alias("right"))
    big = saved(packed.filter("of > 1"))
    # Each block is paired with itself and with each later block of its signature.
    one = big.select("seg", "part", "of", F.col("block").alias("i"), F.col("fps").alias("left"), F.explode(F.sequence("block", F.col("of") - 1)).alias("block"))
    two = one.join(big.select("seg", "part", "block", F.col("fps").alias("right")).hint("merge"), ["seg", "part", "block"])
    large = two.select("left", F.when(F.col("i") != F.col("block"), F.col("right")).alias("right")).repartition(F.rand(7))
    find = lambda b: _links(b, limit)
    return small.mapInArrow(find, "a long, b long").unionByName(large.mapInArrow(find, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that links (a, b) touch: the least node that each reaches.

    Each takes the least label of its neighbours, then the label's own label,
    until none changes. Repeated and reversed links count once; without links
    there are no rows.
    """
    pairs = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = saved(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        of_v = labels.select(F.col("u").alias("v"), F.col("label").alias("near"))
        near = pairs.join(of_v, "v").groupBy("u").agg(F.min("near").alias("near"))
        hooked = labels.join(near, "u").select("u", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("u").alias("new"), F.col("label").alias("far"))
        after = saved(hooked.join(jump, "new", "left").select("u", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        changed = after.filter("new <> label").limit(1).count()
        labels = after.select("u", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def near_groups(docs: DataFrame, size: int = 3, limit: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component) of each row: the smallest doc_id that links of at most ``limit`` bits reach.

    Null and empty texts share the fingerprint 0, linked like any other. Rows
    of one fingerprint are one node, so copies cost nothing, and rows that
    repeat an id are linked by their texts alone. A row with a null doc_id
    links like any other and gets the smallest id of its component; where all
    ids of a component are null, so is it. An empty table gives no rows.
    Other columns are not read.
    """
    rows = saved(fingerprints(docs, size, doc_id, text))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    grouped = saved(_grouped(nodes, limit))
    least = saved(grouped.groupBy("group").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("members")))
    named = saved(join_hot(grouped, least, "group", "members").select("fp", "n", "component"))
    return join_hot(rows, named, "fp", "n").select("doc_id", "fp", "component")


def _grouped(nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes`` (fp, ...), one for each fingerprint, with the component of each as ``group``."""
    found = components(saved(links(nodes.select("fp"), limit)))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp")).drop("component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document, by shingles of three words and links of at most 3 bits."""
    rows = near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, limit: int = 3) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns, whatever their names.

    Of rows that repeat that id one stays; where all ids of a group are null,
    so does one. An empty table gives no rows.
    """
    row = free_name(docs, "_row")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = fingerprints(numbered.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row")).alias("doc_id"), "text"), size)
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    best = _grouped(nodes, limit).groupBy("group").agg(F.min("first").alias("best"))
    return numbered.join(best.select(F.col("best.row").alias(row)), row, "left_semi").drop(row)
