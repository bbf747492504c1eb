"""Packing of token sequences: exact complements by length sums, then best fit."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import raw_texts, saved, table, text_batches
from .tokens import Encoder

CAPACITY = 2048
#: Ends each document.
END = b"\0\0\0\0"


class Sums:
    """An index of the available lengths: which single lengths, pairs and triples have each sum.

    ``pairs[s]`` marks the larger length of each pair of sum ``s``, and
    ``triples[s]`` the largest of each triple. A pair or triple needs a length
    as often as it has it. Lengths only run out, so a triple's mark is made
    once, before any is taken, and removed when it is found to hold no longer.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.left, self.size = counts, len(counts)
        s, n = np.ogrid[: self.size, : self.size]
        self.halves = (n >= s - n) & (n < s)
        self.pairs = np.zeros((self.size, self.size), bool)
        for length in range(1, self.size):
            self._set_pairs(length)
        # A length is the largest of a triple where the rest has a pair with none larger.
        least = np.where(self.pairs.any(1), self.pairs.argmax(1), self.size)
        self.triples = (n <= s) & (counts[n] > 0) & (least[np.maximum(s - n, 0)] <= n)

    def _set_pairs(self, n: int) -> None:
        """Mark anew the pairs that have the length ``n``."""
        other = np.arange(1, self.size - n)
        there = (self.left[other] > (other == n)) & (self.left[n] > 0)
        self.pairs[n + other, np.maximum(n, other)] = there & self.halves[n + other, np.maximum(n, other)]

    def take(self, lengths: tuple[int, ...], many: int) -> None:
        """Use up ``many`` times these lengths; pairs change only where a length has none or one left."""
        for n in lengths:
            self.left[n] -= many
        for n in set(lengths):
            if self.left[n] < 2:
                self._set_pairs(n)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to ``gap``, the fewest and largest first."""
        if self.left[gap] > 0:
            return (gap,)
        found = np.flatnonzero(self.pairs[gap])
        if len(found):
            return int(found[-1]), int(gap - found[-1])
        for a in np.flatnonzero(self.triples[gap] & (self.left > 0))[::-1].tolist():
            for b in np.flatnonzero(self.pairs[gap - a][: a + 1])[::-1].tolist():
                whole = a, b, gap - a - b
                if all(self.left[n] >= k for n, k in Counter(whole).items()):
                    return whole
            self.triples[gap, a] = False
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such sequences), from how many pieces have each length.

    From the longest length down, single lengths, pairs and triples that
    exactly fill what it leaves are taken as often as they are available.
    What remains goes by best fit, longest first: into the open sequences
    with the least room that suffices. Each step uses up a length or a kind
    of sequence, so the plan has no more steps than a few times ``capacity``,
    however many pieces there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"a piece of {n} tokens doesn't fit {capacity}")
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = Sums(left)
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            index.take((n,), 1)  # one is in hand while its complement is sought
            found = index.exact(capacity - n)
            index.take((n,), -1)
            if not found:
                break
            whole = (n, *found)
            many = min(int(left[m]) // k for m, k in Counter(whole).items())
            out.append((whole, many))
            index.take(whole, many)
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity, 0, -1):
        while left[n]:
            gap = min((g for g in room if g >= n), default=None)
            if gap is None:
                fits = capacity // n
                many, odd = divmod(int(left[n]), fits)
                for lengths, k in (((n,) * fits, many), ((n,) * odd, 1 if odd else 0)):
                    if k:
                        room.setdefault(capacity - n * len(lengths), []).append((lengths, k))
                left[n] = 0
                break
            lengths, k = room[gap].pop()
            if not room[gap]:
                del room[gap]
            each = min(gap // n, max(1, int(left[n]) // k))  # as many as fit into each of them
            used = min(k, int(left[n]) // each)
            left[n] -= used * each
            room.setdefault(gap - n * each, []).append((lengths + (n,) * each, used))
            if k > used:
                room.setdefault(gap, []).append((lengths, k - used))
    return out + [x for kinds in room.values() for x in kinds]


def intervals(steps: list[tuple[tuple[int, ...], int]]) -> pa.Table:
    """Where the pieces of each length go: ranks from ``first`` on have sequence ``sequence`` + (rank - first) at ``offset``."""
    used: Counter = Counter()
    rows: dict[str, list[int]] = {k: [] for k in ("length", "first", "sequence", "offset")}
    sequence = 0
    for lengths, many in steps:
        offset = 0
        for n in lengths:
            for k, x in zip(rows, (n, used[n], sequence, offset), strict=True):
                rows[k].append(x)
            used[n] += many
            offset += n
        sequence += many
    return pa.table(rows).sort_by([("length", "ascending"), ("first", "ascending")])


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, paths: tuple[str | None, str | None]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, and how many pieces of that length this partition had before."""
    encoder, part, seen = Encoder.get(*paths), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in text_batches(batches):
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            ids = encoder.encode(text.decode("utf-8", "replace")) + END
            n = len(ids) // 4
            start, cut = 0, n % capacity or capacity
            for piece in range(-(-n // capacity)):
                rows.append((doc_id, piece, start, cut, zlib.crc32(ids[4 * start : 4 * (start + cut)]), part, int(seen[cut])))
                seen[cut] += 1
                start, cut = start + cut, capacity
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A null or empty text is its end token alone. Repeated rows are documents
    of their own. Longer documents are cut into full pieces after a first
    piece with the rest. The driver sees how many pieces each length has, at
    most ``capacity`` numbers, and sends out the plan; pieces are numbered
    within their length by partition counts and their sums, so that no length
    is gathered in one place. An empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(rows.mapInArrow(lambda b: _pieces(b, capacity, paths), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"))
    per = saved(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity
    where = docs.sparkSession.sparkContext.broadcast(intervals(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = (c.to_numpy() for c in where.value.columns)
        keys = (length << 48) + first
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(keys, (own << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`pack` for all documents."""
    return pack(table(spark, sf_dir, "documents"))
