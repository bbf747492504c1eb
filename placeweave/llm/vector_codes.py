"""Vectors as codes of their parts' nearest entries in codebooks, found by screening in single precision and settled in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, saved, table

#: Parts of a vector, entries of a codebook, rounds of fitting, and what components are multiplied with.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are smaller than this, so that sums of squared differences over up to 511 components fit into 64 bits.
RANGE = 1 << 26
#: Vectors that are compared with a codebook at once.
ROWS = 4096


@dataclass
class Codebooks:
    """For each part of a vector, from ``edges[p]`` to ``edges[p + 1]``, the integer entries, one a row."""

    books: list[np.ndarray]
    edges: list[int]

    @staticmethod
    def first(vectors: np.ndarray, parts: int) -> Codebooks:
        """From vectors whose parts are the entries; where ``parts`` doesn't divide their length, sizes differ by one at most."""
        edges = [vectors.shape[1] * p // parts for p in range(parts + 1)]
        return Codebooks([vectors[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], edges)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry's number for each part of each vector, and the squared distances."""
        found = [nearest(vectors[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The entries that codes stand for, as vectors again."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)

    def sha256(self) -> str:
        """Of all components as decimal text, by part, entry and place in the part."""
        return hashlib.sha256(",".join(str(c) for book in self.books for c in book.ravel().tolist()).encode()).hexdigest()


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first of the entries at the least squared distance, and that distance, both exact.

    A distance less the point's own square is |c|^2 - 2 x.c. Its value in
    single precision, by one matrix product, is off by no more than
    (w + 5) u (|c|^2 + 2 |x| |c|) for points of w components, with u = 2^-24
    and terms in u^2 left to the slack of three more u; norms bound the sums
    of absolute products in whatever order they are added. Entries whose
    interval overlaps that of the least upper end are measured in integers.
    """
    at, out = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    square = (book * book).sum(1)
    size = np.sqrt(square.astype(np.float64))
    entries, squares = book.astype(np.float32).T, square.astype(np.float32)
    unit = (book.shape[1] + 8) * 2.0**-24
    for a in range(0, len(points), ROWS):
        x = points[a : a + ROWS]
        value = (squares - np.float32(2) * (x.astype(np.float32) @ entries)).astype(np.float64)
        off = unit * (square + 2 * np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * size)
        row, entry = np.nonzero(value - off <= (value + off).min(1)[:, None])
        exact = ((x[row] - book[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == least[row])
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
        at[a : a + ROWS], out[a : a + ROWS] = entry[first], least
    return at, out


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), length)


def _sums(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """For each entry the sums of its parts' components, and their number, each as a slot of its own."""
    books: Codebooks = shared.value
    n, length = len(books.books[0]), books.edges[-1]
    for batch in batches:
        vectors = _matrix(batch.column(0), length)
        codes, _ = books.encode(vectors)
        sums, counts = np.zeros((n, length), np.int64), np.zeros((n, len(books.books)), np.int64)
        for p, (a, b) in enumerate(zip(books.edges[:-1], books.edges[1:], strict=True)):
            np.add.at(sums[:, a:b], codes[:, p], vectors[:, a:b])
            counts[:, p] = np.bincount(codes[:, p], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * (length + counts.shape[1]))), pa.array(np.concatenate([sums.ravel(), counts.ravel()]))], ["slot", "value"])


def _codes(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    books: Codebooks = shared.value
    for batch in batches:
        codes, off = books.encode(_matrix(batch.column(2), books.edges[-1]))
        text = [bytes(c) for c in codes.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary()), pa.array(off.sum(1))], ["vec_id", "label", "code", "error"])


def as_integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, parts) of the vectors that have finite components only, each as the integer under ``scale`` times it.

    Null vectors and those with a null or non-finite component are dropped,
    and so are integers of RANGE or more, whose distances 64 bits may not
    hold. Vectors have the length of the one that comes first (smallest id,
    null ids last, then by components); others are dropped.
    """
    ok = F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < RANGE // scale, F.lit(False))), F.lit(False))
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = vectors.filter(ok).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), parts.alias("parts"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").select(F.size("parts")).first()
    return rows.filter(F.size("parts") == (first[0] if first else 0))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that begin as the parts of the ``entries`` first vectors and move to their parts' means, rounded down, ``rounds`` times.

    Unused entries stay. Fewer vectors make fewer entries. Only sums of
    entries come to the driver: at most ``entries`` times (length + ``parts``) numbers.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").select("parts").limit(entries).collect()
    length = len(start[0].parts) if start else 0
    books = Codebooks.first(np.array([r.parts for r in start], np.int64).reshape(len(start), length), parts)
    n = len(start)
    for _ in range(rounds if start else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("parts").mapInArrow(lambda b, s=shared: _sums(b, s), "slot long, value long")
        got = {r.slot: int(r.value) for r in sums.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
        for p, (a, b) in enumerate(zip(books.edges[:-1], books.edges[1:], strict=True)):
            book = books.books[p].copy()
            for e in range(n):
                if used := got[n * length + e * parts + p]:
                    book[e] = [got[e * length + c] // used for c in range(a, b)]
            books.books[p] = book
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of each row: a byte for each part, and the squared distance to what the code stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    return rows.select("vec_id", "label", "parts").mapInArrow(lambda b: _codes(b, shared), kinds)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is kept; null labels are one label."""
    rows = saved(as_integers(table(spark, sf_dir, "embeddings")))
    books = fit(rows)
    codes = saved(encode(rows, books).withColumn("of", F.struct("label")))
    sums = saved(codes.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    found = join_hot(codes, sums, "of", "n")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"u AS (SELECT r, vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // {PARTS} AS w FROM v)",
        f"c AS (SELECT r, i // w AS p, i % w AS j, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM u)",
        f"b0 AS (SELECT p, j, r AS k, x AS y FROM c WHERE r < {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps += [
            f"d{n} AS (SELECT r, c.p, k, sum((x - y) * (x - y))::BIGINT AS d FROM c JOIN b{n} b ON c.p = b.p AND c.j = b.j GROUP BY r, c.p, k)",
            f"a{n} AS (SELECT r, p, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY d, k) AS nth FROM d{n}) WHERE nth = 1)",
        ]
        if n < ROUNDS:
            steps += [
                f"m{n} AS (SELECT a.p, j, k, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} a JOIN c ON a.r = c.r AND a.p = c.p GROUP BY a.p, j, k)",
                f"b{n + 1} AS (SELECT b.p, b.j, b.k, CASE WHEN s IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.j = m.j AND b.k = m.k)",
            ]
    return "WITH " + ",\n".join(steps) + f""",
g AS (SELECT r, string_agg(lower(lpad(to_hex(k), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM g JOIN v USING (r), h
"""


OP12_SQL = _sql()
