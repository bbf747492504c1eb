"""Codes of vectors against a plain search in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from placeweave.llm import vector_codes
from placeweave.llm.common import saved


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error) of each row and the codebooks' digest."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(((i, [math.floor(256 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            found = [(nearest(cut(v)[p], book)[1], cut(v)[p]) for _, v, _ in kept]
            mine = [[x for e, x in found if e == k] for k in range(len(book))]
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else book[k] for k, m in enumerate(mine)])
        books = new
    out = []
    for i, v, label in kept:
        best = [nearest(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def rows_of(n, length=8):
    draw = random.Random(n)
    rows = [(i, [draw.choice([-1, 1]) * draw.choice([0.0, 0.25, 1 / 256, draw.random(), 40 * draw.random()]) for _ in range(length)], draw.choice([0, 1, None])) for i in range(n)]
    copies = [(n + i, rows[i % min(n, 5)][1], 7) for i in range(40)]
    bad = [(-1, None, 0), (-2, [None] * length, 0), (-3, [math.nan] + [0.0] * (length - 1), 0), (-4, [math.inf] * length, 0), (None, [0.5] * length, None), (2, [0.125] * length, 1), (2, [0.125] * length, 1)]
    return [*rows, *copies, *bad]


@pytest.mark.parametrize(("n", "entries"), [(200, 16), (3, 64), (60, 1)])
def test_equals_plain_search(spark, n, entries):
    rows = rows_of(n)
    table = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    ints = saved(vector_codes.as_integers(table))
    books = vector_codes.fit(ints, 4, entries, 2)
    want, digest = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], 4, entries, 2)
    got = vector_codes.encode(ints, books).collect()
    assert sorted(((r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in got), key=repr) == sorted(want, key=repr) and books.sha256() == digest
    vectors = np.array([r.parts for r in ints.collect()], np.int64)
    codes, off = books.encode(vectors)
    assert ((vectors - books.decode(codes)) ** 2).sum() == off.sum()


def test_large_numbers_and_ties():
    """Distances beyond what single precision tells apart, and entries that are equal."""
    draw = np.random.default_rng(2)
    book = draw.integers(-(1 << 26), 1 << 26, (40, 4))
    book[20:30] = book[:10]
    book[30:] = book[10:20] + 1
    points = np.concatenate([book, (book[:20] + book[20:]) // 2, draw.integers(-(1 << 26), 1 << 26, (9000, 4))])
    at, off = vector_codes.nearest(points, book)
    exact = ((points[:, None] - book) ** 2).sum(2)
    assert (at == exact.argmin(1)).all() and (off == exact.min(1)).all()


def test_odd_tables(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0], 1), (3, [2.0**20, 0.0], 1), (4, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in vector_codes.as_integers(table).collect()] == [1]
    assert vector_codes.as_integers(table.limit(0)).count() == 0
    books = vector_codes.fit(vector_codes.as_integers(table.limit(0)))
    assert vector_codes.encode(vector_codes.as_integers(table.limit(0)), books).count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    uneven = spark.createDataFrame([(i, [float(i), 0.0, -i / 3], 1) for i in range(5)], "vec_id long, embedding array<double>, label int")
    ints = vector_codes.as_integers(uneven)
    assert {r.error for r in vector_codes.encode(ints, vector_codes.fit(ints, 2)).collect()} == {0}
