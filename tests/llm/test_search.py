"""Ranked search against a plain ranking of all documents."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import ranked_search
from placeweave.llm.common import saved

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(data):
    return [t.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for t in TERM.findall(data or b"")]


def plain(docs, queries, k):
    all_ = [(i, terms(t)) for i, t in docs]
    held, total = sum(bool(t) for _, t in all_), sum(len(t) for _, t in all_)
    out = []
    for item, text in queries:
        found = []
        for i, mine in all_:
            score = 0
            for t in set(terms(text)) & set(mine):
                df = sum(t in other for _, other in all_)
                m = 10 + 90 * len(mine) * held // total
                score += math.floor(1000 * math.log((2 * held + 2) / (2 * df + 1))) * (10**9 * mine.count(t) // (1000 * mine.count(t) + 8 * m))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def data():
    draw = random.Random(3)
    word = lambda: draw.choice(["a", "B", "the", "Été", "x1", "the", "of"]) + draw.choice(["", "", str(draw.randint(0, 40))])
    some = lambda n: draw.choice([" ", "-", "\n"]).join(word() for _ in range(n)).encode()
    docs = [(i, some(draw.randint(1, 40))) for i in range(150)]
    docs += [(i + 500, docs[7][1]) for i in range(30)] + [(3, docs[7][1]), (3, docs[7][1]), (None, docs[7][1]), (None, None), (900, b""), (901, b"- ."), (902, b"\xff a \xc3"), (903, some(5000))]
    queries = [(i, some(6)) for i in range(12)] + [(50, docs[7][1]), (50, docs[7][1]), (None, b"the of"), (51, None), (52, b"?"), (53, b"nowhere"), (54, b"\xff")]
    return docs, queries


def frames(spark, docs, queries):
    d = spark.createDataFrame([(*r, "own", 1) for r in docs], "doc_id long, raw binary, terms string, score int").withColumn("text", F.expr("cast(raw as string)"))
    q = spark.createDataFrame([(*r, "own", 1) for r in queries], "item_id long, raw binary, terms string, rank int").withColumn("text", F.expr("cast(raw as string)"))
    return saved(d), saved(q)


@pytest.mark.parametrize(("shard_bytes", "block_terms", "k"), [(None, None, 10), (500, 9, 10), (1, None, 3)])
def test_equals_plain_ranking(spark, shard_bytes, block_terms, k):
    docs, queries = data()
    d, q = frames(spark, docs, queries)
    index = ranked_search.Index.build(d.repartition(3), shard_bytes=shard_bytes)
    assert index.shards.count() > (100 if shard_bytes == 1 else 2 if shard_bytes else 0)
    got = ranked_search.search(index, q, k, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == plain(docs, queries, k)


def test_empty_tables_and_later_sessions(spark):
    d, q = frames(spark, *data())
    empty = ranked_search.Index.build(d.limit(0))
    assert (empty.held, empty.total) == (0, 0) and ranked_search.search(empty, q).count() == 0
    index = ranked_search.Index.build(d)
    assert ranked_search.search(index, q.limit(0)).count() == 0
    again = ranked_search.Index.open(spark, index.shards.inputFiles()[0].rpartition("/")[0])
    assert (again.held, again.total) == (index.held, index.total) and ranked_search.search(again, q).count() == ranked_search.search(index, q).count()


def test_selection_and_sizes():
    scores = np.array([5, 0, 7, 5, 5, 9, 0, 5])
    assert sorted(ranked_search.top(scores, 4).tolist()) == [0, 2, 3, 5] and sorted(ranked_search.top(scores, 7).tolist()) == [0, 2, 3, 4, 5, 7]
    assert ranked_search.top(scores * 0, 3).tolist() == [] and ranked_search.top(scores[:3], 3).tolist() == [0, 2]
    assert ranked_search._norms(np.array([10**8]), 10**12, 10**14).tolist() == [10 + 90 * 10**6]
