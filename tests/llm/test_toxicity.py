"""Both Kneser-Ney models against plain Python: probabilities, sums to 1, scores; accuracy on rows held out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from placeweave.llm import toxicity
from placeweave.llm.common import saved
from placeweave.llm.hashed import word_hashes


def corpus(n=400):
    draw = random.Random(3)
    rows = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        seq = draw.choices(["sun", "sea", "hill", "road", "far"], k=30) + [f"once{i}"]
        for k in range(3):
            seq.insert(draw.randrange(30), "vile" if toxic else "Fine.")
            at = draw.randrange(28)
            seq[at : at + 2] = ["hot", "air"] if toxic else ["hot", "tea"]
        rows.append((i, " ".join(seq), toxic))
    return rows


def plain(texts):
    """The two models of (text, toxic), on dicts of words: P_c(word | before) as a function, and what counts apart."""
    alone, pairs = ({c: Counter() for c in (0, 1)} for _ in range(2))
    for t, c in set(texts):
        w = toxicity.words(t)
        alone[c].update(set(w))
        pairs[c].update(set(zip([None, *w], w, strict=False)))
    vocabulary, all_pairs = set(alone[0]) | set(alone[1]), set(pairs[0]) | set(pairs[1])
    follows = Counter(w for _, w in all_pairs)
    p0 = lambda w: (follows[w] + 0.5) / (len(all_pairs) + 0.5 * (len(vocabulary) + 1))
    total = {c: sum(alone[c].values()) for c in (0, 1)}
    after = {c: Counter() for c in (0, 1)}
    for c in (0, 1):
        for (v, _), n in pairs[c].items():
            after[c][v] += n

    def chance(k, m, share):
        return (k * math.log(k / (k + m) / share) if k else 0) + (m * math.log(m / (k + m) / (1 - share)) if m else 0)

    clear = {w for w in vocabulary if chance(alone[1][w], alone[0][w], total[1] / (total[0] + total[1])) > 2 * math.log(len(vocabulary))}
    above = lambda n: max(n - 0.75, 0)
    left = {c: 1 - sum(above(alone[c][w]) for w in clear) / total[c] for c in (0, 1)}
    p1 = lambda c, w: (above(alone[c][w]) / total[c] if w in clear else 0) + left[c] * p0(w)
    far = set()
    for v, w in all_pairs:
        k, m = pairs[1][v, w], pairs[0][v, w]
        if k + m >= 4 and after[0][v] and after[1][v]:
            odds = after[1][v] * p1(1, w), after[0][v] * p1(0, w)
            if chance(k, m, odds[0] / sum(odds)) > 2 * math.log(len(all_pairs)):
                far.add((v, w))
    left2 = {(c, v): 1 - sum(above(pairs[c][x]) for x in far if x[0] == v) / after[c][v] for c in (0, 1) for v, _ in far}
    p2 = lambda c, v, w: (above(pairs[c][v, w]) / after[c][v] if (v, w) in far else 0) + left2.get((c, v), 1.0) * p1(c, w)
    return p2, vocabulary, clear, far


@pytest.fixture(scope="module")
def texts(spark):
    rows = corpus()
    return rows, saved(spark.createDataFrame([(i, t, bool(c)) for i, t, c in rows], "row long, text string, toxic boolean"))


def test_models_equal_plain_python_and_sum_to_one(texts):
    rows, frame = texts
    p2, vocabulary, clear, far = plain([(t, c) for _, t, c in rows])
    for v in (None, "hot", b"hot", b"sun", b"never seen"):
        for c in (0, 1):
            assert sum(p2(c, v, w) for w in vocabulary) + p2(c, v, b"none such") == pytest.approx(1)
    assert {b"vile", b"fine"} <= clear and {(b"hot", b"air"), (b"hot", b"tea")} & far or {b"air", b"tea"} <= clear
    found = toxicity.levels(saved(toxicity.counted(frame.select("text", "toxic"))))
    constant, values = toxicity._values(found)
    assert len(found.pairs.collect()) == len(far) and len(found.alone.collect()) == len(clear)
    got = {r.row: r.difference for r in toxicity.differences(frame, constant, values).collect()}
    for i, t, _ in rows[:40]:
        w = toxicity.words(t)
        want = sum(math.log(p2(1, v, x) / p2(0, v, x)) for v, x in zip([None, *w], w, strict=False)) / len(w)
        assert got[i] == pytest.approx(want)


def test_values_beyond_the_sent_ones_come_by_a_join(texts, monkeypatch):
    _, frame = texts
    found = toxicity.levels(saved(toxicity.counted(frame.select("text", "toxic"))))
    constant, values = toxicity._values(found)
    assert values.whole
    want = {r.row: r.difference for r in toxicity.differences(frame, constant, values).collect()}
    monkeypatch.setattr(toxicity, "SENT", 1)
    constant, values = toxicity._values(found)
    assert not values.whole and {r.row: r.difference for r in toxicity.differences(frame, constant, values).collect()} == pytest.approx(want, abs=1e-9)
    model = toxicity.Model(constant, values, 2.0, 0.5)
    got = {r.row: r.Toxicity for r in toxicity.score(frame.withColumnRenamed("toxic", "_ROW"), model, "Toxicity").collect()}
    assert got == pytest.approx({i: 1 / (1 + math.exp(-2 * x - 0.5)) for i, x in want.items()})


def test_held_out_rows_and_columns(spark, texts):
    rows, _ = texts
    docs = saved(spark.createDataFrame([(i, t, "own", i) for i, t, _ in rows] + [(None, None, "own", -1), (1000, "", "own", -2), (1001, "word " * 50_000, "own", -3), (1, rows[1][1], "own", -4)], "doc_id long, text string, Toxicity string, difference long"))
    labels = saved(spark.createDataFrame([(i, 1, c) for i, _, c in rows] + [(None, 1, 1), (3, None, None), (4, 0, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int"))
    train = saved(toxicity.training_rows(docs, labels))
    assert train.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows) + 1  # a repeated id is there twice
    model = toxicity.fit(train)
    got = {(r.doc_id, r.difference): r.score for r in toxicity.score(docs, model, "score").collect()}
    assert len(got) == docs.count() and all(0 <= x <= 1 for x in got.values())
    held = [(got[i, i] >= 0.5) == bool(c) for i, _, c in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95
    assert got[None, -1] == got[1000, -2] and got[1, 1] == got[1, -4]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.Toxicity for r in kept.collect()} == {"own"}
    assert {(r.doc_id, r.difference) for r in kept.collect()} == {k for k, x in got.items() if x < 0.5}
    few = saved(toxicity.training_rows(docs, labels, 40))
    assert [r["count"] for r in few.groupBy("toxic").count().orderBy("toxic").collect()] in ([20, 20], [21, 20])
    weights = {r.toxic: r.w for r in few.groupBy("toxic").agg({"weight": "max"}).withColumnRenamed("max(weight)", "w").collect()}
    assert weights[0] > weights[1] > 1


def test_without_labels_or_rows(spark, texts):
    rows, frame = texts
    docs = frame.select(frame.row.alias("doc_id"), "text")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(saved(toxicity.training_rows(docs, none)))
    assert {r.toxicity for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.drop_toxic(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert max(r.toxicity for r in toxicity.score(docs, toxicity.fit(saved(toxicity.training_rows(docs, one)))).collect()) < 0.1


def test_words_are_hashed_alike():
    for t in ("A b, c!", None, "", "x..y  Z"):
        assert word_hashes([(t or "").encode()], toxicity._VALUES)[1][0] == len(toxicity.words(t))
