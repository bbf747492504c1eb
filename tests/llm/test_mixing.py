"""Mixing: the classifier on rows apart, rates against projected gradient in plain Python, labels, copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import mixing
from placeweave.llm.common import saved

SOFT = "doc_id long, tokens long, p array<double>"


def least_squares(rows, target, floor, rounds=200_000):
    """The smallest miss of expected totals, as a share of all tokens, that rates of at least ``floor`` leave."""
    t, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    a = (p * t[:, None]).T / t.sum()
    r = np.full(len(rows), max(1.0, floor))
    step = 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(rounds):
        new = np.maximum(floor, r - step * a.T @ (a @ r - target))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return a @ r


@pytest.mark.parametrize(
    ("target", "floor"),
    [((0.4, 0.35, 0.25), 0.0), ((0.85, 0.10, 0.05), 0.0), ((1.0, 0.0, 0.0), 0.0), ((0.2, 0.2, 0.6), 0.5), ((0.1, 0.0, 0.9), 0.9)],
)
def test_rates_equal_plain_least_squares(spark, target, floor):
    draw = np.random.default_rng(4)
    rows = [(i, int(draw.integers(5, 90)), [float(x) for x in draw.dirichlet([2, 1, 0.3])]) for i in range(120)]
    rated, fit = mixing.fit_rates(saved(spark.createDataFrame(rows, SOFT)), dict(zip(mixing.DOMAINS, target, strict=True)), floor)
    got = rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]) / F.sum("tokens") for i in range(3)], F.min("rate")).first()
    want = least_squares(rows, np.array(target), floor)
    assert got[3] >= floor - 1e-12
    assert ((np.array(got[:3]) - target) ** 2).sum() == pytest.approx(((want - target) ** 2).sum(), abs=1e-4)
    assert fit.residual == pytest.approx(np.abs(np.array(got[:3]) - target).max(), abs=1e-9)


def test_rare_domain(spark):
    p = [[0.97, 0.03, 0.0], [0.3, 0.7, 0.0]]
    rows = [(i, 50 + i % 9, p[i % 2]) for i in range(2000)] + [(2000 + i, 54, [0.05, 0.05, 0.9]) for i in range(2)]
    rated, fit = mixing.fit_rates(saved(spark.createDataFrame(rows, SOFT)), mixing.WEIGHTS)
    got = rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]) / F.sum("tokens") for i in range(3)]).first()
    assert list(got) == pytest.approx([mixing.WEIGHTS[d] for d in mixing.DOMAINS], abs=1e-4) and fit.residual <= 1e-4
    assert mixing.fit_rates(spark.createDataFrame([], SOFT), {"high": 1.0})[0].count() == 0


def test_unreachable_targets(spark):
    rows = saved(spark.createDataFrame([(i, 10, [0.5, 0.5, 0.0]) for i in range(20)], SOFT))
    _, fit = mixing.fit_rates(rows, {"high": 1.0})
    assert fit.residual == pytest.approx(0.5, abs=1e-3)  # the nearest to (1, 0) on the line of (1, 1) is (0.5, 0.5)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels, {"high": 1.0}).filter("residual > 0.1").count() == 6


def test_repeating_only_what_is_kept(spark):
    rows = [(i, 10 + i % 7, [[0.9, 0.1, 0.0], [0.1, 0.9, 0.0], [0.0, 0.02, 0.98]][(i % 50 >= 48) + (i % 50 == 49)]) for i in range(500)]
    soft = saved(spark.createDataFrame(rows, SOFT))
    for want in ({"high": 0.8, "low": 0.2, "toxic": 0.0}, {"high": 0.88, "low": 0.12, "toxic": 0.0}):
        rated, _ = mixing.fit_rates(soft, want, 1.0, free_total=True)
        high, low = rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]) for i in (0, 1)]).first()
        assert high / (high + low) == pytest.approx(want["high"], abs=1e-3) and rated.filter("rate < 1").count() == 0
        assert rated.filter("p[2] > 0.5").agg(F.max("rate")).first()[0] < 1.2


def corpus(n=600):
    draw = random.Random(6)
    rows = []
    for i in range(n):
        kind = mixing.DOMAINS[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        seq = draw.choices([f"word{k}" for k in range(60)], k=draw.randint(20, 60))
        if kind == "low":
            seq = [f"{w}%%%" for w in seq]
        if kind == "toxic":
            seq[3:3] = ["vile"] * 3
        rows.append((i, " ".join(seq), kind))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    extra = [(None, None, 0), (9000, "", 1), (5, rows[5][1], 2), (9001, "word1 " * 30_000, 3)]
    docs = saved(spark.createDataFrame([(i, t, i) for i, t, _ in rows] + extra, "doc_id long, text string, _row long"))
    labels = saved(spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, _, k in rows if i % 3] + [(None, 1, 1), (6, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int"))
    return rows, docs, labels


def test_classifier(spark, labelled):
    rows, docs, labels = labelled
    model = mixing.fit_classifier(docs, labels)
    assert model.loss < model.prior_loss / 4
    soft = mixing.soft_domains(docs, model, ("doc_id", "_row")).collect()
    assert len(soft) == docs.count() and all(sum(r.p) == pytest.approx(1) and min(r.p) >= 0 for r in soft)
    best = {r.doc_id: mixing.DOMAINS[int(np.argmax(r.p))] for r in soft}
    assert np.mean([best[i] == k for i, _, k in rows if i % 3 == 0]) > 0.95  # no labels of these were there
    assert all(best[i] == "toxic" for i, _, k in rows if k == "toxic" and i % 3)
    tokens = {(r.doc_id, r._row): r.tokens for r in soft}
    assert tokens[None, 0] == tokens[9000, 1] == 1 and tokens[9001, 3] == 30_001 and tokens[5, 5] == tokens[5, 2]


def test_evidence_of_a_text(spark, labelled):
    _, docs, labels = labelled
    model = mixing.fit_classifier(docs, labels)
    w = {r.bucket: [r.w_high, r.w_low, r.w_toxic] for r in model.weights.collect()}
    text = "word1 word1%%% Vile vile"
    buckets = spark.createDataFrame([(x,) for x in text.lower().split()], "word string").select(*mixing._buckets(F.col("word"))).collect()
    want = [np.mean([w.get(b[i], [0, 0, 0]) for b in buckets], 0) for i in (0, 1)]
    got = mixing.features(spark.createDataFrame([(1, text)], "row long, text string"), model.weights, "row").first()
    assert got.x == pytest.approx([*want[0], *want[1], 3 / 4, np.log(5)])


def test_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    assert mixing.labelled(docs, labels, 5).count() == 5  # labels of other documents take no place
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0), (2, 0, 0), (3, 1, None), (4, None, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    assert {r.text: r.domain for r in mixing.labelled(docs, both).collect()} == {"text 1": "toxic", "text 2": "low", "text 3": "high", "text 4": "high"}


def test_regression_is_at_its_optimum():
    draw = np.random.default_rng(2)
    x = np.column_stack([draw.normal(size=(300, 2)), np.ones(300)])
    y = draw.integers(0, 3, 300)
    b = mixing.softmax_regression(x, y, 3)
    p = mixing.softmax(x @ b.T)
    assert np.abs((p - np.eye(3)[y]).T @ x / 300 + mixing.RIDGE * b).max() < 1e-6


def test_repeated_rows_and_columns(spark, labelled):
    rows, docs, labels = labelled
    docs = docs.withColumn("_nth", F.lit("own"))
    out = mixing.repeated(docs, labels).collect()
    assert {r._nth for r in out} == {"own"} and {(r.doc_id, r._row) for r in out} == {(r.doc_id, r._row) for r in docs.select("doc_id", "_row").collect()}
    assert mixing.repeated(docs.limit(0), labels).count() == 0
    n = 4000
    got = spark.range(n).select(mixing.copies(F.lit(1.3), F.col("id")).alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert got[0] == pytest.approx(1.3, abs=0.03) and (got[1], got[2]) == (1, 2)
