"""The pipeline's stages against brute force on a small corpus, with nulls, copies, repeated ids and columns of clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from placeweave.llm import mixing, simhash, toxicity
from placeweave.llm.common import saved
from placeweave.llm.tokens import Encoder


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("aeioumnrst") for _ in range(draw.randint(2, 6)))
    lexicon = [word() for _ in range(300)]
    texts = []
    for i in range(240):
        seq = draw.choices(lexicon, k=draw.randint(40, 90))
        if i % 6 == 0:
            seq[5:5] = ["vile", "vile"]
        if i % 6 == 1:
            seq = [f"{w}%%" for w in seq]
        texts.append((i, " ".join(seq), i % 6))
    out = [*texts, *[(1000 + i, t.replace(" ", "  "), k) for i, t, k in texts[:20]], *[(2000 + i, t + " more", k) for i, t, k in texts[20:30]]]
    return out + [(None, None, 2), (3000, "", 2), (3001, " ", 2), (2, texts[2][1], 2), (None, texts[3][1], 3), (3002, "long " * 6000, 2)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, "own") for n, (i, t, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _row long, toxicity string")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 0)) for i, _, k in rows[:240]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(top / "documents.parquet"))
    labels.write.parquet(str(top / "labels.parquet"))
    return str(top)


def test_stages(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if name != "packing" else None
        docs = saved(stage(spark, docs, sf))
        if name == "packing":
            break
        rows = docs.collect()
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        assert {r._row for r in rows} <= {r._row for r in before} and all(r.toxicity == "own" for r in rows)
        kept.append((name, before, rows))
    stages = {name: (before, rows) for name, before, rows in kept}
    source = spark.read.parquet(f"{sf}/documents.parquet")
    before, rows = stages["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r._row: r.score for r in toxicity.score(source, toxicity.fit(saved(toxicity.training_rows(source, labels))), "score").collect()}
    assert {r._row for r in rows} == {n for n, x in scores.items() if x < 0.5}
    kinds = [k for _, _, k in corpus()]
    assert not any(kinds[r._row] == 0 for r in rows) and all(r._row in {x._row for x in rows} for r in before if kinds[r._row] != 0)

    before, rows = stages["exact dedup"]
    groups = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append((r.doc_id is None, r.doc_id or 0, r._row))
    assert len(rows) == len(groups)
    want = {min(g)[:2] for g in groups.values()}
    assert {(r.doc_id is None, r.doc_id or 0) for r in rows} == want

    before, rows = stages["near dedup"]
    prints = [simhash.fingerprint(r.text, corpus_pipeline.NEAR_WORDS) for r in before]
    label = list(range(len(before)))
    for _ in before:
        label = [min(label[j] for j in range(len(before)) if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.NEAR_BITS) for i in range(len(before))]
    best = {}
    for i, r in enumerate(before):
        best.setdefault(label[i], []).append((r.doc_id is None, r.doc_id or 0, r._row))
    assert {r._row for r in rows} == {min(g)[2] for g in best.values()} and len(rows) < len(before)

    before, rows = stages["mixing"]
    times = Counter(r._row for r in rows)
    assert set(times) == {r._row for r in before}  # no clean document is lost, and rates are at least 1
    frame = saved(spark.createDataFrame(before, source.schema))
    soft = mixing.soft_domains(frame, mixing.fit_classifier(frame, labels), ("_row",)).collect()
    total = np.array([sum(times[r._row] * r.tokens * r.p[i] for r in soft) for i in range(3)])
    assert total[0] / total[:2].sum() == pytest.approx(0.85 / 0.95, abs=0.05)

    packed = docs.collect()
    encoder = Encoder.get()
    assert sum(r.length for r in packed) == sum(len(encoder.encode(r.text)) // 4 + 1 for r in rows)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1].tolist()] and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
