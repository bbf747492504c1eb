"""The suffix tree against one that is built in plain Python, and as a distribution."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeweave.llm import hashed, suffix_tree
from placeweave.llm.common import saved

SCHEMA = "row long, text string"


def scored(rows, train="true"):
    root, counts = suffix_tree.root_of(rows.filter(train))
    coded = suffix_tree.encode(rows, root, "row")
    tree = suffix_tree.fit(coded.filter(train), root, counts)
    return tree, {r.row: r for r in suffix_tree.score(coded, tree).collect()}


def plain(train, asked, least_context=50, least_next=3):
    """Scores of texts by the same definition, on dicts of tuples of words."""
    seqs = [suffix_tree.tokens(t) for t in train]
    count = Counter(w for s in seqs for w in s)
    floor = sum(count.values()) + 0.1 * (len(count) + 1)
    base = lambda w: (count[w] + 0.1) / floor
    factor, own = {}, {}

    def q(ctx, w):
        if not ctx:
            return base(w)
        if ctx not in factor:
            return q(ctx[1:], w)
        return own[ctx][w] if w in own[ctx] else factor[ctx] * q(ctx[1:], w)

    d, longest = 0, -1
    while longest < max(map(len, factor), default=0):
        longest, d = max(map(len, factor), default=0), d + 1
        pairs = defaultdict(Counter)
        for s in seqs:
            for i in range(d, len(s)):
                pairs[tuple(s[i - d : i])][s[i]] += 1
        for ctx, after in pairs.items():
            total = sum(after.values())
            if total < least_context or ctx[1:] and ctx[1:] not in factor:
                continue
            p = {w: q(ctx[1:], w) for w in after}
            clear = {w: n * math.log(n / total / p[w]) for w, n in after.items() if n >= least_next and abs(n * math.log(n / total / p[w])) >= 2}
            s, mass = sum(after[w] for w in clear), sum(p[w] for w in clear)
            rest, left = total - s, max(1 - mass, 1e-9)
            gain = sum(clear.values()) + (rest * math.log(rest / total / left) if rest > 0 else 0)
            if clear and gain > len(clear) * 0.5 * math.sqrt(math.log(total)):
                factor[ctx] = (rest + 5 * left) / (total + 5) / left
                own[ctx] = {w: (after[w] + 5 * p[w]) / (total + 5) for w in clear}
    out = {}
    for i, t in asked.items():
        s = suffix_tree.tokens(t)
        out[i] = sum(math.log10(q(tuple(s[max(0, k - 15) : k]), w)) for k, w in enumerate(s))
    return out, factor


def corpus(seed=3):
    draw = random.Random(seed)
    lines = ["a m n x", "b m n y", "e b m n y", "f b m n z"] * 70 + ["k z"] * 4 + [f"k o{i % 7}" for i in range(56)]
    lines += [f"{' '.join(draw.choices('st', k=5))} u" for _ in range(100)] + ["s s s s u v"] * 80 + ["t s s s u w"] * 80 + ["s s s u s"] * 60 + ["t s s u t"] * 60 + ["t s u x"] * 50 + [f"{p}d1 d2 d3 d4 d5 d6 {e}" for n in range(7) for p, e in ((" ".join(["c"] * n) + " g ", "h" + str(n)), (" ".join(["c"] * n) + " k ", "i" + str(n))) for _ in range(60)]
    draw.shuffle(lines)
    other = [" ".join(draw.choices([f"w{i}" for i in range(40)] + ["m", "n", "x", "y"], k=8)) for _ in lines]
    return {i: f"{o} {t}" for i, (o, t) in enumerate(zip(other, lines, strict=True))} | {-1: None, -2: "", -3: "A  B", -4: "unseen words only", -5: "k z k z"}


@pytest.mark.parametrize("single", [suffix_tree.SINGLE, 2])
def test_equals_a_tree_in_plain_python(spark, monkeypatch, single):
    monkeypatch.setattr(suffix_tree, "SINGLE", single)
    texts = corpus()
    train = [t for i, t in texts.items() if i % 5]
    want, factor = plain(train, texts)
    rows = saved(spark.createDataFrame(list(texts.items()), SCHEMA))
    tree, got = scored(rows, "row % 5 <> 0")
    assert max(map(len, factor)) == tree.depth >= 4
    assert {i: r.score for i, r in got.items()} == pytest.approx(want)
    count = Counter(w for t in train for w in suffix_tree.tokens(t))
    total, kinds = sum(count.values()), len(count)
    for i, t in texts.items():
        words = suffix_tree.tokens(t)
        assert got[i].base_score == pytest.approx(sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))
        assert (got[i].n_tokens, got[i].n_known) == (len(words), sum(count[w] > 0 for w in words))
    assert tree.total == total


def test_joins_equal_broadcasts(spark, monkeypatch):
    texts = corpus(8)
    want, _ = plain([t for i, t in texts.items() if i % 5], texts)
    rows = saved(spark.createDataFrame(list(texts.items()), SCHEMA))
    for frequent, hot in ((4, 1 << 19), (1 << 18, 1), (8, 8)):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        monkeypatch.setattr(suffix_tree, "USED", 1)
        monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
        monkeypatch.setattr(suffix_tree, "FREQUENT_BITS", frequent.bit_length() - 1)
        tree, got = scored(rows, "row % 5 <> 0")
        assert len(tree.values.sent.index.keys) <= hot and len(tree.root.counts) <= frequent
        if frequent == 1 << 18:
            assert {i: r.score for i, r in got.items()} == pytest.approx(want)
        assert sorted(got) == sorted(texts)


@pytest.mark.parametrize("frequent", [4, 16])
def test_words_without_numbers_are_contexts_too(spark, monkeypatch, frequent):
    """However few words have numbers, the tree is the same."""
    texts = corpus(8)
    want, factor = plain([t for i, t in texts.items() if i % 5], texts)
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_tree, "FREQUENT_BITS", frequent.bit_length() - 1)
    tree, got = scored(saved(spark.createDataFrame(list(texts.items()), SCHEMA)), "row % 5 <> 0")
    assert len(tree.root.counts) <= frequent < len([ctx for ctx in factor if len(ctx) == 1]) and tree.depth == max(map(len, factor))
    assert {i: r.score for i, r in got.items()} == pytest.approx(want)


def test_a_task_of_many_sequences_and_batches(spark):
    """A text has the same score wherever a task reads it: over a fourfold of TOKENS, and over more rows than a record batch has."""
    texts, copies = corpus(), 30
    want, _ = plain([t for i, t in texts.items() if i % 5], texts)
    many = [(i + k * 100_000, t) for k in range(copies) for i, t in texts.items()]
    rows = saved(spark.createDataFrame(many, SCHEMA).coalesce(1))
    _, got = scored(rows, "row < 90000 and row % 5 <> 0")
    assert sum(r.n_tokens for r in got.values()) > 2 * suffix_tree.TOKENS and len(many) > 2 * 10_000
    assert {i + k * 100_000: want[i] for k in range(copies) for i in texts} == pytest.approx({i: r.score for i, r in got.items()})


def test_all_lengths_are_distributions(spark):
    texts = {i: "x y z x y w x y z q " * 30 for i in range(8)}
    words = ["x", "y", "z", "w", "q", ""]
    asked, whole = {}, list(texts.items())
    for k, before in enumerate(("x", "x y", "z x y", "q x y z x y")):
        asked |= {1000 + 100 * k + i: f"{before} {w}" for i, w in enumerate(words)}
        asked[1000 + 100 * k + 99] = f"{before} unseen"
    asked[1] = texts[1]
    _, got = scored(saved(spark.createDataFrame([*whole, *[(i, t) for i, t in asked.items() if i >= 1000]], SCHEMA)), "row < 1000")
    want, factor = plain(list(texts.values()), asked)
    assert {i: got[i].score for i in asked} == pytest.approx(want) and factor
    count = Counter(w for t in texts.values() for w in suffix_tree.tokens(t))
    kinds, floor = len(count), sum(count.values()) + 0.1 * (len(count) + 1)
    assert sum((c + 0.1) / floor for c in count.values()) + 0.1 / floor == pytest.approx(1) and kinds == 6


def test_nothing_to_learn_from(spark):
    rows = saved(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA))
    _, got = scored(rows, "row > 5")
    assert [got[i].base_score for i in (1, 2)] == [pytest.approx(0.0)] * 2 and got[2].n_tokens == 1 and got[1].n_known == 0
    assert scored(rows.limit(0))[1] == {}


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (None, "c", "z")]
    saved(spark.createDataFrame(rows, "doc_id long, text string, row string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_tree.op9_lm(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_counts_meet_packed():
    """A task passes on a row for each part, not for each pair, and each pair's counts come together."""
    draw, names, parts = np.random.default_rng(4), np.concatenate([np.arange(3000), (1 << 61) + 4 * np.arange(3000)]), 8
    words = suffix_tree.Words(np.ones(3000, bool), hashed.Filter(np.full(16, ~np.uint64(0))))
    shared = lambda x: SimpleNamespace(value=x)
    rows, want = [], {1: Counter(), 2: Counter()}
    for _ in range(3):
        w = names[(6000 * draw.random(20_000) ** 4).astype(int)]
        batch = pa.RecordBatch.from_arrays([pa.array([np.where(w < 3000, w, -1).astype(np.int32).tobytes()]), pa.array([w[w >= 3000].tobytes()])], ["ids", "rare"])
        for d in want:
            want[d].update(zip(*(w[k : len(w) - d + k].tolist() for k in range(d + 1)), strict=True))
            every = shared(words.others)
            got = list(suffix_tree._pairs(iter([batch]), range(d, d + 1), parts, shared(words), {1: shared(words)}, {1: every}, every))
            assert sum(b.num_rows for b in got) <= 2 * parts
            rows += [tuple(r.values()) for b in got for r in b.to_pylist()]
    rows.sort(key=lambda r: r[:2])
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    halves = [pa.RecordBatch.from_arrays([c[a:b] for c in columns], ["depth", "part", "data"]) for a, b in ((0, 17), (17, len(rows)))]
    for least in (1, 3):
        summed = [r for b in suffix_tree._summed(iter(halves), least) for r in b.to_pylist()]
        found = {1: {(r["x"], r["sym"]): r["n"] for r in summed if r["depth"] == 1}, 2: {(r["x"], r["low"], r["sym"]): r["n"] for r in summed if r["depth"] == 2}}
        assert len(summed) == sum(map(len, found.values()))
        assert found == {d: {k: n for k, n in c.items() if n >= least} for d, c in want.items()}


def test_word_hashes_tell_tokens_apart():
    some = [b"", b"a", b"A b", b"ab", b"a\tb ", b" a b", b"\x00 a\x00", "\u00c4 \u4e2d".encode(), b"a" * 5000]
    h, n = hashed.word_hashes(some)
    want = [suffix_tree.tokens(t.decode()) for t in some]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    by = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_filter_knows_all_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    made = hashed.Filter.of(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key long"))
    assert made.may_have(keys[:2000]).all() and made.may_have(keys[2000:]).mean() < 0.2
