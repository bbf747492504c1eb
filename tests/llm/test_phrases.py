"""Recurring windows of words against brute force: copies, overlaps, edges of passages, runs of one word, and odd rows."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeweave.llm import hashed, phrase_automata
from placeweave.llm.common import saved

W, A = 6, 3


def texts():
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdeABCé", k=draw.randint(1, 3)))
    some = lambda n: " ".join(word() for _ in range(n))
    base = [some(draw.randint(0, 60)) for _ in range(60)]
    shared, line = some(30), some(W)
    parts = shared.split(" ")
    out = [None, "", " \t\n", "x", *base, *base[:7], *[f"{some(4)} {line} {some(4)}" for _ in range(40)]]
    out += [f"{some(5)}\n{shared}\t{some(3)}", f"{some(2)} {' '.join(parts[4:20])}  {some(9)}", " ".join(parts[10:30]), "go " * 50, "go " * 6, "stop " * 7, "end " * 6]
    return [*out, some(3000), *[" ".join([*parts[:15], f"u{i}", *parts[16:]]) for i in range(12)]]


def removed(all_words, window):
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield gone


def words_of(data):
    return re.findall(rb"[^\x20\x09-\x0D]+", data or b"")


@pytest.mark.parametrize("part_bytes", [None, 300])
def test_equals_brute_force(spark, part_bytes):
    data = [None if t is None else t.encode() for t in texts()]
    data += [b"\xff\xfe a b \xc3 c d e f g h", b"q \xff\xfe a b \xc3 c d e f g h", b"q \xfe\xfe a b \xc3 c d e f g h"]
    rows = [(n, n // 2 if n % 5 else None, t, "own", -n) for n, t in enumerate(data)]
    docs = spark.createDataFrame(rows, "row long, doc_id long, raw binary, words string, part int").withColumn("text", F.expr("cast(raw as string)"))
    got = {r.row: r for r in phrase_automata.without_recurring(saved(docs), W, A, part_bytes=part_bytes).collect()}
    assert len(got) == len(data)
    all_words = [words_of(t) for t in data]
    for n, (words, gone) in enumerate(zip(all_words, removed(all_words, W), strict=True)):
        spans = [[m.start(), m.end()] for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        assert (got[n].n_words, [[s.start, s.stop] for s in got[n].spans]) == (len(words), spans), n
        assert bytes(got[n].kept) == b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def test_no_rows_and_nothing_that_recurs(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "row long, text string")
    assert phrase_automata.without_recurring(docs.limit(0)).count() == 0
    assert sorted((r.row, r.n_words, r.spans, bytes(r.kept)) for r in phrase_automata.without_recurring(docs, 2, 1).collect()) == [(1, 3, [], b"a b c"), (2, 0, [], b"")]


def test_pieces_of_long_texts(monkeypatch):
    """Anchors and occurrences over the edges of what is read at once."""
    draw = np.random.default_rng(1)
    grams = draw.integers(0, 5, 400).astype(np.uint64)
    whole = phrase_automata._least(grams, 7)
    words = [b"%d" % i for i in draw.integers(0, 3, 500)]
    automaton = phrase_automata.Automaton()
    for at in (17, 99, 250, 390):
        automaton.add(b" ".join(words[at : at + 12]))
    automaton.add(b"")
    covered = automaton.covered(words)
    monkeypatch.setattr(phrase_automata, "PIECE", 11)
    monkeypatch.setattr(phrase_automata, "READ", 5)
    assert (phrase_automata._least(grams, 7) == whole).all() and (automaton.covered(words) == covered).all() and covered.sum() >= 48
    assert whole.tolist() == [i + int(np.argmin(grams[i : i + 7])) for i in range(394)]


def test_hashes_do_not_depend_on_what_is_hashed_at_once():
    """Words over the edges of pieces, and words longer than a piece."""
    some = [b"", b" a bc  def\n", b"x" * 100 + b" y", b"end"]
    whole, lengths = hashed.plain_hashes(some, phrase_automata.EXACT)
    assert len(whole) == 6 and lengths.tolist() == [0, 3, 2, 1]
    for window in (1, 3, 8, 64):
        found, n = hashed.plain_hashes(some, phrase_automata.EXACT, window)
        assert (found == whole).all() and (n == lengths).all()


def test_an_automaton_reads_only_where_phrases_may_be():
    """Words that no phrase's first words lead to are not read; what is found is the same, over phrases of any length and the ends of texts."""
    draw = random.Random(3)
    words = [b"w%d" % draw.randrange(50) for _ in range(20_000)]
    phrases = [words[at : at + n] for at, n in ((0, 40), (700, 35), (700, 60), (9_000, 40), (9_010, 44), (19_960, 40))]
    phrases += [phrase[:20] + [b"w1", b"w2"] * 10 for phrase in phrases]
    for extra in ([], [words[5_000:5_003]]):  # with a phrase of fewer words than a head, too
        automaton, read = phrase_automata.Automaton(), 0

        class Counted:
            def __init__(self, found):
                self.add_word, self.make_automaton, self.found = found.add_word, found.make_automaton, found

            def iter(self, numbers):
                nonlocal read
                read += len(numbers)
                return self.found.iter(numbers)

        automaton._found = Counted(automaton._found)
        for phrase in [*phrases, *extra]:
            automaton.add(b" ".join(phrase))
        gone = np.zeros(len(words), bool)
        for phrase in [*phrases, *extra]:
            for at in range(len(words) - len(phrase) + 1):
                if words[at : at + len(phrase)] == phrase:
                    gone[at : at + len(phrase)] = True
        assert (automaton.covered(words) == gone).all()
        assert read < 2_000
    texts = [b" ".join(words[a:b]) for a, b in ((700, 720), (720, 760), (690, 770), (0, 0), (0, 41))]
    spans = [[(s["start"], s["stop"]) for s in found] for found in phrase_automata._kept([*range(5)], texts, automaton).column("spans").to_pylist()]
    assert spans == [[], [], [(10, 70)], [], [(0, 40)]]


def test_memory_of_a_batch_is_small():
    """A batch of very frequent short words is hashed, and located, in pieces: a worker's memory doesn't follow the batch."""
    draw = random.Random(8)
    text = pa.array([" ".join(draw.choices("abcdefgh", k=1000)) for _ in range(4000)])
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, np.int64)), pa.array(np.arange(4000)), text.cast(pa.binary())], ["part", "row", "words"])
    for made in (lambda: phrase_automata._anchors(iter([rows.select(["words"])]), W, A), lambda: phrase_automata._located(iter([rows]))):
        next(made())  # what is made once in a task
        tracemalloc.start()
        for batch in made():
            assert batch.nbytes <= 16 * phrase_automata.BATCH
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50_000_000, peak
