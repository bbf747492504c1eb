"""Words of passages that recur: found by anchors, confirmed, compiled into automata, and sought in all documents.

A window is a number of words in a row. Of the short phrases inside a window
the one with the least hash is its anchor, the same wherever the window
recurs, so windows meet by equality of anchors. Consecutive windows of one
anchor make a segment; equal segments make a kind.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, join_hot, raw_texts, saved, table, text_batches, tidied
from .hashed import Filter, Index, byte_values, mixed, plain_hashes, run_hashes

#: Words of a window, and of the phrases that anchors are drawn from.
WINDOW, ANCHOR = 35, 10
#: Bytes of texts that one automaton serves, about.
PART_BYTES = 4 << 20
#: Bytes of texts that a task hashes at once; windows whose anchors are sought at once; words that an automaton reads at once.
BATCH, PIECE, READ = 1 << 19, 1 << 14, 1 << 14
#: First words of a phrase by which an automaton finds where to read; shorter phrases have fewer.
HEAD = 8
#: Bytes whose words are hashed in one step, few enough for a processor's cache.
AT_ONCE = 1 << 15
EXACT = byte_values(folded=False)


def _least(grams: np.ndarray, of: int) -> np.ndarray:
    """Where the first least of each ``of`` grams in a row is."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(grams) - of + 1, PIECE):
        piece = np.lib.stride_tricks.sliding_window_view(grams[at : at + PIECE + of - 1], of)
        out.append(piece.argmin(1) + np.arange(at, at + len(piece)))
    return np.concatenate(out)


def _segments(words: np.ndarray, lengths: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of all texts: the text's number, the first window's place in the text, the number of windows, the hashes of anchor and kind."""
    first = np.cumsum(lengths) - lengths
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - first[text_of]
    starts = np.flatnonzero(place + window <= lengths[text_of])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    grams, windows = run_hashes(words, anchor), run_hashes(words, window)
    at = _least(grams.view(np.uint64), window - anchor + 1)[starts]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
    begins, ends = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    anchors, size = grams[at[cut]], ends - begins + 1
    return text_of[begins], place[begins], size, anchors, mixed(anchors, windows[begins], windows[ends], size)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, BATCH):
        key, n = np.unique(_segments(*plain_hashes(raw_texts(batch.column(0)), EXACT, AT_ONCE), window, anchor)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _segment_rows(batches: Iterator[pa.RecordBatch], window: int, anchor: int, shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    recurring = shared.value
    for batch in text_batches(batches, BATCH):
        of, start, size, anchors, kind = _segments(*plain_hashes(raw_texts(batch.column(1)), EXACT, AT_ONCE), window, anchor)
        keep = recurring.may_have(anchors)
        row = batch.column(0).to_numpy()[of[keep]]
        columns = [row, start[keep].astype(np.int32), size[keep].astype(np.int32), anchors[keep], kind[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "start", "size", "anchor", "kind"])


def _hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(mixed(batch.column(0).to_numpy())))], ["key"])


def _row_filter(rows: DataFrame):  # noqa: ANN202
    """A broadcast filter of the numbers in ``row``, of a fixed size."""
    keys = saved(rows.select("row").mapInArrow(_hashed_rows, "key long").distinct())
    found = rows.sparkSession.sparkContext.broadcast(Filter.of(keys))
    dropped(keys)
    return found


def _asked(batches: Iterator[pa.RecordBatch], shared, there: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The rows whose number the filter may have, or all others."""
    for batch in text_batches(batches, BATCH):
        yield batch.filter(pa.array(shared.value.may_have(mixed(batch.column(0).to_numpy())) == there))


def _only(docs: DataFrame, shared, there: bool) -> DataFrame:  # noqa: ANN001
    """``docs`` (row, ...) of numbers that the filter may have, so that the others' texts stay out of a shuffle; or those others."""
    return docs.mapInArrow(lambda b: _asked(b, shared, there), docs.schema)


def _phrases(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each asked segment, and its windows' hashes where those are asked for."""
    names = ["anchor", "kind", "n", "words", "windows"]
    for batch in text_batches(batches, BATCH):
        asked = batch.column(1).flatten()
        start, size, apart = (asked.field(x).to_pylist() for x in ("start", "size", "apart"))
        phrases, hashes, at = [], [], 0
        for text, count in zip(raw_texts(batch.column(0)), batch.column(1).value_lengths().to_pylist(), strict=True):
            words, windows = text.split(), None
            for a, n, alone in zip(start[at : at + count], size[at : at + count], apart[at : at + count], strict=True):
                if alone and windows is None:
                    windows = run_hashes(plain_hashes([text], EXACT, AT_ONCE)[0], window)
                phrases.append(b" ".join(words[a : a + n + window - 1]))
                hashes.append(windows[a : a + n].tolist() if alone else None)
            at += count
        out = [*map(asked.field, names[:3]), pa.array(phrases, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names)


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For each phrase the longest passages whose windows all recur."""
    for batch in batches:
        kinds, phrases = [], []
        for kind, words, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, words = np.unique(at), words.split()
            for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                kinds.append(kind)
                phrases.append(b" ".join(words[run[0] : run[-1] + window]))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(phrases, pa.binary())], ["kind", "words"])


class Automaton:
    """Seeks phrases, word by word, in texts; words of no phrase have the number 0.

    It reads on from each place where the first words of a phrase are, as far
    as the longest phrase that begins with them; of other words none is in an
    occurrence, and at its root it would compare each with all first words.
    """

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        self.longest = 0
        self._found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self._sizes: list[int] = []
        self._firsts: list[tuple[int, ...]] = []
        self._head = 0

    def add(self, phrase: bytes) -> None:
        words = phrase.split()
        if words:
            phrase_numbers = tuple(map(self.numbers.__getitem__, words))
            self._found.add_word(phrase_numbers, len(words))
            self.longest = max(self.longest, len(words))
            self._sizes.append(len(words))
            self._firsts.append(phrase_numbers[:HEAD])
            self._head = 0

    def _make(self) -> None:
        """The automaton, and of each head, the first words of phrases, how many words its longest phrase has."""
        self._found.make_automaton()
        self._head = min(map(len, self._firsts))
        firsts = np.array([n for first in self._firsts for n in first[: self._head]], np.int64)
        heads, of = np.unique(run_hashes(mixed(firsts), self._head)[:: self._head].view(np.uint64), return_inverse=True)
        self._heads, self._reach = Index(heads.view(np.int64)), np.zeros(len(heads), np.int64)
        np.maximum.at(self._reach, of, self._sizes)

    def _stretches(self, numbers: np.ndarray) -> list[list[int]]:
        """From where to where phrases may be."""
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(numbers), READ):
            place = self._heads.places(run_hashes(mixed(numbers[at : at + READ + self._head - 1]), self._head))
            here = np.flatnonzero(place >= 0)
            begins.append(here + at)
            ends.append(here + at + self._reach[place[here]])
        begin, end = np.concatenate(begins), np.maximum.accumulate(np.concatenate(ends))
        if not len(begin):
            return []
        cut = np.flatnonzero(begin[1:] > end[:-1])
        return np.stack([begin[np.append(0, cut + 1)], np.minimum(end[np.append(cut, len(end) - 1)], len(numbers))], 1).tolist()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words an occurrence of a phrase covers."""
        edges = np.zeros(len(words) + 1, np.int64)
        if self.longest:
            if not self._head:
                self._make()
            numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
            for begin, end in self._stretches(numbers):
                for at in range(begin, end, READ):  # each piece begins with what an occurrence that ends in it may need
                    first = max(begin, at - self.longest + 1)
                    hits = list(self._found.iter(tuple(numbers[first : min(at + READ, end)].tolist())))
                    if hits:
                        last, size = np.array(hits, np.int64).T
                        last += first + 1
                        np.add.at(edges, last - size, 1)
                        np.add.at(edges, last, -1)
        return np.cumsum(edges[:-1]) > 0


_KEPT = "row long, n_words long, spans array<struct<start:int,stop:int>>, kept binary"


def _kept(rows: list[int], texts: list[bytes], automaton: Automaton) -> pa.RecordBatch:
    n, spans, kept = [], [], []
    split = [text.split() for text in texts]
    if automaton.longest:
        gone = automaton.covered([w for words in split for w in (*words, b"")])  # no phrase goes on over an empty word
        first = np.cumsum([0, *[len(words) + 1 for words in split]])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).view(np.int8)))
        cut = np.searchsorted(edges, first)
        own = [(edges[a:b] - at).tolist() for a, b, at in zip(cut[:-1].tolist(), cut[1:].tolist(), first.tolist(), strict=False)]
    else:
        own = [[]] * len(split)
    for words, ends in zip(split, own, strict=True):
        n.append(len(words))
        spans.append([{"start": a, "stop": b} for a, b in zip(ends[::2], ends[1::2], strict=True)])
        kept.append(b" ".join([w for a, b in zip([0, *ends[1::2]], [*ends[::2], len(words)], strict=True) for w in words[a:b]] if ends else words))
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rows, n, spans, kept), types, strict=True)], ["row", "n_words", "spans", "kept"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, BATCH):
        yield _kept(batch.column(0).to_pylist(), raw_texts(batch.column(1)), Automaton())


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, row, words) sorted so that a part's phrases, which have no row, come before its texts."""
    part, automaton = None, Automaton()
    for batch in text_batches(batches, BATCH):
        rows, texts = [], []
        for mine, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            if mine != part:
                if rows:
                    yield _kept(rows, texts, automaton)
                part, automaton, rows, texts = mine, Automaton(), [], []
            if row is None:
                automaton.add(text)
            else:
                rows.append(row)
                texts.append(text)
        if rows:
            yield _kept(rows, texts, automaton)


def recurring_phrases(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Phrases (kind, words, n) whose windows all recur, and segments (row, kind) that may hold them, from ``docs`` (row, text).

    A segment met twice is a phrase as it is. One that is met once, but whose
    anchor recurs, is compared with the others by its windows, and the
    passages of it whose windows recur are phrases. So each occurrence of a
    window that recurs is inside a phrase of its segment's kind.
    """
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(lambda b: _anchors(b, window, anchor), "key long, n long")
    recurring = saved(counts.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))
    shared = spark.sparkContext.broadcast(Filter.of(recurring))
    segments = saved(docs.select("row", "text").mapInArrow(lambda b: _segment_rows(b, window, anchor, shared), "row long, start int, size int, anchor long, kind long"))
    dropped(recurring)
    tidied(spark)
    kinds = saved(segments.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "size")).alias("first")))
    anchors = saved(kinds.groupBy("anchor").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("kinds"), (F.min("n") == 1).alias("apart")).filter("times > 1"))
    each = join_hot(kinds, anchors.select("anchor", "kinds", "apart"), "anchor", "kinds")
    by_row = saved(each.groupBy("first.row").agg(F.collect_list(F.struct("first.start", "first.size", "anchor", "kind", "n", "apart")).alias("asked")))
    needed = _row_filter(by_row)
    met = _only(docs.select("row", "text"), needed, True).join(by_row.hint("merge"), "row").select("text", "asked")
    phrases = saved(met.mapInArrow(lambda b: _phrases(b, window), "anchor long, kind long, n long, words binary, windows array<long>"))
    dropped(kinds, anchors, by_row)
    tidied(spark)
    windows = phrases.filter("windows is not null").select("anchor", "kind", "n", F.posexplode("windows").alias("at", "window"))
    again = windows.groupBy("anchor", "window").agg(F.sum("n").alias("times"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone"))
    again = saved(again.filter("times > 1 and alone > 0").select(F.col("anchor").alias("of"), "window", "alone"))
    found = join_hot(windows.filter("n = 1"), again, "window", "alone").filter("anchor = of").groupBy("kind").agg(F.collect_list("at").alias("places"))
    alone = phrases.filter("n = 1").select("kind", "words").join(found.hint("merge"), "kind").select("kind", "words", "places")
    passages = alone.mapInArrow(lambda b: _runs(b, window), "kind long, words binary").withColumn("n", F.lit(1).cast("long"))
    out = saved(phrases.filter("n > 1").select("kind", "words", "n").unionByName(passages))
    dropped(phrases, again)
    tidied(spark)
    return out, segments.select("row", "kind")


def without_recurring(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, row: str = "row", text: str = "text", part_bytes: int | None = None) -> DataFrame:
    """(row, n_words, spans, kept) of each row: its removed spans of words, and the words that stay, joined by single spaces.

    A word goes if a window of ``window`` words covers it whose words also
    begin anywhere else, in the same text too; windows are judged on the
    input. ``row`` names a column of numbers that tell the rows apart, the
    same each time ``docs`` is read. Null and empty texts, and texts of white
    space, have no words and an empty rest; texts of fewer words than a window
    stay whole. Bytes that are no UTF-8 are bytes of words like any others.
    Of copies none stays. Rows that repeat an id are rows of their own. An
    empty table gives no rows; other columns are not read.

    Texts are dealt to parts of about ``part_bytes``, and an automaton of the
    phrases that a part's segments may hold reads all its texts; so no
    automaton is larger than its texts ask for, however many phrases there are.
    Texts without recurring anchors have no part.
    """
    docs = docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("binary").alias("text"))
    phrases, segments = recurring_phrases(docs, window, anchor)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64("row"), F.lit(1 + size // (part_bytes or PART_BYTES)))
    pairs = saved(segments.select(part.alias("part"), "kind").distinct())
    met = _row_filter(segments)
    asked = join_hot(pairs, phrases, "kind", "n").select("part", F.lit(None).cast("long").alias("row"), "words")
    texts = _only(docs, met, True).select(part.alias("part"), "row", F.col("text").alias("words"))
    dealt = asked.unionByName(texts).repartition("part").sortWithinPartitions("part", F.col("row").asc_nulls_first())
    return dealt.mapInArrow(_located, _KEPT).unionByName(_only(docs, met, False).mapInArrow(_whole, _KEPT))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rest = without_recurring(docs)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    found = rest.select("row", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("row", "doc_id").join(found, "row").select("doc_id", "n_words", "n_removed", "kept_sha256")
