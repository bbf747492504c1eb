"""Log-probabilities of texts by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_threshold, dropped, held_out, raw_texts, saved, table, text_batches, tidied
from .hashed import Filter, Index, Values, dealt, edges, mixed, unpacked, word_hashes

#: Ends each text; no word has a line feed.
END = b"\n"
#: Words that occur at least so often have a number of their own, or those that occur oftener if they were over FREQUENT. The others are known by their hashes.
NUMBERED = 8
FREQUENT_BITS = 20
FREQUENT = 1 << FREQUENT_BITS
#: Values of the tree of at least so many uses are sent to all tasks, or of more if they were over HOT; the others meet the texts in a join, with the same result.
USED, HOT = 16, 1 << 21
#: Bytes of texts that a task splits into words at once; tokens that it reads at once; contexts that it counts before it passes them on.
BATCH, TOKENS, HELD = 1 << 17, 1 << 17, 2_000_000
#: Counts meet in as many parts as there are so many tokens, down to a power of two, in LEAST_PARTS at least; a task has about TOGETHER of them, where that makes more tasks than Spark's setting.
PART, LEAST_PARTS, TOGETHER = 1 << 20, 64, 4
#: Contexts that occur less often are no states, and next symbols counted less often are left to the shorter context.
LEAST_CONTEXT, LEAST_NEXT = 50, 3
#: Lengths of contexts that are counted one a pass; each later pass counts as many as there were before.
SINGLE = 4
#: Weight of the shorter context's distribution, in tokens.
PRIOR = 5.0
ADD = 0.1
#: Stands for the context without words.
NONE = -1
#: Kinds of rows that scoring makes: a text, a word that has no number, and a key of the tree.
TEXT, WORD, VALUE = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and one end; a null text counts as empty."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

    for batch in text_batches(batches, BATCH):
        if batch.num_rows:
            held.append(word_hashes(raw_texts(batch.column(0)))[0])
            if sum(map(len, held)) > HELD:
                yield from flush()
    yield from flush()


@dataclass
class Vocabulary:
    """The root: the words that have numbers, in the order of their hashes, with their counts."""

    index: Index
    counts: np.ndarray
    total: int
    kinds: int

    @property
    def floor(self) -> float:
        return self.total + ADD * (self.kinds + 1)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words that have one, and -1 for all others."""
        return self.index.places(h << 3)  # a word's hash has its first bits in common with all others


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Each row's tokens: numbers of words, -1 for those that have none, whose hashes are in ``rare`` in their order."""
    known = vocabulary.value
    for batch in text_batches(batches, BATCH):
        if not batch.num_rows:
            continue
        h, lengths = word_hashes(raw_texts(batch.column(batch.num_columns - 1)))
        ids = known.ids(h)
        other = ids < 0
        ends = np.concatenate([[0], np.cumsum(lengths)])
        rare_ends = np.concatenate([[0], np.cumsum(other)])[ends]
        cut = lambda x, e: [x[a:b].tobytes() for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cut(ids, ends), pa.binary()), pa.array(cut(h[other], rare_ends), pa.binary())], [*batch.schema.names[:-1], "ids", "rare"])


def state_key(ctx: np.ndarray, depth: int) -> np.ndarray:
    """The key of a context's own value; the depth tells it from a context of more words (words have no negative numbers)."""
    return mixed(ctx, np.full_like(ctx, -depth))


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words, tokens of each row) of encoded rows, some at a time; rare words stand as their hashes."""
    ids, rare = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
    first = 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS, "right")) - 1)
        w = np.frombuffer(b"".join(ids[first:stop]), np.int32).astype(np.int64)
        w[w < 0] = np.frombuffer(b"".join(rare[first:stop]), np.int64)
        yield first, stop, w, np.diff(ends[first : stop + 1])
        first = stop


def places(lengths: np.ndarray) -> np.ndarray:
    """How many tokens of its own text are before each token."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@dataclass
class Words:
    """A set of words: by their numbers, and a filter of those that have none; it may let a few others of the latter pass."""

    numbered: np.ndarray
    others: Filter

    @staticmethod
    def of(numbered: np.ndarray, others: DataFrame) -> Words:
        """``others`` has hashes of the words without a number in the column ``key``."""
        return Words(numbered, Filter.of(others))

    def may_have(self, w: np.ndarray) -> np.ndarray:
        there = w < len(self.numbered)
        rest = ~there
        there[there] = self.numbered[w[there]]
        if self.others.bits.any():
            there[rest] = self.others.may_have(mixed(w[rest]))
        return there


def _longer(w: np.ndarray, before: np.ndarray, depth: int, at: np.ndarray, ctx: np.ndarray, usual: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens ``at`` with the word ``depth`` before them, ``ctx`` of those, and that word; only for ``usual`` words."""
    there = before[at] >= depth
    at, ctx = at[there], ctx[there]
    x = w[at - depth]
    there = usual.may_have(x)
    return at[there], ctx[there], x[there]


#: An odd number and its inverse modulo 2 ** 64: products differ as the factors do, and their first bits are spread.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _pairs(batches: Iterator[pa.RecordBatch], depths: range, parts: int, usual, states, often, seen) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Counts of the symbol ``sym`` after the context ``low`` with the word ``x`` before it, merged in batches of bounded size.

    They are packed, (low, x, sym, n) or for contexts of one word (x, sym, n),
    in a row for each depth and each of ``parts`` that pairs are dealt to.
    Only ``states`` of each length, as far as they are known, are made longer
    (those of one word by number). What is known to be too rare is left
    out: contexts that aren't in ``often`` of their length, and pairs whose
    shorter context hasn't ``seen`` their symbol.
    """
    held: list[tuple] = []
    plain = depths[-1] == 1

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for d in depths:
            mine = [c[1:] for c in held if c[0] == d]
            if not mine:
                continue
            low, x, sym = (np.concatenate(c) for c in zip(*mine, strict=True))
            if plain:
                small = (x < FREQUENT) & (sym < FREQUENT)
                code, n = np.unique((x[small] << FREQUENT_BITS | sym[small]).view(np.uint64) * _ODD, return_counts=True)
                pair = (code * _BACK).view(np.int64)
                rows += [(d, *r) for r in dealt(code, parts, pair >> FREQUENT_BITS, pair & (FREQUENT - 1), n)]
                x, sym = x[~small], sym[~small]
            key, at, n = np.unique((mixed(x, sym) if plain else mixed(low, x, sym)).view(np.uint64), return_index=True, return_counts=True)
            columns = (x[at], sym[at], n) if plain else (low[at], x[at], sym[at], n)
            rows += [(d, *r) for r in dealt(key, parts, *columns)]
        held.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["depth", "part", "data"])

    words, known, enough, last = usual.value, {k: f.value for k, f in states.items()}, {k: f.value for k, f in often.items()}, seen and seen.value
    for batch in batches:
        for _, _, w, lengths in _sequences(batch):
            before = places(lengths)
            at, ctx, x = _longer(w, before, 1, np.arange(len(w)), w, words if plain else known[1])
            if plain:
                held.append((1, x, x, w[at]))
            for d in range(2, depths[-1] + 1):
                # The context of d words at a token is the one of d - 1 words before the token ahead of it, with that token.
                ctx = x if d == 2 else mixed(ctx, x)
                if d == depths[0] > 2:
                    rare = np.zeros(len(w) + 1, bool)
                    rare[at + 1] = ~enough[d - 1].may_have(mixed(ctx, w[at]))
                if d > 2 and d - 1 in known:
                    there = known[d - 1].may_have(ctx)
                    at, ctx = at[there], ctx[there]
                at, ctx, x = _longer(w, before, d, at, ctx, words)
                if d < depths[0]:
                    continue
                there = enough[1].may_have(mixed(x, w[at - d + 1]))
                if d == depths[0] > 2:
                    there &= ~rare[at]
                if d == 2:
                    there &= last.may_have(mixed(ctx, w[at]))
                at, ctx, x = at[there], ctx[there], x[there]
                held.append((d, ctx, x, w[at]))
            if sum(len(c[1]) for c in held) > HELD:
                yield from flush()
    yield from flush()


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(depth, low, x, sym, n) of packed counts that come by depth and part: each pair once, with the sum of its counts, if that is ``least``."""
    rows = ((d, p, x) for b in batches for d, p, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (d, _), data in groupby(rows, itemgetter(0, 1)):
        *pair, n = unpacked((x[2] for x in data), 3 if d == 1 else 4)
        key = mixed(*pair)
        order = np.argsort(key)
        start = edges(key[order])
        n = np.add.reduceat(n[order], start)
        at, n = order[start[n >= least]], n[n >= least]
        low = [np.full(len(at), NONE)] if d == 1 else []
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), *[pa.array(c) for c in (*low, *[c[at] for c in pair], n)]], ["depth", "low", "x", "sym", "n"])


def _mapped(make: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str]):  # noqa: ANN202
    """A function for mapInArrow that makes columns of numbers from each batch."""
    return lambda batches: (pa.RecordBatch.from_arrays([pa.array(x) for x in make(b)], names) for b in batches if b.num_rows)


def _states(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (ctx, total, factor), and all rows with own (whether it is an entry of a state), factor and q, the tree's probability.

    ``rows``: (ctx, sym, n, total, p), with p from the shorter context.
    """
    gain = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p"))
    clear_one = F.abs(gain) >= 2
    kept = rows.withColumn("gain", gain).filter(clear_one)
    per = kept.groupBy("ctx").agg(F.sum("gain").alias("g"), F.sum("n").cast("double").alias("s"), F.sum("p").alias("q"), F.first("total").cast("double").alias("total"), F.count(F.lit(1)).alias("k"))
    rest, left = F.greatest(F.col("total") - F.col("s"), F.lit(0.0)), F.greatest(1 - F.col("q"), F.lit(1e-9))
    clear = F.col("g") + F.when(rest > 0, rest * F.log(rest / F.col("total") / left)).otherwise(0)
    factor = (rest + PRIOR * left) / (F.col("total") + PRIOR) / left
    states = saved(per.filter(clear > F.col("k") * 0.5 * F.sqrt(F.log("total"))).select("ctx", "total", factor.alias("factor")))
    smooth = (F.col("n") + PRIOR * F.col("p")) / (F.col("total") + PRIOR)
    own = F.col("factor").isNotNull() & clear_one
    q = F.when(own, smooth).otherwise(F.col("p") * F.coalesce("factor", F.lit(1.0)))
    return states, rows.join(states.select("ctx", "factor"), "ctx", "left").select("ctx", "low", "sym", "n", "p", own.alias("own"), "factor", q.alias("q"))


@dataclass
class Tree:
    """The root, counts of all words (h, c), and values by key.

    A text's score is its base score and, for each of its tokens, the values
    of the keys of its contexts and of its contexts with the token, where the
    tree has them: so the longest suffix that is a state decides. ``first``
    has those of contexts of one word by its number, and NaN for no state;
    those of words without a number are among the values. ``usual`` are the
    words that contexts consist of, ``one`` those that are states.
    """

    root: Vocabulary
    words: DataFrame
    usual: Words
    one: Words
    first: np.ndarray
    values: Values
    depth: int

    @property
    def total(self) -> int:
        return self.root.total


def encode(docs: DataFrame, root: Vocabulary, *keep: str) -> DataFrame:
    """``keep`` and the tokens of the column ``text``, written down: 32-bit numbers of words (ids), and 64-bit hashes of those without (rare)."""
    shared = docs.sparkSession.sparkContext.broadcast(root)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*[f"{k} {t}" for k, t in rows.dtypes[:-1]], "ids binary, rare binary"])
    return saved(rows.mapInArrow(lambda b: _encoded(b, shared), schema))


def root_of(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The root, and the counts (h, c) of all tokens of the column ``text``. An empty table gives a root without words."""
    counts = saved(train.select(F.col("text").cast("string").alias("text")).mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter(F.col("c") >= count_threshold(counts, "c", FREQUENT, NUMBERED)).orderBy("h").toArrow()  # at most FREQUENT
    return Vocabulary(Index(top["h"].to_numpy() << 3), top["c"].to_numpy(), int(total), int(kinds)), counts


def fit(rows: DataFrame, root: Vocabulary, counts: DataFrame) -> Tree:
    """The tree from encoded texts (ids, rare), their root and the counts of their words.

    All counts are over all rows and all words, and the tree grows with them.
    Contexts of one word that occur LEAST_CONTEXT times are candidates, and so
    are those that make a state longer by one word and occur as often. A
    candidate becomes a state if the divergence of its next-symbol counts
    from the distribution of its own suffix outweighs the cost of its
    symbols. A state's symbols with a clear divergence have entries, smoothed
    with the shorter context; all others share what remains in proportion to
    it. Each length is a pass over the tokens at first, and then each pass
    counts as many lengths as there were before; the last is the length that gives no state. Words and contexts are told apart by 64-bit hashes.
    Empty tables give a tree without states.
    """
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    first, kept, often = np.full(len(root.counts), np.nan), {}, {}
    parts = 1 << max(LEAST_PARTS, root.total // PART).bit_length() - 1
    tasks = [parts // TOGETHER] if parts // TOGETHER > int(spark.conf.get("spark.sql.shuffle.partitions")) else []

    def counted(depths: range, least: int, seen=None) -> DataFrame:  # noqa: ANN001
        found = rows.select("ids", "rare").mapInArrow(lambda b: _pairs(b, depths, parts, words, kept, often, seen), "depth int, part int, data binary")
        met = found.repartition(*tasks, "depth", "part").sortWithinPartitions("depth", "part")
        return saved(met.mapInArrow(lambda b: _summed(b, least), "depth int, low long, x long, sym long, n long"))

    def ends(pairs: DataFrame, least: int, *ctx: str):  # noqa: ANN202
        """A filter of the pairs of contexts and symbols that occur ``least`` times."""
        key = _mapped(lambda b: [mixed(*(b.column(i).to_numpy() for i in range(b.num_columns)))], ["key"])
        return share(Filter.of(pairs.filter(F.col("n") >= least).select(*ctx, "sym").mapInArrow(key, "key long")))

    def hashed(rows: DataFrame, word: str) -> DataFrame:
        """Those words that have no number, hashed once more, since their own hashes have their first bits in common."""
        return rows.filter(F.col(word) >= FREQUENT).select(word).mapInArrow(_mapped(lambda b: [mixed(b.column(0).to_numpy())], ["key"]), "key long")

    def with_count(pairs: DataFrame, key: str, name: str) -> DataFrame:
        """The words' counts: at most FREQUENT are broadcast, and none of the others is common."""
        of = sizes.select(F.col("word").alias(key), F.col("c").alias(name))
        numbered = F.col(key) < FREQUENT
        return pairs.filter(numbered).join(F.broadcast(of.filter(numbered)), key).unionByName(pairs.filter(~numbered).join(of.filter(~numbered), key))

    def values(depth: int, states: DataFrame, level: DataFrame) -> DataFrame:
        """The tree's keys and values of one depth, and how often each is used; states of one word with a number have no key."""

        def keys(batch: pa.RecordBatch) -> list[np.ndarray]:
            ctx, sym, own, value, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            key = state_key(ctx, depth)
            return [np.where(own, key, mixed(key, sym)), value, n]

        state = states.filter(F.lit(depth > 1) | (F.col("ctx") >= FREQUENT)).select("ctx", F.lit(0).cast("long").alias("sym"), F.lit(True).alias("own"), F.log10("factor").alias("value"), F.col("total").cast("long").alias("n"))
        next_symbol = level.filter("own").select("ctx", "sym", F.lit(False).alias("own"), F.log10(F.col("q") / F.col("p") / F.col("factor")).alias("value"), "n")
        return saved(state.unionByName(next_symbol).mapInArrow(_mapped(keys, ["key", "value", "n"]), "key long, value double, n long"))

    def named(batch: pa.RecordBatch) -> list[np.ndarray]:
        low, x, *rest = (batch.column(i).to_numpy() for i in range(batch.num_columns))
        return [np.where(low == NONE, x, mixed(low, x)), low, *rest]

    def leveled(level: DataFrame) -> DataFrame:
        """(low, x, sym, n, total, p) with contexts' keys in the place of ``x``, written down."""
        level = level.select("low", "x", "sym", "n", "total", "p")
        return saved(level.mapInArrow(_mapped(named, ["ctx", "low", "sym", "n", "total", "p"]), "ctx long, low long, sym long, n long, total long, p double"))

    shared = share(root)
    numbers = lambda b: [np.where((i := shared.value.ids(h := b.column(0).to_numpy())) < 0, h, i), b.column(1).to_numpy()]
    sizes = saved(counts.filter(F.col("c") >= LEAST_NEXT).mapInArrow(_mapped(numbers, ["word", "c"]), "word long, c long"))
    usual = Words.of(root.counts >= LEAST_CONTEXT, hashed(sizes.filter(F.col("c") >= LEAST_CONTEXT), "word"))
    one, words = Words.of(~np.isnan(first), hashed(sizes.limit(0), "word")), share(usual)
    pairs = counted(range(1, 2), LEAST_NEXT)
    level = leveled(with_count(with_count(pairs, "x", "total").filter(F.col("total") >= LEAST_CONTEXT), "sym", "c").withColumn("p", (F.col("c") + ADD) / root.floor))
    depth, last, model = 1, 1, []
    while True:
        states, told = _states(level)
        if states.isEmpty():
            break
        if depth == 1:
            found = states.filter(F.col("ctx") < FREQUENT).select("ctx", F.log10("factor").alias("value")).toArrow()  # at most FREQUENT
            first[found["ctx"].to_numpy()] = found["value"].to_numpy()
            one = Words.of(~np.isnan(first), hashed(states, "ctx"))
            kept[1] = share(one)
        else:
            kept[depth] = share(Filter.of(states.withColumnRenamed("ctx", "key")))
        model.append(values(depth, states, told))
        used, before = [level], pairs
        depth += 1
        if depth > last:
            often[depth - 1] = ends(level, LEAST_CONTEXT, "ctx")
            last = depth if depth <= SINGLE else 2 * depth - 2
            pairs = counted(range(depth, last + 1), 1) if depth > 2 else counted(range(2, 3), LEAST_NEXT, ends(level, LEAST_NEXT, "ctx"))
            used.append(before)
        mine = pairs.filter(F.col("depth") == depth).join(states.select(F.col("ctx").alias("low")), "low", "left_semi")
        if depth == 2:  # the pairs that couldn't have an entry are missing, but their contexts were counted as pairs
            total = before.filter(F.col("n") >= LEAST_CONTEXT).select("x", F.col("sym").alias("low"), F.col("n").alias("total"))
        else:
            total = mine.groupBy("low", "x").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_CONTEXT)
        suffix = told.select(F.col("ctx").alias("low"), "sym", F.col("q").alias("p"))
        level = leveled(mine.filter(F.col("n") >= LEAST_NEXT).join(total, ["low", "x"]).join(suffix, ["low", "sym"]))
        dropped(*used)
        tidied(spark)
    whole = reduce(DataFrame.unionByName, model) if model else saved(spark.createDataFrame([], "key long, value double, n long"))
    return Tree(root, counts, usual, one, first, Values.of(whole, HOT, USED), depth - 1)


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """A row for each text with what tasks know of it, under a key of its own, and rows for its other words and keys."""
    counts, total, usual, one, first_values, held, deepest = shared.value
    floor = np.log10(total) if total else 0.0
    for batch in batches:
        for first, stop, w, lengths in _sequences(batch):
            rows, text_of = batch.column(0).to_numpy()[first:stop], np.repeat(np.arange(stop - first), lengths)
            known = w < len(counts)
            base, more, rest = np.full(len(w), -floor), np.zeros(len(w)), []
            base[known] += np.log10(counts[w[known]] + ADD)
            before = places(lengths)
            at, _, ctx = _longer(w, before, 1, np.arange(len(w)), w, one)
            numbered, key = ctx < len(counts), state_key(ctx, 1)
            more[at[numbered]] += first_values[ctx[numbered]]
            rest += [held.add(key[~numbered], at[~numbered], more), held.add(mixed(key, w[at]), at, more)]
            for depth in range(2, deepest + 1):
                at, ctx, x = _longer(w, before, depth, at, ctx, usual)
                ctx = mixed(ctx, x)
                key = state_key(ctx, depth)
                there = held.filter.may_have(key)
                at, ctx, key = at[there], ctx[there], key[there]
                rest += [held.add(key, at, more), held.add(mixed(key, w[at]), at, more)]
            rare = np.flatnonzero(~known)
            of = text_of[np.concatenate([rare, *[x[0] for x in rest]])]
            key = np.concatenate([w[rare], *[x[1] for x in rest]])
            kind = np.repeat(np.array([WORD, VALUE], np.int32), [len(rare), len(key) - len(rare)])
            _, pick, times = np.unique(mixed(of, key, kind.astype(np.int64)), return_index=True, return_counts=True)
            starts, none = np.cumsum(lengths) - lengths, np.zeros(len(pick))
            columns = [
                (rows, rows[of[pick]]), (mixed(rows), key[pick]), (np.full(len(rows), TEXT, np.int32), kind[pick]), (lengths.astype(np.int64), times),
                (np.add.reduceat(known.astype(np.int64), starts), none.astype(np.int64)), (np.add.reduceat(base, starts), none), (np.add.reduceat(more, starts), none),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["row", "key", "kind", "n", "known", "base", "more"])


def score(rows: DataFrame, tree: Tree) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score) of the encoded texts (row, ids, rare).

    ``row`` is a number that tells rows apart. A null or empty text has its
    end alone. Words and keys that tasks don't have find their counts and
    values by a join; by the way the others are chosen none of them is
    common. An empty table gives no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tree.root.counts, tree.root.floor, tree.usual, tree.one, tree.first, tree.values.sent, tree.depth))
    asked = rows.select("row", "ids", "rare").mapInArrow(lambda b: _scored(b, shared), "row long, key long, kind int, n long, known long, base double, more double")
    words = tree.words.select(F.col("h").alias("key"), F.lit(WORD).alias("kind"), F.col("c").cast("double").alias("value"))
    found = asked.join(words.unionByName(tree.values.rest.select("key", F.lit(VALUE).alias("kind"), "value")).hint("shuffle_hash"), ["key", "kind"], "left")
    value, word = F.coalesce("value", F.lit(0.0)), F.col("kind") == WORD
    tokens_ = F.when(F.col("kind") == TEXT, F.col("n")).otherwise(0)
    known = F.when(word & (value > 0), F.col("n")).otherwise(F.col("known"))
    base = F.when(word, F.col("n") * F.log10(value + ADD)).otherwise(F.col("base"))
    more = F.when(F.col("kind") == VALUE, F.col("n") * value).otherwise(F.col("more"))
    sums = found.groupBy("row").agg(F.sum(tokens_).alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(more).alias("more"))
    return sums.select("row", "n_tokens", "n_known", "base_score", (F.col("base_score") + F.col("more")).alias("score"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "text")
    root, counts = root_of(docs.filter("not held_out"))
    rows = encode(docs, root, "row", "doc_id", "held_out")
    tree = fit(rows.filter("not held_out"), root, counts)
    return rows.select("row", "doc_id", "held_out").join(score(rows, tree), "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
