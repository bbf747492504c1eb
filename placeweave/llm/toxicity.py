"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts, that share their backoff counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, held_out, raw_texts, saved, table, text_batches
from .hashed import Values, byte_values, mixed, word_hashes

#: Labelled documents the models are fitted on at most: those of the smallest hashes of their ids, up to half of them toxic.
LABELLED = 20_000
DISCOUNT = 0.75
#: Added to the number of words that a word follows, for each word and once for all unseen ones.
UNSEEN = 0.5
#: An expression counts apart if chance would tell its classes so far apart with less than the number of expressions to this power, inverse.
CERTAIN = 2.0
#: Texts that a pair of words is in at least to count apart.
LEAST_TEXTS = 4
#: Of the labelled rows this remainder by four sets the probabilities; the others are counted.
CALIBRATE = 3
#: Expressions that are sent to all tasks at most; a text's other ones meet their values in a join, with the same result.
SENT = 1 << 20
BATCH = 2 << 20

MARKS = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
_VALUES = byte_values(b"\t\n\v\f\r " + MARKS)
#: Before the first word of a text; the key of counts of words alone. A word's hash is greater.
START, ALONE = np.int64(1), np.int64(2)


def words(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, without punctuation, and one end (an empty word); a null text has its end alone."""
    data = (text or "").encode("utf-8", "replace").lower()
    return [*data.translate(bytes.maketrans(MARKS, b" " * len(MARKS))).split(), b""]


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the one before each, and the number of tokens of each text."""
    w, lengths = word_hashes(texts, _VALUES)
    before = np.concatenate([[START], w[:-1]])
    before[np.cumsum(lengths) - lengths] = START
    return w, before, lengths


@dataclass
class Model:
    """Differences of the logarithms of both models' probabilities, toxic less ordinary.

    A token's difference is ``constant``, and the values of its word, of the
    word before it and of both together, where ``values`` has them: what the
    two models share cancels out. ``slope`` and ``shift`` make a probability
    of a text's mean difference.
    """

    constant: float
    values: Values | None
    slope: float
    shift: float


def _chance(toxic: Column, plain: Column, share: Column) -> Column:
    """How far the counts are from ``share``: chance makes them so or more different with a probability under the exponential of its negative."""
    n = toxic + plain
    part = lambda k, e: F.when(k > 0, k * F.log(k / n / e)).otherwise(0.0)
    return part(toxic, share) + part(plain, 1 - share)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and ordinary texts words (before: ALONE) and pairs of words are."""
    for batch in text_batches(batches, BATCH):
        if not batch.num_rows:
            continue
        w, before, lengths = _sequence(raw_texts(batch.column(0)))
        text_of = np.repeat(np.arange(batch.num_rows), lengths)
        before, w, text_of = np.concatenate([before, np.full(len(w), ALONE)]), np.tile(w, 2), np.tile(text_of, 2)
        key = mixed(before, w)
        _, once = np.unique(mixed(key, text_of), return_index=True)
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)[text_of[once]]
        _, at, kind = np.unique(key[once], return_index=True, return_inverse=True)
        n = [np.bincount(kind, x, len(at)).astype(np.int64) for x in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(before[once][at]), pa.array(w[once][at]), *map(pa.array, n)], ["before", "word", "toxic", "plain"])


def counted(texts: DataFrame) -> DataFrame:
    """(before, word, toxic, plain) from (text, toxic boolean): in how many texts of either class words and pairs are, each distinct text once."""
    once = texts.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").distinct()
    found = once.mapInArrow(_counts, "before long, word long, toxic long, plain long")
    return found.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


@dataclass
class Levels:
    """Both models: for each class c the counts above DISCOUNT of the expressions that count apart, and what is left to the level below.

    ``alone`` (word, toxic, plain, p0, p_toxic, p_plain), ``after`` (before,
    left_toxic, left_plain) and ``pairs`` (before, word, q_toxic, q_plain):
    P_c(word) = (count - DISCOUNT) / all + left_c * P0(word), with P0 by the
    number of distinct words before it in both classes; P_c(word | before) is
    the same of pairs, above P_c(word). Whatever doesn't count apart gives
    its whole count to the level below, so each level sums to 1.
    """

    left: dict[str, float]
    alone: DataFrame
    after: DataFrame
    pairs: DataFrame
    p0: DataFrame
    p0_unseen: float


CLASSES = ("toxic", "plain")


def levels(counts: DataFrame) -> Levels | None:
    """The models from ``counts`` (written down); None without texts of both classes."""
    words_, pairs_ = counts.filter(F.col("before") == int(ALONE)).drop("before"), counts.filter(F.col("before") != int(ALONE))
    t = words_.agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), F.count(F.lit(1)).alias("kinds")).first()
    if not t.toxic or not t.plain:
        return None
    follows = pairs_.groupBy("word").agg(F.count(F.lit(1)).alias("follows"))
    all_pairs = pairs_.count()
    floor = all_pairs + UNSEEN * (t.kinds + 1)
    p0 = saved(follows.select("word", ((F.col("follows") + UNSEEN) / floor).alias("p0")))
    above = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    clear = words_.filter(_chance(F.col("toxic"), F.col("plain"), F.lit(t.toxic / (t.toxic + t.plain))) > CERTAIN * math.log(max(t.kinds, 2)))
    clear = saved(clear.join(p0, "word"))
    taken = clear.agg(*[F.coalesce(F.sum(above(c)), F.lit(0.0)).alias(c) for c in CLASSES]).first()
    left = {c: 1 - taken[c] / t[c] for c in CLASSES}
    alone = saved(clear.withColumns({f"p_{c}": above(c) / t[c] + left[c] * F.col("p0") for c in CLASSES}))
    totals = pairs_.groupBy("before").agg(*[F.sum(c).alias(f"all_{c}") for c in CLASSES]).filter("all_toxic > 0 and all_plain > 0")
    p_alone = {c: F.coalesce(f"p_{c}", left[c] * F.col("p0")) for c in CLASSES}
    tested = pairs_.filter(F.col("toxic") + F.col("plain") >= LEAST_TEXTS).join(totals, "before").join(p0, "word").join(alone.drop("p0", "toxic", "plain"), "word", "left")
    odds = [F.col(f"all_{c}") * p_alone[c] for c in CLASSES]
    far = tested.filter(_chance(F.col("toxic"), F.col("plain"), odds[0] / (odds[0] + odds[1])) > CERTAIN * math.log(max(all_pairs, 2)))
    far = saved(far.select("before", "word", *[p_alone[c].alias(f"p_{c}") for c in CLASSES], *[(above(c) / F.col(f"all_{c}")).alias(f"a_{c}") for c in CLASSES]))
    after = saved(far.groupBy("before").agg(*[(1 - F.sum(f"a_{c}")).alias(f"left_{c}") for c in CLASSES]))
    pairs = far.join(after, "before").select("before", "word", *[f"p_{c}" for c in CLASSES], *[(F.col(f"a_{c}") + F.col(f"left_{c}") * F.col(f"p_{c}")).alias(f"q_{c}") for c in CLASSES])
    return Levels(left, alone, after, saved(pairs), p0, UNSEEN / floor)


def _values(found: Levels) -> tuple[float, Values]:
    """The constant and the values of :class:`Model`."""
    ratio = lambda name: F.log(F.col(f"{name}_toxic") / F.col(f"{name}_plain"))
    constant = math.log(found.left["toxic"] / found.left["plain"])
    alone = found.alone.select(F.lit(int(ALONE)).alias("a"), F.col("word").alias("b"), (ratio("p") - constant).alias("value"), (F.col("toxic") + F.col("plain")).alias("n"))
    after = found.after.select(F.col("before").alias("a"), F.lit(0).cast("long").alias("b"), ratio("left").alias("value"), F.lit(1).cast("long").alias("n"))
    both = found.pairs.join(found.after, "before").select(F.col("before").alias("a"), F.col("word").alias("b"), (ratio("q") - ratio("p") - ratio("left")).alias("value"), F.lit(1).cast("long").alias("n"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(b.column(0).to_numpy(), b.column(1).to_numpy())), *b.columns[2:]], ["key", "value", "n"])

    return constant, Values.of(saved(alone.unionByName(after).unionByName(both).mapInArrow(keyed, "key long, value double, n long")), SENT)


def _sums(texts: list[bytes], constant: float, sent) -> tuple[np.ndarray, np.ndarray, list]:  # noqa: ANN001
    """Tokens and sum of differences of each text, and the tokens and keys whose values tasks don't hold."""
    w, before, lengths = _sequence(texts)
    total, place = np.full(len(w), constant), np.arange(len(w))
    asked = [sent.add(key, place, total) for key in (mixed(np.full(len(w), ALONE), w), mixed(before, np.zeros(len(w), np.int64)), mixed(before, w))]
    return lengths.astype(np.int64), np.add.reduceat(total, np.cumsum(lengths) - lengths), asked


def _summed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(row, n, key, sum): a row for each text, with its tokens and sum of differences, and one for each key that tasks don't hold, with its times."""
    for batch in text_batches(batches, BATCH):
        if not batch.num_rows:
            continue
        lengths, sums, asked = _sums(raw_texts(batch.column(1)), *shared.value)
        row = batch.column(0).to_numpy()
        of, key = np.repeat(row, lengths)[np.concatenate([x[0] for x in asked])], np.concatenate([x[1] for x in asked])
        _, one, times = np.unique(mixed(of, key), return_index=True, return_counts=True)
        columns = [np.concatenate(x) for x in ((row, of[one]), (lengths, times), (sums, np.zeros(len(one))))]
        keys = pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(key[one])])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), keys, pa.array(columns[2])], ["row", "n", "key", "sum"])


def differences(rows: DataFrame, constant: float, values: Values) -> DataFrame:
    """(row, difference) from (row long, text): the mean over a text's tokens of the two log-likelihoods' difference."""
    shared = rows.sparkSession.sparkContext.broadcast((constant, values.sent))
    found = rows.select("row", "text").mapInArrow(lambda b: _summed(b, shared), "row long, n long, key long, sum double")
    if values.whole:
        found = found.filter("key is null")  # what the filter wrongly lets pass has no value
    else:
        named = found.join(values.rest.hint("merge"), "key", "left")
        tokens = F.when(F.col("key").isNull(), F.col("n")).otherwise(0)
        found = named.groupBy("row").agg(F.sum(tokens).alias("n"), F.sum(F.col("sum") + F.coalesce(F.col("n") * F.col("value"), F.lit(0.0))).alias("sum"))
    return found.select("row", (F.col("sum") / F.col("n")).alias("difference"))


def fit(labelled: DataFrame) -> Model:
    """The two models from (text, toxic, weight), written down; ``weight`` is how many labelled rows each stands for.

    Kneser-Ney with absolute discounts in three levels: pairs of words by
    class, words by class, and words by the number of distinct words they
    follow in both classes, shared. An expression whose class counts differ
    no more than chance has them is rare evidence: its whole count backs off.
    Slope and shift come from rows that weren't counted, or from all if those
    lack a class. A null text is empty; null labels count for nothing. Without
    both classes, or rows at all, every score is the smoothed share of toxic rows.
    """
    rows = labelled.filter("toxic is not null").withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows.select("row", "text", (F.col("toxic") == 1).alias("toxic"), "weight", F.pmod(F.xxhash64(F.lit("part"), F.coalesce("text", F.lit(""))), F.lit(4)).alias("part")))
    rate = rows.agg(F.sum(F.when(F.col("toxic"), F.col("weight")).otherwise(0)).alias("t"), F.sum("weight").alias("n")).first()
    share = ((rate.t or 0) + 0.5) / ((rate.n or 0) + 1)
    found = levels(saved(counted(rows.filter(F.col("part") != CALIBRATE))))
    if found is None:
        return Model(0.0, None, 0.0, math.log(share / (1 - share)))
    constant, values = _values(found)
    apart = rows.filter(F.col("part") == CALIBRATE)
    if apart.agg(F.count_distinct("toxic")).first()[0] < 2:
        apart = rows
    held = differences(apart, constant, values).join(apart.select("row", "toxic", "weight"), "row").toArrow()  # at most LABELLED rows of four numbers
    x, y, w = (np.array(held[c]).astype(float) for c in ("difference", "toxic", "weight"))
    return Model(constant, values, *logistic(x, y, w))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, lightly shrunk."""
    scale = x.std() or 1.0
    a = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * x.mean() / scale)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, toxic, weight) of at most ``most`` labelled documents that aren't held out: all, where there are no more.

    Beyond that up to half are toxic and the others fill the rest; ``weight``
    is how many labelled rows of its class each stands for. A document is
    toxic if any of its labels says so. Null ids and labels count for nothing.
    """
    named = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"), 5)).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    named = saved(named.join(docs.select("doc_id"), "doc_id", "left_semi"))
    count = {r.toxic: r.n for r in named.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, plain = count.get(True, 0), count.get(False, 0)
    take = {True: min(toxic, max(most // 2, most - plain))}
    take[False] = min(plain, most - take[True])
    parts = [named.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("weight", F.lit(count.get(c, 0) / max(n, 1))) for c, n in take.items()]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "weight")


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with the toxicity (0 to 1) of each row's whole text as ``name``.

    A null text counts as empty: its end alone is scored. Repeated rows are
    scored alike. An empty table gives no rows. A column of that name, in
    whatever case, is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    if model.values is None:
        return docs.withColumn(name, F.lit(1 / (1 + math.exp(-model.shift))))

    def chance(difference: str) -> Column:
        of = F.lit(model.slope) * F.col(difference) + model.shift
        return (1 / (1 + F.exp(-F.greatest(F.least(of, F.lit(500.0)), F.lit(-500.0))))).alias(name)

    if model.values.whole:  # all values are in the tasks: a column more, and no join
        shared = docs.sparkSession.sparkContext.broadcast((model.constant, model.values.sent))
        text, found = [c.lower() for c in docs.columns].index("text"), free_name(docs, "difference")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches, BATCH):
                if batch.num_rows:
                    lengths, sums, _ = _sums(raw_texts(batch.column(text)), *shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums / lengths)], [*batch.schema.names, found])

        return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(found, "double")).select(*docs.columns, chance(found))
    row = free_name(docs, "_row")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    found = differences(numbered.select(F.col(row).alias("row"), "text"), model.constant, model.values).select(F.col("row").alias(row), chance("difference"))
    return numbered.join(found, row).drop(row)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(saved(training_rows(docs, table(spark, sf_dir, "labels"))))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """The documents whose score is under ``reject``, with their columns, whatever their names; see :func:`score`."""
    name = free_name(docs, "toxicity")
    return score(docs, fit(saved(training_rows(docs, labels))), name).filter(F.col(name) < reject).drop(name)
