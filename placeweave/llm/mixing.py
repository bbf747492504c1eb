"""Document rates that bring soft domains to target token totals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, free_name, saved, table

#: In the order in which contradictory labels are taken: toxic before low before high.
PRECEDENCE = ("toxic", "low", "high")
DOMAINS = ("high", "low", "toxic")
#: Labelled documents that the classifier is fitted on at most: those of the smallest hashes of their ids.
LABELLED = 20_000
#: Buckets of hashed words, and of hashed ends of words; the table of their weights is broadcast and has no more rows than that.
BUCKETS, ENDS = 1 << 16, 1 << 14
#: Characters of a word's end.
END = 3
#: Occurrences of average classes that are added to what is counted of a bucket.
PRIOR = 10.0
#: Of the labelled rows this remainder by four fits the softmax regression; the others are counted.
CALIBRATE = 3
#: Weight of the penalty of the regression's squared weights.
RIDGE = 1e-3


@dataclass
class Classifier:
    """Class evidence of hashed words and word ends, averaged over a text, in a softmax regression.

    ``weights`` (bucket, w_high, w_low, w_toxic) has log P(class | bucket) - log P(class);
    ``regression`` a row of coefficients for each class, of the features of :func:`features`.
    ``prior`` stands alone where there are no labels to learn from. ``loss``
    is the mean log-loss of labelled rows that weren't counted, and ``prior_loss`` that of their shares.
    """

    weights: DataFrame | None
    prior: dict[str, float]
    regression: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    loss: float = math.nan
    prior_loss: float = math.nan


@dataclass
class Fit:
    """Aggregates that the fit took, and how far the totals are from the targets, as a share of all tokens."""

    steps: int = 0
    residual: float = math.inf
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) | (toxic == 0), "high")


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, domain) of at most ``most`` labelled documents of ``docs``.

    A label that is null or unknown counts for nothing; of contradictory ones
    the first of PRECEDENCE holds. Rows that repeat an id all have its label.
    """
    order = F.create_map(*[F.lit(x) for i, d in enumerate(PRECEDENCE) for x in (d, i)])
    named = labels.select(F.col("doc_id").alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("_id is not null and domain is not null")
    named = named.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    some = named.groupBy("_id").agg(F.min_by("domain", order[F.col("domain")]).alias("domain")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "_id").select("text", "domain")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _buckets(word: Column) -> list[Column]:
    """The buckets of a word and of its end, told apart by their ranges."""
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    return [hashed(word, BUCKETS), hashed(F.right(word, F.lit(END)), ENDS) + BUCKETS]


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each word of ``text``, with the row's number of words and of different ones; one with a null word where there are none."""
    listed = rows.select(*keep, _words(F.col("text")).alias("words"))
    counted = listed.select(*keep, "words", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("kinds"))
    return counted.select(*keep, "n", "kinds", F.explode_outer("words").alias("word"))


def features(rows: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n (words) and x: mean evidence of words for each class, of word ends for each class, the share of different words, and the logarithm of n.

    ``keep`` has to tell the rows apart.
    """
    words, ends = _buckets(F.col("word"))
    each = _exploded(rows, *keep).select(*keep, "n", "kinds", words.alias("b0"), ends.alias("b1"))
    for i in (0, 1):
        of = weights.filter(F.col("bucket") < BUCKETS if i == 0 else F.col("bucket") >= BUCKETS)
        each = each.join(F.broadcast(of.select(F.col("bucket").alias(f"b{i}"), *[F.col(f"w_{d}").alias(f"w{i}_{d}") for d in DOMAINS])), f"b{i}", "left")
    sums = each.groupBy(*keep).agg(F.first("n").alias("n"), F.first("kinds").alias("kinds"), *[F.coalesce(F.sum(f"w{i}_{d}"), F.lit(0.0)).alias(f"s{i}_{d}") for i in (0, 1) for d in DOMAINS])
    size = F.greatest("n", F.lit(1))
    x = [*[F.col(f"s{i}_{d}") / size for i in (0, 1) for d in DOMAINS], F.col("kinds") / size, F.log1p(F.col("n").cast("double"))]
    return sums.select(*keep, "n", F.array(*x).alias("x"))


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Classifier:
    """Counts by hashed word and word end over labelled rows, and a softmax regression on others of them.

    Buckets are counted by DataFrame aggregates; the regression is fitted
    where the driver sees, of at most ``most`` rows, their class and eight
    numbers. Null texts count as empty. Without labels, or with those of one
    class, the priors stand for every document.
    """
    rows = saved(labelled(docs, labels, most).withColumns({"row": F.monotonically_increasing_id(), "part": F.pmod(F.xxhash64("text"), F.lit(4))}))
    count = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(count.values())
    prior = {d: (count.get(d, 0) + 1) / (total + len(DOMAINS)) for d in DOMAINS}
    if len(count) < 2:
        return Classifier(None, prior)
    learn, apart = rows.filter(F.col("part") != CALIBRATE), rows.filter(F.col("part") == CALIBRATE)
    if apart.select("domain").distinct().count() < len(count):
        apart = rows
    each = _exploded(learn, "domain").filter("word is not null")
    per = each.select("domain", F.explode(F.array(*_buckets(F.col("word")))).alias("bucket")).groupBy("bucket").pivot("domain", list(DOMAINS)).agg(F.count(F.lit(1))).na.fill(0)
    per = saved(per)
    share = per.filter(F.col("bucket") < BUCKETS).agg(*[F.sum(d).alias(d) for d in DOMAINS]).first()
    of = {d: max((share[d] or 0) / max(sum(x or 0 for x in share), 1), 1e-9) for d in DOMAINS}
    seen = sum(F.col(d) for d in DOMAINS)
    weights = saved(per.select("bucket", *[F.log((F.col(d) + PRIOR * of[d]) / (seen + PRIOR) / of[d]).alias(f"w_{d}") for d in DOMAINS]))
    found = features(apart.select("row", "text"), weights, "row").join(apart.select("row", "domain"), "row").collect()  # at most ``most`` rows
    x, y = np.array([r.x for r in found]), np.array([DOMAINS.index(r.domain) for r in found])
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    b = softmax_regression(z, y, len(DOMAINS))
    shares = np.bincount(y, minlength=len(DOMAINS)) / len(y)
    return Classifier(weights, prior, b, center, scale, float(-np.log(softmax(z @ b.T)[np.arange(len(y)), y]).mean()), float(-np.log(shares[y]).mean()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """A row of coefficients for each class by Newton's method with a ridge; x has a column of ones."""
    n, k = x.shape
    b, one = np.zeros((classes, k)), np.eye(classes)[y]
    loss = lambda b: -np.log(np.maximum(softmax(x @ b.T)[np.arange(n), y], 1e-300)).mean() + RIDGE / 2 * (b**2).sum()
    while True:
        p = softmax(x @ b.T)
        slope = (p - one).T @ x / n + RIDGE * b
        if np.abs(slope).max() < 1e-8:
            return b
        curve = np.zeros((classes, k, classes, k))
        for i in range(classes):
            for j in range(classes):
                curve[i, :, j] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x / n
        step = np.linalg.solve(curve.reshape(classes * k, -1) + RIDGE * np.eye(classes * k), slope.ravel()).reshape(classes, k)
        length = 1.0
        while length > 1e-6 and loss(b - length * step) > loss(b) - 1e-4 * length * (slope * step).sum():
            length /= 2
        if length <= 1e-6:
            return b
        b = b - length * step


def soft_domains(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, tokens (words and one end) and ``p``, the probability of each of DOMAINS, of each row.

    Null and empty texts have no words: the regression judges them by their
    length. Without any labels the priors stand for all. Rows are told apart
    by their own numbers, so that ids may repeat or be null.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    own = [f"_k{i}" for i in range(len(keep))]
    back = [F.col(o).alias(k) for o, k in zip(own, keep, strict=True)]
    if model.weights is None:
        tokens = (F.size(_words(F.col("text"))) + 1).cast("long").alias("tokens")
        return rows.select(*back, tokens, F.array(*[F.lit(model.prior[d]) for d in DOMAINS]).alias("p"))
    found = features(rows, model.weights, "_n", *own)
    z = lambda i: (F.col("x")[i] - float(model.center[i])) / float(model.scale[i])
    score = [sum((z(i) * float(b) for i, b in enumerate(row[:-1])), F.lit(float(row[-1]))) for row in model.regression]
    scored = found.select(*own, (F.col("n") + 1).cast("long").alias("tokens"), F.array(*score).alias("s"))
    scored = scored.withColumn("s", F.transform("s", lambda v: F.exp(F.greatest(v - F.array_max("s"), F.lit(-700.0)))))
    return scored.select(*back, "tokens", F.transform("s", lambda v: v / F.aggregate("s", F.lit(0.0), lambda a, b: a + b)).alias("p"))


#: Steps whose rates are one expression; after so many the rates are written down.
FOLDED = 8
#: Added to the metric of a step; with the last, no less than the metric itself, it is a plain gradient step, which always leads down.
DAMPED = (1e-9, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)


def fit_rates(soft: DataFrame, weights: dict[str, float], floor: float = 0.0, tolerance: float = 1e-4, free_total: bool = False) -> tuple[DataFrame, Fit]:
    """``soft`` with a ``rate`` of at least ``floor`` for each row, such that expected domain totals match the targets.

    Least squares by projected gradient: the sums of rate * tokens *
    posterior should be weight * all tokens. Rates begin at 1 (or at the
    floor, if that is more); each step goes against the gradient of the
    squared misses, in the metric of the rows whose rates can move, damped in
    several ways of which the best is taken, and puts what falls under the
    floor back on it. The driver sees some sums a step. Steps end when all totals are within ``tolerance``
    of all tokens, or when no step brings the squared misses down by a
    hundred-thousandth any more: no such rates reach the targets then, and the totals are the nearest.
    ``Fit.residual`` tells how far. An empty table gives no rows.

    With ``free_total`` the total is free as well, and the weights are shares
    of what the domains of positive weight have together, so that rates
    of at least 1 reach them by repeating what is too little. Nothing is asked of a domain of
    weight 0, and documents of such a domain keep a rate of about 1.
    """
    k = len(DOMAINS)
    share = sum(weights.get(d, 0.0) for d in DOMAINS)
    target = np.array([weights.get(d, 0.0) / share for d in DOMAINS])
    q = [F.col("p")[i] for i in range(k)]
    if free_total:  # shares are met when the totals of posterior less weight times the wanted domains' posteriors are 0
        wanted = sum(q[i] for i in range(k) if target[i] > 0)
        q = [q[i] - F.lit(float(target[i])) * wanted if target[i] > 0 else F.lit(0.0) for i in range(k)]
        target = np.zeros(k)
    total = float(soft.agg(F.sum("tokens")).first()[0] or 0)
    fit = Fit(targets=list(target * total))
    if not total:
        return soft.withColumn("rate", F.lit(1.0)), fit

    def moved(rate: Column, y: np.ndarray) -> Column:
        return F.greatest(F.lit(float(floor)), rate - sum(q[i] * F.lit(float(y[i])) for i in range(k)))

    def sums(frame: DataFrame, rates: list[Column]) -> list[np.ndarray]:
        """Domain totals at each of the rates, by total tokens."""
        got = frame.agg(*[F.sum(F.col("tokens") * r * q[i]) for r in rates for i in range(k)]).first()
        fit.steps += 1
        return list(np.array(got).reshape(-1, k) / total)

    def metric(frame: DataFrame, rate: Column, miss: np.ndarray) -> np.ndarray:
        """Products of the posteriors over the rows whose rates can move: those above the floor, and those that the gradient raises."""
        free = (rate > floor) | (sum(q[i] * F.lit(float(miss[i])) for i in range(k)) < 0)
        t = F.when(free, F.col("tokens")).otherwise(0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = frame.agg(*[F.sum(t * q[i] * q[j]) for i, j in pairs]).first()
        fit.steps += 1
        gram = np.zeros((k, k))
        for (i, j), g in zip(pairs, got, strict=True):
            gram[i, j] = gram[j, i] = g / total
        return gram

    frame, rate, folded, tables = soft, F.lit(max(1.0, float(floor))), 0, []
    now = sums(frame, [rate])[0]
    while True:
        miss = now - target
        fit.totals, fit.residual = list(now * total), float(np.abs(miss).max())
        if fit.residual <= tolerance:
            break
        gram = metric(frame, rate, miss)
        steps = [np.linalg.solve(gram + damp * np.eye(k), miss) for damp in DAMPED]
        tried = sums(frame, [moved(rate, y) for y in steps])
        i = min(range(len(steps)), key=lambda j: float(((tried[j] - target) ** 2).sum()))
        if ((tried[i] - target) ** 2).sum() > (1 - 1e-5) * (miss**2).sum():
            break
        rate, now, folded = moved(rate, steps[i]), tried[i], folded + 1
        if folded == FOLDED:
            frame = saved(frame.withColumn("rate", rate))
            dropped(*tables)
            tables, rate, folded = [frame], F.col("rate"), 0
    return frame.withColumn("rate", rate), fit


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their mean; the fraction is rounded by the key's hash, the same in every run."""
    u = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1_000_003)) / 1_000_003.0
    return (F.floor(rate) + (rate - F.floor(rate) > u).cast("long")).cast("long")


#: Production parameters: shares of all tokens.
WEIGHTS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
#: Those of the pipeline, whose first stage takes out what is toxic: what it missed isn't repeated.
KEPT_WEIGHTS = {"high": 0.85, "low": 0.10, "toxic": 0.0}


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, floor: float = 0.0, keep: tuple[str, ...] = ("doc_id",), free_total: bool = False) -> DataFrame:
    """(keep, tokens, p, rate, copies, residual) of each row of ``docs``.

    Domains come from the labelled table: toxic, else low or high quality.
    Rows with a null or repeated doc_id are rows like any other. Null texts
    count as empty. Without labels every row has the priors; an empty table
    gives no rows. ``residual``, the same in all rows, is how far the rates' totals are from
    the targets, as a share of all tokens. Other columns are not read.
    """
    soft = saved(soft_domains(docs, fit_classifier(docs, labels), keep))
    rated, fit = fit_rates(soft, weights, floor, free_total=free_total)
    return rated.withColumns({"copies": copies(F.col("rate"), F.col(keep[-1])), "residual": F.lit(fit.residual)})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic, rate, copies, residual) of each document."""
    rows = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies", "residual")


def repeated(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = KEPT_WEIGHTS, floor: float = 1.0) -> DataFrame:
    """Each document as often as :func:`mix` says with a free total, with its columns, whatever their names; by default no document is left out.

    Rows that repeat an id are rows of their own, and so are those with none.
    An empty table gives no rows.
    """
    row, nth = free_name(docs, "_row"), free_name(docs, "_nth")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    times = mix(numbered, labels, weights, floor, ("doc_id", row), True).filter("copies > 0").select(row, F.col("copies").alias(nth))
    return numbered.join(times, row).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth).cast("int")))).select(*docs.columns)
