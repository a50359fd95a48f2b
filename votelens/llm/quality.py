"""Quality by Bradley-Terry ranking: preference pairs teach a score, and a quantile of the scores is the threshold.

A document has numbers that tell how it is written (symbols, capitals, repeats, marks), taken by SQL expressions from its
whole text.  In the Bradley-Terry model the log-odds that one document is preferred to another are the difference of their
scores, here linear in these numbers; so each pair of a good and a bad document is one observation of a logistic loss on the
difference of their features.  The threshold is that quantile of the labelled documents' scores which costs least.
Both come from every labelled text: pairs are made by a join, sums over them are taken by tasks, and the driver gets sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import free_names, stored

PAIRS = 4  # each text of the label with more texts is paired with so many of the other
RIDGE = 1.0
#: Of the label with fewer texts, so many are broadcast to be paired; of more, each is in few enough pairs for a shuffle.
FEW = 4096
BUCKET = 20_000  # about so many texts are ranked in a task
KEEP_SCORE = 0.7  # the score at the threshold

FEATURES = (
    "log_words", "symbols", "capitals", "digits", "repeated_words", "repeated_lines", "repeated_pairs", "doubled_words",
    "word_letters", "sentence_ends", "bare_words", "mark_runs", "lines", "same_marks",
)


def text_features(text: Column) -> Column:
    """The numbers of a whole text, in the order of FEATURES; null is the empty text, which has zeros.

    Words are what ASCII white space separates.  Shares of an empty whole are zero.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"[\n\r]+"), lambda w: w != "")

    def left(other: str) -> Column:
        return F.length(F.regexp_replace(t, other, ""))

    def numbers(s: Column) -> Column:
        n, m, k, letters = F.length(t), F.size(s["words"]), F.size(s["lines"]), s["letters"]
        rest = F.greatest(m - 1, F.lit(0))
        ahead = (F.slice(s["words"], 1, rest), F.slice(s["words"], 2, rest))
        pairs = F.array_distinct(F.zip_with(*ahead, lambda a, b: F.concat(a, F.lit(" "), b)))
        same = F.size(F.filter(F.zip_with(*ahead, lambda a, b: a == b), lambda x: x))

        def share(part: Column, whole: Column) -> Column:
            return part.cast("double") / (whole + 1)

        return F.array(
            F.log1p(m), share(left(r"[\p{L}\p{N}\s]+"), n), share(left(r"\P{Lu}+"), letters), share(left("[^0-9]+"), n),
            share(m - F.size(F.array_distinct(s["words"])), m), share(k - F.size(F.array_distinct(s["lines"])), k),
            share(rest - F.size(pairs), m), share(same, m), share(letters, m), share(F.regexp_count(t, F.lit(r"[.!?](?=\s|\z)")), m),
            share(F.regexp_count(t, F.lit(r"(?<!\S)[^\p{L}\s]+(?!\S)")), m), share(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]{2}")), m),
            share(k, m), share(F.regexp_count(t, F.lit(r"([^\p{L}\p{N}\s])\1")), m),
        )

    # a lambda's argument is computed once, unlike a column that is used in many places
    return F.element_at(F.transform(F.array(F.struct(words.alias("words"), lines.alias("lines"), left(r"\P{L}+").alias("letters"))), numbers), 1)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float
    level: float  # the quantile of the labelled documents' scores that the threshold is

    def raw(self, features: Column) -> Column:
        """The Bradley-Terry score: only differences have a meaning."""
        return sum((F.element_at(features, i + 1) * F.lit(w) for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, features: Column) -> Column:
        """From 0 to 1; KEEP_SCORE at the threshold."""
        z = F.least(F.greatest(self.raw(features) - F.lit(self.threshold), F.lit(-30.0)), F.lit(30.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z) * F.lit((1 - KEEP_SCORE) / KEEP_SCORE))


# ---------------------------------------------------------------- learning


def preference_pairs(n_good: int, n_bad: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preferred and of the other document of each pair: every document is in some, evenly."""
    n = max(n_good, n_bad)
    at = np.tile(np.arange(n), pairs)
    shift = np.repeat(np.arange(pairs), n) * (min(n_good, n_bad) // pairs + 1)
    less = (at + shift) % min(n_good, n_bad)
    return (at, less) if n_good >= n_bad else (less, at)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton's method: the loss of a pair is log(1 + exp(-(difference of features) . weights)).

    `sums` gives the slope and the curve (`slope_and_curve`) over all pairs.  Features are scaled, which is undone in the weights.
    """
    w = np.zeros(len(scale))
    for _ in range(100):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), slope - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def slope_and_curve(gaps: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(gaps @ w, -30, 30)))
    return gaps.T @ (1 - p), (gaps * (p * (1 - p))[:, None]).T @ gaps


def unit(spread: np.ndarray) -> np.ndarray:
    """What features are divided by to have unit deviation; one that is always the same counts nothing."""
    return np.where(spread > 1e-9, spread, np.inf)


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The weights for features in memory; `weights_of` finds the same for a table."""
    scale = unit(np.concatenate([good, bad]).std(axis=0))
    one, other = preference_pairs(len(good), len(bad))
    gaps = (good[one] - bad[other]) / scale
    return newton(lambda w: slope_and_curve(gaps, w), scale, ridge)


def quantile_threshold(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(threshold, level): the quantile at which the rejected good and the kept bad documents weigh least, the middle of equals.

    For scores in memory; `threshold_of` finds the same for a table."""
    order = np.argsort(scores, kind="stable")
    s, g, w = scores[order], good[order], weight[order]
    cost = np.concatenate([[0], np.cumsum(w * g)]) + np.concatenate([np.cumsum((w * ~g)[::-1])[::-1], [0]])
    cost[1:-1][s[1:] == s[:-1]] = np.inf  # equal scores stay together
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = int(best[len(best) // 2])
    edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    return float(edge[at]), float(w[:at].sum() / w.sum())


# ---------------------------------------------------------------- Spark


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that learning must not see; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def with_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), x (its features) of each row, stored: each text is read once, and none moves."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), text_features(F.col(text)).alias("x"))
    return stored(rows, "quality")


def ranked(known: DataFrame, texts: int) -> DataFrame:
    """Adds `rank`: the place of each text among its label's in the order of h, from 0.  Ranges of h, a hash, hold about equally many."""
    bits = min(16, max(5, math.ceil(math.log2(texts / BUCKET))))
    cut = known.withColumn("cut", F.shiftright("h", 64 - bits))
    before = Window.partitionBy("label").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("label", "cut").agg(F.count(F.lit(1)).alias("m")).select("label", "cut", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("label", "cut").orderBy("h")) - 1
    return cut.withColumn("inside", inside).join(F.broadcast(offsets), ["label", "cut"]).withColumn("rank", F.col("before") + F.col("inside"))


def pair_gaps(known: DataFrame, n_good: int, n_bad: int, pairs: int = PAIRS) -> DataFrame:
    """gap: the features of the preferred text less the other's, of each of the pairs that `preference_pairs` makes of all texts."""
    most, least = (1, 0) if n_good >= n_bad else (0, 1)
    n = min(n_good, n_bad)
    rows = ranked(known, n_good + n_bad)
    shifts = F.explode(F.array(*[F.lit(k * (n // pairs + 1)) for k in range(pairs)]))
    many = rows.where(F.col("label") == most).select("x", "rank", shifts.alias("shift")).select("x", ((F.col("rank") + F.col("shift")) % n).alias("place"))
    few = rows.where(F.col("label") == least).select(F.col("x").alias("other"), F.col("rank").alias("place"))
    sign = 1.0 if most == 1 else -1.0
    return many.join(F.broadcast(few) if n <= FEW else few, "place").select(F.zip_with("x", "other", lambda a, b: (a - b) * F.lit(sign)).alias("gap"))


def weights_of(known: DataFrame, n_good: int, n_bad: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights learnt from all texts of `known` (label, h, x): each step of Newton's method is a pass over the stored pairs."""
    size = len(FEATURES)
    spread = known.agg(*[F.stddev_pop(F.element_at("x", i + 1)).alias(f"d{i}") for i in range(size)]).first()
    scale = unit(np.array(list(spread), dtype=np.float64))
    gaps = stored(pair_gaps(known, n_good, n_bad), "pairs")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                s, c = slope_and_curve(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) / scale, w)
                slope, curve = slope + s, curve + c
            yield pa.RecordBatch.from_arrays([pa.array([[*slope, *curve.ravel()]], pa.list_(pa.float64()))], names=["s"])

        found = np.array([r["s"] for r in gaps.mapInArrow(part, "s array<double>").collect()]).sum(axis=0)  # a row a task
        return found[:size], found[size:].reshape(size, size)

    return newton(sums, scale, ridge)


def threshold_of(scores: DataFrame, good_weight: float, bad_weight: float) -> tuple[float, float]:
    """`quantile_threshold` of all rows of `scores` (s, good), where those of a kind weigh the same; rows of equal scores are one.

    Scores are dealt by range, and running counts go on from one range to the next; the driver gets a row for each range.
    """
    equal = scores.groupBy("s").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    dealt = stored(equal.repartitionByRange("s").select("s", "g", "b", F.spark_partition_id().alias("part")), "scores")
    ranges = sorted(dealt.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("s").alias("s")).collect(), key=lambda r: r["part"])
    ahead, g, b = {}, 0, 0
    for r in ranges:
        ahead[r["part"]] = (g, b)
        g, b = g + r["g"], b + r["b"]
    table = dealt.sparkSession.createDataFrame([(k, *v) for k, v in ahead.items()], "part int, g0 long, b0 long")
    running = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    below = dealt.join(F.broadcast(table), "part").select(
        "part", "s", (F.col("g0") + F.sum("g").over(running)).alias("g"), (F.col("b0") + F.sum("b").over(running)).alias("b"),
    )
    # a cut right above each score, and one below all
    cuts = below.withColumn("cost", F.col("g") * F.lit(good_weight) + (F.lit(b) - F.col("b")) * F.lit(bad_weight))
    none = b * bad_weight
    least = min(none, cuts.agg(F.min("cost")).first()[0])
    best = cuts.where(F.col("cost") <= F.lit(least + 1e-9))
    ties = sorted((r["part"], r["count"]) for r in best.groupBy("part").count().collect())
    left = (sum(n for _, n in ties) + (none <= least + 1e-9)) // 2 - (none <= least + 1e-9)
    if left < 0:
        return ranges[0]["s"] - 1, 0.0
    for part, n in ties:
        if left < n:
            break
        left -= n
    place = F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1
    at = best.where(F.col("part") == part).withColumn("place", place).where(F.col("place") == left).first()
    above = dealt.where(F.col("s") > F.lit(at["s"])).agg(F.min("s")).first()[0]
    weight = good_weight * at["g"] + bad_weight * at["b"]
    return at["s"] + 1 if above is None else (at["s"] + above) / 2, weight / (good_weight * g + bad_weight * b)


def fit(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Learns from all rows of `with_features` that are labelled and not held out.

    Each different text of a label counts once for the weights; the threshold weighs the texts for all rows that have their
    label.  A text that has both labels is in both.  Without texts of both labels every document gets the same score, which
    tells the label that there is.  Labels other than 0 and 1 are none.
    """
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = rows.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").groupBy("label", "h").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    known = stored(known, "labelled")
    total = {r["label"]: (r["texts"], r["n"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}
    if len(total) < 2:
        return Model((0.0,) * len(FEATURES), -1.0 if 1 in total else 1.0, 0.0 if 1 in total else 1.0)
    (n_good, good_rows), (n_bad, bad_rows) = total[1], total[0]
    model = Model(tuple(map(float, weights_of(known, n_good, n_bad))), 0.0, 0.0)
    scores = known.select(model.raw(F.col("x")).alias("s"), (F.col("label") == 1).alias("good"))
    threshold, level = threshold_of(scores, good_rows / n_good, bad_rows / n_bad)
    return Model(model.weights, threshold, level)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id and score of each row; learnt from the labels of the rows that are not held out."""
    rows = with_features(docs, doc_id, text)
    return rows.select("doc_id", fit(rows, labels, doc_id, label).score(F.col("x")).alias("score"))


def drop_low_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` whose score reaches KEEP_SCORE, with all their columns."""
    (x,) = free_names(docs, "_x")
    return docs.withColumn(x, text_features(F.col(text))).where(model.score(F.col(x)) >= KEEP_SCORE).select(*docs.columns)


def keep_best(docs: DataFrame, model: Model, share: float, text: str = "text") -> DataFrame:
    """The best `share` of the rows: those at or above that quantile of the scores of `docs`; rows of equal scores stay together."""
    (s,) = free_names(docs, "_score")
    ranked = docs.withColumn(s, model.raw(text_features(F.col(text))))
    least = ranked.agg(F.percentile_approx(s, max(0.0, 1 - share), F.lit(10_000))).first()[0]
    return ranked.where(F.col(s) >= F.lit(-math.inf if least is None else least)).select(*docs.columns)
