"""Scoring predicted lists against labelled ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fuzzy

#: Predicted and labelled names that are at least so alike (0 to 100) match.
THRESHOLD = 80
#: Labels of a key up to which the fuzzy method compares them with all its predictions.
DIRECT = 32


def exact(predicted: DataFrame, truth: DataFrame, key: str = "image_id", value: str = "item") -> DataFrame:
    """Predictions, doubles kept, that are in the truth of their image."""
    return predicted.join(truth.select(key, value).distinct(), [key, value], "left_semi")


def _dealt(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, key)


def fuzzy_best(predicted: DataFrame, truth: DataFrame, key: str = "image_id", value: str = "item", score: Callable[[Column, Column], Column] | None = None, least: int | None = None, parts: int | None = None) -> DataFrame:
    """key, item, best, score: each distinct prediction with its most similar label, ties to the first in order of the alphabet.

    score: of two columns, in place of the common subsequence's. least: predictions whose best label scores less are left out; keys of more than DIRECT labels then compare
    only the pairs that can reach it (see fuzzy.alike). Without it each prediction meets all labels of its image. parts: how many parts
    the rows are dealt into by key, so that what a task holds doesn't grow with the input; None: Spark's own number.
    """
    p = _dealt(predicted.select(key, value).where(F.col(value).isNotNull()), key, parts).distinct()
    t = _dealt(truth.select(key, F.col(value).alias("best")).where("best is not null"), key, parts).distinct()
    if least is not None and least > 0 and score is None:
        t = t.withColumn("many", F.count("*").over(Window.partitionBy(key)) > DIRECT)
        few, many = t.where("not many").drop("many"), t.where("many").drop("many")
        m, n = F.length(value), F.length("best")
        met = p.join(few, key).where(200 * F.least(m, n) >= (least - 0.5) * (m + n))
        named = lambda df, c: df.select(F.col(key).alias("key"), F.col(c).alias("name"))
        rare = fuzzy.candidates(named(p.join(many.select(key).distinct(), key, "left_semi"), value), named(many, "best"), least)
        pairs = fuzzy.scored(met.toDF("key", "a", "b").union(rare)).where(F.col("score") >= least).toDF(key, value, "best", "score")
    else:
        pairs = p.join(t, key)
        if score:
            pairs = pairs.withColumn("score", score(F.col(value), F.col("best")))
        else:
            pairs = fuzzy.scored(pairs.toDF("key", "a", "b")).toDF(key, value, "best", "score")
        if least is not None:
            pairs = pairs.where(F.col("score") >= least)
    if score is None:  # the rows come from tasks of Python, without their order
        pairs = _dealt(pairs, key, parts)
    found = pairs.groupBy(key, value).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("best"))).alias("m"))
    return found.select(key, value, F.col("m.best").alias("best"), (-F.col("m.s")).alias("score"))


def metrics(predicted: DataFrame, truth: DataFrame, method: str = "exact", key: str = "image_id", value: str = "item", threshold: int = THRESHOLD, score: Callable[[Column, Column], Column] | None = None, parts: int | None = None) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1, tp_rate of each image of the truth.

    A missed label counts by exact comparison, for the fuzzy method too; tp_rate may exceed 1, as predictions count
    with their doubles. The lists lie one below the other and are grouped, so either is read and shuffled once. parts: see fuzzy_best.
    """
    side = lambda df, made, wanted, hit: df.select(key, value, F.lit(made).alias("made"), F.lit(wanted).alias("wanted"), F.lit(hit).alias("hit"))
    rows = side(predicted.where(F.col(key).isNotNull()), 1, 0, 0).union(side(truth, 0, 1, 0))
    if method == "levenshtein":
        rows = rows.union(side(fuzzy_best(predicted, truth, key, value, score, threshold, parts), 0, 0, 1))
    elif method != "exact":
        raise ValueError(f"no such method: {method}")
    alone = F.when(F.col(value).isNull(), F.col("wanted")).alias("alone")  # null names match nothing
    sums = _dealt(rows, key, parts).groupBy(key, value, alone).agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("made", "wanted", "hit")))
    hit = F.col("wanted" if method == "exact" else "hit") > 0
    some = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).alias
    counts = sums.groupBy(key).agg(some("made", hit)("tp"), some("made", ~hit)("fp"), some("wanted", F.col("made") == 0)("fn"), F.sum("wanted").alias("wanted"))
    return with_rates(counts.where("wanted > 0").select(key, "fn", "wanted", "tp", "fp")).drop("wanted")


def with_rates(counts: DataFrame) -> DataFrame:
    """Counts tp, fp, fn, wanted with precision, recall, f1 (0 where undefined) and tp_rate (null where nothing is wanted)."""
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, p, r = F.col("tp"), F.col("precision"), F.col("recall")
    out = counts.withColumns({"precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn")), "tp_rate": F.try_divide(tp.cast("double"), F.col("wanted"))})
    return out.withColumn("f1", share(2 * p * r, p + r))


def macro(scores: DataFrame) -> DataFrame:
    """accuracy and f1_score: the means over all images, rounded half to even."""
    return scores.agg(F.bround(F.avg("tp_rate"), 2).alias("accuracy"), F.bround(F.avg("f1"), 2).alias("f1_score"))
