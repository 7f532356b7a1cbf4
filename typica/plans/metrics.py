"""Ranking metrics of scores (score double, is_id int): higher scores should be in-distribution rows, is_id = 1.

A batch without rows of one kind has null metrics where they divide by them. All start from counts per distinct score, and
running sums go over ranges of the scores, so that no task holds all of them when there are many. Metrics of one row are
worked out when they are called, with the counts cached for that long; points of curves are left to Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typica.operators import order
from typica.operators.order import ranged, ranges_for
from typica.storage import write_out


def counts(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, p, n): rows of either kind per distinct score."""
    is_id = F.col("is_id") == 1
    return scores.groupBy(*(keys or []), "score").agg(F.sum(is_id.cast("long")).alias("p"), F.sum((~is_id).cast("long")).alias("n"))


def curve(scores: DataFrame, ranges: int | None = None) -> DataFrame:
    """(score, tp, fp, tp0, fp0, P, N, keep): running counts from the highest score down, those before it, and the totals.

    keep is false for a point that lies evenly between its neighbours: the next lower score adds as much of either kind.
    ranges: ranges of scores to sum within before their offsets are added; by default as many as the distinct scores need.
    """
    return curve_of(counts(scores), [], ranges)


def curve_of(c: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """The curve of every group of keys at once from its counts; a group's scores are ranges in several tasks too."""
    ranges = ranges_for(c.count()) if ranges is None else ranges
    c = c.withColumn("part", ranged(c, "score", ranges))
    tops = c.groupBy(*keys, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"), F.max_by(F.struct("p", "n"), "score").alias("top"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("part")), Window.partitionBy(*keys)  # one row per range
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*keys, "part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"), F.lead("top").over(down).alias("under"), F.sum("pp").over(whole).alias("all_p"), F.sum("nn").over(whole).alias("all_n"))
    w = Window.partitionBy(*keys, "part").orderBy(F.desc("score"))
    run = c.select(*keys, "part", "score", "p", "n", F.sum("p").over(w).alias("sp"), F.sum("n").over(w).alias("sn"), F.lead(F.struct("p", "n")).over(w).alias("next"))
    right = offsets.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part").alias("__part"), "p0", "n0", "under", "all_p", "all_n")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("part") == F.col("__part")]
    run = run.join(right if keys else F.broadcast(right), same).withColumn("next", F.coalesce("next", "under"))
    tp, fp = F.col("sp") + F.col("p0"), F.col("sn") + F.col("n0")
    first = (tp == F.col("p")) & (fp == F.col("n"))
    keep = first | F.col("next").isNull() | (F.col("next.p") != F.col("p")) | (F.col("next.n") != F.col("n"))
    return run.select(*keys, "score", tp.alias("tp"), fp.alias("fp"), (tp - F.col("p")).alias("tp0"), (fp - F.col("n")).alias("fp0"), F.col("all_p").alias("P"), F.col("all_n").alias("N"), keep.alias("keep"))


def one_row(scores: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """of the curve, worked out now: one row."""
    c = counts(scores).persist()  # scores may be dear to work out again
    try:
        row = of(curve_of(c, []))
        return scores.sparkSession.createDataFrame([tuple(row.first())], row.schema)
    finally:
        c.unpersist()


def roc(scores: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr): the curve's corners and its ends; the first point has no threshold."""
    points = curve(scores).where("keep").select(F.col("score").alias("threshold"), F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    start = scores.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def auroc_of(tp: Column, fp: Column, tp0: Column, fp0: Column) -> Column:
    return F.try_divide(F.sum((fp - fp0) * (tp + tp0) / 2.0), F.max(tp) * F.max(fp))


def auroc(scores: DataFrame) -> DataFrame:
    return one_row(scores, lambda c: c.agg(auroc_of(*(F.col(x) for x in ("tp", "fp", "tp0", "fp0"))).alias("auroc")))


def average_precision(scores: DataFrame) -> DataFrame:
    step = (F.col("tp") - F.col("tp0")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return one_row(scores, lambda c: c.agg(F.try_divide(F.sum(step), F.max("tp")).alias("auprc")))


def f1_of(eps: float) -> Column:
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide("tp", "P")
    return 2 * precision * recall / (precision + recall + eps)


def f1_curve(scores: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(score, f1) of accepting all rows from that score up."""
    return curve(scores).select("score", f1_of(eps).alias("f1"))


def best_f1(scores: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(f1, threshold): the largest, at the lowest score that reaches it."""
    best = F.max_by("score", F.struct("f1", (-F.col("score")).alias("low"))).alias("threshold")
    return one_row(scores, lambda c: c.select("score", f1_of(eps).alias("f1")).agg(F.max("f1").alias("f1"), best))


def fpr_at(tpr: float) -> Column:
    """Over the curve's corners: the false positive rate at the one nearest to tpr, the highest threshold of equals; it may lie below tpr."""
    near = F.struct(F.abs(F.try_divide("tp", "P") - tpr).alias("gap"), (-F.col("score")).alias("high"))
    return F.min_by(F.try_divide("fp", "N"), F.when(F.col("keep"), near))


def fpr_at_tpr(scores: DataFrame, tpr: float = 0.95) -> DataFrame:
    return one_row(scores, lambda c: c.agg(fpr_at(tpr).alias("fpr95")))


def all_metrics(scores: DataFrame, eps: float = 1e-10) -> DataFrame:
    """One row, from one pass over the curve: auroc, fpr95, auprc, f1."""
    tp, fp, tp0, fp0 = (F.col(c) for c in ("tp", "fp", "tp0", "fp0"))
    auprc = F.try_divide(F.sum((tp - tp0) * tp / (tp + fp)), F.max("P"))
    return one_row(scores, lambda c: c.agg(auroc_of(tp, fp, tp0, fp0).alias("auroc"), fpr_at(0.95).alias("fpr95"), auprc.alias("auprc"), F.max(f1_of(eps)).alias("f1")))


def by_group(scores: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """keys, auroc, auprc, f1 for every group of keys at once."""
    tp, fp, tp0, fp0 = (F.col(c) for c in ("tp", "fp", "tp0", "fp0"))
    counted = write_out(counts(scores, keys), "group-counts")  # read several times; scores may be dear
    return curve_of(counted, keys).groupBy(*keys).agg(
        auroc_of(tp, fp, tp0, fp0).alias("auroc"),
        F.try_divide(F.sum((tp - tp0) * tp / (tp + fp)), F.max("tp")).alias("auprc"),
        F.max(f1_of(eps)).alias("f1"),
    )


def statistics(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.count(F.lit(1)).alias("n"))


def percentile(scores: DataFrame, p: float, column: str = "score") -> float:
    """Linear interpolation between order statistics. One number."""
    return order.percentiles(scores, [p], column)[0]


def decide(scores: DataFrame, threshold: float | None) -> DataFrame:
    """pred: 1 above the threshold, else -1; by default the batch's median."""
    threshold = percentile(scores, 0.5) if threshold is None else threshold
    return scores.withColumn("pred", F.when(F.col("score") > F.lit(threshold), 1).otherwise(-1))


def probabilities(scores: DataFrame) -> DataFrame:
    """proba: scores scaled to [0, 1] over the batch; 0.5 if all are equal."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    if lo is None or hi == lo:
        return scores.withColumn("proba", F.lit(0.5))
    return scores.withColumn("proba", (F.col("score") - lo) / (hi - lo))


PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def rejection_rates(scores: DataFrame, percentiles: tuple[int, ...] = PERCENTILES, *, reject_above: bool = True) -> DataFrame:
    """(threshold_key, threshold, safe_rejection_rate, toxic_rejection_rate, accuracy) at percentiles and at the best F1.

    reject_above rejects scores over the threshold, as the tables of the method do although high scores are safe; False
    rejects those at or under it.
    """
    values = order.percentiles(scores, [p / 100 for p in percentiles])
    best = best_f1(scores, 1e-8).first()["threshold"]
    wanted = [(f"threshold_{i + 1}", v) for i, v in enumerate(values)] + [("optimal_f1", best)]
    safe, aggs = F.col("is_id") == 1, []
    for k, (_, t) in enumerate(wanted):
        rejected = F.col("score") > t if reject_above else F.col("score") <= t
        aggs += [F.avg(F.when(safe, rejected.cast("double"))).alias(f"s{k}"), F.avg(F.when(~safe, rejected.cast("double"))).alias(f"t{k}"), F.avg(((safe & ~rejected) | (~safe & rejected)).cast("double")).alias(f"a{k}")]
    one = scores.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("threshold_key"), F.lit(float(t)).alias("threshold"), *(F.coalesce(f"{c}{k}", F.lit(0.0)).alias(x) for c, x in (("s", "safe_rejection_rate"), ("t", "toxic_rejection_rate"), ("a", "accuracy")))) for k, (n, t) in enumerate(wanted)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """(is_id, bin, lo, hi, n, density): equal bins over all scores, densities per kind."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((F.col("score") - lo) / width), F.lit(bins - 1)).cast("long")
    h = scores.groupBy("is_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("is_id"))
    return h.select("is_id", "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") / total / width).alias("density"))
