"""Queries over scores: ranking metrics, thresholds, reports.

The scores are the sums of whole embeddings, rounded so that there are ties; is_id is label < 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.functions import vectors as V
from typica.plans import metrics, report
from typica.plans.registered import query
from typica.plans.registered.vectors import METRICS
from typica.session import table


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.round(V.total(v), 1) + 0.0).alias("score"), (F.col("label") < 7).cast("int").alias("is_id"), F.col("label").cast("long").alias("label"))


S = "s AS (SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 1) + 0.0 AS score, (label < 7)::INT AS is_id, label FROM embeddings)"
SM = f"WITH {S}, {METRICS}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query(f"{SM} SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT score, round(fp / nn::DOUBLE, 6), round(tp / pp::DOUBLE, 6) FROM kept")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc(scores(spark, sf_dir)), "fpr", "tpr")


@query(f"{SM} SELECT round(auroc, 6) AS auroc FROM m")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(scores(spark, sf_dir)), "auroc")


@query(f"{SM} SELECT round(auroc, 6) AS auroc FROM m")
def auroc_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by running sums within ranges of scores, as for very many distinct ones."""
    tp, fp, tp0, fp0 = (F.col(c) for c in ("tp", "fp", "tp0", "fp0"))
    return rounded(metrics.curve(scores(spark, sf_dir), ranges=8).agg(metrics.auroc_of(tp, fp, tp0, fp0).alias("auroc")), "auroc")


@query(f"{SM} SELECT round(fpr95, 6) AS fpr95 FROM m")
def fpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fpr_at_tpr(scores(spark, sf_dir)), "fpr95")


@query(f"{SM} SELECT round(auprc, 6) AS auprc FROM m")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(scores(spark, sf_dir)), "auprc")


@query(f"{SM} SELECT round(2 * pr * rc / (pr + rc + 1e-10), 6) AS f1, score AS threshold FROM f ORDER BY 2 * pr * rc / (pr + rc + 1e-10) DESC, score LIMIT 1")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_f1(scores(spark, sf_dir)), "f1")


@query(f"WITH {S} SELECT is_id, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max, count(*) AS n FROM s GROUP BY is_id")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.statistics(scores(spark, sf_dir), ["is_id"]), "mean", "std")


@query(f"WITH {S}, t AS (SELECT quantile_cont(score, 0.05) AS t FROM s WHERE is_id = 1 AND id % 5 < 3) SELECT id AS vec_id, score, round(t, 6) AS threshold, CASE WHEN score > t THEN 1 ELSE -1 END AS pred FROM s, t")
def threshold_p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    t = metrics.percentile(s.where("is_id = 1 AND id % 5 < 3"), 0.05)
    return metrics.decide(s, t).select(F.col("id").alias("vec_id"), "score", F.lit(round(t, 6)).alias("threshold"), "pred")


@query(f"""WITH {S}, t AS (SELECT quantile_cont(score, 0.05) AS t FROM s WHERE is_id = 1) SELECT round(avg((score > t)::INT) FILTER (is_id = 1), 6) AS id_accepted, round(avg((score <= t)::INT) FILTER (is_id = 0), 6) AS ood_detected,
round(avg(CASE WHEN is_id = 1 THEN (score > t)::INT ELSE (score <= t)::INT END), 6) AS accuracy, round(abs(avg(score) FILTER (is_id = 1) - avg(score) FILTER (is_id = 0)), 6) AS separation FROM s, t""")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return rounded(report.detection_rates(s, metrics.percentile(s.where("is_id = 1"), 0.05)), "id_accepted", "ood_detected", "accuracy", "separation")


@query(f"WITH {S} SELECT id AS vec_id, CASE WHEN score > (SELECT median(score) FROM s) THEN 1 ELSE -1 END AS pred FROM s")
def median_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decide(scores(spark, sf_dir), None).select(F.col("id").alias("vec_id"), "pred")


@query(f"WITH {S} SELECT id AS vec_id, round((score - (SELECT min(score) FROM s)) / ((SELECT max(score) FROM s) - (SELECT min(score) FROM s)), 6) AS proba FROM s")
def minmax_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.probabilities(scores(spark, sf_dir)).select(F.col("id").alias("vec_id"), "proba"), "proba")


def _rates_sql(above: bool) -> str:
    r = "(s.score > w.t)" if above else "(s.score <= w.t)"
    return f"""{SM}, w AS (SELECT 'threshold_' || i AS threshold_key, quantile_cont(score, p) AS t FROM s, (VALUES (1, 0.1), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.9), (6, 0.95), (7, 0.99)) x(i, p) GROUP BY i, p UNION ALL
(SELECT 'optimal_f1', score FROM f ORDER BY 2 * pr * rc / (pr + rc + 1e-8) DESC, score LIMIT 1))
SELECT threshold_key, round(any_value(w.t), 6) AS threshold, round(avg({r}::INT) FILTER (is_id = 1), 6) AS safe_rejection_rate, round(avg({r}::INT) FILTER (is_id = 0), 6) AS toxic_rejection_rate, round(avg(CASE WHEN is_id = 1 THEN 1 - {r}::INT ELSE {r}::INT END), 6) AS accuracy FROM s, w GROUP BY threshold_key"""


def _quantiles(sql: str) -> str:
    """quantile_cont needs a constant fraction: one branch per percentile."""
    branches = " UNION ALL ".join(f"SELECT 'threshold_{i + 1}' AS threshold_key, quantile_cont(score, {p / 100}) AS t FROM s" for i, p in enumerate(metrics.PERCENTILES))
    a, b = sql.index("SELECT 'threshold_'"), sql.index(" UNION ALL\n")
    return sql[:a] + branches + sql[b:]


@query(_quantiles(_rates_sql(True)))
def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rejection_rates(scores(spark, sf_dir)), "threshold", "safe_rejection_rate", "toxic_rejection_rate", "accuracy")


@query(_quantiles(_rates_sql(False)))
def accept_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejecting low scores, as higher is safer."""
    return rounded(metrics.rejection_rates(scores(spark, sf_dir), reject_above=False), "threshold", "safe_rejection_rate", "toxic_rejection_rate", "accuracy")


@query(f"""WITH {S}, b AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / 30 AS w FROM s), h AS (SELECT is_id, least(floor((score - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM s, b GROUP BY 1, 2)
SELECT is_id, bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, n, round(n / sum(n) OVER (PARTITION BY is_id) / w, 6) AS density FROM h, b""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.histogram(scores(spark, sf_dir)), "lo", "hi", "density")


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods on three sets of unwanted rows (labels 7, 8, 9), each against all safe rows: the safe rows are scored once."""
    s = scores(spark, sf_dir)
    both = s.select("label", "is_id", F.explode(F.array(F.struct(F.lit("sum").alias("m"), F.col("score").alias("score")), F.struct(F.lit("neg").alias("m"), (-F.col("score")).alias("score")))).alias("x")).select("label", "is_id", F.col("x.m").alias("method"), F.col("x.score").alias("score"))
    name = F.when(F.col("is_id") == 1, F.array(*(F.lit(f"set{k}") for k in (7, 8, 9)))).otherwise(F.array(F.concat(F.lit("set"), F.col("label").cast("string"))))
    return both.select("method", "is_id", "score", F.explode(name).alias("dataset"))


DS = f"""{S}, ms AS (SELECT label, is_id, 'sum' AS method, score FROM s UNION ALL SELECT label, is_id, 'neg', -score FROM s),
ds AS (SELECT method, is_id, score, 'set' || label AS dataset FROM ms WHERE is_id = 0 UNION ALL SELECT method, is_id, score, d FROM ms, (VALUES ('set7'), ('set8'), ('set9')) x(d) WHERE is_id = 1),
c AS (SELECT method, dataset, score, sum(is_id) AS p, sum(1 - is_id) AS n FROM ds GROUP BY ALL), cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY method, dataset) AS pp FROM c WINDOW w AS (PARTITION BY method, dataset ORDER BY score DESC)),
mm AS (SELECT method, dataset, sum(n * (tp + tp - p) / 2.0::DOUBLE) / (max(tp) * max(fp)) AS auroc, sum(p * (tp / (tp + fp)::DOUBLE)) / max(tp) AS auprc, max(2 * (tp / (tp + fp)::DOUBLE) * (tp / pp::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / pp::DOUBLE + 1e-8)) AS f1 FROM cu GROUP BY ALL)"""


@query(f"WITH {DS} SELECT method, dataset, round(auroc, 4) AS auroc, round(auprc, 4) AS auprc, round(f1, 4) AS f1 FROM mm")
def report_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_group(_datasets(spark, sf_dir), ["method", "dataset"], 1e-8), "auroc", "auprc", "f1", digits=4)


@query(f"WITH {DS} SELECT method, " + ", ".join(f"printf('%.4f', any_value({m}) FILTER (dataset = '{d}')) AS \"{d}_{m.upper()}\"" for d in ("set7", "set8", "set9") for m in ("auroc", "auprc", "f1")) + " FROM mm GROUP BY method")
def report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.wide(metrics.by_group(_datasets(spark, sf_dir), ["method", "dataset"], 1e-8), ["set7", "set8", "set9"], ["auroc", "auprc", "f1"])


@query(f"WITH {S}, d AS (SELECT id, CASE WHEN score > (SELECT median(score) FROM s) THEN 1 ELSE -1 END AS pred, is_id FROM s), f AS (SELECT * FROM d WHERE is_id = 1 ORDER BY id LIMIT 100) SELECT count(*) AS n, round(avg((pred < 1)::INT), 6) AS flagged_share FROM f")
def false_positive_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.flagged_share(metrics.decide(scores(spark, sf_dir), None), 100, "id"), "flagged_share")
