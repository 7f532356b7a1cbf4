"""Reports of metrics, and their sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detection_rates(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: share of safe rows accepted, of others detected, overall accuracy, gap of the means."""
    safe, up = F.col("is_id") == 1, F.col("score") > threshold
    rate = lambda who, what: F.avg(F.when(who, what.cast("double")))
    return scores.agg(
        rate(safe, up).alias("id_accepted"),
        rate(~safe, ~up).alias("ood_detected"),
        F.avg((up == safe).cast("double")).alias("accuracy"),
        F.abs(F.avg(F.when(safe, F.col("score"))) - F.avg(F.when(~safe, F.col("score")))).alias("separation"),
    )


def flagged_share(decided: DataFrame, n: int, order: str) -> DataFrame:
    """One row (n, flagged_share): the share of pred < 1 among the first n safe rows (is_id = 1), a guard's false positives."""
    first = decided.where("is_id = 1").orderBy(order).limit(n)
    return first.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") < 1).cast("double")).alias("flagged_share"))


def wide(tidy: DataFrame, datasets: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per method; columns dataset_METRIC as text of four decimals. Naming the datasets saves a pass."""
    aggs = [F.format_string("%.4f", F.first(m)).alias(m.upper()) for m in names]
    return tidy.groupBy("method").pivot("dataset", list(datasets)).agg(*aggs)


def lines(report: DataFrame, *columns: str) -> list[str]:
    """A report for a console: a head and a line per row, in columns as wide as what stands in them."""
    names = list(columns) or report.columns
    rows = [names, *([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in report.select(*names).collect())]
    sizes = [max(len(r[i]) for r in rows) for i in range(len(names))]
    return ["  ".join(x.ljust(n) for x, n in zip(r, sizes, strict=True)).rstrip() for r in rows]


def write_csv(report: DataFrame, path: str) -> None:
    """One file with a header; a report has a row per method."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metadata(report: DataFrame, path: str, metadata: Mapping[str, object], at: datetime | None = None) -> None:
    """Run metadata as one JSON row beside a report, with the time of the run: now, unless the caller has a clock."""
    spark = report.sparkSession
    fields = [F.lit(v if isinstance(v, (str, int, float, bool)) else str(v)).alias(k) for k, v in metadata.items()]
    spark.range(1).select(F.date_format(F.current_timestamp() if at is None else F.lit(at), "yyyyMMdd_HHmmss").alias("timestamp"), *fields).coalesce(1).write.mode("overwrite").json(path)
