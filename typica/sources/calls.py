"""Calls of models over tables: rounds in which only rows that failed go again, and a log of every attempt.

The log under ``folder`` is a table (run, round, model_id, key, input, metadata, output, error, success, timestamp_utc,
duration_seconds). A round is written as a whole under its run and number, so a round that runs twice leaves the same rows,
and a run that was cut off goes on after its last whole round. No text is sent again after a success, in whatever run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from typica.functions.text import content_key

LOG = "model_id string, key string, input string, metadata map<string,string>, output string, error string, success boolean, timestamp_utc timestamp, duration_seconds double"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts so far; empty where nothing was written yet."""
    try:
        return spark.read.schema(f"{LOG}, run string, round int").option("basePath", folder).parquet(f"{folder}/run=*/round=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{LOG}, run string, round int")


def waits(wait: float, jitter: float, run: str, k: int) -> float:
    """Seconds before round k: twice as long each time, and up to jitter of that more, by the run's name."""
    return wait * 2 ** (k - 1) * (1 + jitter * xxhash.xxh64_intdigest(f"{run}:{k}") / 2**64)


def _whole(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def call_all(texts: DataFrame, model_id: str, call: Callable[[DataFrame], DataFrame], folder: str, *, text_col: str = "text", metadata: list[str] = (), times: int = 3, wait: float = 1.0, jitter: float = 0.5, run: str | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> DataFrame:
    """texts with output, error, success and attempts (of all runs), after up to 1 + times rounds.

    call maps rows (key, text) to (key, output, success[, error, duration_seconds]). Each different text is sent once a
    round; a row that call leaves out has failed. If call as a whole fails, its round counts as failed for all its rows, and
    the error is logged. metadata: columns of texts that are logged, of one of the rows with a text. Null texts are empty ones.
    """
    spark, run = texts.sparkSession, run or uuid.uuid4().hex
    keyed = texts.withColumn("key", content_key(F.col(text_col)))
    facts = F.create_map(*(x for c in metadata for x in (F.lit(c), F.col(c).cast("string")))) if metadata else F.create_map().cast("map<string,string>")
    once = keyed.select("key", F.coalesce(F.col(text_col), F.lit("")).alias("text"), facts.alias("metadata")).dropDuplicates(["key"])
    for k in range(times + 1):
        path = f"{folder}/run={run}/round={k}"
        if _whole(spark, path):
            continue
        done = log(spark, folder).where((F.col("model_id") == model_id) & F.col("success") & ~((F.col("run") == run) & (F.col("round") == k)))
        left = once.join(done.select("key").distinct(), "key", "left_anti").persist()
        try:
            if left.isEmpty():
                break
            if k:
                sleep(waits(wait, jitter, run, k))
            now, rows = F.lit(clock().replace(tzinfo=None).isoformat()).cast("timestamp"), left.select("key", "text")
            sent = lambda found, left=left, now=now: left.join(found, "key", "left").select(F.lit(model_id).alias("model_id"), "key", F.col("text").alias("input"), "metadata", "output", F.when(~F.coalesce("success", F.lit(False)), F.coalesce("error", F.lit("no answer"))).alias("error"), F.coalesce("success", F.lit(False)).alias("success"), now.alias("timestamp_utc"), "duration_seconds")
            try:
                found = call(rows)
                more = {c: F.lit(None).cast(t) for c, t in (("error", "string"), ("duration_seconds", "double")) if c not in found.columns}
                answers = found.withColumns(more).select("key", F.col("output").cast("string").alias("output"), "success", "error", "duration_seconds").dropDuplicates(["key"])
                sent(answers).write.mode("overwrite").parquet(path)
            except Exception as e:  # the whole call failed: all of its rows did
                why = F.lit(f"{type(e).__name__}: {e}"[:500])
                sent(rows.select("key", F.lit(None).cast("string").alias("output"), F.lit(False).alias("success"), why.alias("error"), F.lit(None).cast("double").alias("duration_seconds"))).write.mode("overwrite").parquet(path)
        finally:
            left.unpersist()
    own = log(spark, folder).where(F.col("model_id") == model_id).groupBy("key").agg(F.max_by(F.struct("output", "error", "success"), F.struct("success", "timestamp_utc", "round")).alias("x"), F.count(F.lit(1)).alias("attempts"))
    return keyed.join(own, "key", "left").select(*(F.col(f"`{c}`") for c in texts.columns), "x.output", "x.error", "x.success", "attempts")
