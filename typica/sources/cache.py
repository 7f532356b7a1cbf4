"""Response cache: a table keyed by model and the hash of the text; content keys, never counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.functions.text import content_key

SCHEMA = "model_id string, key string, output string, timestamp_utc timestamp, duration_seconds double, success boolean"


def hits(texts: DataFrame, cache: DataFrame, model_id: str, text_col: str = "text") -> DataFrame:
    """texts with the latest successful output; rows of equal text share it."""
    own = cache.where((F.col("model_id") == model_id) & F.col("success")).groupBy("key").agg(F.max_by("output", F.struct("timestamp_utc", "output")).alias("output"))
    return texts.withColumn("key", content_key(F.col(text_col))).join(own, "key")


def misses(texts: DataFrame, cache: DataFrame, model_id: str, text_col: str = "text") -> DataFrame:
    """Distinct texts without a successful output."""
    own = cache.where((F.col("model_id") == model_id) & F.col("success")).select("key")
    return texts.select(F.col(text_col).alias("text")).distinct().withColumn("key", content_key(F.col("text"))).join(own, "key", "left_anti")


def retried(call: Callable[[DataFrame], DataFrame], times: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """call, tried again so many times after wait, twice, four times ... that many seconds; the last error is raised."""

    def attempt(rows: DataFrame) -> DataFrame:
        for k in range(times + 1):
            try:
                return call(rows)
            except Exception:
                if k == times:
                    raise
                sleep(wait * 2**k)
        raise AssertionError

    return attempt


SCORES = "name string, key string, score double"


def scored(texts: DataFrame, name: str, score: Callable[[DataFrame], DataFrame], path: str, text_col: str = "text") -> DataFrame:
    """texts with score, through a table of scores at path: score maps distinct new texts (key, text) to (key, score).

    Scores are found by the texts' hashes, so a table of another batch serves as far as it goes and is never taken by its
    length alone.
    """
    spark = texts.sparkSession
    held = lambda: spark.read.schema(SCORES).parquet(path).where(F.col("name") == name).groupBy("key").agg(F.first("score").alias("score"))
    keyed = texts.withColumn("key", content_key(F.col(text_col)))
    new = keyed.select("key", F.col(text_col).alias("text")).dropDuplicates(["key"]).join(held().select("key"), "key", "left_anti")
    score(new).select(F.lit(name).alias("name"), "key", F.col("score").cast("double").alias("score")).write.mode("append").parquet(path)
    return keyed.join(held(), "key", "left").drop("key")


def filled(texts: DataFrame, cache: DataFrame, model_id: str, call: Callable[[DataFrame], DataFrame], path: str, text_col: str = "text") -> DataFrame:
    """Call a model on the misses only, append its rows (key, output, duration_seconds, success) to the table at path, and return all hits."""
    fresh = call(misses(texts, cache, model_id, text_col)).select(F.lit(model_id).alias("model_id"), "key", "output", F.current_timestamp().alias("timestamp_utc"), "duration_seconds", "success")
    fresh.write.mode("append").parquet(path)
    return hits(texts, texts.sparkSession.read.schema(SCHEMA).parquet(path), model_id, text_col)
