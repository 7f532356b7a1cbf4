"""Embeddings of texts through a content-keyed table: only texts that the table lacks go to the encoder.

An encoder is a Python function from a list of texts to a matrix; it runs on the executors, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.functions.text import content_key

SCHEMA = "model string, key string, v array<float>"


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, v) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encoder(b.column(1).to_pylist()), np.float32) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], ["key", "v"])

    return texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key string, v array<float>")


def embedded(texts: DataFrame, model: str, encoder: Callable[[list[str]], np.ndarray], path: str, text_col: str = "text") -> DataFrame:
    """texts with v; new texts of the model are encoded once each and appended to the table at path, partitioned by model."""
    spark = texts.sparkSession
    keyed = texts.withColumn("key", content_key(F.col(text_col)))
    known = spark.read.schema(SCHEMA).parquet(path).where(F.col("model") == model)
    fresh = keyed.select("key", F.col(text_col).alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    encode(fresh, encoder).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)
    table = spark.read.schema(SCHEMA).parquet(path).where(F.col("model") == model)
    return keyed.join(table.select("key", "v"), "key").drop("key")


def per_model(texts: DataFrame, models: dict[str, Callable[[list[str]], np.ndarray]], path: str, id_col: str, text_col: str = "text") -> dict[str, DataFrame]:
    """model -> (id, v), as the detectors take them."""
    return {m: embedded(texts, m, f, path, text_col).select(F.col(id_col).alias("id"), F.col("v").cast("array<double>").alias("v")) for m, f in models.items()}

