"""What the training-data operators share: tables, scratch tables, bound variables in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.storage import discard, drop_path, drop_scratch, numbered, scratch_path, session_dir, shared_dir, write_out  # noqa: F401

#: ASCII white space, as the contracts have it: space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(columns: list[str], wanted: str) -> str:
    """wanted, with as many underscores as it takes until no column starts with it in any case."""
    while any(c.lower().startswith(wanted.lower()) for c in columns):
        wanted += "_"
    return wanted


def unclashed(df: DataFrame, *added: str) -> DataFrame:
    """df without the columns, in any case, that have the names of added ones: an operator's own columns replace them."""
    own = {a.lower() for a in added}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in own)) if any(c.lower() in own for c in df.columns) else df


def some_rows(rows: DataFrame, key: Column, most: int, total: int) -> DataFrame:
    """The most rows of the smallest hashes of key, of total: a bound on the hash first, so that tasks pass on few."""
    h = F.xxhash64(key)
    near = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (1.5 * most + 50) / max(1, total))))
    return near.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold the Arrow batches given to Python to so many rows and 16 MB, so that long texts don't add up.

    Spark reads these settings when a query runs, after the operator has returned, so they stay for the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once. A plain column would be pasted into each lambda and computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words between ASCII white space, in order; none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(t, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"[ \t-\r]+")))
