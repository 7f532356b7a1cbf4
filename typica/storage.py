"""Tables in the folder that all executors share: they cut lineage, and a lost executor costs no rerun."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none: one of our own in local mode, as in tests; an
    error on a cluster, whose executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/typica-shared"


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/typica/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._typica_path = path
    return out


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with a row number that is fixed, because it is written."""
    return write_out(rows.withColumn(column, F.monotonically_increasing_id()), "numbered")


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by write_out, once nothing will read them again."""
    for df in tables:
        drop_path(df.sparkSession, df._typica_path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application in the shared folder; results that read them end with them."""
    drop_path(spark, session_dir(spark))
