"""Sources and sinks: Parquet, CSV and JSON with fixed schemas, optional inputs, stage tables, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at path, or no rows of its schema if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """by: a column to cut the table by, for example a date, so that later filters read only their part."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Keeps the header even without rows: an empty table gets one partition, and so one file."""
    (df.coalesce(1) if df.isEmpty() else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stage(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table under root: read if a whole one is there, else built, written and read."""
    path = f"{root}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs under root, one folder run=... each."""
    return spark.read.parquet(root).select(F.col("run").cast("string")).distinct().orderBy("run")
