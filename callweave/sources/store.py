"""Runs, results and the cache as Parquet, partitioned by run."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def run_id(sha: str = "", now: dt.datetime | None = None) -> str:
    stamp = (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%SZ")
    return f"{stamp}-{sha}" if sha else stamp


def save(df: DataFrame, root: str, table: str, run: str) -> None:
    """Add a run's rows; saving a run again replaces its partition alone."""
    rows = df.withColumn("run_id", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(os.path.join(root, table))


def load(spark: SparkSession, root: str, table: str, run: str | None = None) -> DataFrame | None:
    """A run's rows, or all runs'; None where there is no such table."""
    try:
        df = spark.read.option("basePath", os.path.join(root, table)).parquet(os.path.join(root, table))
    except AnalysisException:
        return None
    df = df.withColumn("run_id", F.col("run_id").cast("string"))
    return df if run is None else df.where(F.col("run_id") == run)


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if k.startswith(("map", "array", "struct")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, root: str, table: str) -> None:
    df.write.mode("append").parquet(os.path.join(root, table))


def whole(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table that isn't by run; None where it is not there."""
    try:
        return spark.read.parquet(os.path.join(root, table))
    except AnalysisException:
        return None


def export_results(df: DataFrame, path: str) -> str:
    """A long table as Parquet, or as CSV where that can't be written; the path that was."""
    try:
        df.write.mode("overwrite").parquet(path)
        return path
    except Exception:  # any writer's failure
        export_csv(df, f"{path}.csv")
        return f"{path}.csv"


def cache_put(results: DataFrame, root: str) -> None:
    """Append successes; the commit of the write makes it atomic."""
    results.where("error IS NULL").withColumn("cached", F.lit(False)).write.mode("append").parquet(os.path.join(root, "cache"))


def cache_get(spark: SparkSession, root: str, enabled: bool = True) -> DataFrame | None:
    if not enabled:
        return None
    try:
        return spark.read.parquet(os.path.join(root, "cache")).dropDuplicates(["cache_key"])
    except AnalysisException:
        return None
