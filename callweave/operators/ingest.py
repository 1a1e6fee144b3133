"""Clips: discovery order, identity, duplicates, warnings, the result cache and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.gates import cache_key

SHORT_S, LONG_S = 0.5, 1800.0


def first_by_path(clips: DataFrame) -> DataFrame:
    """One clip for each id, the first by path."""
    order = Window.partitionBy("clip_id").orderBy("source_path")
    return clips.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def flag_duration(clips: DataFrame, short_s: float = SHORT_S, long_s: float = LONG_S) -> DataFrame:
    """A warning for clips out of the usual lengths; none is dropped."""
    d = F.col("duration_s")
    return clips.withColumn("duration_flag", F.when(d < short_s, "too_short").when(d > long_s, "too_long").otherwise("ok"))


def work(clips: DataFrame, scorers: DataFrame) -> DataFrame:
    """Every clip with every scorer that applies to it. ``scorers(scorer, config_hash, layer, needs)``
    is a short list; ``needs`` is ``barge`` for those that want events or two channels."""
    pairs = clips.crossJoin(F.broadcast(scorers))
    barge = (F.coalesce("n_events", F.lit(0)) > 0) | (F.col("agent_only_path").isNotNull() & F.col("caller_only_path").isNotNull())
    return pairs.where(F.when(F.col("needs") == "barge", barge).otherwise(True)).withColumn("cache_key", cache_key(F.col("clip_id").cast("string"), F.col("scorer"), F.col("config_hash")))


def cache_hits(todo: DataFrame, cache: DataFrame) -> DataFrame:
    """The work with what the cache holds of it, marked ``cached``."""
    return todo.join(cache.drop("cached", "clip_id", "scorer"), "cache_key").withColumn("cached", F.lit(True))


def cache_misses(todo: DataFrame, cache: DataFrame) -> DataFrame:
    return todo.join(cache.select("cache_key"), "cache_key", "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Successes only: an error is tried again next time. Stored as not cached."""
    return results.where("error IS NULL").withColumn("cached", F.lit(False))


def cache_clear(cache: DataFrame, scorer: str | None = None) -> DataFrame:
    """What stays when a scorer's entries, or all, are cleared."""
    return cache.where(F.lit(False)) if scorer is None else cache.where(~F.col("scorer").eqNullSafe(scorer))


def pick_baseline(runs: DataFrame, current: str, wanted: str = "previous") -> DataFrame:
    """The baseline's ``run_id``, or null: for ``previous`` the greatest other id, be it newer;
    else the greatest that equals or begins with what is wanted."""
    rows = runs.select("run_id").distinct()
    rows = rows.where(F.col("run_id") != current) if wanted == "previous" else rows.where(F.col("run_id").startswith(wanted))
    return rows.agg(F.max("run_id").alias("run_id"))
