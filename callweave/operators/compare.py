"""Two agent versions, scenario by scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import gates as G
from callweave.operators.metrics import quantiles, real

EPS = 0.05


def medians(long: DataFrame) -> DataFrame:
    """``version``, ``scenario``, ``metric``, ``median`` and ``clips``. Rows without a version, a
    value or with an error don't count, nor do NaNs; a missing scenario is ``_all``."""
    rows = long.where(F.col("error").isNull() & F.col("version").isNotNull() & real(F.col("value"))).withColumn("scenario", F.coalesce("scenario", F.lit("_all")))
    keys = ["version", "scenario", "metric"]
    # clips are counted in two steps, so that a large group is not gathered in one place
    clips = rows.select(*keys, "clip_id").distinct().groupBy(*keys).agg(F.count("*").alias("clips"))
    return quantiles(rows, keys, "value", [0.5]).select(*keys, F.col("q")[0].alias("median")).join(clips, keys)


def deltas(mid: DataFrame, candidate: str, baseline: str, gates: DataFrame, max_delta: DataFrame, eps: float = EPS) -> DataFrame:
    """``improvement`` and ``verdict`` of every scenario and metric that both versions have; a metric
    with both bounds never changes."""
    of = lambda v, n: F.max(F.when(F.col("version") == v, F.col("median"))).alias(n)
    both = mid.groupBy("scenario", "metric").agg(of(candidate, "candidate"), of(baseline, "baseline")).where("candidate IS NOT NULL AND baseline IS NOT NULL")
    both = both.join(F.broadcast(gates.select("metric", "min", "max")), "metric", "left").join(F.broadcast(max_delta), "metric", "left")
    change = F.col("candidate") - F.col("baseline")
    better = F.when(G.lower_is_better(F.col("metric"), F.col("min"), F.col("max")), -change).otherwise(change)
    t = F.coalesce("delta", F.lit(eps))
    banded = F.col("min").isNotNull() & F.col("max").isNotNull()
    word = F.when(banded, "same").when(better < -t, "regressed").when(better > t, "improved").otherwise("same")
    return both.select("scenario", "metric", "candidate", "baseline", better.alias("improvement"), word.alias("verdict"))


def ordered(delta: DataFrame) -> DataFrame:
    return delta.orderBy(F.col("verdict") != "regressed", "scenario", "metric")


def one_sided(mid: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Scenarios, and metrics of shared scenarios, that only one version has."""
    has = [F.bool_or(F.col("version") == v).alias(n) for v, n in ((candidate, "c"), (baseline, "b"))]
    metric = mid.where(F.col("version").isin(candidate, baseline)).groupBy("scenario", "metric").agg(*has)
    scenario = metric.groupBy("scenario").agg(F.bool_or("c").alias("sc"), F.bool_or("b").alias("sb"))
    side = lambda c: F.when(F.col(c), "candidate").otherwise("baseline").alias("side")
    lone = scenario.where("sc <> sb").select("scenario", F.lit(None).cast("string").alias("metric"), side("sc"))
    odd = metric.join(scenario.where("sc AND sb").select("scenario"), "scenario").where("c <> b").select("scenario", "metric", side("c"))
    return lone.unionByName(odd)


def passes(mid: DataFrame, delta: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """One row: ``error`` when a version has no rows at all, ``regressed`` and ``passed``."""
    sides = mid.agg(F.count_if(F.col("version") == candidate).alias("c"), F.count_if(F.col("version") == baseline).alias("b"))
    bad = delta.agg(F.count_if(F.col("verdict") == "regressed").alias("regressed"))
    error = F.when(F.col("c") == 0, F.lit(f"no results of {candidate}")).when(F.col("b") == 0, F.lit(f"no results of {baseline}"))
    return sides.crossJoin(bad).select(error.alias("error"), "regressed", (error.isNull() & (F.col("regressed") == 0)).alias("passed"))
