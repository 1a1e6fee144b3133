"""What a report shows: histograms, findings, offenders, a row for each clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.metrics import real

BINS, TOP = 12, 15


def histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal bins of each metric's real values, numbered from 1; the top edge is in the last bin, a
    constant metric has a range of 1."""
    rows = long.where(real(F.col("value")))
    # the ranges are a row for each metric; a shuffle by metric would bring each to a single task
    span = rows.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    bin_ = F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1).cast("int")
    return rows.join(F.broadcast(span), "metric").groupBy("metric", bin_.alias("bin")).agg(F.count("*").alias("n"))


def worst_status(outcomes: DataFrame) -> DataFrame:
    """``bad`` for a metric with a failure, ``warn`` with a warning, else ``good``."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return outcomes.groupBy("metric").agg(rank.alias("r")).select("metric", F.when(F.col("r") == 2, "bad").when(F.col("r") == 1, "warn").otherwise("good").alias("status"))


def offenders(outcomes: DataFrame, judged: DataFrame, top: int = TOP) -> DataFrame:
    """The clips of greatest weight: 2 for a failure, a half for a warning, and what a judge's score
    of a dimension is under 3; a clip with none of these is not listed, one with a 3 is. Groups that
    regressed count as clips. ``judged(clip_id, dimension, score)``. Ties by clip."""
    gates = outcomes.where("status IN ('fail', 'warn')").select("clip_id", F.when(F.col("status") == "fail", 2.0).otherwise(0.5).alias("w"))
    marks = judged.where("score <= 3 AND dimension <> 'overall'").select("clip_id", (3 - F.col("score")).cast("double").alias("w"))
    total = gates.unionByName(marks).groupBy("clip_id").agg(F.sum("w").alias("score"))
    return total.orderBy(F.desc("score"), "clip_id").limit(top)


def findings(outcomes: DataFrame, judged: DataFrame, top: int = TOP) -> DataFrame:
    """Failures, then judge scores of 2 or less from the lowest, the overall ones among them;
    ``judged`` as above. Ties by clip, then name."""
    bad = outcomes.where("status = 'fail'").select("clip_id", F.col("metric").alias("what"), F.lit(-1.0).alias("severity"))
    low = judged.where("score <= 2").select("clip_id", F.col("dimension").alias("what"), F.col("score").cast("double").alias("severity"))
    return bad.unionByName(low).orderBy("severity", "clip_id", "what").limit(top)


def clip_detail(gated: DataFrame) -> DataFrame:
    """A row for each clip of the gated long table: its metrics (of several values the last by
    ``seq``), errors, failures, warnings and status, which is the gates' alone. One pass: a clip has
    as many rows as its scorers have metrics."""
    held = F.array_sort(F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("seq", "value", "metric"))))
    out = gated.groupBy("clip_id").agg(held.alias("held"), F.count_if(F.col("error").isNotNull() & F.col("metric").isNull()).alias("errors"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"))
    names = F.array_sort(F.array_distinct(F.transform("held", lambda h: h["metric"])))
    last = F.transform(names, lambda m: F.element_at(F.filter("held", lambda h: h["metric"] == m), -1)["value"])
    status = F.when(F.col("fails") > 0, "bad").when(F.col("warns") > 0, "warn").otherwise("good")
    return out.select("clip_id", "errors", "fails", "warns", F.when(F.size("held") > 0, F.map_from_arrays(names, last)).alias("metrics"), status.alias("status"))
