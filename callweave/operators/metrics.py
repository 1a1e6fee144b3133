"""The long metric table, summaries, gates and regression against a baseline.

``results`` holds one row for each clip and scorer with ``metrics map<string,double>``; the gate
and delta tables are configuration of a few rows and are broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import gates as G

#: Bins of a group's values in which the ranks of its quantiles are sought.
BINS = 1024
VERSIONS = ("agent_version", "prompt_version", "model_id", "tts_provider")


def gate_table(spark: SparkSession, specs: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(m, *(float(s[k]) if s.get(k) is not None else None for k in ("min", "max", "warn"))) for m, s in specs.items()]
    return spark.createDataFrame(rows, "metric string, min double, max double, warn double")


def delta_table(spark: SparkSession, deltas: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(m, float(d)) for m, d in deltas.items()], "metric string, delta double")


def flatten(results: DataFrame, by: str | None = None) -> DataFrame:
    """One row for each metric; a result with an error or without metrics gives one with nulls. With
    ``by`` results are moved to the place of that key while they are one row each, so that grouping
    the long table by it moves nothing more."""
    if by is not None:
        results = results.repartition(by)
    shown = F.when(F.col("error").isNull(), F.col("metrics"))
    rest = [c for c in results.columns if c != "metrics"]
    return results.select(*rest, F.explode_outer(shown).alias("metric", "value"))


def enrich(results: DataFrame, clips: DataFrame) -> DataFrame:
    """Results with their clip's metadata; of several clips with one id the first by path counts."""
    first = Window.partitionBy("clip_id").orderBy("source_path")
    one = clips.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("clip_id", *[v for v in (*VERSIONS, "scenario") if v in clips.columns])
    return results.join(one, "clip_id", "left")


def metric_of(results: DataFrame, metric: str) -> DataFrame:
    """The value of a metric of each clip from its first result without an error that has it; of
    results with one ``seq`` the least value."""
    has = results.where(F.col("error").isNull() & F.map_contains_key("metrics", metric))
    rows = has.select("clip_id", "seq", F.col("metrics")[metric].alias("value"))
    return rows.groupBy("clip_id").agg(F.min(F.struct("seq", "value"))["value"].alias("value"))


def clip_order(results: DataFrame) -> DataFrame:
    """Distinct clips with their place by first appearance."""
    seen = results.groupBy("clip_id").agg(F.min("seq").alias("first_seq"))
    return seen.select("clip_id", "first_seq")


def metric_names(results: DataFrame) -> DataFrame:
    return results.where("error IS NULL").select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()


def real(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float], bins: int = BINS) -> DataFrame:
    """``keys`` and ``q``, the exact quantiles, linearly interpolated, of each group's real values.

    For groups of any size: bins of values between the group's least and greatest are counted, and
    only in the bins that hold a wanted rank equal values are counted and put in order. No task
    gathers a group or counts all its values: what holds a few rows for each group is broadcast.
    Keys are not null.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    binned = rows.join(F.broadcast(span), keys).withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins).cast("int"))))
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # n stays a column throughout, so that every use of span has the same plan, which is run once
    held = binned.groupBy(*keys, "n", "bin").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(order))
    # wanted ranks from 0: below and above each place between two values
    places = [F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for k, p in enumerate(probabilities)]
    at = held.select("*", F.explode(F.array(*places)).alias("at")).select(*keys, "n", "bin", "m", "upto", "at.k", "at.place")
    hit = at.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
    few = hit.select(*keys, "n", "bin", (F.col("upto") - F.col("m")).alias("before")).distinct()
    inner = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = binned.join(F.broadcast(few), [*keys, "n", "bin"]).groupBy(*keys, "bin", "before", "v").agg(F.count("*").alias("m"))
    values = counted.withColumn("upto", F.col("before") + F.sum("m").over(inner))
    found = values.select(*keys, "bin", "v", "m", "upto").join(F.broadcast(hit.select(*keys, "bin", "k", "place", "rank")), [*keys, "bin"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
    low, high = F.min("v"), F.max("v")
    part = F.first("place") - F.floor(F.first("place"))
    one = found.groupBy(*keys, "k").agg((low + (high - low) * part).alias("x"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("q"))


def gated(long: DataFrame, gates: DataFrame) -> DataFrame:
    """Each row with ``status`` and ``threshold``, in one projection; null where the metric has no
    gate or the row no value."""
    g = F.broadcast(gates.select("metric", "min", "max", "warn", F.lit(True).alias("__gated")))
    s = G.gate(F.col("value"), F.col("metric"), F.col("min"), F.col("max"), F.col("warn"))
    out = long.join(g, "metric", "left").withColumn("__s", F.when(F.col("__gated"), s))
    return out.withColumns({"status": F.col("__s.status"), "threshold": F.col("__s.threshold"), "passed": F.col("__s.status") != "fail"}).drop("min", "max", "warn", "__gated", "__s")


def summary(long: DataFrame, gates: DataFrame) -> DataFrame:
    """Count, mean, median, 95th percentile, least and greatest of each metric over real values, and
    the share of gated ones that pass."""
    rows = long.where(real(F.col("value")))
    out = gated(rows, gates).groupBy("metric").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    q = quantiles(rows, ["metric"], "value", [0.5, 0.95])
    return out.join(q, "metric").select("metric", "count", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "min", "max", "pass_rate")


def outcomes(long: DataFrame, gates: DataFrame) -> DataFrame:
    """The gate's word on each gated row with a value."""
    return gated(long, gates).where("status IS NOT NULL")


def hard_gates(gates: DataFrame) -> DataFrame:
    return gates.where("min IS NOT NULL OR max IS NOT NULL")


def rollup(long: DataFrame, gates: DataFrame) -> DataFrame:
    """Whether each clip and scorer passes: null without a gated metric, a warning passes."""
    return gated(long, gates).groupBy("clip_id", "scorer").agg(F.bool_and("passed").alias("passed"))


def group_means(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.where(real(F.col("value"))).groupBy(*keys, "metric").agg(F.avg("value").alias("mean"))


def regression(current: DataFrame, baseline: DataFrame, gates: DataFrame, deltas: DataFrame, group_by: list[str]) -> DataFrame:
    """Group means against the baseline's, for the metrics of ``deltas``: ``clip_id`` (the group's
    name), ``metric``, ``current``, ``baseline``, ``drop``, ``status``.

    Only columns that both tables have group; without any there is one group. A group with a null
    key matches none, as in ``missing_groups``. A change for the worse beyond the delta fails.
    """
    keys = [k for k in group_by if k in current.columns and k in baseline.columns]
    d = F.broadcast(deltas)
    now = group_means(current.join(d.select("metric"), "metric"), keys).withColumnRenamed("mean", "current")
    old = group_means(baseline.join(d.select("metric"), "metric"), keys).withColumnRenamed("mean", "baseline")
    both = now.join(old, [*keys, "metric"]).join(d, "metric").join(F.broadcast(gates.select("metric", "min", "max")), "metric", "left")
    lower = G.lower_is_better(F.col("metric"), F.col("min"), F.col("max"))
    drop = F.when(lower, F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    return both.select(group_name(keys).alias("clip_id"), "metric", "current", "baseline", drop.alias("drop"), F.when(drop > F.col("delta"), "fail").otherwise("pass").alias("status"))


def group_name(keys: list[str]) -> Column:
    if not keys:
        return F.lit("group:all")
    return F.concat(F.lit("group:"), F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys]))


def missing_groups(current: DataFrame, baseline: DataFrame, keys: list[str], deltas: DataFrame) -> DataFrame:
    """Groups of the current run that the baseline lacks, null keys among them."""
    d = F.broadcast(deltas.select("metric"))
    return group_means(current.join(d, "metric"), keys).join(group_means(baseline.join(d, "metric"), keys), [*keys, "metric"], "left_anti").select(*keys, "metric")


def scorer_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("scorer").agg(F.count("*").alias("results"), F.count_if("cached").alias("cached"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def verdict(outcomes: DataFrame, regressions: DataFrame) -> DataFrame:
    """Failures and warnings over gates and regressions, and whether the run passes."""
    every = outcomes.select("status").unionByName(regressions.select("status"))
    return every.agg(F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "warn").alias("warnings")).withColumn("passed", F.col("failures") == 0)


def union_external(long: DataFrame, external: DataFrame) -> DataFrame:
    """Semantic results of elsewhere joined on; another layer among them is an error."""
    checked = external.withColumn("layer", F.when(F.col("layer") == "semantic", F.col("layer")).otherwise(F.raise_error(F.lit("external results must be of the semantic layer")).cast("string")))
    return long.unionByName(checked, allowMissingColumns=True)
