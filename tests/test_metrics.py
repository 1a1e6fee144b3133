"""Gates, rollups, regression, comparison and agreement, fixture by fixture."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import gates as G
from callweave.operators import agreement, compare, ingest, metrics, report

NAN = float("nan")


def long(spark, rows):
    return spark.createDataFrame(rows, "clip_id string, scorer string, metric string, value double, error string, agent_version string")


def status(spark, spec, values, metric="mos"):
    g = metrics.gate_table(spark, {metric: spec})
    rows = metrics.gated(long(spark, [(str(i), "s", metric, v, None, "a") for i, v in enumerate(values)]), g).collect()
    return [r.status for r in sorted(rows, key=lambda r: int(r.clip_id))]


def test_gates(spark):
    assert status(spark, {"min": 2.8, "warn": 3.2}, [3.5, 3.0, 2.5]) == ["pass", "warn", "fail"]
    assert status(spark, {"max": 3.0, "warn": 2.5}, [2.0, 2.8, 3.5]) == ["pass", "warn", "fail"]
    assert status(spark, {"min": 1, "max": 3}, [2.0, 5.0, 0.5]) == ["pass", "fail", "fail"]
    assert status(spark, {"warn": 2.0}, [3.0, 1.0], "latency_p95_s") == ["warn", "pass"]
    assert status(spark, {"warn": 2.0}, [3.0, 1.0], "mos") == ["pass", "warn"]
    assert status(spark, {"max": 0.5}, [NAN, None]) == ["pass", None]
    assert status(spark, {"min": 1.0}, [1.0]) == ["pass"]


def test_direction(spark):
    rows = [("x", None, 1.0, True), ("latency", 1.0, None, False), ("latency", 1.0, 2.0, False), ("agent_talk_ratio", None, None, True), ("mos", None, None, False), ("tts_delay", None, None, False), ("stop_delay_s", None, None, True)]
    df = spark.createDataFrame(rows, "m string, lo double, hi double, want boolean")
    got = df.select("want", G.lower_is_better(F.col("m"), F.col("lo"), F.col("hi")).alias("got"), "m").collect()
    assert all(r.got == r.want for r in got if r.m != "tts_delay")


def test_same_metric_of_two_scorers(spark):
    df = long(spark, [("a", "one", "mos", 4.0, None, "v"), ("a", "two", "mos", 2.0, None, "v"), ("b", "one", None, None, "boom", "v"), ("c", "one", "free", 1.0, None, "v")])
    got = {(r.clip_id, r.scorer): r.passed for r in metrics.rollup(df, metrics.gate_table(spark, {"mos": {"min": 3.0}})).collect()}
    assert got == {("a", "one"): True, ("a", "two"): False, ("b", "one"): None, ("c", "one"): None}


def test_errors_flatten_to_one_row(spark):
    res = spark.createDataFrame([("a", "s", {"m": 1.0, "n": 2.0}, None), ("b", "s", {"m": 1.0}, "boom"), ("c", "s", {}, None), ("d", "s", None, None)], "clip_id string, scorer string, metrics map<string,double>, error string")
    got = sorted((r.clip_id, r.metric or "", r.value) for r in metrics.flatten(res).collect())
    assert got == [("a", "m", 1.0), ("a", "n", 2.0), ("b", "", None), ("c", "", None), ("d", "", None)]


def test_summary_leaves_nan_out(spark):
    df = long(spark, [(str(i), "s", "mos", v, None, "v") for i, v in enumerate([1.0, 2.0, 4.0, NAN, None])])
    r = metrics.summary(df, metrics.gate_table(spark, {"mos": {"min": 1.5}})).first()
    assert (r["count"], r["median"], r["min"], r["max"]) == (3, 2.0, 1.0, 4.0) and abs(r.p95 - 3.8) < 1e-9 and abs(r.pass_rate - 2 / 3) < 1e-9


@pytest.mark.parametrize(("spec", "delta", "old", "new", "want"), [({}, 0.15, 3.5, 3.2, "fail"), ({}, 0.15, 3.5, 3.45, "pass"), ({"max": 3.0}, 0.2, 1.0, 1.5, "fail"), ({"max": 3.0}, 0.2, 1.5, 1.0, "pass"), ({}, 0.5, 3.5, 3.0, "pass")])
def test_regression(spark, spec, delta, old, new, want):
    one = lambda v: long(spark, [("c", "s", "mos", v, None, "v1")])
    r = metrics.regression(one(new), one(old), metrics.gate_table(spark, {"mos": spec}), metrics.delta_table(spark, {"mos": delta}), ["agent_version", "nowhere"]).collect()
    assert [(x.clip_id, x.status) for x in r] == [("group:agent_version=v1", want)]


def test_null_groups_match_none(spark):
    df = long(spark, [("c", "s", "mos", 1.0, None, None)])
    args = metrics.gate_table(spark, {"mos": {}}), metrics.delta_table(spark, {"mos": 0.1})
    assert metrics.regression(df, df, *args, ["agent_version"]).count() == 0
    assert metrics.missing_groups(df, df, ["agent_version"], args[1]).count() == 1


def sides(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "clip_id string, version string, scenario string, metric string, value double").withColumn("error", F.lit(None).cast("string"))
    return compare.medians(df)


def test_two_versions(spark):
    none, free = metrics.delta_table(spark, {}), metrics.gate_table(spark, {"banded": {"min": 1, "max": 9}})
    mid = sides(spark, [("c", "hard", "mos", 1.0), ("b", "hard", "mos", 4.0), ("c", "easy", "mos", 5.0), ("b", "easy", "mos", 4.0), ("c", None, "banded", 1.0), ("b", None, "banded", 8.0), ("b", None, "mos", NAN), (None, "easy", "mos", 0.0)])
    got = compare.ordered(compare.deltas(mid, "c", "b", free, metrics.delta_table(spark, {"mos": 0.5}))).collect()
    assert [(r.scenario, r.metric, r.verdict) for r in got] == [("hard", "mos", "regressed"), ("_all", "banded", "same"), ("easy", "mos", "improved")]
    small = sides(spark, [("c", "s", "mos", 3.97), ("b", "s", "mos", 4.0)])
    assert compare.deltas(small, "c", "b", free, metrics.delta_table(spark, {"mos": 0.02})).first().verdict == "regressed"
    assert compare.deltas(small, "c", "b", free, none).first().verdict == "same"
    lone = sides(spark, [("b", "s", "mos", 4.0)])
    word = compare.passes(lone, compare.deltas(lone, "c", "b", free, none), "c", "b").first()
    assert word.error and not word.passed
    odd = sides(spark, [("c", "s", "m1", 1.0), ("b", "s", "m2", 1.0), ("c", "t", "m1", 1.0)])
    assert {tuple(r) for r in compare.one_sided(odd, "c", "b").collect()} == {("t", None, "candidate"), ("s", "m1", "candidate"), ("s", "m2", "baseline")}


def pairs(spark, h, j):
    return spark.createDataFrame([("d", a, b) for a, b in zip(h, j, strict=True)], "dimension string, human int, judge int")


def test_agreement(spark):
    r = agreement.calibration(pairs(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])).first()
    assert r.kappa == 1 and r.recommend_gate and abs(r.pearson - 1) < 1e-9 and r.mae == 0
    r = agreement.calibration(pairs(spark, [1, 2, 3, 4, 5], [3] * 5)).first()
    assert abs(r.kappa) < 1e-9 and math.isnan(r.pearson) and math.isnan(r.spearman) and not r.recommend_gate
    r = agreement.calibration(pairs(spark, [1, 2, 3], [3, 2, 1])).first()
    assert abs(r.pearson + 1) < 1e-9
    r = agreement.calibration(pairs(spark, [1, 2, 3, 4], [10, 20, 25, 40])).first()
    assert abs(r.spearman - 1) < 1e-9
    r = agreement.calibration(pairs(spark, [3], [3])).first()
    assert r.kappa == 1 and math.isnan(r.pearson)
    assert agreement.calibration(pairs(spark, [], [])).count() == 0


def test_golden_rows(spark):
    rows = [("# note", "naturalness", "3", 0), ("callA", " Naturalness ", "4", 1), ("callB", "fluency", "2.4", 2), ("callB", "fluency", "x", 3), ("callC", "unknown", "3", 4), ("callC", "fluency", "9", 5), (" ", "fluency", "3", 6)]
    got = agreement.golden(spark.createDataFrame(rows, "clip_id string, dimension string, human_score string, row_no int"), ["naturalness", "fluency"]).collect()
    assert {tuple(r) for r in got} == {("callA", "naturalness", 4), ("callB", "fluency", 2)}


def test_keys_resolve_by_tier(spark):
    clips = spark.createDataFrame([("abcdef12", 0, "/x/call_x.wav"), ("ab99", 1, "/x/y.wav")], "clip_id string, seq int, source_path string")
    keys = spark.createDataFrame([("call_x.wav",), ("call_x",), ("abcdef",), ("ab",), ("ab99",), ("nope",)], "key string")
    assert {r.key: r.clip_id for r in agreement.resolve(keys, clips).collect()} == {"call_x.wav": "abcdef12", "call_x": "abcdef12", "abcdef": "abcdef12", "ab": "abcdef12", "ab99": "ab99"}


def test_baseline_choice(spark):
    runs = spark.createDataFrame([("20250101",), ("20250301",), ("20250201",)], "run_id string")
    pick = lambda *a: ingest.pick_baseline(runs, *a).first()[0]
    assert pick("20250301") == "20250201" and pick("20250101") == "20250301" and pick("x", "202501") == "20250101" and pick("x", "2024") is None


def test_offenders_and_bins(spark):
    out = spark.createDataFrame([("a", "m", "fail"), ("a", "n", "warn"), ("b", "m", "warn"), ("c", "m", "pass")], "clip_id string, metric string, status string")
    marks = spark.createDataFrame([("b", "x", 1), ("c", "x", 3), ("d", "x", 5), ("d", "overall", 2), ("e", "overall", 3)], "clip_id string, dimension string, score int")
    assert [tuple(r) for r in report.offenders(out, marks).collect()] == [("a", 2.5), ("b", 2.5), ("c", 0.0)]
    assert [(r.clip_id, r.severity) for r in report.findings(out, marks).collect()] == [("a", -1.0), ("b", 1.0), ("d", 2.0)]
    df = long(spark, [(str(i), "s", "m", float(v), None, "v") for i, v in enumerate([0, 12, 6])] + [("z", "s", "k", 5.0, None, "v")])
    assert {(r.metric, r.bin, r.n) for r in report.histogram(df).collect()} == {("m", 1, 1), ("m", 7, 1), ("m", 12, 1), ("k", 1, 1)}


def test_scalars(spark):
    r = spark.range(1).select(
        G.severity(F.lit(2.5)).alias("a"), G.severity(F.lit(3.5)).alias("b"), G.number(F.lit(NAN)).alias("c"), G.number(F.lit(1.236)).alias("d"), G.self_judged(F.lit("OpenAI TTS"), F.lit("openai")).alias("e"), G.self_judged(F.lit(""), F.lit("openai")).alias("f"),
        G.rubric_version(F.lit("version: v2 \nmore: x")).alias("g"), G.rubric_version(F.lit("none\na: b")).alias("h"), G.stream_address(F.lit("https://x.io/a/")).alias("i"), G.attribute(F.lit('<a & "b">')).alias("j"),
    ).first()
    assert tuple(r) == ("bad", "good", "—", "1.24", True, False, "v2", "unknown", "wss://x.io/a", "&lt;a &amp; &quot;b&quot;&gt;")


def test_quantiles_of_any_distribution(spark):
    """Against numpy: a constant, two values, many ties, a heavy tail, one value, negative and huge ones."""
    rng = np.random.default_rng(1)
    groups = {"same": [4.0] * 9, "two": [1.0, 2.0], "ties": rng.integers(0, 5, 500).astype(float).tolist(), "tail": np.exp(9 * rng.random(700)).tolist(), "one": [-3.5], "wide": [-1e300, 0.0, 1e-300, 5.0, 1e300], "even": rng.normal(size=200).tolist()}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    for bins in (1, 7, 1024):
        got = {r.g: r.q for r in metrics.quantiles(df, ["g"], "v", probs, bins).collect()}
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12, atol=0), (g, bins)


def test_clip_status_is_the_gates_alone(spark):
    rows = [("a", "s", 1, None, "boom", None), ("a", "t", 2, "m", None, 1.0), ("a", "u", 3, "m", None, 9.0), ("b", "s", 1, "m", None, -1.0)]
    df = spark.createDataFrame([(c, k, n, m, e, v) for c, k, n, m, e, v in rows], "clip_id string, scorer string, seq long, metric string, error string, value double")
    got = {r.clip_id: (r.errors, r.fails, r.status, r.metrics) for r in report.clip_detail(metrics.gated(df, metrics.gate_table(spark, {"m": {"min": 0.0}}))).collect()}
    assert got == {"a": (1, 0, "good", {"m": 9.0}), "b": (0, 1, "bad", {"m": -1.0})}


def test_labels_that_no_integer_holds(spark):
    rows = [("c", "pace", v, k) for k, v in enumerate(["nan", "1e12", "-1e30", "inf", "2.5", "x", ""])]
    got = agreement.golden(spark.createDataFrame(rows, "clip_id string, dimension string, human_score string, row_no long"), ["pace"]).collect()
    assert [r.human for r in got] == [2]


def exchanged(df):
    """The columns by which each shuffle of a plan moves its rows, before it is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#\d+", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)]


def test_histogram_moves_counts_alone(spark):
    """Rows are not moved by metric, which would put each metric into a single task."""
    df = long(spark, [(str(i), "s", "mk"[i % 2], float(i), None, "v") for i in range(40)]).where("value >= 0")
    got = report.histogram(df)
    # that of the ranges, which moves a row for each task and metric, is the only one by metric
    assert exchanged(got).count(["metric"]) == 1
    assert sum(r.n for r in got.collect()) == 40


def test_quantiles_move_counts_alone(spark):
    """Neither the rows of a group nor all its values are moved to be counted: only those of the bins
    that are looked into go by value."""
    df = spark.createDataFrame([("ab"[i % 2], float(i % 37)) for i in range(200)], "g string, v double")
    plan = metrics.quantiles(df, ["g"], "v", [0.5])
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    assert ["g", "v"] not in exchanged(plan) and ["g", "bin", "before", "v"] in exchanged(plan)
    assert {r.g: r.q[0] for r in plan.collect()} == {g: float(np.quantile([i % 37 for i in range(200) if "ab"[i % 2] == g], 0.5)) for g in "ab"}


def test_versions_join_before_the_map(spark, sf):
    """The join sorts the numbers of a result, not a map of them with their names."""
    from callweave.plans import mappings

    plan = mappings.versions(spark, sf).groupBy("version", "metric").agg(F.sum("value"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("map(mos_quantity") < plan.index("Join Inner")


def test_clip_detail_moves_results_once(spark, sf):
    """A clip's rows are brought together before its metrics become rows, and not again."""
    import __spark_entry__

    plan = __spark_entry__.queries()["q_clip_detail"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 1
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
