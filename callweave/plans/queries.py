"""Every operator as a query over the supplied tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import agreement, compare, dynamics, metrics, timeline
from callweave.plans import mappings as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Floating sums depend on order: compared to 6 places; NaN becomes null with a flag beside it."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def nan_flag(df: DataFrame, *names: str) -> DataFrame:
    flags = {f"{n}_nan": F.coalesce(F.isnan(n), F.lit(False)) for n in names}
    return df.withColumns(flags | {n: F.when(~F.isnan(n), F.round(n, 6)) for n in names})


# timeline and dynamics


@query("WITH " + M.SEG + " SELECT clip_id, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM seg")
def q_event_segments(spark, sf):
    return r6(timeline.pair_events(M.gateway_events(spark, sf)), "start_s", "end_s")


TTFT = M.EV + """,
tt AS (SELECT clip_id, seq, t_s - heard AS latency_s FROM (
  SELECT *, max(CASE WHEN kind = 'stt_final' THEN t_s END) OVER (PARTITION BY clip_id ORDER BY t_s, CASE WHEN kind = 'stt_final' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS heard
  FROM ev WHERE kind IN ('stt_final', 'tts_first_audio')) WHERE kind = 'tts_first_audio' AND heard IS NOT NULL)"""
STATS = "round(quantile_cont(latency_s, 0.5), 6) AS latency_p50_s, round(quantile_cont(latency_s, 0.95), 6) AS latency_p95_s, round(quantile_cont(latency_s, 0.99), 6) AS latency_p99_s, round(max(latency_s), 6) AS latency_max_s, count(*) AS n_turns"
PS = ("latency_p50_s", "latency_p95_s", "latency_p99_s", "latency_max_s")


@query("WITH " + TTFT + f" SELECT clip_id, {STATS} FROM tt GROUP BY clip_id")
def q_ttft_latency(spark, sf):
    return r6(dynamics.latency_stats(dynamics.ttft(M.gateway_events(spark, sf))), *PS)


TGAP = M.SEG + """,
tg AS (SELECT clip_id, ce AS caller_end_s, min(start_s) - ce AS latency_s FROM (
  SELECT a.clip_id, a.start_s, max(c.end_s) AS ce FROM seg a JOIN seg c ON a.clip_id = c.clip_id AND a.speaker = 'agent' AND c.speaker = 'caller' AND c.end_s <= a.start_s GROUP BY 1, 2) GROUP BY 1, 2)"""


@query("WITH " + TGAP + " SELECT clip_id, round(caller_end_s, 6) AS caller_end_s, round(latency_s, 6) AS latency_s FROM tg")
def q_turn_gap_latency(spark, sf):
    return r6(dynamics.turn_gaps(timeline.pair_events(M.gateway_events(spark, sf))), "caller_end_s", "latency_s")


@query()
def q_latency_method(spark, sf):
    # calls whose id divides by three come without transcripts, so that both methods are used
    ev = M.gateway_events(spark, sf).where("clip_id % 3 <> 0 OR kind <> 'stt_final'")
    return r6(dynamics.latency(ev, timeline.pair_events(ev)), *PS)


ORACLE_SQL["q_latency_method"] = "WITH " + TGAP + """,
tt AS (SELECT clip_id, t_s - heard AS latency_s FROM (
  SELECT *, max(CASE WHEN kind = 'stt_final' THEN t_s END) OVER (PARTITION BY clip_id ORDER BY t_s, CASE WHEN kind = 'stt_final' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS heard
  FROM ev WHERE kind = 'tts_first_audio' OR kind = 'stt_final' AND clip_id % 3 <> 0) WHERE kind = 'tts_first_audio' AND heard IS NOT NULL),
b AS (SELECT clip_id, latency_s, 'ttft_events' AS method FROM tt UNION ALL SELECT clip_id, latency_s, 'turn_gap' FROM tg WHERE clip_id NOT IN (SELECT clip_id FROM tt))
SELECT clip_id, method, """ + STATS + " FROM b GROUP BY clip_id, method"


@query("WITH " + M.MRG + " SELECT clip_id, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM mrg")
def q_interval_union(spark, sf):
    return r6(timeline.union(timeline.pair_events(M.gateway_events(spark, sf))), "start_s", "end_s")


@query("WITH " + M.OVER + " SELECT clip_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM ovl")
def q_interval_intersect(spark, sf):
    return r6(timeline.intersect(timeline.union(timeline.pair_events(M.gateway_events(spark, sf)))), "start_s", "end_s")


@query("WITH " + M.GAP + " SELECT clip_id, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(gap_s, 6) AS gap_s FROM gap")
def q_turn_gaps(spark, sf):
    return r6(timeline.gaps(timeline.union(timeline.pair_events(M.gateway_events(spark, sf)))), "start_s", "end_s", "gap_s")


@query("WITH " + M.GAP + " SELECT clip_id, count(*) FILTER (WHERE gap_s > 1.5e0) AS awkward_gap_count, round(max(gap_s), 6) AS max_gap_s FROM gap GROUP BY clip_id")
def q_awkward_gaps(spark, sf):
    return r6(dynamics.awkward(timeline.gaps(timeline.union(timeline.pair_events(M.gateway_events(spark, sf))))).drop("places"), "max_gap_s")


@query("WITH " + M.OVER + """,
talk AS (SELECT clip_id, sum(CASE WHEN speaker = 'agent' THEN end_s - start_s ELSE 0 END) AS a, sum(CASE WHEN speaker = 'caller' THEN end_s - start_s ELSE 0 END) AS c, max(end_s) AS m FROM mrg GROUP BY 1),
o AS (SELECT clip_id, sum(end_s - start_s) AS o FROM ovl GROUP BY 1), p AS (SELECT clip_id, count(*) FILTER (WHERE gap_s > 1.5e0) AS n, max(gap_s) AS g FROM gap GROUP BY 1)
SELECT clip_id, coalesce(n, 0) AS awkward_gap_count, round(coalesce(g, 0), 6) AS max_gap_s, round(coalesce(o, 0) / m, 6) AS overlap_ratio, round(a / (a + c), 6) AS agent_talk_ratio
FROM talk LEFT JOIN o USING (clip_id) LEFT JOIN p USING (clip_id)""")
def q_turn_taking(spark, sf):
    return r6(dynamics.turn_taking(timeline.pair_events(M.gateway_events(spark, sf))), "max_gap_s", "overlap_ratio", "agent_talk_ratio")


BARGE = M.EV + """,
ba AS (
  SELECT b.clip_id, b.seq, b.t_s AS bt, (SELECT min(s.t_s) FROM ev s WHERE s.clip_id = b.clip_id AND s.kind = 'agent_interrupted' AND s.t_s >= b.t_s) AS st,
    coalesce((SELECT min(u.t_s) FROM ev u WHERE u.clip_id = b.clip_id AND u.kind = 'user_speech_start' AND abs(u.t_s - b.t_s) <= 0.5e0), b.t_s) AS onset
  FROM ev b WHERE b.kind = 'barge_in_detected'),
bx AS (
  SELECT clip_id, seq, bt AS barge_s, round(onset, 3) AS onset_s, coalesce(round(st - bt, 3), 15e0) AS latency_s, coalesce(st - bt <= 1.5e0, false) AS success,
    round((SELECT min(v.t_s) FROM ev v WHERE v.clip_id = ba.clip_id AND v.kind = 'user_speech_end' AND v.t_s >= onset) - onset, 3) AS utterance_s FROM ba)"""


@query("WITH " + BARGE + " SELECT clip_id, seq, round(barge_s, 6) AS barge_s, onset_s, latency_s, utterance_s, success FROM bx")
def q_barge_attempts_events(spark, sf):
    return r6(dynamics.barge_attempts(M.gateway_events(spark, sf)), "barge_s")


@query("WITH " + M.SEG + """
SELECT c.clip_id, round(c.start_s, 6) AS barge_s, round(c.start_s, 3) AS onset_s, round(min_by(a.end_s, a.start_s) - c.start_s, 3) AS latency_s, round(c.end_s - c.start_s, 3) AS utterance_s, min_by(a.end_s, a.start_s) - c.start_s <= 1.5e0 AS success
FROM seg c JOIN seg a ON a.clip_id = c.clip_id AND a.speaker = 'agent' AND c.speaker = 'caller' AND a.start_s < c.start_s AND c.start_s < a.end_s GROUP BY c.clip_id, c.start_s, c.end_s""")
def q_barge_attempts_timeline(spark, sf):
    return r6(dynamics.barge_attempts_timeline(timeline.pair_events(M.gateway_events(spark, sf))), "barge_s")


BARGE_OUT = """SELECT clip_id, round(quantile_cont(latency_s, 0.5) FILTER (WHERE success), 6) AS bargein_latency_p50_s, round(quantile_cont(latency_s, 0.95) FILTER (WHERE success), 6) AS bargein_latency_p95_s,
  count(*) FILTER (WHERE success) = 0 AS bargein_latency_p50_s_nan, count(*) FILTER (WHERE success) = 0 AS bargein_latency_p95_s_nan,
  round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS bargein_success_rate, round(CAST(count(*) FILTER (WHERE success AND utterance_s < 0.1e0) AS DOUBLE) / count(*), 6) AS bargein_false_alarm_rate, count(*) AS n_bargein_events
"""


@query("WITH " + BARGE + BARGE_OUT + "FROM bx GROUP BY clip_id")
def q_barge_metrics(spark, sf):
    ev = M.gateway_events(spark, sf)
    out = dynamics.barge_metrics(dynamics.barge(ev, timeline.pair_events(ev)))
    return r6(nan_flag(out, "bargein_latency_p50_s", "bargein_latency_p95_s"), "bargein_success_rate", "bargein_false_alarm_rate")


VAD = """fl AS (SELECT vec_id AS clip_id, i - 1 AS frame, embedding[i] > 0 AS speech FROM embeddings, generate_series(1, 64) AS s(i)),
rn AS (SELECT clip_id, min(frame) * 0.016e0 AS start_s, (max(frame) + 1) * 0.016e0 AS end_s FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM fl WHERE speech) GROUP BY clip_id, g)"""


def _flags(spark, sf):
    return M.signals(spark, sf).select("clip_id", F.posexplode("x").alias("frame", "v")).select("clip_id", "frame", (F.col("v") > 0).alias("speech"))


@query("WITH " + VAD + " SELECT clip_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM rn")
def q_vad_runs(spark, sf):
    return r6(timeline.runs(_flags(spark, sf), 0.016), "start_s", "end_s")


@query("WITH " + VAD + """,
ml AS (SELECT clip_id, min(start_s) AS start_s, max(end_s) AS end_s FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR start_s - prev > 0.048e0 + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, lag(end_s) OVER (PARTITION BY clip_id ORDER BY start_s) AS prev FROM rn)) GROUP BY clip_id, k)
SELECT clip_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM ml WHERE end_s - start_s >= 0.1e0 - 1e-9""")
def q_vad_smooth(spark, sf):
    return r6(timeline.smooth(timeline.runs(_flags(spark, sf), 0.016), gap=0.048), "start_s", "end_s")


@query("""WITH d AS (SELECT conv_id AS clip_id, role AS label, CAST(turn AS DOUBLE) AS start_s, turn + CAST(length(text) AS DOUBLE) / 15 AS end_s FROM conversations),
h AS (SELECT clip_id, label, sum(end_s - start_s) AS held FROM d GROUP BY 1, 2),
a AS (SELECT clip_id, label FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(held, 6) DESC, label) AS n FROM h) WHERE n = 1)
SELECT d.clip_id, CASE WHEN d.label = a.label THEN 'agent' ELSE 'caller' END AS speaker, start_s, round(end_s, 6) AS end_s FROM d JOIN a USING (clip_id)""")
def q_diarize_label(spark, sf):
    c = M.read(spark, sf, "conversations")
    seg = c.select(F.col("conv_id").alias("clip_id"), F.col("role").alias("label"), F.col("turn").cast("double").alias("start_s"), (F.col("turn") + F.length("text") / 15).alias("end_s"))
    return r6(timeline.label_speakers(seg), "end_s")


# the long table and gates

LONG_COLS = "run_id, clip_id, scorer, layer, cached, error, agent_version, prompt_version, metric, value"


@query("WITH " + M.LONG + f" SELECT {LONG_COLS} FROM lng")
def q_long_table(spark, sf):
    return M.long_metrics(spark, sf).select(*LONG_COLS.split(", "))


@query("WITH " + M.RES + " SELECT clip_id, p AS value FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq, p) AS n FROM res WHERE error IS NULL) WHERE n = 1")
def q_metric_first(spark, sf):
    return metrics.metric_of(M.results(spark, sf), "price")


@query("WITH " + M.RES + " SELECT clip_id, min(seq) AS first_seq FROM res GROUP BY clip_id")
def q_clip_order(spark, sf):
    return metrics.clip_order(M.results(spark, sf))


@query("WITH " + M.LONG + " SELECT DISTINCT metric FROM lng WHERE metric IS NOT NULL")
def q_metric_names(spark, sf):
    return metrics.metric_names(M.results(spark, sf))


def _gates(spark):
    return metrics.gate_table(spark, M.GATES)


@query("WITH " + M.GATE + """ SELECT metric, count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max,
  round(avg(CASE WHEN status = 'fail' THEN 0e0 WHEN status IS NOT NULL THEN 1e0 END), 6) AS pass_rate FROM g WHERE value IS NOT NULL GROUP BY metric""")
def q_summary(spark, sf):
    return r6(metrics.summary(M.long_metrics(spark, sf), _gates(spark)), "mean", "median", "p95", "pass_rate")


def _outcome(spark, sf, *names):
    out = metrics.outcomes(M.long_metrics(spark, sf), _gates(spark))
    return out.where(F.col("metric").isin(*names)).select("run_id", "clip_id", "scorer", "metric", "value", "status", "threshold")


OUTCOME = "WITH " + M.GATE + " SELECT run_id, clip_id, scorer, metric, value, status, threshold FROM g WHERE status IS NOT NULL AND metric IN "


@query(OUTCOME + "('mos_quantity', 'latency_discount')")
def q_absolute_gates(spark, sf):
    return _outcome(spark, sf, "mos_quantity", "latency_discount")


@query(OUTCOME + "('tax_gap')")
def q_banded_gates(spark, sf):
    return _outcome(spark, sf, "tax_gap")


@query(OUTCOME + "('price')")
def q_warn_only(spark, sf):
    return _outcome(spark, sf, "price")


@query("SELECT * FROM (VALUES ('mos_quantity'), ('latency_discount'), ('tax_gap')) t(metric)")
def q_hard_gates(spark, sf):
    return metrics.hard_gates(_gates(spark)).select("metric")


@query("WITH " + M.GATE + " SELECT clip_id, scorer, bool_and(status <> 'fail') AS passed FROM g GROUP BY clip_id, scorer")
def q_passed_rollup(spark, sf):
    return metrics.rollup(M.long_metrics(spark, sf), _gates(spark))


def _runs(spark, sf):
    long = M.long_metrics(spark, sf)
    return long.where("run_id = 'run_b'"), long.where("run_id = 'run_a'")


def _regression_sql(keys: str, name: str) -> str:
    group = f"{keys}, metric" if keys else "metric"
    return "WITH " + M.LONG + f""",
dl(metric, delta) AS (VALUES ('mos_quantity', 0.01e0), ('latency_discount', 0.0001e0), ('tax_gap', 0.0001e0), ('price', 50e0)),
c AS (SELECT {group}, avg(value) AS cur FROM lng WHERE run_id = 'run_b' AND value IS NOT NULL GROUP BY {group}),
b AS (SELECT {group}, avg(value) AS bas FROM lng WHERE run_id = 'run_a' AND value IS NOT NULL GROUP BY {group}),
j AS (SELECT *, CASE WHEN metric = 'latency_discount' THEN cur - bas ELSE bas - cur END AS dr FROM c JOIN b USING ({group}) JOIN dl USING (metric))
SELECT {name} AS clip_id, metric, round(cur, 6) AS current, round(bas, 6) AS baseline, round(dr, 6) AS drop, CASE WHEN dr > delta THEN 'fail' ELSE 'pass' END AS status FROM j"""


def _regression(spark, sf, keys):
    now, old = _runs(spark, sf)
    return r6(metrics.regression(now, old, _gates(spark), metrics.delta_table(spark, M.DELTAS), keys), "current", "baseline", "drop")


@query(_regression_sql("agent_version", "'group:agent_version=' || agent_version"))
def q_regression(spark, sf):
    return _regression(spark, sf, ["agent_version"])


@query(_regression_sql("", "'group:all'"))
def q_regression_all(spark, sf):
    return _regression(spark, sf, [])


@query("WITH " + M.LONG + """, k AS (SELECT CASE WHEN agent_version = 'R' THEN NULL ELSE agent_version END AS agent_version, metric FROM lng WHERE run_id = 'run_b' AND value IS NOT NULL AND metric <> 'tax_gap')
SELECT DISTINCT agent_version, metric FROM k WHERE agent_version IS NULL OR agent_version = 'N'""")
def q_regression_missing_groups(spark, sf):
    now, old = _runs(spark, sf)
    now = now.withColumn("agent_version", F.when(F.col("agent_version") != "R", F.col("agent_version")))
    old = old.where("agent_version <> 'N'")
    return metrics.missing_groups(now, old, ["agent_version"], metrics.delta_table(spark, {k: v for k, v in M.DELTAS.items() if k != "tax_gap"}))


@query("WITH " + M.RES + " SELECT scorer, count(*) AS results, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM res GROUP BY scorer")
def q_scorer_counts(spark, sf):
    return metrics.scorer_counts(M.results(spark, sf))


@query("WITH " + M.GATE + " SELECT count(*) FILTER (WHERE status = 'fail') AS failures, count(*) FILTER (WHERE status = 'warn') AS warnings, count(*) FILTER (WHERE status = 'fail') = 0 AS passed FROM g WHERE run_id = 'run_b'")
def q_verdict(spark, sf):
    now, _ = _runs(spark, sf)
    none = spark.createDataFrame([], "status string")
    return metrics.verdict(metrics.outcomes(now, _gates(spark)), none)


# two versions


@query("WITH " + M.AB + " SELECT version, scenario, metric, round(med, 6) AS median, clips FROM mid")
def q_ab_medians(spark, sf):
    return r6(compare.medians(M.versions(spark, sf)), "median")


@query("WITH " + M.AB + """,
j AS (SELECT c.scenario, c.metric, c.med AS candidate, b.med AS baseline, CASE WHEN c.metric = 'latency_discount' THEN b.med - c.med ELSE c.med - b.med END AS imp,
  CASE c.metric WHEN 'mos_quantity' THEN 0.5e0 WHEN 'price' THEN 100e0 ELSE 0.05e0 END AS t FROM mid c JOIN mid b ON c.version = 'F' AND b.version = 'O' AND c.scenario = b.scenario AND c.metric = b.metric)
SELECT scenario, metric, round(candidate, 6) AS candidate, round(baseline, 6) AS baseline, round(imp, 6) AS improvement,
  CASE WHEN metric = 'tax_gap' THEN 'same' WHEN imp < -t THEN 'regressed' WHEN imp > t THEN 'improved' ELSE 'same' END AS verdict FROM j""")
def q_ab_verdict(spark, sf):
    out = compare.deltas(compare.medians(M.versions(spark, sf)), "F", "O", _gates(spark), metrics.delta_table(spark, M.AB_DELTAS))
    return r6(out, "candidate", "baseline", "improvement")


AB_LESS = "version = 'F' AND scenario = '1-URGENT' OR version = 'O' AND metric = 'price'"


@query("WITH " + M.AB + f""", x AS (SELECT * FROM mid WHERE NOT ({AB_LESS}) AND version IN ('F', 'O')),
s AS (SELECT scenario FROM x GROUP BY 1 HAVING count(DISTINCT version) = 2)
SELECT scenario, CAST(NULL AS VARCHAR) AS metric, CASE min(version) WHEN 'F' THEN 'candidate' ELSE 'baseline' END AS side FROM x GROUP BY scenario HAVING count(DISTINCT version) = 1
UNION ALL SELECT scenario, metric, CASE min(version) WHEN 'F' THEN 'candidate' ELSE 'baseline' END FROM x WHERE scenario IN (SELECT scenario FROM s) GROUP BY scenario, metric HAVING count(DISTINCT version) = 1""")
def q_ab_warnings(spark, sf):
    return compare.one_sided(compare.medians(M.versions(spark, sf)).where(f"NOT ({AB_LESS})"), "F", "O")


# agreement

KAPPA = "1 - sum((h - j) * (h - j)) / (sum(h * h) + sum(j * j) - 2e0 * sum(h) * sum(j) / count(*))"


@query("WITH " + M.PAIRS + f" SELECT dimension, count(*) AS n, round({KAPPA}, 6) AS kappa FROM pr GROUP BY dimension")
def q_kappa(spark, sf):
    d = lambda c: F.col(c).cast("double")
    return r6(M.judged(spark, sf).groupBy("dimension").agg(F.count("*").alias("n"), agreement.kappa(d("human"), d("judge")).alias("kappa")), "kappa")


@query("WITH " + M.PAIRS + " SELECT dimension, round(corr(CAST(h AS DOUBLE), CAST(j AS DOUBLE)), 6) AS pearson FROM pr GROUP BY dimension")
def q_pearson(spark, sf):
    d = lambda c: F.col(c).cast("double")
    return r6(M.judged(spark, sf).groupBy("dimension").agg(agreement.pearson(d("human"), d("judge")).alias("pearson")), "pearson")


RANKS = M.PAIRS + """,
rk AS (SELECT *, rank() OVER (PARTITION BY dimension ORDER BY h) + (count(*) OVER (PARTITION BY dimension, h) - 1) / 2e0 AS rh, rank() OVER (PARTITION BY dimension ORDER BY j) + (count(*) OVER (PARTITION BY dimension, j) - 1) / 2e0 AS rj FROM pr)"""


@query("WITH " + RANKS + " SELECT dimension, round(corr(rh, rj), 6) AS spearman FROM rk GROUP BY dimension")
def q_spearman(spark, sf):
    return r6(agreement.calibration(M.judged(spark, sf)).select("dimension", "spearman"), "spearman")


@query("WITH " + RANKS + f" SELECT dimension, count(*) AS n, round({KAPPA}, 6) AS kappa, round(corr(CAST(h AS DOUBLE), CAST(j AS DOUBLE)), 6) AS pearson, round(corr(rh, rj), 6) AS spearman, round(avg(abs(h - j)), 6) AS mae, {KAPPA} >= 0.6 AS recommend_gate FROM rk GROUP BY dimension")
def q_calibration(spark, sf):
    return r6(agreement.calibration(M.judged(spark, sf)), "kappa", "pearson", "spearman", "mae")


@query("WITH " + M.PAIRS + f", k AS (SELECT dimension, {KAPPA} AS kappa FROM pr GROUP BY 1) SELECT round(avg(kappa), 6) AS macro_kappa, count(*) AS dimensions FROM k")
def q_macro_kappa(spark, sf):
    return r6(agreement.macro_kappa(agreement.calibration(M.judged(spark, sf))), "macro_kappa")
