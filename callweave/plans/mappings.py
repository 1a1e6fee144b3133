"""Deterministic views of the supplied tables as the engine's inputs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.operators import metrics
from callweave.session import ship

#: Ten hours of the event table are one second of a call.
SCALE = 3.6e10
SPLIT = "2000-01-01"
GATES = {"mos_quantity": {"min": 10.0, "warn": 20.0}, "latency_discount": {"max": 0.08, "warn": 0.05}, "tax_gap": {"min": 0.01, "max": 0.06}, "price": {"warn": 2000.0}}
DELTAS = {"mos_quantity": 0.01, "latency_discount": 0.0001, "tax_gap": 0.0001, "price": 50.0}
AB_DELTAS = {"mos_quantity": 0.5, "price": 100.0}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    second = (F.extract(F.lit("SECOND"), F.col(ts)) * 1000000).cast("long")
    return (day * 86400 + clock) * 1000000 + second


def gateway_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events(clip_id, seq, kind, t_s)``: a user is a call."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), "event_type", micros("ts").alias("us"))
    t = (F.col("us") - F.min("us").over(Window.partitionBy("clip_id"))).cast("double") / SCALE
    even = F.col("seq") % 2 == 0
    two = lambda a, b: F.when(even, a).otherwise(b)
    kind = (
        F.when(F.col("event_type") == "view", two("agent_tts_start", "tts_first_audio")).when(F.col("event_type") == "click", two("agent_tts_end", "agent_interrupted")).when(F.col("event_type") == "signup", "user_speech_start")
        .when(F.col("event_type") == "purchase", two("user_speech_end", "stt_final")).otherwise("barge_in_detected")
    )
    return e.select("clip_id", "seq", kind.alias("kind"), t.alias("t_s"))


EV = """ev AS (
  SELECT user_id AS clip_id, event_id AS seq,
    CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'agent_tts_start' ELSE 'tts_first_audio' END
      WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'agent_tts_end' ELSE 'agent_interrupted' END
      WHEN 'signup' THEN 'user_speech_start'
      WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'user_speech_end' ELSE 'stt_final' END
      ELSE 'barge_in_detected' END AS kind,
    CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 3.6e10 AS t_s
  FROM events)"""
SEG = (
    EV
    + """,
seg AS (
  SELECT clip_id, speaker, t_s AS start_s, nxt AS end_s FROM (
    SELECT *, lead(t_s) OVER (PARTITION BY clip_id, speaker ORDER BY t_s, seq) AS nxt FROM (
      SELECT *, CASE WHEN kind LIKE 'agent%' THEN 'agent' ELSE 'caller' END AS speaker FROM ev
      WHERE kind IN ('agent_tts_start', 'agent_tts_end', 'agent_interrupted', 'user_speech_start', 'user_speech_end')))
  WHERE kind IN ('agent_tts_start', 'user_speech_start') AND nxt > t_s)"""
)
MRG = (
    SEG
    + """,
mrg AS (
  SELECT clip_id, speaker, min(start_s) AS start_s, max(end_s) AS end_s FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, speaker ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, max(end_s) OVER (PARTITION BY clip_id, speaker ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg))
  GROUP BY clip_id, speaker, island)"""
)
GAP = (
    MRG
    + """,
gap AS (
  SELECT clip_id, speaker, end_s AS start_s, ns AS end_s, ns - end_s AS gap_s FROM (
    SELECT *, lead(speaker) OVER w AS nsp, lead(start_s) OVER w AS ns FROM mrg WINDOW w AS (PARTITION BY clip_id ORDER BY start_s, end_s, speaker))
  WHERE nsp <> speaker AND ns - end_s > 0)"""
)
OVER = (
    GAP
    + """,
ovl AS (
  SELECT a.clip_id, greatest(a.start_s, c.start_s) AS start_s, least(a.end_s, c.end_s) AS end_s
  FROM mrg a JOIN mrg c ON a.clip_id = c.clip_id AND a.speaker = 'agent' AND c.speaker = 'caller' AND a.start_s < c.end_s AND c.start_s < a.end_s
  WHERE least(a.end_s, c.end_s) - greatest(a.start_s, c.start_s) >= 0.1e0)"""
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer results from order lines; a quantity of 1 stands for a failed scorer."""
    return scored(read(spark, sf_dir, "lineitem"))


def scored(l: DataFrame, *more: str) -> DataFrame:  # noqa: E741
    """Results of order lines with their columns ``more``."""
    bad = F.col("l_quantity") == 1
    m = F.create_map(F.lit("mos_quantity"), F.col("l_quantity").cast("double"), F.lit("latency_discount"), F.col("l_discount").cast("double"), F.lit("tax_gap"), F.col("l_tax").cast("double"), F.lit("price"), F.col("l_extendedprice").cast("double"))
    return l.select(
        F.when(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz"), "run_a").otherwise("run_b").alias("run_id"), F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("scorer"),
        F.lit("acoustic").alias("layer"), (F.col("l_linenumber") % 2 == 0).alias("cached"), F.when(bad, "boom").alias("error"), F.col("l_returnflag").alias("agent_version"), F.col("l_linestatus").alias("prompt_version"), m.alias("metrics"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("seq"), *more,
    )


def long_metrics(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    return metrics.flatten(results(spark, sf_dir), by)


RES = """res AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'run_a' ELSE 'run_b' END AS run_id, l_orderkey AS clip_id, l_linenumber AS scorer, 'acoustic' AS layer,
    l_linenumber % 2 = 0 AS cached, CASE WHEN l_quantity = 1 THEN 'boom' END AS error, l_returnflag AS agent_version, l_linestatus AS prompt_version,
    CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS seq, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) AS p
  FROM lineitem)"""
LONG = (
    RES
    + """,
lng AS (
  SELECT run_id, clip_id, scorer, layer, cached, error, agent_version, prompt_version, seq, u.metric AS metric, u.value AS value
  FROM res, LATERAL (VALUES ('mos_quantity', q), ('latency_discount', d), ('tax_gap', t), ('price', p)) AS u(metric, value) WHERE error IS NULL
  UNION ALL SELECT run_id, clip_id, scorer, layer, cached, error, agent_version, prompt_version, seq, NULL, NULL FROM res WHERE error IS NOT NULL)"""
)
GATE = (
    LONG
    + """,
gates(metric, lo, hi, wn) AS (VALUES ('mos_quantity', 10e0, NULL, 20e0), ('latency_discount', NULL, 0.08e0, 0.05e0), ('tax_gap', 0.01e0, 0.06e0, NULL), ('price', NULL, NULL, 2000e0)),
g AS (
  SELECT l.*, lo, hi, wn, k.metric IS NOT NULL AND value IS NOT NULL AS gated,
    CASE WHEN k.metric IS NULL OR value IS NULL THEN NULL WHEN value < lo THEN 'fail' WHEN value > hi THEN 'fail'
      WHEN (lo IS NOT NULL OR hi IS NULL) AND value < wn THEN 'warn' WHEN lo IS NULL AND hi IS NOT NULL AND value > wn THEN 'warn' ELSE 'pass' END AS status,
    CASE WHEN k.metric IS NULL OR value IS NULL THEN NULL WHEN value < lo THEN lo WHEN value > hi THEN hi
      WHEN (lo IS NOT NULL OR hi IS NULL) AND value < wn THEN wn WHEN lo IS NULL AND hi IS NOT NULL AND value > wn THEN wn ELSE coalesce(lo, hi) END AS threshold
  FROM lng l LEFT JOIN gates k USING (metric))"""
)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table with ``version`` and ``scenario`` of its order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("scenario"))
    # the map of metrics is made after the join, which so moves and sorts a few numbers for each result
    return metrics.flatten(scored(read(spark, sf_dir, "lineitem").join(o, "l_orderkey"), "version", "scenario"))


AB = (
    LONG
    + """,
mid AS (
  SELECT o_orderstatus AS version, o_orderpriority AS scenario, metric, median(value) AS med, count(DISTINCT clip_id) AS clips
  FROM lng JOIN orders ON clip_id = o_orderkey WHERE error IS NULL GROUP BY ALL)"""
)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs(dimension, human, judge)`` of labelled documents."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    both = lab.join(d.select("doc_id", "lang", "n_chars"), "doc_id")
    return both.select("doc_id", F.col("lang").alias("dimension"), (1 + 3 * F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("human"), (1 + F.col("n_chars") % 5).cast("int").alias("judge"))


PAIRS = "pr AS (SELECT doc_id, lang AS dimension, 1 + 3 * quality + (1 - toxic) AS h, 1 + n_chars % 5 AS j FROM labels JOIN documents USING (doc_id))"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``moves(call_id, seq, speaker, text, dur_s, latency_s, hangup)`` of conversations."""
    c = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    return c.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "caller").otherwise("agent").alias("speaker"), "text", (F.length("text") / 15).alias("dur_s"), ((F.col("turn") * 37 % 100) / 100).alias("latency_s"), F.lit(False).alias("hangup"))


MOVES = "mv AS (SELECT conv_id AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'caller' ELSE 'agent' END AS speaker, text, CAST(length(text) AS DOUBLE) / 15 AS dur_s, CAST(turn * 37 % 100 AS DOUBLE) / 100 AS latency_s FROM conversations WHERE role IN ('user', 'assistant'))"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clips`` from documents: the content's digest is the id, the document id the path's order."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.sha2("text", 256).alias("clip_id"), F.col("doc_id").alias("seq"), F.format_string("corpus/%08d.wav", "doc_id").alias("source_path"), (F.col("n_chars") / 15).alias("duration_s"), F.col("source").alias("tts_provider"), F.col("lang").alias("domain"))


CLIPS = "cl AS (SELECT sha256(text) AS clip_id, doc_id AS seq, 'corpus/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS source_path, CAST(n_chars AS DOUBLE) / 15 AS duration_s, source AS tts_provider, lang AS domain FROM documents)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
