"""Queries of ingest, cache, judge, signal, report, simulation and streaming, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import gates as G
from callweave.operators import agreement, ingest, judge, metrics, report, signal, simulate
from callweave.plans import mappings as M
from callweave.plans.queries import _gates, query, r6
from callweave.streaming import calls

# labels and clips


@query("""WITH raw AS (SELECT ' ' || CASE WHEN doc_id % 11 = 0 THEN '#' ELSE '' END || 'call' || (doc_id // 2) || ' ' AS c, CASE doc_id % 3 WHEN 0 THEN ' Naturalness' WHEN 1 THEN 'fluency' ELSE 'charm' END AS d,
  CASE doc_id % 7 WHEN 0 THEN '4.4' WHEN 1 THEN 'x' WHEN 2 THEN '9' WHEN 3 THEN '2.6' WHEN 4 THEN 'nan' WHEN 5 THEN '1e12' ELSE '1' END AS s, doc_id AS row_no FROM labels),
num AS (SELECT *, round_even(TRY_CAST(s AS DOUBLE), 0) AS x FROM raw),
ok AS (SELECT trim(c) AS clip_id, lower(trim(d)) AS dimension, CAST(CASE WHEN x BETWEEN 1 AND 5 THEN x END AS INT) AS human, row_no FROM num)
SELECT clip_id, dimension, max_by(human, row_no) AS human FROM ok WHERE clip_id NOT LIKE '#%' AND dimension IN ('naturalness', 'fluency') AND human BETWEEN 1 AND 5 GROUP BY 1, 2""")
def q_golden_filter(spark, sf):
    i = F.col("doc_id")
    raw = M.read(spark, sf, "labels").select(
        F.concat(F.lit(" "), F.when(i % 11 == 0, "#").otherwise(""), F.lit("call"), F.floor(i / 2).cast("string"), F.lit(" ")).alias("clip_id"), F.when(i % 3 == 0, " Naturalness").when(i % 3 == 1, "fluency").otherwise("charm").alias("dimension"),
        F.when(i % 7 == 0, "4.4").when(i % 7 == 1, "x").when(i % 7 == 2, "9").when(i % 7 == 3, "2.6").when(i % 7 == 4, "nan").when(i % 7 == 5, "1e12").otherwise("1").alias("human_score"), i.alias("row_no"),
    )
    return agreement.golden(raw, ["naturalness", "fluency"])


KEYS = "CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' WHEN 2 THEN lpad(CAST(doc_id AS VARCHAR), 8, '0') ELSE left(sha256(text), 12) END"


@query("WITH " + M.CLIPS + f""", k AS (SELECT DISTINCT {KEYS} AS key FROM documents JOIN labels USING (doc_id)),
t AS (SELECT key, clip_id, seq, CASE WHEN clip_id = key THEN 1 WHEN source_path = 'corpus/' || key OR source_path = 'corpus/' || key || '.wav' THEN 2 ELSE 3 END AS tier
  FROM k JOIN cl ON clip_id = key OR source_path = 'corpus/' || key OR source_path = 'corpus/' || key || '.wav' OR starts_with(clip_id, key))
SELECT key, clip_id, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, seq) AS n FROM t) WHERE n = 1""")
def q_golden_resolve(spark, sf):
    d = M.read(spark, sf, "documents").join(M.read(spark, sf, "labels").select("doc_id"), "doc_id")
    i, name = F.col("doc_id"), F.format_string("%08d", "doc_id")
    key = F.when(i % 4 == 0, F.sha2("text", 256)).when(i % 4 == 1, F.concat(name, F.lit(".wav"))).when(i % 4 == 2, name).otherwise(F.left(F.sha2("text", 256), F.lit(12)))
    return agreement.resolve(d.select(key.alias("key")).distinct(), M.clips(spark, sf))


@query("WITH " + M.CLIPS + " SELECT clip_id, source_path FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY source_path) AS n FROM cl) WHERE n = 1")
def q_ingest_dedup(spark, sf):
    return ingest.first_by_path(M.clips(spark, sf)).select("clip_id", "source_path")


@query("WITH " + M.CLIPS + " SELECT source_path, CASE WHEN duration_s < 0.5 THEN 'too_short' WHEN duration_s > 1800 THEN 'too_long' ELSE 'ok' END AS duration_flag FROM cl")
def q_duration_flags(spark, sf):
    return ingest.flag_duration(M.clips(spark, sf)).select("source_path", "duration_flag")


HASH = G.scorer_hash("mos", "1", {"window_s": 20})
KEY = "sha256(clip_id || chr(0) || scorer || chr(0) || '{h}')".replace("{h}", HASH)


def _work(spark, sf):
    clips = M.clips(spark, sf).withColumns({"n_events": F.lit(0), "agent_only_path": F.when(F.col("seq") % 4 == 0, "a.wav"), "caller_only_path": F.when(F.col("seq") % 2 == 0, "c.wav")})
    scorers = spark.createDataFrame([("mos", HASH, "acoustic", "any"), ("barge", HASH, "dynamics", "barge")], "scorer string, config_hash string, layer string, needs string")
    return ingest.work(ingest.first_by_path(clips), scorers)


WORK = M.CLIPS + f""", fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY source_path) AS n FROM cl) WHERE n = 1),
wk AS (SELECT clip_id, seq, scorer, {KEY} AS cache_key FROM fc, (VALUES ('mos'), ('barge')) s(scorer) WHERE scorer = 'mos' OR seq % 4 = 0)"""


@query("WITH " + WORK + " SELECT clip_id, scorer, cache_key FROM wk")
def q_cache_key(spark, sf):
    return _work(spark, sf).select("clip_id", "scorer", "cache_key")


@query("WITH " + WORK + " SELECT scorer, count(*) AS n FROM wk GROUP BY scorer")
def q_applicable_work(spark, sf):
    return _work(spark, sf).groupBy("scorer").agg(F.count("*").alias("n"))


def _cache(todo):
    return todo.where("seq % 3 = 0").select("cache_key", "clip_id", "scorer", F.lit(1.0).alias("value"))


@query("WITH " + WORK + " SELECT clip_id, scorer, seq % 3 = 0 AS cached FROM wk")
def q_cache_work(spark, sf):
    todo = _work(spark, sf)
    cache = _cache(todo)
    hit = ingest.cache_hits(todo, cache).select("clip_id", "scorer", "cached")
    return hit.unionByName(ingest.cache_misses(todo, cache).select("clip_id", "scorer", F.lit(False).alias("cached")))


@query("WITH " + WORK + " SELECT clip_id, scorer FROM wk WHERE seq % 3 = 0 AND scorer <> 'barge'")
def q_cache_clear(spark, sf):
    return ingest.cache_clear(_cache(_work(spark, sf)), "barge").select("clip_id", "scorer")


@query("WITH " + M.RES + ", r AS (SELECT DISTINCT 'run_' || strftime(l_shipdate, '%Y%m') AS run_id FROM lineitem) SELECT 'previous' AS wanted, max(run_id) AS run_id FROM r WHERE run_id <> (SELECT max(run_id) FROM r) UNION ALL SELECT 'run_1995', max(run_id) FROM r WHERE starts_with(run_id, 'run_1995')")
def q_baseline_pick(spark, sf):
    runs = M.read(spark, sf, "lineitem").select(F.concat(F.lit("run_"), F.date_format("l_shipdate", "yyyyMM")).alias("run_id")).distinct()
    newest = runs.agg(F.max("run_id").alias("last"))
    prev = runs.join(F.broadcast(newest), F.col("run_id") != F.col("last")).agg(F.max("run_id").alias("run_id")).select(F.lit("previous").alias("wanted"), "run_id")
    return prev.unionByName(ingest.pick_baseline(runs, "", "run_1995").select(F.lit("run_1995").alias("wanted"), "run_id"))


# report


@query("WITH " + M.LONG + """, v AS (SELECT metric, value FROM lng WHERE value IS NOT NULL), s AS (SELECT metric, min(value) AS lo, CASE WHEN max(value) > min(value) THEN max(value) ELSE min(value) + 1 END AS hi FROM v GROUP BY 1)
SELECT metric, CAST(least(12, floor((value - lo) / ((hi - lo) / 12)) + 1) AS INT) AS bin, count(*) AS n FROM v JOIN s USING (metric) GROUP BY 1, 2""")
def q_histogram(spark, sf):
    return report.histogram(M.long_metrics(spark, sf))


@query("WITH " + M.GATE + " SELECT metric, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'good' END AS status FROM g WHERE status IS NOT NULL GROUP BY metric")
def q_worst_status(spark, sf):
    return report.worst_status(metrics.outcomes(M.long_metrics(spark, sf), _gates(spark)))


def _judged(spark, sf):
    dim = F.when(F.col("doc_id") % 4 == 0, "overall").otherwise(F.col("dimension"))
    return M.judged(spark, sf).select(F.col("doc_id").alias("clip_id"), dim.alias("dimension"), F.col("judge").alias("score"))


MARKS = M.GATE + ", mk AS (SELECT doc_id AS clip_id, CASE WHEN doc_id % 4 = 0 THEN 'overall' ELSE lang END AS dimension, 1 + n_chars % 5 AS score FROM labels JOIN documents USING (doc_id))"


@query("WITH " + MARKS + """, w AS (SELECT clip_id, CASE status WHEN 'fail' THEN 2e0 ELSE 0.5e0 END AS w FROM g WHERE status IN ('fail', 'warn') UNION ALL SELECT clip_id, CAST(3 - score AS DOUBLE) FROM mk WHERE score <= 3 AND dimension <> 'overall')
SELECT clip_id, sum(w) AS score FROM w GROUP BY clip_id ORDER BY score DESC, clip_id LIMIT 15""")
def q_worst_offenders(spark, sf):
    return report.offenders(metrics.outcomes(M.long_metrics(spark, sf), _gates(spark)), _judged(spark, sf))


@query("WITH " + MARKS + """, f AS (SELECT clip_id, metric AS what, -1e0 AS severity FROM g WHERE status = 'fail' UNION ALL SELECT clip_id, dimension, CAST(score AS DOUBLE) FROM mk WHERE score <= 2)
SELECT * FROM f ORDER BY severity, clip_id, what LIMIT 15""")
def q_key_findings(spark, sf):
    return report.findings(metrics.outcomes(M.long_metrics(spark, sf), _gates(spark)), _judged(spark, sf))


@query("WITH " + M.GATE + """, last AS (SELECT clip_id, max(value) FILTER (WHERE metric = 'price' AND n = 1) AS price, max(value) FILTER (WHERE metric = 'tax_gap' AND n = 1) AS tax_gap FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id, metric ORDER BY seq DESC, value DESC) AS n FROM g WHERE metric IS NOT NULL) GROUP BY 1),
c AS (SELECT clip_id, count(*) FILTER (WHERE error IS NOT NULL AND metric IS NULL) AS errors, count(*) FILTER (WHERE status = 'fail') AS fails, count(*) FILTER (WHERE status = 'warn') AS warns FROM g GROUP BY 1)
SELECT clip_id, errors, fails, warns, price, tax_gap, CASE WHEN fails > 0 THEN 'bad' WHEN warns > 0 THEN 'warn' ELSE 'good' END AS status FROM c LEFT JOIN last USING (clip_id)""")
def q_clip_detail(spark, sf):
    out = report.clip_detail(metrics.gated(M.long_metrics(spark, sf, "clip_id"), _gates(spark)))
    return out.select("clip_id", "errors", "fails", "warns", F.col("metrics")["price"].alias("price"), F.col("metrics")["tax_gap"].alias("tax_gap"), "status")


# judge


def _replies(spark, sf):
    i = F.col("doc_id")
    score = lambda k: (F.pmod(i * (k + 3), F.lit(7)) + 1).cast("int")
    dims = [F.struct(F.lit("because").alias("reasoning"), score(k).alias("score")).alias(d) for k, d in enumerate(judge.DIMENSIONS)]
    # unscoreable replies whose id divides by eight leave out the scores
    given = [F.when(~((F.col("toxic") == 1) & (i % 8 == 0)), d).alias(n) for n, d in zip(judge.DIMENSIONS, dims, strict=True)]
    obj = F.to_json(F.struct(*given, (1 + i % 5).cast("int").alias("overall"), (F.col("toxic") == 1).alias("unscoreable"), F.when(i % 2 == 0, "noise").alias("unscoreable_reason")))
    text = F.when(i % 4 == 0, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nbye"))).when(i % 4 == 1, F.concat(F.lit("Sure. "), obj, F.lit(" Done."))).when(i % 4 == 2, obj).otherwise(F.when(i % 3 == 0, "no object").otherwise(obj))
    return M.read(spark, sf, "labels").select("doc_id", text.alias("text"))


SCORES = {d: f"((doc_id * {k + 3}) % 7 + 1)" for k, d in enumerate(judge.DIMENSIONS)}
FINE = " AND ".join(f"{s} <= 5" for s in SCORES.values())
LOST = "(doc_id % 4 = 3 AND doc_id % 3 = 0)"


@query(f"SELECT doc_id, NOT {LOST} AS found FROM labels")
def q_judge_extract(spark, sf):
    obj = judge.extract(F.col("text"))
    return _replies(spark, sf).select("doc_id", (F.coalesce(obj.startswith("{") & obj.endswith("}"), F.lit(False)) & F.get_json_object(obj, "$.overall").isNotNull()).alias("found"))


@query("SELECT doc_id, 1e0 + doc_id % 5 AS judge_overall, " + ", ".join(f"CAST({s} AS DOUBLE) AS judge_{d}" for d, s in SCORES.items()) + f" FROM labels WHERE NOT {LOST} AND {FINE} AND toxic <> 1")
def q_judge_validate(spark, sf):
    out = judge.parse(_replies(spark, sf)).where("error IS NULL")
    return out.select("doc_id", *[F.col("metrics")[f"judge_{d}"].alias(f"judge_{d}") for d in ("overall", *judge.DIMENSIONS)])


@query(f"""SELECT doc_id, CASE WHEN toxic = 1 AND NOT {LOST} AND (doc_id % 8 = 0 OR {FINE}) THEN CASE WHEN doc_id % 2 = 0 THEN 'noise' ELSE 'the judge marked the clip unscoreable' END ELSE 'judge_parse_failure: no valid reply' END AS error
FROM labels WHERE toxic = 1 OR {LOST} OR NOT ({FINE})""")
def q_judge_salvage(spark, sf):
    return judge.parse(_replies(spark, sf)).where("error IS NOT NULL").select("doc_id", "error")


@query("SELECT source, lang, count(*) AS n, lower(trim(source)) <> '' AND (contains(lower(source), lang) OR contains(lang, lower(source)) OR source = 'src1' AND false) AS blocked FROM documents GROUP BY source, lang")
def q_judge_guard(spark, sf):
    g = M.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("blocked", G.self_judged(F.col("source"), F.col("lang")))


# signal


@query("""SELECT vec_id AS clip_id, CAST(w AS INT) AS window, CAST(least(24, 64 - w * 24) AS INT) AS samples, round(sqrt(list_sum(list_transform(embedding[w * 24 + 1 : w * 24 + 24], lambda v: CAST(v AS DOUBLE) * v)) / least(24, 64 - w * 24)), 6) AS rms
FROM embeddings, generate_series(0, 2) AS s(w) WHERE w = 0 OR 64 - w * 24 >= 8""")
def q_windows(spark, sf):
    w = signal.windows(M.signals(spark, sf).drop("label"), 24, 8)
    return r6(w.select("clip_id", "window", F.size("x").alias("samples"), signal.rms(F.col("x")).alias("rms")), "rms")


@query("SELECT vec_id AS clip_id, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v * POW(10, -2 * (vec_id % 5)))) / 64) < 1e-4 AS silent FROM embeddings")
def q_silence(spark, sf):
    x = F.transform("x", lambda v: v * F.pow(F.lit(10.0), -(F.col("clip_id") % 5)))
    return M.signals(spark, sf).select("clip_id", signal.silent(x).alias("silent"))


@query("""WITH w AS (SELECT vec_id AS clip_id, sqrt(list_sum(list_transform(embedding[w * 16 + 1 : w * 16 + 16], lambda v: CAST(v AS DOUBLE) * v)) / 16) AS value FROM embeddings, generate_series(0, 3) AS s(w))
SELECT clip_id, 'rms' AS metric, round(median(value), 6) AS value FROM w GROUP BY clip_id""")
def q_window_agg(spark, sf):
    w = signal.windows(M.signals(spark, sf).drop("label"), 16, 8).select("clip_id", F.lit("rms").alias("metric"), signal.rms(F.col("x")).alias("value"))
    return r6(signal.aggregate_windows(w), "value")


# simulation


@query("WITH " + M.MOVES + """, p AS (SELECT *, CASE speaker WHEN 'agent' THEN latency_s ELSE 0 END AS wait, dur_s + CASE speaker WHEN 'agent' THEN latency_s + 0.3e0 ELSE 0 END AS step FROM mv),
c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + wait AS s FROM p),
e AS (SELECT call_id, c.seq AS move, k, CASE speaker WHEN 'agent' THEN ['tts_first_audio', 'agent_tts_start', 'agent_tts_end'][k] ELSE ['user_speech_start', 'user_speech_end', 'stt_final'][k] END AS kind,
  CASE WHEN speaker = 'agent' AND k = 3 OR speaker = 'caller' AND k > 1 THEN s + dur_s ELSE s END AS t_s FROM c, generate_series(1, 3) AS g(k))
SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY move, k) - 1 AS seq, kind, round(t_s, 6) AS t_s FROM e""")
def q_recording_events(spark, sf):
    return r6(simulate.events(M.moves(spark, sf)), "t_s").withColumn("seq", F.col("seq").cast("long"))


@query("WITH " + M.MOVES + """, x AS (SELECT call_id, CASE call_id % 7 WHEN 0 THEN 'caller' WHEN 1 THEN 'agent' ELSE speaker END AS speaker, CASE WHEN call_id % 7 = 2 AND seq = 1 THEN 0.05e0 ELSE dur_s END AS dur_s, CASE WHEN call_id % 7 = 3 AND seq = 1 THEN '  ' ELSE text END AS text FROM mv),
v AS (SELECT call_id, count(*) FILTER (WHERE speaker = 'caller') AS c, count(*) FILTER (WHERE speaker = 'agent') AS a, count(*) FILTER (WHERE dur_s < 0.1e0) AS s, count(*) FILTER (WHERE trim(text) = '') AS b FROM x GROUP BY 1)
SELECT call_id, c > 0 AND a > 0 AND s = 0 AND b = 0 AS valid, CASE WHEN c = 0 THEN 'no caller turn' WHEN a = 0 THEN 'no agent turn' WHEN s > 0 THEN 'turn too short' WHEN b > 0 THEN 'blank turn' END AS reason FROM v""")
def q_conversation_valid(spark, sf):
    # calls of each kind are spoilt: one side alone, a turn too short, a turn without words
    spoilt = F.col("call_id") % 7
    second = F.col("seq") == 1
    moves = M.moves(spark, sf).withColumns({"speaker": F.when(spoilt == 0, "caller").when(spoilt == 1, "agent").otherwise(F.col("speaker")), "dur_s": F.when((spoilt == 2) & second, 0.05).otherwise(F.col("dur_s")), "text": F.when((spoilt == 3) & second, "  ").otherwise(F.col("text"))})
    return simulate.validity(moves)


@query("WITH " + M.LONG + "," + M.PAIRS + """ SELECT layer, metric, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT layer, metric, value FROM lng UNION ALL SELECT 'semantic', dimension, CAST(j AS DOUBLE) FROM pr) GROUP BY layer, metric""")
def q_semantic_union(spark, sf):
    ext = M.judged(spark, sf).select(F.col("doc_id").alias("clip_id"), F.lit("semantic").alias("layer"), F.col("dimension").alias("metric"), F.col("judge").cast("double").alias("value"))
    every = metrics.union_external(M.long_metrics(spark, sf), ext)
    return r6(every.groupBy("layer", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


STREAM = """WITH RECURSIVE
ord AS (SELECT CAST(user_id AS VARCHAR) AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, coalesce(value, 0) > 50 AS v FROM events),
fr AS MATERIALIZED (SELECT call_id, n * 10 + i AS k, v FROM ord, generate_series(0, 9) AS g(i)),
st AS (
  SELECT DISTINCT call_id, CAST(-1 AS BIGINT) AS k, CAST(-20 AS BIGINT) AS now, false AS speaking, false AS in_turn, CAST(-1 AS BIGINT) AS run, CAST(-1 AS BIGINT) AS began, CAST(-1 AS BIGINT) AS voice, CAST(0 AS BIGINT) AS queue, CAST(0 AS BIGINT) AS turns,
    CAST(0 AS BIGINT) AS barges, CAST(-1 AS BIGINT) AS ba, CAST(-1 AS BIGINT) AS be, false AS opened, CAST(NULL AS BIGINT) AS ended, false AS stt, CAST(NULL AS BIGINT) AS yielded, false AS spoke, false AS cut, false AS hushed FROM fr
  UNION ALL
  SELECT call_id, k, now, speaking2, in3, CASE WHEN cut2 THEN now ELSE run1 END, began3, voice1, greatest(q2 - 1, 0), turns1 + CASE WHEN cut2 THEN 1 ELSE 0 END, barges + CASE WHEN cut2 THEN 1 ELSE 0 END,
    CASE WHEN cut2 THEN now ELSE ba1 END, CASE WHEN cut2 THEN now + 1000 ELSE be END, opened2, CASE WHEN quit THEN voice WHEN left2 THEN voice1 END, quit AND voice - began + 20 >= 200 OR left2 AND voice1 - began2 + 20 >= 200,
    CASE WHEN yields THEN voice1 END, reply OR cut2, cut2, q2 = 1
  FROM (SELECT *, CASE WHEN cut2 THEN 50 ELSE q1 END AS q2 FROM (
   SELECT *, v AND ba1 < 0 AND q1 = 0 AND barges < 1 AND now - run1 >= 1000 AND turns1 < 8 AS cut2 FROM (
    SELECT *, in2 AND NOT left2 AS in3, CASE WHEN left2 THEN -1 ELSE began2 END AS began3, CASE WHEN yields OR ba >= 0 AND v AND now > be + 500 THEN -1 ELSE ba END AS ba1 FROM (
     SELECT *, yields AND in2 AS left2 FROM (
      SELECT *, ba >= 0 AND NOT v AND voice1 BETWEEN ba AND be + 500 AND now - voice1 >= 200 AS yields, in1 AND NOT quit AS in2, CASE WHEN quit THEN -1 ELSE began1 END AS began2, CASE WHEN reply THEN 50 ELSE queue END AS q1, turns + CASE WHEN reply THEN 1 ELSE 0 END AS turns1 FROM (
       SELECT *, quiet AND in_turn AS quit, quiet AND queue = 0 AND ba < 0 AND turns < 8 AS reply, CASE WHEN v THEN true WHEN quiet THEN false ELSE speaking END AS speaking2 FROM (
        SELECT st.call_id, f.k, f.k * 20 AS now, f.v, speaking, in_turn, voice, queue, turns, barges, ba, be, began, CASE WHEN f.v AND (run < 0 OR voice < 0 OR f.k * 20 - voice > 200) THEN f.k * 20 ELSE run END AS run1, f.v AND NOT in_turn AS opened2, in_turn OR f.v AS in1,
          CASE WHEN f.v AND NOT in_turn THEN f.k * 20 ELSE began END AS began1, NOT f.v AND speaking AND f.k * 20 - voice >= 600 AS quiet, CASE WHEN f.v THEN f.k * 20 ELSE voice END AS voice1
        FROM st JOIN fr f ON f.call_id = st.call_id AND f.k = st.k + 1)))))))),
e AS (
  SELECT call_id, unnest(['agent_tts_start', 'tts_first_audio']) AS kind, now AS t FROM st WHERE opened
  UNION ALL SELECT call_id, 'agent_tts_end', ended FROM st WHERE ended IS NOT NULL UNION ALL SELECT call_id, 'stt_final', ended FROM st WHERE stt
  UNION ALL SELECT call_id, 'agent_interrupted', yielded FROM st WHERE yielded IS NOT NULL UNION ALL SELECT call_id, 'user_speech_start', now FROM st WHERE spoke
  UNION ALL SELECT call_id, 'barge_in_detected', now FROM st WHERE cut UNION ALL SELECT call_id, 'user_speech_end', now + 20 FROM st WHERE hushed
  UNION ALL SELECT call_id, unnest(CASE WHEN voice - began + 20 >= 200 THEN ['agent_tts_end', 'stt_final'] ELSE ['agent_tts_end'] END), voice FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k DESC) AS back FROM st) WHERE back = 1 AND in_turn)
SELECT call_id, kind, CAST(t AS DOUBLE) / 1000 AS t_s FROM e"""


@query(STREAM)
def q_stream_turns(spark, sf):
    """The call state machine over frames made from events: each event is a run of frames whose
    loudness follows its value. Agents are transcribed, callers cut in after a second."""
    return calls.batch(calls.frames_of(M.read(spark, sf, "events")), calls.Policy(barge=True, after_ms=1000, transcribed=True))
