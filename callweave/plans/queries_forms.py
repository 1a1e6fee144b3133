"""Queries of scalar forms, sidecars, messages, samples, prompts and scenarios, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import gates as G
from callweave.operators import compare, dynamics, judge, metrics, signal, simulate, timeline
from callweave.plans import mappings as M
from callweave.plans.queries import _gates, query, r6
from callweave.session import ship
from callweave.sources import recordings
from callweave.streaming import calls

# texts


@query("SELECT doc_id, 'p-' || left(sha256(text), 8) AS prompt_version, CASE WHEN contains(line, ':') THEN trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) ELSE 'unknown' END AS rubric_version FROM (SELECT *, split_part(regexp_replace(CASE doc_id % 3 WHEN 0 THEN chr(10) || ' RUBRIC: v' || doc_id || ' ' || chr(10) || text ELSE text END, '^\\s+', ''), chr(10), 1) AS line FROM documents)")
def q_versions(spark, sf):
    d = M.read(spark, sf, "documents")
    rubric = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n RUBRIC: v"), F.col("doc_id"), F.lit(" \n"), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", G.prompt_version(F.col("text")).alias("prompt_version"), G.rubric_version(rubric).alias("rubric_version"))


@query("""SELECT page_id, 'wss://' || regexp_replace(regexp_replace(trim(u), '^(https?|wss?)://', '', 'i'), '/+$', '') AS address, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attribute
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN ' ' || url || '// ' WHEN 1 THEN replace(url, 'http', 'WS') ELSE url END AS u FROM pages)""")
def q_addresses(spark, sf):
    """Stream addresses, and pages escaped for an attribute."""
    i, u = F.col("page_id"), F.col("url")
    url = F.when(i % 3 == 0, F.concat(F.lit(" "), u, F.lit("// "))).when(i % 3 == 1, F.replace(u, F.lit("http"), F.lit("WS"))).otherwise(u)
    return M.read(spark, sf, "pages").select("page_id", G.stream_address(url).alias("address"), G.attribute(F.col("html")).alias("attribute"))


@query("""SELECT doc_id, CASE WHEN s IS NULL OR isnan(s) THEN 'none' WHEN round_even(s, 0) <= 2 THEN 'bad' WHEN round_even(s, 0) = 3 THEN 'warn' ELSE 'good' END AS severity, CASE WHEN v IS NULL OR isnan(v) THEN '—' ELSE printf('%.2f', v) END AS shown
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE 0.5 + (n_chars % 10) / 2.0 END AS s, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) / 7 END AS v FROM documents)""")
def q_shown_numbers(spark, sf):
    i = F.col("doc_id")
    odd = lambda v: F.when(i % 11 == 0, None).when(i % 13 == 0, float("nan")).otherwise(v)
    return M.read(spark, sf, "documents").select("doc_id", G.severity(odd(0.5 + F.col("n_chars") % 10 / 2)).alias("severity"), G.number(odd(F.col("n_chars").cast("double") / 7)).alias("shown"))


# sidecars and messages


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'k' || doc_id END AS call_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 'v' || quality END AS agent_version, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 > 0 THEN doc_id % 3 - 1 END AS agent_channel,
  CASE WHEN doc_id % 5 > 0 THEN 'fine' END AS weather, CASE WHEN doc_id % 5 > 0 THEN 2 ELSE 0 END AS n_events, CASE WHEN doc_id % 5 > 0 THEN 1.5e0 END AS second_s FROM labels""")
def q_sidecars(spark, sf):
    i = F.col("doc_id")
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("t_s"))
    body = F.to_json(F.struct(
        F.concat(F.lit("k"), i).alias("call_id"), F.when(i % 2 == 0, F.concat(F.lit("v"), F.col("quality"))).alias("agent_version"), F.struct(F.when(i % 3 > 0, (i % 3 - 1).cast("int")).alias("agent_channel")).alias("channel_map"),
        F.array(event("user_speech_start", 0.0), event("user_speech_end", 1.5)).alias("events"), F.lit("fine").alias("weather"),
    ))
    text = F.when(i % 5 == 0, "{broken").otherwise(body)
    m = M.read(spark, sf, "labels").select("doc_id", recordings.parse_sidecar(text).alias("m"))
    return m.select("doc_id", "m.call_id", "m.agent_version", F.col("m.channel_map.agent_channel").cast("long").alias("agent_channel"), F.col("m.extra")["weather"].alias("weather"), F.coalesce(F.size("m.events"), F.lit(0)).alias("n_events"), F.get("m.events", F.lit(1))["t_s"].alias("second_s")).withColumn("n_events", F.greatest("n_events", F.lit(0)))


@query("""SELECT 's' || user_id AS call_id, CASE event_id % 10 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'media' END AS event, CASE WHEN event_id % 10 > 0 THEN event_id END AS seq, CASE WHEN event_id % 10 = 2 THEN 'outbound' ELSE 'inbound' END AS track,
  CASE WHEN event_id % 10 > 1 THEN event_type END AS payload, event_id % 10 = 1 AS stop FROM events WHERE event_id % 10 < 8""")
def q_stream_messages(spark, sf):
    i, d = F.col("event_id"), F.col("event_id") % 10
    sid = F.concat(F.lit("s"), F.col("user_id"))
    name = F.when(d == 0, "start").when(d == 1, "stop").when(d == 9, "mark").otherwise("media")
    media = F.when(d > 1, F.struct(F.when(d == 2, "outbound").alias("track"), F.base64(F.col("event_type").cast("binary")).alias("payload")))
    text = F.to_json(F.struct(name.alias("event"), F.when(d > 0, sid).alias("streamSid"), F.when(d > 0, i.cast("string")).alias("sequenceNumber"), F.when(d == 0, F.struct(sid.alias("streamSid"))).alias("start"), media.alias("media")))
    lines = M.read(spark, sf, "events").select(F.when(d == 8, "no message").otherwise(text).alias("value"))
    return calls.parse(lines).withColumn("payload", F.col("payload").cast("string"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf):
    out = calls.sessions(M.read(spark, sf, "events"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


# samples


@query("""SELECT vec_id AS clip_id, round(list_max(list_transform(y, lambda v: abs(v))), 5) AS peak, round(list_sum(y), 4) AS total
FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda v: 0e0) ELSE list_transform(embedding, lambda v: greatest(-1e0, least(1e0, CAST(v AS DOUBLE) * 0.5011872336272722e0 / list_max(list_transform(embedding, lambda w: abs(CAST(w AS DOUBLE))))))) END AS y FROM embeddings)""")
def q_peak_normalize(spark, sf):
    x = F.when(F.col("clip_id") % 9 == 0, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x"))
    y = signal.peak_normalize(x, -6.0)
    s = M.signals(spark, sf).select("clip_id", y.alias("y"))
    return s.select("clip_id", F.round(F.array_max(F.transform("y", lambda v: F.abs(v))), 5).alias("peak"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""SELECT vec_id AS clip_id, CAST(i AS INT) AS i, round(a + (b - a) * (i * 1.6e0 - floor(i * 1.6e0)), 4) AS v
FROM (SELECT vec_id, i, CAST(embedding[CAST(floor(i * 1.6e0) AS INT) + 1] AS DOUBLE) AS a, CAST(embedding[least(64, CAST(floor(i * 1.6e0) AS INT) + 2)] AS DOUBLE) AS b FROM embeddings, generate_series(0, 39) AS g(i))""")
def q_resample(spark, sf):
    ship(spark)
    s = M.signals(spark, sf).select("clip_id", F.posexplode(signal.resampled(F.col("x"), 16000, 10000)).alias("i", "v"))
    return s.select("clip_id", "i", F.round(F.col("v").cast("double"), 4).alias("v"))


MULAW = """e AS (SELECT vec_id, CASE WHEN p < 0 THEN -1 ELSE 1 END AS sign, abs(p) + 132 AS m FROM (SELECT vec_id, greatest(-32635, least(32635, CAST(trunc(CAST(v AS DOUBLE) * 100000) AS INT))) AS p FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings))),
d AS (SELECT vec_id, sign * ((((((m >> (x + 3)) & 15) << 3) + 132) << x) - 132) AS y FROM (SELECT *, CAST(floor(log2(m)) AS INT) - 7 AS x FROM e))"""


@query("WITH " + MULAW + " SELECT vec_id AS clip_id, round(sqrt(avg((y / 32768e0) * (y / 32768e0))), 6) AS level FROM d GROUP BY vec_id")
def q_frame_level(spark, sf):
    ship(spark)
    pcm = F.transform("x", lambda v: (v * 100000).cast("int"))
    return r6(M.signals(spark, sf).select("clip_id", signal.frame_levels(pcm).alias("level")), "level")


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(trunc(CAST(v AS DOUBLE) * 150000) AS INT)) AS a, list_transform(embedding[1:40], lambda v: CAST(trunc(CAST(v AS DOUBLE) * -90000) AS INT)) AS b FROM embeddings)
SELECT vec_id AS clip_id, CAST(sum(greatest(-32768, least(32767, a[i] + coalesce(b[i], 0)))) AS BIGINT) AS mixed, CAST(sum(CASE WHEN i <= 50 THEN b[(vec_id + i - 1) % 40 + 1] * i ELSE 0 END) AS BIGINT) AS looped FROM s, generate_series(1, 64) AS g(i) GROUP BY vec_id""")
def q_mix_and_loop(spark, sf):
    pcm = lambda c, k: F.transform(c, lambda v: (v * k).cast("int"))
    s = M.signals(spark, sf).select("clip_id", pcm("x", 150000).alias("a"), pcm(F.slice("x", 1, 40), -90000).alias("b"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    looped = F.transform(signal.loop(F.col("b"), F.col("clip_id"), 50), lambda v, i: v * (i + 1))
    return s.select("clip_id", total(signal.mix(F.col("a"), F.col("b"))).alias("mixed"), total(looped).alias("looped"))


@query("""WITH w AS (SELECT vec_id, k, sqrt(list_sum(list_transform(embedding[k * 24 + 1 : k * 24 + 24], lambda v: CAST(v AS DOUBLE) * v * POW(10, -2 * (vec_id % 5)))) / least(24, 64 - k * 24)) AS level FROM embeddings, generate_series(0, 2) AS g(k))
SELECT vec_id AS clip_id, count(*) FILTER (WHERE level >= 1e-4) AS windows, CASE WHEN count(*) FILTER (WHERE level >= 1e-4) = 0 THEN 'silent clip' END AS error FROM w GROUP BY vec_id""")
def q_silent_clips(spark, sf):
    """Clips with no window to score have an error."""
    x = F.transform("x", lambda v: v * F.pow(F.lit(10.0), -(F.col("clip_id") % 5)))
    w = signal.windows(M.signals(spark, sf).select("clip_id", x.alias("x")), 24, 8)
    out = w.groupBy("clip_id").agg(F.count_if(~signal.silent(F.col("x"))).alias("windows"))
    return out.withColumn("error", F.when(F.col("windows") == 0, "silent clip"))


# the judge's question


@query("""SELECT vec_id AS clip_id, CASE WHEN vec_id % 3 = 0 THEN 'only the agent''s side of the call' ELSE 'both sides of the call in one track' END || '|' || CASE WHEN vec_id % 4 = 0 THEN 'topic ' || label WHEN vec_id % 4 = 1 THEN 'leasing' ELSE 'leasing' END AS said,
  len(a) AS heard, round(list_sum(list_transform(a, lambda v: CAST(v AS DOUBLE))), 5) AS total FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN embedding[1:12] ELSE embedding[1:15] END AS a FROM embeddings)""")
def q_judge_prompt(spark, sf):
    """The channel, the domain, the system text and the first three seconds at five samples a second."""
    s = M.signals(spark, sf)
    i = F.col("clip_id")
    s = s.withColumns({"mono": F.col("x"), "agent": F.when(i % 3 == 0, F.slice("x", 1, 12)).when(i % 3 == 1, F.slice("x", 1, 0)), "caller": F.lit(None).cast("array<double>")})
    heard, said = judge.channel("agent_only")
    about = judge.domain(F.when(i % 4 == 0, F.concat(F.lit("topic "), F.col("label"))).when(i % 4 == 1, ""), "leasing")
    x = judge.cap(heard, F.lit(5), 3.0)
    return s.select("clip_id", judge.prompt(said, about, "{channel}|{domain}").alias("said"), x.alias("a")).select("clip_id", "said", F.size("a").cast("long").alias("heard"), F.round(F.aggregate("a", F.lit(0.0), lambda t, v: t + v), 5).alias("total"))


# scenarios, versions, timelines


@query("""SELECT c_custkey || '-' || lpad(CAST(k AS VARCHAR), 2, '0') AS call_id, CAST(c_custkey AS VARCHAR) AS scenario_id, CAST(k AS INT) AS run,
  '{"scenario_id":"' || c_custkey || '","source_call_id":' || CASE WHEN c_nationkey % 2 = 0 THEN '"n' || c_nationkey || '"' ELSE 'null' END || ',"persona":"' || c_mktsegment || '","adversarial":' || CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END || ',"background":false,"tags":["n' || c_nationkey || '"]}' AS tags_json
FROM customer, generate_series(0, 2) AS g(k)""")
def q_suite(spark, sf):
    c = M.read(spark, sf, "customer")
    n = F.concat(F.lit("n"), F.col("c_nationkey"))
    sc = c.select(F.col("c_custkey").cast("string").alias("scenario_id"), F.when(F.col("c_nationkey") % 2 == 0, n).alias("source_call_id"), F.col("c_mktsegment").alias("persona"), (F.col("c_acctbal") < 0).alias("adversarial"), F.lit(False).alias("background"), F.array(n).alias("tags"))
    return simulate.suite(simulate.tags(sc), 3).select("call_id", "scenario_id", "run", "tags_json")


@query("WITH " + M.RES + """, c AS (SELECT o_orderkey AS clip_id, o_orderstatus AS agent_version, o_orderpriority AS model_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY path) AS n FROM (
  SELECT *, 'b' || o_orderkey AS path FROM orders UNION ALL SELECT * REPLACE ('Z' AS o_orderstatus), 'a' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0))
SELECT r.clip_id, scorer, c.agent_version, c.model_id FROM res r LEFT JOIN c ON c.clip_id = r.clip_id AND n = 1""")
def q_enrich(spark, sf):
    """Results with the metadata of their clip, of which a third are there twice."""
    o = M.read(spark, sf, "orders")
    clip = lambda version, path: o.select(F.col("o_orderkey").alias("clip_id"), version.alias("agent_version"), F.col("o_orderpriority").alias("model_id"), F.concat(F.lit(path), F.col("o_orderkey")).alias("source_path"))
    clips = clip(F.col("o_orderstatus"), "b").unionByName(clip(F.lit("Z"), "a").where("clip_id % 3 = 0"))
    return metrics.enrich(M.results(spark, sf).select("clip_id", "scorer"), clips).select("clip_id", "scorer", "agent_version", "model_id")


AB_PAIR = """j AS (SELECT c.scenario, c.metric, CASE WHEN c.metric = 'latency_discount' THEN b.med - c.med ELSE c.med - b.med END AS imp, CASE c.metric WHEN 'mos_quantity' THEN 0.5e0 WHEN 'price' THEN 100e0 ELSE 0.05e0 END AS t
  FROM mid c JOIN mid b ON c.version = 'F' AND b.version = 'O' AND c.scenario = b.scenario AND c.metric = b.metric),
bad AS (SELECT count(*) FILTER (WHERE metric <> 'tax_gap' AND imp < -t) AS regressed FROM j)"""


@query("WITH " + M.AB + ", " + AB_PAIR + " SELECT 'F' AS candidate, CAST(NULL AS VARCHAR) AS error, regressed, regressed = 0 AS passed FROM bad UNION ALL SELECT 'none', 'no results of none', 0, false")
def q_ab_passes(spark, sf):
    """Whether a version passes against another, and one that has no results."""
    mid, gates, limits = compare.medians(M.versions(spark, sf)), _gates(spark), metrics.delta_table(spark, M.AB_DELTAS)
    one = lambda v: compare.passes(mid, compare.deltas(mid, v, "O", gates, limits), v, "O").select(F.lit(v).alias("candidate"), "error", "regressed", "passed")
    return one("F").unionByName(one("none"))


@query("WITH " + M.LONG + """, c AS (SELECT metric, avg(value) AS cur FROM lng WHERE run_id = 'run_b' AND value IS NOT NULL GROUP BY 1), b AS (SELECT metric, avg(value) AS bas FROM lng WHERE run_id = 'run_a' AND value IS NOT NULL AND metric <> 'tax_gap' GROUP BY 1)
SELECT 'group:all' AS clip_id, metric, round(cur, 6) AS current, round(bas, 6) AS baseline, round(bas - cur, 6) AS drop, CASE WHEN bas - cur > 0 THEN 'fail' ELSE 'pass' END AS status FROM c JOIN b USING (metric) WHERE metric IN ('price', 'tax_gap')""")
def q_regression_some(spark, sf):
    """Regression of metrics with a limit that both runs have: one is gone from the baseline, and one of
    the limits is for no metric at all."""
    long = M.long_metrics(spark, sf)
    now, old = long.where("run_id = 'run_b'"), long.where("run_id = 'run_a' AND (metric IS NULL OR metric <> 'tax_gap')")
    out = metrics.regression(now, old, _gates(spark), metrics.delta_table(spark, {"price": 0.0, "tax_gap": 0.0, "nothing": 1.0}), [])
    return r6(out, "current", "baseline", "drop")


@query("SELECT vec_id AS clip_id, CASE WHEN vec_id % 4 = 0 THEN 'events' WHEN vec_id % 4 = 1 THEN 'channels' ELSE 'diarization' END AS source, vec_id % 4 > 1 AS estimated FROM embeddings")
def q_timeline_source(spark, sf):
    i = F.col("clip_id") % 4
    s = M.signals(spark, sf).withColumns({"has_events": i == 0, "agent": F.when(i < 3, F.col("x")), "caller": F.when(i < 2, F.col("x")).when(i == 2, F.slice("x", 1, 0))})
    return timeline.source_of(s).select("clip_id", "source", "estimated")


@query("WITH " + M.GAP + " SELECT clip_id, round(start_s, 3) AS at_s, round(gap_s, 3) AS gap_s FROM gap WHERE gap_s > 1.5e0")
def q_awkward_places(spark, sf):
    out = dynamics.awkward(timeline.gaps(timeline.union(timeline.pair_events(M.gateway_events(spark, sf)))))
    return out.select("clip_id", F.explode("places").alias("p")).select("clip_id", "p.at_s", "p.gap_s")
