"""Simulated calls: events from a list of moves, validity, scripted suites."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THINK_S, MIN_AUDIO_S = 0.3, 0.1


def place(moves: DataFrame) -> DataFrame:
    """Moves with ``start_s`` and ``end_s``: a running cursor over the call. The agent starts after its
    latency and thinks on after its end; a caller starts at the cursor."""
    order = Window.partitionBy("call_id").orderBy("seq")
    agent = F.col("speaker") == "agent"
    wait = F.when(agent, F.greatest(F.lit(0.0), F.col("latency_s"))).otherwise(0.0)
    step = wait + F.col("dur_s") + F.when(agent, THINK_S).otherwise(0.0)
    before = F.coalesce(F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = moves.withColumns({"__step": step, "__wait": wait}).withColumn("start_s", before + F.col("__wait"))
    return rows.withColumn("end_s", F.col("start_s") + F.col("dur_s")).drop("__step", "__wait")


def events(moves: DataFrame) -> DataFrame:
    """The event log of placed moves, numbered in time order."""
    e = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.col(t).alias("t_s"))
    caller = F.array(e("user_speech_start", "start_s"), e("user_speech_end", "end_s"), e("stt_final", "end_s"))
    agent = F.array(e("tts_first_audio", "start_s"), e("agent_tts_start", "start_s"), e("agent_tts_end", "end_s"))
    rows = place(moves).select("call_id", "seq", F.posexplode(F.when(F.col("speaker") == "agent", agent).otherwise(caller)).alias("k", "e"))
    order = Window.partitionBy("call_id").orderBy("seq", "k")
    return rows.select("call_id", (F.row_number().over(order) - 1).alias("seq"), F.col("e.kind").alias("kind"), F.col("e.t_s").alias("t_s"))


def validity(moves: DataFrame) -> DataFrame:
    """Why a call cannot be used, or null: no caller turn, no agent turn, a turn that is too short, a
    turn without words, in this order."""
    n = lambda c: F.count_if(c)
    out = moves.groupBy("call_id").agg(n(F.col("speaker") == "caller").alias("c"), n(F.col("speaker") == "agent").alias("a"), n(F.coalesce("dur_s", F.lit(0.0)) < MIN_AUDIO_S).alias("s"), n(F.trim(F.coalesce("text", F.lit(""))) == "").alias("b"))
    reason = F.when(F.col("c") == 0, "no caller turn").when(F.col("a") == 0, "no agent turn").when(F.col("s") > 0, "turn too short").when(F.col("b") > 0, "blank turn")
    return out.select("call_id", reason.isNull().alias("valid"), reason.alias("reason"))


def suite(scenarios: DataFrame, k: int) -> DataFrame:
    """Every scenario ``k`` times, with its call id."""
    runs = scenarios.sparkSession.range(k).select(F.col("id").cast("int").alias("run"))
    return scenarios.crossJoin(F.broadcast(runs)).withColumn("call_id", F.format_string("%s-%02d", F.col("scenario_id"), F.col("run")))


def tags(scenarios: DataFrame) -> DataFrame:
    """Scenarios with ``tags_json``, what recordings keep of them."""
    keep = ("scenario_id", "source_call_id", "persona", "adversarial", "background", "tags")
    return scenarios.withColumn("tags_json", F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}))


SCENARIO = "scenario_id string, source_call_id string, domain string, persona string, adversarial boolean, background boolean, goal string, opening string, max_turns int, tags array<string>, body string"


def scenario_table(spark: SparkSession, document: list | dict) -> DataFrame:
    """Scenarios from a parsed manifest: a list, or a mapping with ``scenarios``. ``body`` has all of
    each as JSON."""
    rows = document.get("scenarios", []) if isinstance(document, dict) else document
    if not isinstance(rows, list):
        raise ValueError("a scenario manifest is a list or a mapping with scenarios")

    def flat(r: dict) -> tuple:
        persona, noise = r.get("persona") or {}, r.get("background") or {}
        who = persona if isinstance(persona, dict) else {"name": persona}
        noisy = noise.get("enabled", False) if isinstance(noise, dict) else noise
        text = lambda k: None if r.get(k) is None else str(r[k])
        return str(r["id"]), text("source_call_id"), text("domain"), str(who.get("name", "caller")), bool(who.get("adversarial", False)), bool(noisy), str(r.get("goal") or ""), text("opening"), int(r.get("max_turns") or 8), [str(t) for t in r.get("tags") or []], json.dumps(r | {"id": str(r["id"])})

    return spark.createDataFrame([flat(r) for r in rows], SCENARIO)
