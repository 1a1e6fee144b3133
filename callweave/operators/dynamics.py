"""Latency, turn taking and interruptions of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators import timeline

WINDOW_S, ONSET_S, FALSE_ALARM_S = 1.5, 0.5, 0.1


def _by_time(tie: Column) -> Window:
    return Window.partitionBy("clip_id").orderBy("t_s", tie)


def ttft(events: DataFrame) -> DataFrame:
    """From the latest final transcript at or before each first audio to that audio. A window
    instead of an as-of join: one pass over the clip's events."""
    rows = events.where(F.col("kind").isin("stt_final", "tts_first_audio"))
    order = _by_time(F.when(F.col("kind") == "stt_final", 0).otherwise(1))
    heard = F.last(F.when(F.col("kind") == "stt_final", F.col("t_s")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__heard", heard).where("kind = 'tts_first_audio' AND __heard IS NOT NULL").select("clip_id", "seq", (F.col("t_s") - F.col("__heard")).alias("latency_s"))


def turn_gaps(segments: DataFrame) -> DataFrame:
    """From the latest caller end at or before an agent start to that start, once for each caller end."""
    points = segments.select("clip_id", F.when(F.col("speaker") == "caller", F.col("end_s")).otherwise(F.col("start_s")).alias("t_s"), (F.col("speaker") == "agent").alias("agent"))
    order = _by_time(F.col("agent"))
    ended = F.max(F.when(~F.col("agent"), F.col("t_s"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = points.withColumn("caller_end_s", ended).where("agent AND caller_end_s IS NOT NULL")
    return rows.groupBy("clip_id", "caller_end_s").agg(F.min("t_s").alias("t")).select("clip_id", "caller_end_s", (F.col("t") - F.col("caller_end_s")).alias("latency_s"))


def latency_stats(latencies: DataFrame) -> DataFrame:
    q = F.percentile("latency_s", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = latencies.groupBy("clip_id").agg(q.alias("q"), F.max("latency_s").alias("latency_max_s"), F.count("*").alias("n_turns"))
    return out.select("clip_id", *[F.col("q")[i].alias(f"latency_p{p}_s") for i, p in enumerate((50, 95, 99))], "latency_max_s", "n_turns")


def latency(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Statistics with their ``method``: first-audio latencies where a clip has any, else turn gaps."""
    first = latency_stats(ttft(events)).withColumn("method", F.lit("ttft_events"))
    second = latency_stats(turn_gaps(segments)).withColumn("method", F.lit("turn_gap"))
    return first.unionByName(second.join(first, "clip_id", "left_anti"))


def awkward(gaps: DataFrame, over: float = timeline.AWKWARD) -> DataFrame:
    """Of each clip with gaps: how many are longer than ``over``, the longest, and where they are."""
    place = F.when(F.col("gap_s") > over, F.struct(F.round("start_s", 3).alias("at_s"), F.round("gap_s", 3).alias("gap_s")))
    return gaps.groupBy("clip_id").agg(F.count_if(F.col("gap_s") > over).alias("awkward_gap_count"), F.max("gap_s").alias("max_gap_s"), F.array_sort(F.collect_list(place)).alias("places"))


def turn_taking(segments: DataFrame, totals: DataFrame | None = None, over_s: float = timeline.AWKWARD, least_s: float = timeline.OVERLAP_MIN) -> DataFrame:
    """``awkward_gap_count``, ``max_gap_s``, ``overlap_ratio`` and ``agent_talk_ratio`` of each clip
    with segments. ``totals(clip_id, total_s)`` gives lengths; without one, or at 0, the last end
    stands in."""
    merged = timeline.union(segments)
    talk = merged.groupBy("clip_id").agg(*[F.sum(F.when(F.col("speaker") == s, timeline.duration()).otherwise(0.0)).alias(s) for s in ("agent", "caller")], F.max("end_s").alias("last_s"))
    over = timeline.intersect(merged, least_s).groupBy("clip_id").agg(F.sum(timeline.duration()).alias("over"))
    held = awkward(timeline.gaps(merged), over_s).drop("places")
    out = talk.join(over, "clip_id", "left").join(held, "clip_id", "left")
    if totals is not None:
        out = out.join(totals.select("clip_id", "total_s"), "clip_id", "left")
    else:
        out = out.withColumn("total_s", F.lit(None).cast("double"))
    length = F.coalesce(F.nullif(F.col("total_s"), F.lit(0.0)), F.col("last_s"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return out.select("clip_id", zero("awkward_gap_count", 0), zero("max_gap_s", 0.0), ratio(F.coalesce("over", F.lit(0.0)), length).alias("overlap_ratio"), ratio(F.col("agent"), F.col("agent") + F.col("caller")).alias("agent_talk_ratio"))


def barge_attempts(events: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """Each detected interruption: ``clip_id``, ``seq``, ``barge_s``, ``onset_s``, ``latency_s``,
    ``utterance_s``, ``success``.

    The stop is the first interruption of the agent at or after it, the onset the earliest caller
    start within half a second, the utterance runs to the first caller end at or after the onset.
    Windows over the clip's events by time, and no join.
    """
    kind = F.col("kind")
    rows = events.where(kind.isin("barge_in_detected", "agent_interrupted", timeline.CALLER_START, timeline.CALLER_END))
    # a barge comes first among equal times, so what happens then lies ahead of it
    ahead = _by_time(F.when(kind == "barge_in_detected", 0).otherwise(1)).rowsBetween(0, Window.unboundedFollowing)
    stop = F.first(F.when(kind == "agent_interrupted", F.col("t_s")), ignorenulls=True).over(ahead)

    def near(low: float, high: float) -> Column:
        start = f"CASE WHEN kind = '{timeline.CALLER_START}' THEN t_s END"
        side = lambda x: f"{abs(x)!r}D {'PRECEDING' if x < 0 else 'FOLLOWING'}"
        return F.expr(f"min({start}) OVER (PARTITION BY clip_id ORDER BY t_s RANGE BETWEEN {side(low)} AND {side(high)})")

    # at the very ends of the range the difference decides, as a frame adds instead
    tiny = 1e-9
    exact = lambda c: F.when(F.abs(F.col(c) - F.col("t_s")) <= ONSET_S, F.col(c))
    seen = rows.withColumns({"stop_s": stop, "__a": near(-ONSET_S - tiny, -ONSET_S + tiny), "__b": near(-ONSET_S + tiny, ONSET_S - tiny), "__c": near(ONSET_S - tiny, ONSET_S + tiny)})
    onset = seen.where(kind == "barge_in_detected").select("clip_id", "seq", F.coalesce(exact("__a"), "__b", exact("__c"), "t_s").alias("onset"), F.lit(0).alias("tie"), F.struct(F.col("t_s").alias("barge_s"), "stop_s").alias("b"))
    # the first caller end at or after the onset: onsets and ends in one order
    ends = rows.where(kind == timeline.CALLER_END).select("clip_id", F.lit(None).cast("long").alias("seq"), F.col("t_s").alias("onset"), F.lit(1).alias("tie"), F.lit(None).cast("struct<barge_s:double,stop_s:double>").alias("b"))
    behind = F.first(F.when(F.col("tie") == 1, F.col("onset")), ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("onset", "tie").rowsBetween(0, Window.unboundedFollowing))
    done = onset.unionByName(ends).withColumn("__end", behind).where("tie = 0")
    raw = F.col("b.stop_s") - F.col("b.barge_s")
    return done.select("clip_id", "seq", F.col("b.barge_s").alias("barge_s"), F.round("onset", 3).alias("onset_s"), F.coalesce(F.round(raw, 3), F.lit(window_s * 10)).alias("latency_s"), F.round(F.col("__end") - F.col("onset"), 3).alias("utterance_s"), F.coalesce(raw <= window_s, F.lit(False)).alias("success"))


def barge_attempts_timeline(segments: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """Each caller start strictly inside an agent segment, of several the first."""
    a = segments.where("speaker = 'agent'").select("clip_id", F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    c = segments.where("speaker = 'caller'").select("clip_id", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"))
    hit = c.join(a, "clip_id").where("a0 < c0 AND c0 < a1").groupBy("clip_id", "c0", "c1").agg(F.min_by("a1", "a0").alias("a1"))
    raw = F.col("a1") - F.col("c0")
    return hit.select("clip_id", F.col("c0").alias("barge_s"), F.round("c0", 3).alias("onset_s"), F.round(raw, 3).alias("latency_s"), F.round(F.col("c1") - F.col("c0"), 3).alias("utterance_s"), (raw <= window_s).alias("success"))


def barge_metrics(attempts: DataFrame, least_s: float = FALSE_ALARM_S) -> DataFrame:
    """Percentiles over successful attempts (NaN without any), success and false-alarm rates, count.
    A success over less than ``least_s`` of speech, to the millisecond, is a false alarm."""
    won = F.when(F.col("success"), F.col("latency_s"))
    false = F.count_if((F.col("utterance_s") < least_s) & F.col("success"))
    nan = F.lit(float("nan"))
    return attempts.groupBy("clip_id").agg(
        F.coalesce(F.percentile(won, F.lit(0.5)), nan).alias("bargein_latency_p50_s"), F.coalesce(F.percentile(won, F.lit(0.95)), nan).alias("bargein_latency_p95_s"),
        F.avg(F.col("success").cast("double")).alias("bargein_success_rate"), (false / F.count("*")).alias("bargein_false_alarm_rate"), F.count("*").alias("n_bargein_events"),
    )


def barge(events: DataFrame, segments: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """Attempts from events where a clip has a detection, else from its timeline."""
    direct = barge_attempts(events, window_s)
    flagged = events.where("kind = 'barge_in_detected'").select("clip_id").distinct()
    return direct.drop("seq").unionByName(barge_attempts_timeline(segments, window_s).join(flagged, "clip_id", "left_anti"))
