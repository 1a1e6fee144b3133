"""Speech segments of a call: pairing, merging, gaps, overlap.

Tables: ``events(clip_id, seq, kind, t_s)`` and ``segments(clip_id, speaker, start_s, end_s)``. All
windows are keyed by clip, so one exchange on ``clip_id`` serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT_START, AGENT_ENDS = "agent_tts_start", ("agent_tts_end", "agent_interrupted")
CALLER_START, CALLER_END = "user_speech_start", "user_speech_end"
MERGE_GAP, MIN_SPEECH = 0.2, 0.1
OVERLAP_MIN, AWKWARD = 0.1, 1.5


def pair_events(events: DataFrame) -> DataFrame:
    """Segments from start and end events. The next event of the same speaker closes a start, be it
    an end or another start; what stays open or has no length is dropped."""
    kind = F.col("kind")
    agent = kind.isin(AGENT_START, *AGENT_ENDS)
    rows = events.where(agent | kind.isin(CALLER_START, CALLER_END)).withColumn("speaker", F.when(agent, "agent").otherwise("caller"))
    end = F.lead("t_s").over(Window.partitionBy("clip_id", "speaker").orderBy("t_s", "seq"))
    return rows.withColumn("end_s", end).where(kind.isin(AGENT_START, CALLER_START) & (F.col("end_s") > F.col("t_s"))).select("clip_id", "speaker", F.col("t_s").alias("start_s"), "end_s")


def islands(rows: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """Merge intervals of a key that touch, overlap, or lie ``gap`` or less apart."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_s") - reach > gap), 1).otherwise(0)
    numbered = rows.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("__island")


def union(segments: DataFrame) -> DataFrame:
    """The merged turns of each speaker."""
    return islands(segments, ["clip_id", "speaker"])


def intersect(merged: DataFrame, least: float = OVERLAP_MIN) -> DataFrame:
    """Where both speak, for ``least`` seconds or longer; an equi-join on the clip with a range test."""
    a = merged.where("speaker = 'agent'").select("clip_id", F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    c = merged.where("speaker = 'caller'").select("clip_id", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"))
    both = a.join(c, "clip_id").where("a0 < c1 AND c0 < a1")
    return both.select("clip_id", F.greatest("a0", "c0").alias("start_s"), F.least("a1", "c1").alias("end_s")).where(F.col("end_s") - F.col("start_s") >= least)


def gaps(merged: DataFrame) -> DataFrame:
    """Silence between a turn and the next one of the other speaker."""
    order = Window.partitionBy("clip_id").orderBy("start_s", "end_s", "speaker")
    rows = merged.withColumns({"next_speaker": F.lead("speaker").over(order), "next_start": F.lead("start_s").over(order)})
    return rows.where("next_speaker <> speaker AND next_start - end_s > 0").select("clip_id", "speaker", F.col("end_s").alias("start_s"), F.col("next_start").alias("end_s"), (F.col("next_start") - F.col("end_s")).alias("gap_s"))


def runs(frames: DataFrame, frame_s: float) -> DataFrame:
    """Speech regions from flags ``frames(clip_id, frame, speech)``; the last one ends with the clip."""
    on = frames.where("speech")
    order = Window.partitionBy("clip_id").orderBy("frame")
    grouped = on.withColumn("__g", F.col("frame") - F.row_number().over(order)).groupBy("clip_id", "__g").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return grouped.select("clip_id", (F.col("a") * frame_s).alias("start_s"), ((F.col("b") + 1) * frame_s).alias("end_s"))


def smooth(regions: DataFrame, gap: float = MERGE_GAP, least: float = MIN_SPEECH) -> DataFrame:
    """Close gaps up to ``gap``, then drop what is shorter than ``least``."""
    # an allowance for binary fractions keeps the bounds inclusive
    return islands(regions, ["clip_id"], gap + 1e-9).where(F.col("end_s") - F.col("start_s") >= least - 1e-9)


def label_speakers(diarized: DataFrame) -> DataFrame:
    """Segments with ``speaker`` from diarization ``label``: who speaks longest in all, to the
    microsecond, is the agent, ties to the lesser label; everyone else is the caller."""
    # sums of floats depend on their order, so that equal times would differ in the last bits
    held = diarized.groupBy("clip_id", "label").agg(F.sum(duration()).alias("held"))
    first = Window.partitionBy("clip_id").orderBy(F.round("held", 6).desc(), F.asc_nulls_last("label"))
    agent = held.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("clip_id", F.col("label").alias("__agent"))
    return diarized.join(agent, "clip_id").select("clip_id", F.when(F.col("label") == F.col("__agent"), "agent").otherwise("caller").alias("speaker"), "start_s", "end_s")


def duration() -> Column:
    return F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))


def source_of(clips: DataFrame) -> DataFrame:
    """Where a clip's timeline comes from: its events, its two isolated channels, or its mono track,
    which is estimated. ``clips`` has ``has_events``, and ``agent`` and ``caller`` samples."""
    both = (F.size("agent") > 0) & (F.size("caller") > 0)
    src = F.when(F.col("has_events"), "events").when(F.coalesce(both, F.lit(False)), "channels").otherwise("diarization")
    return clips.withColumn("source", src).withColumn("estimated", src == "diarization")


def mono_speech(regions: DataFrame) -> DataFrame:
    """All speech of a mono track counts as the agent's, and is estimated."""
    return regions.select("clip_id", F.lit("agent").alias("speaker"), "start_s", "end_s", F.lit(True).alias("estimated"))
