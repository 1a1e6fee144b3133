"""The state of a phone call, frame by frame.

The clock is the number of frames, 20 ms each, and not the time of day. One class holds the rules; it
runs over a finished call at once, or as the state of a stream, where a call's frames arrive in
pieces. Frames are put in order by ``seq``; a frame that comes early waits for those before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from callweave.operators.signal import mulaw_decode
from callweave.session import ship

FRAME_MS, RATE = 20, 8000
SAMPLES = RATE * FRAME_MS // 1000
EVENTS = "call_id string, kind string, t_s double"


@dataclass
class Policy:
    """How a call goes: times in milliseconds, ``vad_rms`` of full scale."""

    vad_rms: float = 0.02
    gap_ms: int = 200
    end_silence_ms: int = 600
    barge: bool = False
    after_ms: int = 2500
    max_barges: int = 1
    yield_ms: int = 200
    grace_ms: int = 500
    reply_ms: int = 1000
    max_turns: int = 8
    #: Whether the agent's turns are transcribed, and the shortest that can be.
    transcribed: bool = False
    least_ms: int = 200


@dataclass
class Call:
    """One call. ``step`` takes the next frame's loudness and gives the events that it brings.

    The agent's turn opens with its first voiced frame and closes when it has been silent for
    ``end_silence_ms``, at its last voiced frame; the caller then replies. With ``barge`` the caller
    cuts in once the agent has spoken for ``after_ms`` without a gap over ``gap_ms``. The agent
    yields when it falls silent for ``yield_ms`` and spoke last between the cut and ``grace_ms``
    behind the caller's words; when it speaks beyond that, it has ignored the caller.
    """

    clock: int = 0
    speaking: bool = False
    in_turn: bool = False
    run_start: int = -1
    turn_start: int = -1
    last_voice: int = -1
    queue: int = 0
    turns: int = 0
    barges: int = 0
    barge_at: int = -1
    barge_end: int = -1
    hangup: bool = False
    done: bool = False
    waiting: dict = field(default_factory=dict)

    # what a session with sound does otherwise

    def reply(self, p: Policy) -> tuple[int, int, bool]:
        """The frames and the milliseconds of the caller's next words, and whether they are the last."""
        return -(-p.reply_ms // FRAME_MS), p.reply_ms, False

    def heard(self, start: int, end: int, p: Policy) -> bool:
        """Whether the agent's turn gives a transcript."""
        return p.transcribed and end - start + FRAME_MS >= p.least_ms

    def step(self, loud: float | None, p: Policy) -> list[tuple[str, float]]:
        """The next frame; None for one that isn't the agent's, which takes its time alone."""
        out: list[tuple[str, float]] = []
        if loud is not None:
            self.hear(loud >= p.vad_rms, p, out)
        self.pump(out)
        self.clock += FRAME_MS
        return out

    def hear(self, voiced: bool, p: Policy, out: list) -> None:
        now = self.clock
        if voiced:
            if self.run_start < 0 or self.last_voice < 0 or now - self.last_voice > p.gap_ms:
                self.run_start = now
            if not self.in_turn:
                self.in_turn, self.turn_start = True, now
                out += [("agent_tts_start", now / 1000), ("tts_first_audio", now / 1000)]
            self.speaking, self.last_voice = True, now
        elif self.speaking and now - self.last_voice >= p.end_silence_ms:
            self.speaking = False
            self.end_turn(self.last_voice, p, out)
            if not self.queue and self.barge_at < 0:
                self.speak(False, p, out)
        if self.barge_at >= 0:
            limit = self.barge_end + p.grace_ms
            if voiced and now > limit:
                self.barge_at = self.barge_end = -1
            elif not voiced and self.barge_at <= self.last_voice <= limit and now - self.last_voice >= p.yield_ms:
                out.append(("agent_interrupted", self.last_voice / 1000))
                self.end_turn(self.last_voice, p, out)
                self.barge_at = self.barge_end = -1
        if p.barge and voiced and self.barge_at < 0 and not self.queue and self.barges < p.max_barges and now - self.run_start >= p.after_ms:
            self.speak(True, p, out)

    def end_turn(self, at: int, p: Policy, out: list) -> None:
        if self.in_turn:
            out.append(("agent_tts_end", at / 1000))
            if self.heard(self.turn_start, at, p):
                out.append(("stt_final", at / 1000))
            self.in_turn, self.turn_start = False, -1

    def speak(self, barge: bool, p: Policy, out: list) -> None:
        if self.turns >= p.max_turns:
            return
        self.queue, ms, last = self.reply(p)
        self.turns += 1
        out.append(("user_speech_start", self.clock / 1000))
        if barge:
            self.barges += 1
            self.barge_at, self.barge_end, self.run_start = self.clock, self.clock + ms, self.clock
            out.append(("barge_in_detected", self.clock / 1000))
        self.hangup = self.hangup or last or self.turns >= p.max_turns

    def pump(self, out: list) -> None:
        if self.queue:
            self.queue -= 1
            if not self.queue:
                out.append(("user_speech_end", (self.clock + FRAME_MS) / 1000))

    def finish(self, p: Policy) -> list[tuple[str, float]]:
        """Close the agent's turn when the call stops within it."""
        out: list[tuple[str, float]] = []
        self.end_turn(self.last_voice, p, out)
        self.done = True
        return out

    def take(self, seqs: list[int], louds: list[float], stops: list[bool], p: Policy) -> list[tuple[str, float]]:
        """Frames in any order; those before them must have come. A stop holds for its own ``seq``."""
        at = self.clock // FRAME_MS
        self.waiting.update({str(s): [None if v is None or v != v else v, bool(e)] for s, v, e in zip(seqs, louds, stops, strict=True) if s >= at})
        out: list[tuple[str, float]] = []
        while not self.done and (frame := self.waiting.pop(str(self.clock // FRAME_MS), None)) is not None:
            out += self.finish(p) if frame[1] else self.step(frame[0], p)
        if self.done:
            self.waiting.clear()
        return out


def level(pcm: np.ndarray) -> float:
    """Root mean square of 16-bit samples, full scale being 1."""
    return float(np.sqrt(np.mean((pcm / 32768.0) ** 2))) if len(pcm) else 0.0


def loudness(payload: pd.Series) -> pd.Series:
    """Root mean square of frames in mu-law, full scale being 1."""
    return payload.map(lambda b: level(mulaw_decode(np.frombuffer(b, np.uint8))) if b else 0.0)


def parse(messages: DataFrame, col: str = "value") -> DataFrame:
    """``call_id``, ``event``, ``seq``, ``track``, ``payload`` and ``stop`` of media-stream messages in
    JSON. The track is inbound unless said; a start names its stream inside; other events than start,
    media and stop, and what cannot be read, go."""
    m = messages.select(F.from_json(F.col(col).cast("string"), "event string, streamSid string, sequenceNumber string, start struct<streamSid:string>, media struct<track:string,payload:string>").alias("m"))
    rows = m.where("m.event IN ('start', 'media', 'stop')")
    return rows.select(F.coalesce("m.streamSid", "m.start.streamSid").alias("call_id"), F.col("m.event").alias("event"), F.col("m.sequenceNumber").cast("long").alias("seq"), F.coalesce("m.media.track", F.lit("inbound")).alias("track"), F.unbase64("m.media.payload").alias("payload"), (F.col("m.event") == "stop").alias("stop"))


def measured(frames: DataFrame) -> DataFrame:
    """Frames with their loudness, the only thing that the state machine needs of the audio. It is null
    for frames of other tracks, which take their time; a start takes none."""
    ship(frames.sparkSession)
    rms = F.pandas_udf(loudness, "double")
    return frames.where("event <> 'start'").select("call_id", "seq", F.when(F.col("track") == "inbound", rms("payload")).alias("loud"), "stop")


def batch(frames: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Events of finished calls, from ``frames(call_id, seq, loud, stop)``."""
    ship(frames.sparkSession)
    p = policy or Policy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        call = Call()
        pdf = pdf.sort_values("seq")
        got = call.take(range(len(pdf)), pdf.loud.tolist(), pdf.stop.tolist(), p)
        if not call.done:
            got += call.finish(p)
        got.sort(key=lambda e: e[1])
        return pd.DataFrame({"call_id": pdf.call_id.iloc[0], "kind": [k for k, _ in got], "t_s": [t for _, t in got]}, columns=["call_id", "kind", "t_s"])

    return frames.groupBy("call_id").applyInPandas(run, EVENTS)


class Machine(StatefulProcessor):
    """``Call`` as the state of a streaming query; a call's state is dropped when it stops."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("call", "body string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        call = Call(**json.loads(self.state.get()[0])) if self.state.exists() else Call()
        got: list[tuple[str, float]] = []
        for pdf in rows:
            got += call.take(pdf.seq.tolist(), pdf.loud.tolist(), pdf.stop.tolist(), self.policy)
        if call.done:
            self.state.clear()
        else:
            self.state.update((json.dumps(asdict(call)),))
        if got:
            yield pd.DataFrame({"call_id": [str(key[0])] * len(got), "kind": [k for k, _ in got], "t_s": [float(t) for _, t in got]})

    def close(self) -> None:
        pass


def stream(frames: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Events of calls as their frames arrive; needs the RocksDB state store. The order of a call's
    events is by time only when the sink sorts them."""
    ship(frames.sparkSession)
    return frames.groupBy("call_id").transformWithStateInPandas(statefulProcessor=Machine(policy or Policy()), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def frames_of(events: DataFrame) -> DataFrame:
    """Frames from the event table: each event of a user brings ten, loud where its value is over 50,
    in the order of time; a stop ends the call."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").cast("string").alias("call_id"), (F.row_number().over(order) - 1).alias("n"), (F.coalesce("value", F.lit(0.0)) > 50).alias("on"))
    frames = rows.select("call_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("n") * 10 + i).cast("long"))).alias("seq"), F.when(F.col("on"), 0.3).otherwise(0.0).alias("loud"), F.lit(False).alias("stop"))
    ends = frames.groupBy("call_id").agg((F.max("seq") + 1).alias("seq")).select("call_id", "seq", F.lit(0.0).alias("loud"), F.lit(True).alias("stop"))
    return frames.unionByName(ends)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events by event time, with a watermark for late ones; an extension, for
    streams that have a clock. ``ts`` without zone is read in the session's."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
