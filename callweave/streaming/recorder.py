"""A phone call with its sound: media-stream messages in, the caller's frames out, a recording at the end.

``Session`` is the state machine of ``calls`` with voices: what the caller says comes from a function,
what the agent says may be transcribed by another, and a bed of background babble may lie under the
caller. It answers one message at a time, as a live socket needs it, or runs over whole logs of calls
as a table.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from callweave.operators.conversation import metadata_of
from callweave.operators.signal import mulaw_decode, mulaw_encode, resample, tone
from callweave.session import ship
from callweave.sources.recordings import write_wav
from callweave.streaming.calls import FRAME_MS, RATE, SAMPLES, Call, Policy, level

RECORDED = "call_id string, wav binary, sidecar string, duration_s double"

#: What a caller says: the number of the turn and the transcript so far to samples at 8 kHz, the words,
#: and whether they are the last.
Voice = Callable[[int, list[dict]], tuple[np.ndarray, str, bool]]


def scripted_voice(seconds: float = 0.5, most: int = 8) -> Voice:
    """A caller that hums for a fixed time and hangs up on its last turn."""

    def say(turn: int, history: list[dict]) -> tuple[np.ndarray, str, bool]:
        pcm = (resample(tone(seconds, 160, turn), 16000, RATE) * 32767).astype(np.int16)
        return pcm, f"caller turn {turn}", turn + 1 >= most

    return say


def spoken(voice: np.ndarray, rate: int = 16000) -> np.ndarray:
    """Samples from -1 to 1 as 16-bit ones at 8 kHz."""
    return (np.clip(resample(voice, rate, RATE), -1, 1) * 32767).astype(np.int16)


@dataclass
class Session(Call):
    """A call that keeps its sound. ``transcribe`` takes samples and their rate."""

    voice: Voice = field(default_factory=scripted_voice)
    policy: Policy = field(default_factory=Policy)
    transcribe: Callable[[np.ndarray, int], str] | None = None
    background: np.ndarray | None = None
    scenario: dict = field(default_factory=lambda: {"id": "call"})
    version: str = "candidate"
    prompt_version: str | None = None
    events: list = field(default_factory=list)
    transcript: list = field(default_factory=list)
    sound: dict = field(default_factory=lambda: {"agent": [], "caller": []})
    left: list = field(default_factory=list)
    bed_at: int = 0
    sent: np.ndarray | None = None

    def reply(self, p: Policy) -> tuple[int, int, bool]:
        pcm, text, last = self.voice(self.turns, [dict(t) for t in self.transcript])
        pcm = np.asarray(pcm, np.int16)
        self.left = [pcm[i : i + SAMPLES] for i in range(0, len(pcm), SAMPLES)]
        self.transcript.append({"speaker": "caller", "text": text})
        return len(self.left), len(pcm) * 1000 // RATE, bool(last)

    def heard(self, start: int, end: int, p: Policy) -> bool:
        if self.transcribe is None or start < 0:
            return False
        parts = [x for t, x in self.sound["agent"] if start <= t <= end]
        pcm = np.concatenate(parts) if parts else np.zeros(0, np.int16)
        if len(pcm) * 1000 < p.least_ms * RATE:
            return False
        text = self.transcribe(pcm, RATE)
        if text:
            self.transcript.append({"speaker": "agent", "text": text})
        return bool(text)

    def pump(self, out: list) -> None:
        self.sent = None
        if self.queue or self.background is not None:
            frame = self.left.pop(0) if self.queue else np.zeros(SAMPLES, np.int16)
            if self.background is not None:
                n = len(self.background)
                under = self.background[(self.bed_at + np.arange(len(frame))) % n]
                self.bed_at = (self.bed_at + len(frame)) % n
                frame = np.clip(frame.astype(np.int32) + under, -32768, 32767).astype(np.int16)
            self.sound["caller"].append((self.clock, frame))
            self.sent = frame
        super().pump(out)

    def handle(self, message: dict) -> list[dict]:
        """The messages that a message brings: at most a frame of the caller's."""
        if message.get("event") != "media":
            return []
        media, loud = message.get("media") or {}, None
        if media.get("track", "inbound") == "inbound":
            pcm = mulaw_decode(np.frombuffer(base64.b64decode(media["payload"]), np.uint8))
            self.sound["agent"].append((self.clock, pcm))
            loud = level(pcm)
        self.events += self.step(loud, self.policy)
        if self.sent is None:
            return []
        return [{"event": "media", "media": {"payload": base64.b64encode(mulaw_encode(self.sent).tobytes()).decode()}}]

    def recording(self) -> tuple[bytes, dict, float]:
        """Close the call: two channels at 8 kHz, the agent's first, with a second of silence at the
        end, the sidecar, and the seconds."""
        self.events += self.finish(self.policy)
        tracks = []
        for side in ("agent", "caller"):
            end = max((t * RATE // 1000 + len(x) for t, x in self.sound[side]), default=0)
            track = np.zeros(end, np.float32)
            for t, x in self.sound[side]:
                track[t * RATE // 1000 : t * RATE // 1000 + len(x)] = x / 32768
            tracks.append(track)
        car = {
            "call_id": f"{self.scenario['id']}__{self.version}__call", "agent_version": self.version, "prompt_version": self.prompt_version, "tts_provider": "telephony", "channel_map": {"agent_channel": 0, "caller_channel": 1},
            "domain": self.scenario.get("domain"), "transcript": "\n".join(f"{t['speaker']}: {t['text']}" for t in self.transcript), "events": sorted(({"kind": k, "t_s": round(t, 3)} for k, t in self.events), key=lambda e: e["t_s"]),
            **metadata_of(self.scenario), "transport": "media-stream",
        }
        return write_wav(tracks, RATE), car, max(map(len, tracks), default=0) / RATE


def replay(messages: Iterator[dict], session: Session) -> list[dict]:
    """Hand a log of messages to a session until it stops or the caller hangs up; what was sent back,
    which begins with the stream's start."""
    sent, stream = [], None
    for m in messages:
        if m.get("event") == "start":
            stream = (m.get("start") or {}).get("streamSid") or m.get("streamSid")
        for out in session.handle(m):
            if stream is not None:
                sent.append(out | {"streamSid": stream})
        if m.get("event") == "stop" or session.hangup:
            break
    return sent


def record(frames: DataFrame, make: Callable[[str], Session]) -> DataFrame:
    """``RECORDED`` of finished calls from ``frames(call_id, event, seq, track, payload)``, as ``parse``
    gives them; ``make`` gives a call's session. A call's frames are brought together, which are
    8,000 bytes for a second."""
    ship(frames.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        call = str(pdf["call_id"].iloc[0])
        session = make(call)
        for r in pdf.sort_values("seq").itertuples(index=False):
            if r.event == "stop" or session.hangup:
                break
            if r.event == "media":
                session.handle({"event": "media", "media": {"track": r.track, "payload": base64.b64encode(r.payload or b"").decode()}})
        wav, car, seconds = session.recording()
        return pd.DataFrame([(call, wav, json.dumps(car), seconds)], columns=["call_id", "wav", "sidecar", "duration_s"])

    return frames.where("call_id IS NOT NULL").groupBy("call_id").applyInPandas(run, RECORDED)


def frame(pcm: np.ndarray, seq: int, stream: str = "call") -> str:
    """A media message of 20 ms of sound, as a line of a log."""
    return json.dumps({"event": "media", "streamSid": stream, "sequenceNumber": str(seq), "media": {"track": "inbound", "payload": base64.b64encode(mulaw_encode(pcm).tobytes()).decode()}})


__all__ = ["FRAME_MS", "RATE", "SAMPLES", "Session", "frame", "record", "replay", "scripted_voice", "spoken"]
