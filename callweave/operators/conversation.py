"""Turn-based calls between an agent and a simulated caller, and their recordings.

Agents and callers are injected: an agent has ``start``, ``greet``, ``respond`` and ``close``, a caller
``next_turn``. A call is talked in one task; many calls are talked at once. The scripted ones need no
service and tell apart agents that answer late.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.signal import tone
from callweave.operators.simulate import MIN_AUDIO_S, THINK_S, suite
from callweave.session import ship
from callweave.sources.recordings import parse_sidecar, write_wav

RATE = 16000
CALLS = "call_id string, scenario_id string, version string, run int, valid boolean, reason string, attempts int, moves array<struct<speaker:string,text:string,dur_s:double,latency_s:double,hangup:boolean>>, wav binary, sidecar string"


@dataclass
class Move:
    """What one side says: text, samples at 16 kHz, how long an agent took, and whether a caller hangs up."""

    speaker: str
    text: str
    audio: np.ndarray
    latency_s: float = 0.0
    hangup: bool = False


class Agent(Protocol):
    def start(self, scenario: dict) -> None: ...
    def greet(self, scenario: dict) -> Move | None: ...
    def respond(self, heard: np.ndarray) -> Move: ...
    def close(self) -> None: ...


class Caller(Protocol):
    def next_turn(self, scenario: dict, history: list[Move]) -> Move: ...


class ScriptedCaller:
    """Says given lines, then the same complaint, ever longer, and hangs up on its last turn."""

    def __init__(self, seed: int = 0, lines: tuple = ()) -> None:
        self.seed, self.lines = seed, lines

    def next_turn(self, scenario: dict, history: list[Move]) -> Move:
        k = sum(m.speaker == "caller" for m in history)
        first = scenario.get("opening") or f"Hello, it is about this: {scenario.get('goal') or 'a question'}."
        text = self.lines[k] if k < len(self.lines) else first if k == 0 else "You have not answered me yet."
        return Move("caller", text, tone(1.2 + 0.3 * min(k, 4), 170, k + 1000 * self.seed), hangup=k + 1 >= int(scenario.get("max_turns") or 8))


class ScriptedAgent:
    """Greets, and answers every turn after a fixed time."""

    def __init__(self, latency_s: float = 0.8, reply_s: float = 1.8, pitch: float = 120.0, greets: bool = True, seed: int = 0) -> None:
        self.latency_s, self.reply_s, self.pitch, self.greets, self.seed, self.turns = latency_s, reply_s, pitch, greets, seed, 0

    def start(self, scenario: dict) -> None:
        self.turns = 0

    def greet(self, scenario: dict) -> Move | None:
        return Move("agent", "Good day, what can I do for you?", tone(self.reply_s, self.pitch, 99), 0.2) if self.greets else None

    def respond(self, heard: np.ndarray) -> Move:
        self.turns += 1
        return Move("agent", f"One moment, I am looking at that, for the {self.turns}. time.", tone(self.reply_s, self.pitch, self.turns + 10 + 1000 * self.seed), self.latency_s)

    def close(self) -> None: ...


def converse(scenario: dict, agent: Agent, caller: Caller) -> list[Move]:
    """One call: a greeting, then turns of both, until the caller hangs up, which the agent leaves
    unanswered, or has had all its turns."""
    most = int(scenario.get("max_turns") or 8)
    agent.start(scenario)
    try:
        hello = agent.greet(scenario)
        moves = [hello] if hello is not None else []
        turns = 0
        while turns < most:
            moves.append(caller.next_turn(scenario, moves))
            turns += 1
            if moves[-1].hangup:
                break
            moves.append(agent.respond(moves[-1].audio))
        return moves
    finally:
        agent.close()


def fault(moves: list[Move]) -> str | None:
    """Why a call cannot be used, as ``simulate.validity`` says it; None where it can."""
    if not any(m.speaker == "caller" for m in moves):
        return "no caller turn"
    if not any(m.speaker == "agent" for m in moves):
        return "no agent turn"
    if any(len(m.audio) < int(MIN_AUDIO_S * RATE) for m in moves):
        return "turn too short"
    return "blank turn" if any(not m.text.strip() for m in moves) else None


def metadata_of(scenario: dict) -> dict:
    """What a recording keeps of its scenario."""
    persona, noise = scenario.get("persona") or {}, scenario.get("background") or {}
    named = persona if isinstance(persona, dict) else {"name": persona}
    return {"scenario_id": str(scenario["id"]), "source_call_id": scenario.get("source_call_id"), "persona": named.get("name", "caller"), "adversarial": bool(named.get("adversarial", False)), "background": bool(noise.get("enabled", False)) if isinstance(noise, dict) else bool(noise), "tags": list(scenario.get("tags") or [])}


def recorded(moves: list[Move], scenario: dict, call_id: str, version: str, run: int, prompt_version: str | None = None) -> tuple[bytes, dict]:
    """The call on two channels, the agent's first, with a second of silence at the end, and its
    sidecar. The agent starts after its latency and thinks on after its end."""
    at, tracks, events = 0.0, {"agent": np.zeros(0, np.float32), "caller": np.zeros(0, np.float32)}, []
    for m in moves:
        begin = at + max(0.0, m.latency_s) if m.speaker == "agent" else at
        end = begin + len(m.audio) / RATE
        kinds = (("tts_first_audio", begin), ("agent_tts_start", begin), ("agent_tts_end", end)) if m.speaker == "agent" else (("user_speech_start", begin), ("user_speech_end", end), ("stt_final", end))
        events += [{"kind": k, "t_s": round(t, 3)} for k, t in kinds]
        i = int(begin * RATE)
        x = np.zeros(max(len(tracks[m.speaker]), i + len(m.audio)), np.float32)
        x[: len(tracks[m.speaker])] = tracks[m.speaker]
        x[i : i + len(m.audio)] += m.audio
        tracks[m.speaker] = x
        at = end + (THINK_S if m.speaker == "agent" else 0.0)
    car = {
        "call_id": call_id, "agent_version": version, "prompt_version": prompt_version, "tts_provider": "simulated", "channel_map": {"agent_channel": 0, "caller_channel": 1}, "domain": scenario.get("domain"),
        "transcript": "\n".join(f"{m.speaker}: {m.text}" for m in moves), "events": events, **metadata_of(scenario), "run_index": run,
    }
    return write_wav([tracks["agent"], tracks["caller"]], RATE), car


def play(scenarios: DataFrame, versions: dict[str, Callable[[int], Agent]], make_caller: Callable[[int], Caller] = ScriptedCaller, k: int = 3, regen: int = 2) -> DataFrame:
    """``CALLS``: every scenario ``k`` times with the agent of every version. A call that cannot be used
    is talked again, up to ``regen`` times; the last one stays, flagged, so that none is missing.
    ``scenarios`` is a ``scenario_table``; agents and callers are made from a seed."""
    ship(scenarios.sparkSession)
    names = F.explode(F.array(*[F.lit(v) for v in versions])).alias("version")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                scenario, call = json.loads(r.body), f"{r.scenario_id}__{r.version}__run{r.run}"
                for turn in range(regen + 1):
                    seed = zlib.crc32(f"{call}/{turn}".encode())
                    moves = converse(scenario, versions[r.version](seed), make_caller(seed))
                    if (why := fault(moves)) is None:
                        break
                wav, car = recorded(moves, scenario, call, r.version, int(r.run))
                said = [{"speaker": m.speaker, "text": m.text, "dur_s": len(m.audio) / RATE, "latency_s": float(m.latency_s), "hangup": bool(m.hangup)} for m in moves]
                out.append((call, r.scenario_id, r.version, int(r.run), why is None, why, turn + 1, said, wav, json.dumps(car)))
            yield pd.DataFrame(out, columns=["call_id", "scenario_id", "version", "run", "valid", "reason", "attempts", "moves", "wav", "sidecar"])

    return suite(scenarios, k).select("scenario_id", "body", "run", names).mapInPandas(run, CALLS)


def as_recordings(calls: DataFrame) -> DataFrame:
    """The calls as ``recordings.discover`` and ``with_metadata`` would give them, without files."""
    return calls.select(F.concat("call_id", F.lit(".wav")).alias("source_path"), F.length("wav").cast("long").alias("length"), F.col("wav").alias("content"), parse_sidecar(F.col("sidecar")).alias("metadata"))
