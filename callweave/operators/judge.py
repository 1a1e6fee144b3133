"""A judge's answers: asking for them, finding the JSON, checking it, salvaging unscoreable ones. The
reading is all in SQL; only the asking runs in Python."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.session import ship

DIMENSIONS = ("naturalness", "prosody", "fluency", "pace", "responsiveness", "emotional_alignment", "intelligibility", "conversational_flow", "frustration_handling")
SCHEMA = "struct<" + ",".join(f"{d}:struct<reasoning:string,score:string>" for d in DIMENSIONS) + ",overall:string,notable_timestamps:array<string>,summary:string,unscoreable:string,unscoreable_reason:string,rubric_version:string>"
#: What is said of each channel, with the column of its samples.
CHANNELS = {"agent_only": ("agent", "only the agent's side of the call"), "caller_only": ("caller", "only the caller's side of the call"), "mono": ("mono", "both sides of the call in one track")}
SYSTEM = """You grade how a voice agent sounds and converses on the phone, and not whether what it says is right.
You hear {channel}. The call is about: {domain}.
Hear the whole of it. For each dimension give a short reason from what you heard, with times as m:ss, and then a
whole number from 1 to 5, of which 5 is best. Answer with one JSON object in the given form and nothing else."""
RUBRIC = "RUBRIC_VERSION: built-in\nGrade " + ", ".join(DIMENSIONS) + ", each with reasoning before score, then overall, notable_timestamps and summary. Where the audio cannot be graded, set unscoreable and give unscoreable_reason."
NUDGE = "Give the JSON object alone, in the given form."
TRANSIENT = ("429", "500", "502", "503", "504", "timeout", "timed out", "unavailable", "overloaded", "rate limit", "connection")
#: The longest wait between two tries, in seconds.
LONGEST_WAIT = 30.0
FAILURE = "judge_parse_failure: no valid reply"


def extract(text: Column) -> Column:
    """The JSON object in a reply: inside the first fence if there is one, without the word json,
    from the first brace to the last."""
    bind = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  evaluates c once
    fenced = lambda p: F.when(F.size(p) >= 3, F.regexp_replace(p[1], r"^(?i)\s*json", "")).otherwise(F.array_join(p, "```"))

    def braces(body: Column) -> Column:
        start, end = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
        return F.when((start > 0) & body.contains("}") & (end >= start), F.substring(body, start, end - start + 1))

    return bind(bind(F.split(text, "```"), fenced), braces)


def lax_int(text: Column) -> Column:
    """A whole number from 1 to 5 written as a number, a string or true; else null."""
    v = F.when(F.lower(text) == "true", 1.0).otherwise(text.try_cast("double"))
    return F.when((v == F.floor(v)) & v.between(1, 5), v.cast("int"))


def parse(replies: DataFrame, text: str = "text") -> DataFrame:
    """Each reply with ``error`` or ``metrics``: ``judge_<dimension>`` and ``judge_overall``, and with
    ``rubric_version`` and ``object``, the JSON that was found.

    A reply whose ``unscoreable`` is true gives its reason as the error. It may leave out scores, but
    one that it gives must be right. A missing or bad reason or score of another reply is a failure.
    """
    # a generator parses each reply once, however many scores are read from it
    found = replies.withColumn("object", F.explode(F.array(extract(F.col(text)))))
    parsed = found.withColumn("__o", F.explode(F.array(F.from_json("object", SCHEMA))))
    said = F.lower(F.trim(F.coalesce("__o.unscoreable", F.lit("false"))))
    unscoreable = ~said.isin("", "false", "0", "0.0", "null", "[]", "{}")
    score = {d: F.when(F.col(f"__o.{d}.reasoning").isNotNull(), lax_int(F.col(f"__o.{d}.score"))) for d in DIMENSIONS}
    overall = lax_int(F.col("__o.overall"))
    whole, fair = overall.isNotNull(), F.col("__o.overall").isNull() | overall.isNotNull()
    for d, s in score.items():
        whole, fair = whole & s.isNotNull(), fair & (F.col(f"__o.{d}").isNull() | s.isNotNull())
    reason = F.nullif(F.trim("__o.unscoreable_reason"), F.lit(""))
    error = F.when(unscoreable & whole, F.coalesce(reason, F.lit("the judge marked the clip unscoreable"))).when(unscoreable & fair, F.coalesce(reason, F.lit("unscoreable"))).when(unscoreable | ~whole, FAILURE)
    named = {f"judge_{d}": s for d, s in score.items()} | {"judge_overall": overall}
    m = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v.cast("double"))])
    # a reply that is no object has no fields
    error = F.when(F.col("__o").isNull(), FAILURE).otherwise(error)
    out = parsed.withColumns({"error": error, "metrics": F.when(error.isNull(), m)})
    return out.withColumn("rubric_version", F.col("__o.rubric_version")).drop("__o")


def acceptable(text: str | None) -> bool:
    """Whether ``parse`` makes something of a reply, so that it need not be asked for again."""
    body = (text or "").split("```")
    body = body[1] if len(body) >= 3 else "```".join(body)
    a, b = body.find("{"), body.rfind("}")
    try:
        o = json.loads(body[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return False
    if not isinstance(o, dict):
        return False

    def right(v: object) -> bool:
        try:
            return float(v) in (1, 2, 3, 4, 5)
        except (TypeError, ValueError):
            return False

    fair = lambda d: isinstance(d, dict) and isinstance(d.get("reasoning"), str) and right(d.get("score"))
    if o.get("unscoreable") and str(o["unscoreable"]).lower() != "false":
        return all(not isinstance(o.get(d), dict) or fair(o[d]) for d in DIMENSIONS) and (o.get("overall") is None or right(o["overall"]))
    return all(fair(o.get(d)) for d in DIMENSIONS) and right(o.get("overall"))


def channel(kind: str) -> tuple[Column, Column]:
    """The samples that a judge hears and what is said of them: the isolated channel that it wants,
    where there is one, else the mix."""
    mono, mixed = CHANNELS["mono"]
    want, said = CHANNELS.get(kind, CHANNELS["mono"])
    there = F.size(want) > 0
    return F.when(there, F.col(want)).otherwise(F.col(mono)), F.when(there, said).otherwise(mixed)


def domain(override: Column, default: str) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.lit(default))


def prompt(said: Column, about: Column, template: str = SYSTEM) -> Column:
    """The system text; the rubric goes beside it and the audio apart."""
    return F.replace(F.replace(F.lit(template), F.lit("{channel}"), said), F.lit("{domain}"), about)


def cap(x: Column, rate: Column, seconds: float | None) -> Column:
    """The first ``seconds`` of samples; all without a limit or with one of 0."""
    return x if not seconds or seconds <= 0 else F.slice(x, F.lit(1), F.greatest(F.lit(1), F.floor(rate * seconds).cast("int")))


def ask(prompts: DataFrame, client: Callable[[str, str, object, str | None], str], rubric: str = RUBRIC, tries: int = 2, retries: int = 5, at_once: int | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``clip_id``, ``text``, ``error`` and ``duration_ms`` of a judge's answers to
    ``prompts(clip_id, system, audio)``.

    ``client`` is called in the workers with the system text, the rubric, the audio and a nudge,
    which is None at first. An answer that is not ``acceptable`` is asked for again with the nudge,
    up to ``tries`` times. Errors that pass are retried after waits that double up to
    ``LONGEST_WAIT``. What fails in the end is a row with an error. No more than ``at_once`` calls
    run together. Store the answers before using them twice.
    """
    ship(prompts.sparkSession)

    def call(system: str, audio: object, nudge: str | None) -> str:
        for turn in range(retries + 1):
            try:
                return client(system, rubric, audio, nudge)
            except Exception as e:
                passing = isinstance(e, ConnectionError | TimeoutError) or any(t in str(e).lower() for t in TRANSIENT)
                if not passing or turn == retries:
                    raise
                wait(min(LONGEST_WAIT, 2.0**turn))
        raise AssertionError

    def one(system: str, audio: object) -> tuple[str | None, str | None, float]:
        began, text = time.perf_counter(), None
        try:
            for turn in range(tries):
                text = call(system, audio, NUDGE if turn else None)
                if acceptable(text):
                    break
            return text, None, 1000 * (time.perf_counter() - began)
        except Exception as e:
            return None, f"{type(e).__name__}: {e}", 1000 * (time.perf_counter() - began)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(c, *one(s, a)) for c, s, a in pdf.itertuples(index=False)], columns=["clip_id", "text", "error", "duration_ms"])

    rows = prompts.select("clip_id", "system", "audio")
    return (rows.repartition(at_once) if at_once else rows).mapInPandas(run, "clip_id string, text string, error string, duration_ms double")
