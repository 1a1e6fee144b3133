"""Direction, gate status, formats and keys as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER_HINTS = ("latency", "gap", "overlap", "false_alarm", "_delay", "talk_ratio")


def lower_is_better(metric: Column, low: Column, high: Column) -> Column:
    """A maximum alone means lower, any minimum higher; otherwise the name decides."""
    named = metric.rlike("|".join(LOWER_HINTS))
    return F.when(low.isNotNull(), False).when(high.isNotNull(), True).otherwise(named)


def gate(value: Column, metric: Column, low: Column, high: Column, warn: Column) -> Column:
    """``status`` and ``threshold``. A NaN breaks no bound, though Spark orders it above all numbers;
    a null value has no status."""
    real = ~F.isnan(value)
    out = lambda s, t: F.struct(F.lit(s).alias("status"), t.cast("double").alias("threshold"))
    below = low.isNotNull() | (high.isNull() & ~lower_is_better(metric, low, high))
    warned = F.when(below, value < warn).otherwise(value > warn)
    return (
        F.when(value.isNull(), F.lit(None).cast("struct<status:string,threshold:double>"))
        .when(real & (value < low), out("fail", low))
        .when(real & (value > high), out("fail", high))
        .when(real & warned, out("warn", warn))
        .otherwise(out("pass", F.coalesce(low, high)))
    )


def severity(score: Column) -> Column:
    """Class of a 1 to 5 score, rounded half to even."""
    n = F.bround(score.cast("double")).cast("int")
    return F.when(score.isNull() | F.isnan(score.cast("double")), "none").when(n <= 2, "bad").when(n == 3, "warn").otherwise("good")


def number(value: Column, places: int = 2) -> Column:
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.format_string(f"%.{places}f", value))


def cache_key(clip: Column, scorer: Column, config: Column) -> Column:
    return F.sha2(F.concat(clip, F.lit("\0"), scorer, F.lit("\0"), config), 256)


def prompt_version(prompt: Column) -> Column:
    return F.concat(F.lit("p-"), F.left(F.sha2(prompt, 256), F.lit(8)))


def stable_hash(value: object) -> str:
    """16 hex digits of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def scorer_hash(name: str, version: str, config: dict) -> str:
    return stable_hash({"name": name, "version": version, "config": config})


def rubric_version(rubric: Column) -> Column:
    """What follows the first colon of the first line that isn't blank."""
    line = F.substring_index(F.regexp_replace(rubric, r"^\s+", ""), "\n", 1)
    return F.when(line.contains(":"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))).otherwise("unknown")


def self_judged(provider: Column, family: Column) -> Column:
    """Whether a judge would grade its own family: either name holds the other."""
    p, f = F.lower(F.trim(F.coalesce(provider, F.lit("")))), F.lower(F.trim(F.coalesce(family, F.lit(""))))
    return (p != "") & (f != "") & (p.contains(f) | f.contains(p))


def stream_address(url: Column) -> Column:
    """A media-stream address: a secure websocket scheme, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), r"^(?i)(?:https?|wss?)://", "")
    return F.concat(F.lit("wss://"), F.regexp_replace(bare, r"/+$", ""))


def attribute(text: Column) -> Column:
    """Escaped for an XML attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
