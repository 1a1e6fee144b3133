"""Recordings and their sidecars as tables."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.signal import resample
from callweave.session import ship

EXTENSIONS = (".mp3", ".wav", ".m4a", ".ogg", ".flac")
KNOWN = ("call_id", "agent_version", "prompt_version", "model_id", "tts_provider", "channel_map", "transcript", "domain", "events")
META = "call_id string, agent_version string, prompt_version string, model_id string, tts_provider string, channel_map struct<agent_channel:int,caller_channel:int>, transcript string, domain string, events array<struct<kind:string,t_s:double,payload:map<string,string>>>"
DECODED = "source_path string, clip_id string, source_sha256 string, sample_rate int, duration_s double, n_source_channels int, mono array<float>, agent array<float>, caller array<float>, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def discover(spark: SparkSession, folder: str, extensions: tuple = EXTENSIONS) -> DataFrame:
    """Every recording under a folder, at any depth: ``source_path``, ``length``, ``content``. The
    content is read only where a later step wants it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(extension(F.col("path")).isin(*extensions)).select(F.col("path").alias("source_path"), "length", "content")


def parse_sidecar(text: Column) -> Column:
    """Metadata of a sidecar: known keys by type, others in ``extra`` as JSON text. What cannot be
    read is null throughout; an empty channel map is none."""
    known = F.from_json(text, META)
    every = F.from_json(text, "map<string,string>")
    extra = F.map_filter(every, lambda k, v: ~k.isin(*KNOWN))
    fields = {k: known[k] for k in KNOWN}
    empty = known["channel_map"]["agent_channel"].isNull() & known["channel_map"]["caller_channel"].isNull()
    fields["channel_map"] = F.when(~empty, known["channel_map"])
    return F.struct(*[c.alias(k) for k, c in fields.items()], extra.alias("extra"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select(stem(F.col("path")).alias("__stem"), parse_sidecar(F.decode("content", "UTF-8")).alias("metadata"))


def with_metadata(recordings: DataFrame, cars: DataFrame) -> DataFrame:
    """Recordings with the sidecar of their stem; without one the metadata is null."""
    return recordings.withColumn("__stem", stem(F.col("source_path"))).join(cars, "__stem", "left").drop("__stem")


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples by channel from 16-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM can be decoded here")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return x, w.getframerate()


def identity(mono: np.ndarray, call_id: str | None = None) -> str:
    """The clip's id: a digest of its 16-bit samples, salted with the call's id if that is to count."""
    pcm = (np.clip(mono, -1, 1) * 32767).astype("<i2").tobytes()
    salt = b"\0" + call_id.encode() if call_id else b""
    return hashlib.blake2b(pcm + salt, digest_size=20).hexdigest()


def at_peak(x: np.ndarray, dbfs: float | None) -> np.ndarray:
    """Samples scaled so that their peak is at ``dbfs``; silence stays, and so does all without one."""
    peak = float(np.abs(x).max()) if len(x) else 0.0
    return x if dbfs is None or peak <= 1e-9 else np.clip(x * (10 ** (dbfs / 20) / peak), -1, 1).astype(np.float32)


def source_key(recordings: DataFrame, rate: int, salted: bool, level_dbfs: float | None) -> DataFrame:
    """The recordings with ``source_key``: what decides how one is decoded, which is its content, the
    settings, and of its metadata the channel map and, where it counts, the call's id."""
    m = F.col("metadata")
    said = F.to_json(F.struct(F.lit(rate).alias("rate"), F.lit(level_dbfs).cast("double").alias("level"), m["channel_map"].alias("map"), (m["call_id"] if salted else F.lit(None).cast("string")).alias("call")))
    return recordings.withColumn("source_key", F.sha2(F.concat(F.sha2("content", 256), said), 256))


def decode(recordings: DataFrame, rate: int = 16000, salted: bool = False, level_dbfs: float | None = None) -> DataFrame:
    """Each recording decoded once: mono, and the isolated channels where the metadata's map names
    ones that exist and there are two or more. What cannot be decoded gives ``error`` and no samples.

    ``recordings`` has ``source_path``, ``content`` and ``metadata``; anti-join it with what is
    decoded already before calling this.
    """
    ship(recordings.sparkSession)

    def one(path: str, content: bytes, call: str | None, a: float | None, c: float | None) -> tuple:
        sha = hashlib.sha256(content).hexdigest()
        try:
            x, native = read_wav(content)
            f = x.astype(np.float32) / 32768
            n = f.shape[1]
            # each track is brought to the level by its own peak, and the mix before it is named
            mono = at_peak(resample(f.mean(1), native, rate), level_dbfs)
            side = [at_peak(resample(f[:, int(k)], native, rate), level_dbfs) if n >= 2 and k is not None and k == k and 0 <= k < n else None for k in (a, c)]
            return path, identity(mono, call if salted else None), sha, rate, len(x) / native, n, mono, *side, None
        except Exception as e:  # a bad file is a row with an error
            return path, None, sha, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(*r) for r in pdf.itertuples(index=False)], columns=[f.split()[0] for f in DECODED.split(", ")])

    m = F.col("metadata")
    rows = recordings.select("source_path", "content", m["call_id"].alias("call"), m["channel_map"]["agent_channel"].alias("agent"), m["channel_map"]["caller_channel"].alias("caller"))
    return rows.mapInPandas(run, DECODED)


def gateway_events(clips: DataFrame) -> DataFrame:
    """``events(clip_id, seq, kind, t_s, payload)`` of clips with metadata."""
    rows = clips.select("clip_id", F.posexplode("metadata.events").alias("seq", "e"))
    return rows.select("clip_id", "seq", F.col("e.kind").alias("kind"), F.col("e.t_s").alias("t_s"), F.col("e.payload").alias("payload"))


def write_wav(channels: list[np.ndarray], rate: int) -> bytes:
    """16-bit PCM of several channels, the shorter padded, with a second of silence at the end."""
    n = max(map(len, channels), default=0) + rate
    x = np.zeros((n, len(channels)))
    for k, c in enumerate(channels):
        x[: len(c), k] = c
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
