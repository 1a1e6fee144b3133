"""Sample arrays: windows, silence, levels, mixing; what columns cannot do is vectorised numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SILENT = 1e-4


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v) / F.size(x))).otherwise(0.0)


def silent(x: Column) -> Column:
    """No samples, or hardly any energy."""
    return (F.size(x) <= 0) | (rms(x) < SILENT)


def windows(signals: DataFrame, size: int, least: int, col: str = "x") -> DataFrame:
    """Fixed windows of ``size`` samples, numbered from 0. A signal no longer than that is one window;
    a last window under ``least`` goes, unless it is the only one."""
    n = F.size(col)
    start = F.posexplode(F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array(F.lit(0))))
    rest = [c for c in signals.columns if c != col]
    rows = signals.where(n > 0).select(*rest, col, start.alias("window", "__at")).withColumn("__w", F.slice(col, F.col("__at") + 1, F.lit(size)))
    return rows.where((F.size("__w") >= least) | (F.col("window") == 0)).select(*rest, "window", F.col("__w").alias(col))


def aggregate_windows(scored: DataFrame, how: str = "median") -> DataFrame:
    """Of each clip and metric, the median or mean of its windows' real values."""
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    return scored.groupBy("clip_id", "metric").agg((F.median(v) if how == "median" else F.avg(v)).alias("value"))


def peak_normalize(x: Column, dbfs: float) -> Column:
    """Scaled so that the peak is at ``dbfs``, clipped to 1; silence stays."""
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    gain = F.lit(10 ** (dbfs / 20)) / peak
    return F.when(silent(x), x).otherwise(F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * gain))))


def mix(a: Column, b: Column) -> Column:
    """The saturated sum of two 16-bit signals; the shorter one is followed by silence."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))))


def loop(x: Column, at: Column, n: int) -> Column:
    """``n`` samples of an endless repetition of ``x`` from ``at``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, F.pmod(at + i, F.size(x))))


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on a grid that leaves the end out."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * (len(x) / n), np.arange(len(x)), x).astype(np.float32)


def resampled(x: Column, rate: int, to: int) -> Column:
    """``resample`` of a column of samples."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else resample(np.asarray(v), rate, to)), "array<float>")(x)


def frame_levels(pcm: Column) -> Column:
    """Root mean square of 16-bit samples after they went through mu-law, full scale being 1."""
    level = lambda v: float(np.sqrt(np.mean((mulaw_decode(mulaw_encode(np.asarray(v, np.int32))) / 32768.0) ** 2))) if v is not None and len(v) else 0.0
    return F.pandas_udf(lambda s: s.map(level), "double")(pcm)


def mulaw_encode(x: np.ndarray) -> np.ndarray:
    """G.711 bytes of 16-bit samples."""
    v = np.clip(x.astype(np.int32), -32635, 32635)
    sign = np.where(v < 0, 0x80, 0)
    v = np.abs(v) + 132
    exponent = np.floor(np.log2(v)).astype(np.int32) - 7
    mantissa = (v >> (exponent + 3)) & 0x0F
    return (~(sign | exponent << 4 | mantissa) & 0xFF).astype(np.uint8)


def _expand() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    v = (((u & 0x0F) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -v, v).astype(np.int16)


MULAW = _expand()


def mulaw_decode(b: np.ndarray) -> np.ndarray:
    return MULAW[b]


def bed(parts: list, rate: int = 16000, seconds: float = 30.0, gain_db: float = -15.0) -> np.ndarray | None:
    """Background babble of 5 s or more at 8 kHz: the parts in turn with pauses of 0.4 s, and from 1.5 s
    again, from the second on, at 0.8 with pauses of 0.7 s; brought to peak level and then to the
    gain. None without parts."""
    parts = [np.asarray(p, np.float32) for p in parts if p is not None and len(p)]
    if not parts:
        return None
    x = np.zeros(int(max(5.0, seconds) * rate), np.float32)
    for k, begin, loud, pause in ((0, 0.0, 1.0, 0.4), (1, 1.5, 0.8, 0.7)):
        at = int(begin * rate)
        while at < len(x):
            p = parts[k % len(parts)][: len(x) - at]
            x[at : at + len(p)] += np.float32(loud) * p
            at, k = at + len(p) + int(pause * rate), k + 1
    peak = float(np.abs(x).max()) or 1.0
    return (np.clip(resample(x / peak * 10 ** (gain_db / 20), rate, 8000), -1, 1) * 32767).astype(np.int16)


def tone(seconds: float, pitch: float = 150.0, seed: int = 0, rate: int = 16000) -> np.ndarray:
    """A hum of three harmonics that swells three times a second, its pitch shifted a little by the
    seed: speech for the measures of this package, for calls without a voice."""
    t = np.arange(int(rate * max(0.2, seconds))) / rate
    f = pitch * (1 + 0.02 * np.random.default_rng(seed).standard_normal())
    hum = sum(np.sin(2 * np.pi * f * k * t) / k for k in (1, 2, 3))
    return (0.12 * hum * (0.5 + 0.5 * np.sin(6 * np.pi * t))).astype(np.float32)


#: Samples of a frame of voice activity.
HOP = 256


def voiced(x: np.ndarray, rate: int = 16000, threshold: float = 0.5) -> np.ndarray:
    """Whether each whole frame of ``HOP`` samples has energy: a root mean square of a fiftieth of the
    threshold. Stands where a model of voice activity would be plugged in."""
    frames = np.asarray(x[: len(x) // HOP * HOP], np.float64).reshape(-1, HOP)
    return np.sqrt((frames * frames).mean(1)) >= 0.02 * threshold
