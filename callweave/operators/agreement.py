"""Agreement of a judge with people, on scores from 1 to 5. Sums only: one pass, no collected pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR = 0.6
NAN = float("nan")


def _weighted(n: Column | None) -> tuple[Column, Callable[[Column], Column]]:
    """The number of pairs, and a sum over them, when each row stands for ``n`` pairs."""
    return (F.count("*"), F.sum) if n is None else (F.coalesce(F.sum(n), F.lit(0)), lambda x: F.sum(n * x))


def kappa(h: Column, j: Column, n: Column | None = None) -> Column:
    """Quadratic-weighted kappa by sums: NaN without pairs; where chance leaves no room, 1 for equal
    scores and else 0."""
    count, total = _weighted(n)
    seen = total((h - j) * (h - j))
    chance = total(h * h) + total(j * j) - F.try_divide(2.0 * total(h) * total(j), count)
    return F.when(count == 0, NAN).when(F.abs(chance) < 1e-9, F.when(seen == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(seen, chance))


def pearson(x: Column, y: Column, n: Column | None = None) -> Column:
    """Correlation from sums; NaN below two pairs or without spread."""
    count, total = _weighted(n)
    sx, sy = total(x), total(y)
    cov = count * total(x * y) - sx * sy
    vx, vy = count * total(x * x) - sx * sx, count * total(y * y) - sy * sy
    return F.when((count < 2) | (vx <= 1e-9) | (vy <= 1e-9), NAN).otherwise(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))


def average_rank(value: str, key: str, n: str) -> Column:
    """Rank from 1, ties sharing the mean of their places, when each row stands for ``n``."""
    upto = F.sum(n).over(Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return upto - (F.sum(n).over(Window.partitionBy(key, value)) - 1) / 2


def calibration(pairs: DataFrame, bar: float = BAR) -> DataFrame:
    """``n``, ``kappa``, ``pearson``, ``spearman``, ``mae`` and ``recommend_gate`` of each dimension of
    ``pairs(dimension, human, judge)``. Equal pairs are counted first, so that ranks are found among
    the few pairs of scores that there are."""
    d = lambda c: F.col(c).cast("double")
    few = pairs.groupBy("dimension", "human", "judge").agg(F.count("*").alias("n"))
    ranked = few.withColumns({"rh": average_rank("human", "dimension", "n"), "rj": average_rank("judge", "dimension", "n")})
    n = F.col("n")
    mae = F.sum(n * F.abs(d("human") - d("judge"))) / F.sum(n)
    out = ranked.groupBy("dimension").agg(F.sum("n").alias("pairs"), kappa(d("human"), d("judge"), n).alias("kappa"), pearson(d("human"), d("judge"), n).alias("pearson"), pearson(d("rh"), d("rj"), n).alias("spearman"), mae.alias("mae"))
    return out.withColumnRenamed("pairs", "n").withColumn("recommend_gate", ~F.isnan("kappa") & (F.col("kappa") >= bar))


def macro_kappa(calibrated: DataFrame) -> DataFrame:
    return calibrated.where(~F.isnan("kappa")).agg(F.avg("kappa").alias("macro_kappa"), F.count("*").alias("dimensions"))


def golden(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Human labels from raw ``clip_id``, ``dimension``, ``human_score`` and ``row_no``: trimmed,
    dimension in lower case, score rounded half to even and from 1 to 5; comments, blanks, unknown
    dimensions and bad numbers go; of several the last stays."""
    clip, dim = F.trim("clip_id"), F.lower(F.trim("dimension"))
    number = F.bround(F.trim("human_score").try_cast("double"))
    score = F.when(number.between(1, 5), number.cast("int"))  # NaN and what no integer holds are in no range
    ok = rows.select(clip.alias("clip_id"), dim.alias("dimension"), score.alias("human"), "row_no").where((F.col("clip_id") != "") & ~F.col("clip_id").startswith("#") & F.col("dimension").isin(dimensions) & F.col("human").between(1, 5))
    return ok.groupBy("clip_id", "dimension").agg(F.max_by("human", "row_no").alias("human"))


def resolve(keys: DataFrame, clips: DataFrame) -> DataFrame:
    """``key`` with the clip it means: of equal id, else of that file name or stem, else the id it
    begins; within a tier the first by ``seq``. Labels are few and written by people, so each tier
    is a join of its own on an equal value, and only the prefixes compare ranges."""
    name = F.substring_index("source_path", "/", -1)
    c = clips.select("clip_id", "seq", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    tier = lambda rows, n: rows.select("key", "clip_id", "seq", F.lit(n).alias("tier"))
    found = tier(keys.join(c, F.col("key") == F.col("clip_id")), 1).unionByName(tier(keys.join(c, F.col("key") == F.col("name")), 2)).unionByName(tier(keys.join(c, F.col("key") == F.col("stem")), 2))
    prefix = keys.where("key <> ''").withColumn("__p", F.left("key", F.least(F.length("key"), F.lit(4))))
    exact = prefix.join(c.withColumn("__p", F.left("clip_id", F.lit(4))), "__p").where(F.col("clip_id").startswith(F.col("key")) & (F.length("key") >= 4))
    short = prefix.where("length(key) < 4").join(c, F.col("clip_id").startswith(F.col("key")))
    every = found.unionByName(tier(exact, 3)).unionByName(tier(short, 3))
    best = Window.partitionBy("key").orderBy("tier", "seq")
    return every.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("key", "clip_id", "tier")
