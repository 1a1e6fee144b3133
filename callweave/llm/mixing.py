"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source are put in a random order by a hash and cut into blocks. The quotas of the
sources, in blocks, are split between the two halves of the output shards by a multivariate
hypergeometric draw, and so on down to single shards: each shard's composition is that of a draw
without replacement, and the parts add up to the quotas exactly. A draw is seeded by its place in
the tree, so each shard finds its own part in log2(shards) steps without the others. A shard's rows
are then shuffled within the shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, without

#: Share of a source without a given weight: its count to this power.
TEMPER = 0.8
#: Smallest sources that hold less than this share of all rows together do not set the default
#: mixture's size, and it holds at least that share of all rows.
SMALL, LEAST = 0.01, 0.5
BLOCK = 64
SHARD_BLOCKS = 64
#: Rows of a source that one task puts in order, about.
BUCKET = 1024
#: Blocks of a mixture, at most; beyond it blocks are made larger.
DRAW_BLOCKS = 500_000_000
SEED = 17


def target_weights(counts: dict, temper: float = TEMPER) -> dict:
    """Weights in proportion to the counts raised to ``temper``: below 1 damps large sources."""
    return {s: n**temper for s, n in counts.items()}


def quotas(counts: dict, weights: dict) -> dict:
    """Rows of each source in the largest mixture of these weights that repeats no row.

    Sources without a weight, or with one of 0 or less, get 0. Remainders go to the largest
    fractions, ties to the earlier name.
    """
    w = {s: float(weights.get(s, 0)) for s, n in counts.items() if n > 0 and float(weights.get(s, 0)) > 0}
    out = dict.fromkeys(counts, 0)
    if not w:
        return out
    norm = math.fsum(w.values())
    total = math.floor(min(counts[s] * norm / w[s] for s in w) + 1e-9)
    exact = {s: min(counts[s], total * w[s] / norm) for s in w}
    out |= {s: math.floor(x + 1e-9) for s, x in exact.items()}
    left = total - sum(out.values())
    for s in sorted(w, key=lambda s: (out[s] - exact[s], str(s))):
        if left > 0 and out[s] < counts[s]:
            out[s] += 1
            left -= 1
    return out


def filled(counts: dict, weights: dict) -> dict:
    """Rows of each source in a mixture whose size small sources don't set.

    The source that sets the size gives all its rows, larger ones follow by ``quotas``, and those
    that are short of their quota give all they have. It is the one that is shortest for its weight
    of those with which the shorter ones hold ``SMALL`` of all rows, or a less short one until the
    mixture holds ``LEAST`` of all rows.
    """
    order = sorted((s for s in counts if counts[s] > 0), key=lambda s: (counts[s] / weights[s], s is None, str(s)))
    every, short = sum(counts.values()), 0
    for k, s in enumerate(order):
        out = {t: counts[t] for t in order[:k]} | quotas({t: counts[t] for t in order[k:]}, weights)
        short += counts[s]
        if short >= SMALL * every and sum(out.values()) >= LEAST * every:
            return dict.fromkeys(counts, 0) | out
    return dict(counts)


def capacity(blocks: int, shards: int, lo: int, hi: int) -> int:
    """Blocks of shards lo to hi - 1 when they differ by one at most."""
    upto = lambda k: k * (blocks // shards) + min(k, blocks % shards)
    return upto(hi) - upto(lo)


def shard_part(shard: int, blocks: np.ndarray, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each source, the first block and the number of blocks of one shard: a walk down the tree."""
    total = int(blocks.sum())
    lo, hi, count, first = 0, shards, blocks.astype(np.int64).copy(), np.zeros(len(blocks), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi])
        left = draw.multivariate_hypergeometric(count, capacity(total, shards, lo, mid), method="marginals")
        if shard < mid:
            hi, count = mid, left
        else:
            lo, first, count = mid, first + left, count - left
    return first, count


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of all columns that can be hashed, as 63 bits."""
    kinds = [c for c, k in df.dtypes if "map<" not in k and "variant" not in k]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kinds]), 1)


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", temper: float = TEMPER, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """Draw a mixture of the sources and lay it out in shards.

    Returns the chosen rows with all their columns and ``shard`` and ``shard_pos`` (its place in
    the shard, from 0); columns of these names in the input are replaced, others of any name are
    carried. ``weights`` maps source to weight, in any unit; the mixture is the largest that keeps
    them without repeating a row. By default they follow ``target_weights`` and the sizes
    ``filled``. Rows with a null source form a source of their own, whose weight is that of the key
    None. Rows equal in all columns are distinct rows, in any order among themselves. Null, empty
    and long texts are carried unchanged. An empty table gives an empty result. The sources' counts,
    one row for each source, are the only thing collected.
    """
    docs = without(docs, "shard", "shard_pos")
    given = docs.columns
    spark = docs.sparkSession
    source = given.index(source_col)
    docs = docs.toDF(*(f"c{k}" for k in range(len(given))))  # so that no name clashes
    src = F.col(f"c{source}")
    counts = {r[0]: r[1] for r in docs.groupBy(src.alias("s")).count().collect()}
    names = sorted(counts, key=lambda s: (s is None, str(s)))
    quota = filled(counts, target_weights(counts, temper)) if weights is None else quotas(counts, weights)
    # a draw takes less than 1e9 blocks in all
    block *= max(1, -(-sum(quota.values()) // (block * DRAW_BLOCKS)))
    blocks = np.array([-(-quota[s] // block) for s in names], np.int64)
    total = int(blocks.sum())
    if not total:
        return docs.toDF(*given).where(F.lit(False)).withColumns({"shard": F.lit(0), "shard_pos": F.lit(0)})
    shards = max(1, -(-total // shard_blocks))
    bits = max(0, math.ceil(math.log2(max(counts.values()) / bucket)))

    def walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for shard in batch.column(0).to_pylist():
            first, n = shard_part(shard, blocks, shards, seed)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), shard), pa.int32()), pa.array(first[used]), pa.array(n[used])], names=["k", "at", "first", "n"])

    parts = map_arrow(spark.range(0, shards), walk, "k int, at int, first long, n long")
    placed = parts.select("k", "at", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"))

    # a row for each source, as they were counted
    limits = F.broadcast(spark.createDataFrame([(s, i, quota[s]) for i, s in enumerate(names)], f"s {docs.schema[source].dataType.simpleString()}, k int, quota long"))
    keyed = docs.withColumn("h", row_hash(docs, seed)).join(limits, src.eqNullSafe(F.col("s"))).drop("s", "quota")
    keyed = keyed.withColumn("bucket", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("long"))

    # for each bucket of a source: the rank of its first row, and the shards of the blocks that it touches
    sizes = keyed.groupBy("k", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).join(limits.select("k", "quota"), "k").where(F.col("start") < F.col("quota"))
    size = F.lit(block).cast("long")
    div = lambda a, b: F.floor(a / b).cast("long")
    touched = spans.withColumn("block", F.explode(F.sequence(div(F.col("start"), size), div(F.least(F.col("start") + F.col("size"), F.col("quota")) - 1, size))))
    spans = touched.join(placed, ["k", "block"]).groupBy("k", "bucket").agg(F.first("start").alias("start"), F.first("quota").alias("quota"), F.array_sort(F.collect_list(F.struct("block", "at"))).alias("blocks"))

    order = Window.partitionBy("k", "bucket").orderBy("h")
    ranked = keyed.withColumn("row", F.row_number().over(order)).join(spans, ["k", "bucket"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("row") - 1).where(F.col("rank") < F.col("quota"))
    at = (div(F.col("rank"), size) - F.col("blocks")[0]["block"]).cast("int")
    chosen = ranked.withColumn("shard", F.get("blocks", at)["at"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "k", "rank")
    return chosen.withColumn("shard_pos", F.row_number().over(shuffled) - 1).select(*docs.columns, "shard", "shard_pos").toDF(*given, "shard", "shard_pos")


def laid_out(mixture: DataFrame) -> DataFrame:
    """The mixture's rows by shard and in the shard's order. ``mix`` leaves each shard in one
    partition, so this sorts and moves nothing."""
    return mixture.sortWithinPartitions("shard", "shard_pos")
