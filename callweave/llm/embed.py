"""Near-duplicate vectors by PCA-ordered tiles.

Unit vectors are turned into their principal axes, so leading dimensions carry most of the product.
Recursive splits along the leading axes put them into blocks, and these into tiles. Two blocks or
tiles whose balls lie farther apart than the threshold allows are never compared, and two that lie
wholly within it are linked without a product. For others the product is accumulated a few
dimensions at a time; what the rest can still add is at most the product of the suffix norms, and
pairs that cannot reach the threshold are dropped as it grows.

The result holds a row for each vector, its class and its number of links, and not the pairs, of
which a group of copies has a square number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import durable, map_arrow, only
from callweave.llm.simhash import components

THRESHOLD = 0.9
#: Vectors in a block, which one task compares with another, and in a tile of it, about; dimensions
#: accumulated at a time.
BLOCK, TILE, STEP = 8192, 512, 16
#: Leading axes that blocks are split along.
AXES = 12
#: Regions of the first split, at most, and vectors that its borders are taken from (least by a hash).
REGIONS, SPLIT_SAMPLE = 1024, 20_000
#: Of so many vectors one helps to place the borders of blocks.
THIN = 256
#: Border tables are sent to all tasks up to this size.
BROADCAST_BYTES = 32 << 20
SLACK = 1e-6


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of lists of one length, each as a unit vector."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(v: str) -> Column:
    """Whether all numbers of a vector are finite and some not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def axes(moments: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the largest first, from the sum of outer products."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, np.argsort(-values, kind="stable")]


def second_moments(vectors: DataFrame) -> np.ndarray | None:
    """The sum of outer products of all unit vectors in the last column: one small matrix from each
    batch and length, added up in Spark. Different lengths are an error."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        width = batch.column(0).value_lengths().to_numpy()
        for d in np.unique(width).tolist():
            x = matrix(batch.column(0).take(pa.array(np.flatnonzero(width == d))))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([(x.T @ x).ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "m"])

    parts = map_arrow(vectors, run, "dim int, m array<double>").select("dim", F.posexplode("m").alias("i", "v"))
    rows = parts.groupBy("dim", "i").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return None
    dims = rows["dim"].unique()
    if len(dims) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(dims.tolist())}")
    return rows.sort_values("i")["v"].to_numpy().reshape(dims[0], dims[0])


def splits(x: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """A balanced binary tree of (axis, value), breadth first; each node splits its widest axis."""
    tree: list[tuple[int, float]] = []
    level = [x]
    while len(level) < parts:
        nxt = []
        for rows in level:
            if len(rows) < 2:
                tree.append((0, 0.0))
                nxt += [rows, rows[:0]]
                continue
            axis = int(rows.var(0).argmax())
            at = float(np.median(rows[:, axis]))
            tree.append((axis, at))
            nxt += [rows[rows[:, axis] < at], rows[rows[:, axis] >= at]]
        level = nxt
    return tree


def leaf(x: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf of each row under a tree of splits."""
    node = np.zeros(len(x), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] >= at[node])
    return node - len(axis)


def compare(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of rows with a product of the threshold or more, and the multiplications done."""
    suffix = lambda m: np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], 1)[:, ::-1], 0))
    sa, sb = suffix(a), suffix(b)
    dim = a.shape[1]
    done = min(step, dim)
    part = a[:, :done] @ b[:, :done].T
    work = part.size * done
    rest = sa[:, done, None] * sb[None, :, done] if done < dim else 0
    i, j = np.nonzero(part + rest >= threshold - SLACK)
    dot = part[i, j]
    while done < dim and len(i):
        more = min(done + step, dim)
        dot = dot + np.einsum("ij,ij->i", a[i, done:more], b[j, done:more])
        work += len(i) * (more - done)
        done = more
        ok = dot + (sa[i, done] * sb[j, done] if done < dim else 0) >= threshold - SLACK
        i, j, dot = i[ok], j[ok], dot[ok]
    ok = dot >= threshold
    return i[ok], j[ok], work


def join_up(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring labels, the least member of each component so far, up to date with new pairs. Only roots
    move, so that what hung on them follows."""
    while True:
        more = label[i] != label[j]
        if not more.any():
            return
        i, j = i[more], j[more]
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (label[label] != label).any():
            label[:] = label[label]


def tiles_of(x: np.ndarray, tile: int, lead: int) -> list[np.ndarray]:
    """The rows of each tile of a block."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= tile:
            out.append(rows)
            continue
        axis = int(x[rows, :lead].var(0).argmax())
        order = rows[np.argsort(x[rows, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(0)
    return center, float(np.sqrt(((x - center) ** 2).sum(1).max()))


def cross(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, threshold: float, tile: int, step: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of each row of two blocks to rows of the other, weighted, and the label of each: the
    least row that it is joined to. Without ``y`` the block is compared with itself."""
    same = y is None
    every = x if same else np.concatenate([x, y])
    weight = wx if same else np.concatenate([wx, wy])
    n = len(x)
    links, label = np.zeros(len(every), np.int64), np.arange(len(every))
    a = tiles_of(x, tile, lead)
    b = a if same else [n + t for t in tiles_of(y, tile, lead)]
    balls = {id(t): ball(every[t]) for t in (a if same else a + b)}
    reach = np.sqrt(2 - 2 * threshold)
    for p, s in enumerate(a):
        for t in b[p:] if same else b:
            (cs, rs), (ct, rt) = balls[id(s)], balls[id(t)]
            apart = float(np.sqrt(((cs - ct) ** 2).sum()))
            if apart - rs - rt > reach + SLACK:
                continue
            if apart + rs + rt <= reach - SLACK:
                links[s] += weight[t].sum()
                if s is t:
                    links[s] -= weight[s]
                else:
                    links[t] += weight[s].sum()
                join_up(label, np.concatenate([s, np.full(len(t), s[0])]), np.concatenate([np.full(len(s), t[0]), t]))
                continue
            i, j, _ = compare(every[s], every[t], threshold, step)
            if s is t:
                i, j = i[i < j], j[i < j]
            i, j = s[i], t[j]
            links += np.bincount(i, weight[j], len(every)).astype(np.int64) + np.bincount(j, weight[i], len(every)).astype(np.int64)
            new = label[i] != label[j]
            join_up(label, i[new], j[new])
    return links, label


def regions(boxes: list, lead: int, limit: float) -> list[tuple[int, int]]:
    """Pairs of regions that may hold vectors within the limit of each other, by their boxes."""
    s = np.array([r["s"] for r in boxes])
    lo, hi = (np.array([[r[f"{k}{i}"] for i in range(lead)] for r in boxes], float).reshape(-1, lead) for k in ("lo", "hi"))
    out: list[tuple[int, int]] = []
    for k in range(len(s)):
        gap = np.maximum(np.maximum(lo - hi[k], lo[k] - hi), 0)
        out += [(int(s[k]), int(t)) for t in s[(gap * gap).sum(1) <= limit]]
    return out


def classes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, tile: int = TILE, step: int = STEP) -> DataFrame:
    """``id``, ``class_id`` and ``links`` of each vector.

    Two rows are linked when the cosine of their vectors is ``threshold`` or more. ``links`` is the
    number of other rows that a row is linked to, and ``class_id`` the least id of all rows that
    links lead to; a row without links is its own class. The result is exact: every row is compared
    with every other unless a bound decides the pair.

    Rows with a null id or vector, an empty vector, a null, infinite or NaN number, or only zeros
    are left out. Repeated rows, and several vectors of one id, are rows like others: each has a row
    in the result. Vectors of different lengths are an error. Ids may be of any type that can be
    ordered. Other columns are not read; an empty table gives an empty result.
    """
    spark = table.sparkSession
    kind = table.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    src = only(table, id_col, vec_col).toDF("id", "v").where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("v", F.col("v").cast(f"array<{kind}>")).where(usable("v"))
    moments = second_moments(src.select("v"))
    if moments is None:
        return src.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    basis = axes(moments)
    dim = len(basis)
    lead = min(AXES, dim)
    limit = 2 - 2 * threshold + SLACK

    # equal vectors are compared once, under a number that the checkpoint fixes
    digest = lambda v: (F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"))
    equal = src.select("id", "v", *digest("v")).groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    heads = durable(equal.withColumn("h", F.monotonically_increasing_id()))
    rows = heads.count()

    # borders: regions from a bounded sample, blocks of each region from its share of a thin one
    sample = heads.orderBy(F.xxhash64("k1"), "k1").limit(SPLIT_SAMPLE).select("v").toArrow()
    wanted = max(1, -(-rows // block))
    parts = 1 << min(REGIONS.bit_length() - 1, max(0, int(np.ceil(np.log2(wanted / 64)))))
    tree = splits((matrix(sample.column(0).combine_chunks()) @ basis)[:, :lead], parts)
    axis, at = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y = (matrix(batch.column(1)) @ basis)[:, :lead]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf(y, axis, at)), pa.array(list(y), pa.list_(pa.float64()))], names=["h", "s", "y"])

    seen = map_arrow(heads.select("h", "v"), place, "h long, s long, y array<double>")
    sizes = seen.groupBy("s").agg(F.count("*").alias("size"))
    thin = seen.where(F.pmod(F.xxhash64("h"), F.lit(THIN)) == 0).groupBy("s").agg(F.collect_list("y").alias("ys"))

    def grow(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [splits(np.array(ys or np.zeros((0, lead)), float).reshape(-1, lead), 1 << max(0, int(np.ceil(np.log2(n / block))))) for n, ys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t[0] for t in o] for o in out], pa.list_(pa.int64())), pa.array([[t[1] for t in o] for o in out], pa.list_(pa.float64()))], names=["s", "axis", "at"])

    trees = durable(map_arrow(sizes.join(thin, "s", "left"), grow, "s long, axis array<long>, at array<double>"))
    small = 32 * wanted <= BROADCAST_BYTES
    trees = F.broadcast(trees) if small else trees

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = batch.column("s").to_numpy()
        y = np.array(batch.column("y").to_pylist(), float).reshape(len(s), lead)
        out = np.zeros(len(s), np.int64)
        for k in np.unique(s).tolist():
            of = np.flatnonzero(s == k)
            a, t = batch.column("axis")[int(of[0])].values, batch.column("at")[int(of[0])].values
            out[of] = leaf(y[of], a.to_numpy(), t.to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("s"), pa.array(out)], names=["h", "s", "leaf"])

    settled = map_arrow(seen.join(trees, "s"), settle, "h long, s long, leaf long")
    held = settled.groupBy("s", "leaf").agg(F.count("*").alias("size"))
    # a leaf that holds more than two blocks, as ties do, is cut by a hash
    cut = F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / (2 * block)).cast("long"))
    placed = settled.join(F.broadcast(held) if small else held, ["s", "leaf"]).select("h", "s", F.xxhash64("s", "leaf", cut).alias("b"))
    full = placed.join(heads.select("h", "n", "v"), "h").groupBy("s", "b").agg(F.collect_list(F.struct("h", "n", "v")).alias("rows"))

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            flat = batch.column(2).slice(k, 1).flatten()
            h, n, v = flat.field("h").to_numpy(), flat.field("n").to_numpy(), flat.field("v")
            x = matrix(v) @ basis
            center, radius = ball(x)
            data = h.tobytes() + n.tobytes() + v.flatten().to_numpy().tobytes()
            values = [[int(h.min())], [int(n.sum())], [len(h)], [data], [center.tolist()], [radius], [x[:, :lead].min(0).tolist()], [x[:, :lead].max(0).tolist()]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=["s", "b", "one", "weight", "size", "data", "center", "radius", "lo", "hi"])

    blocks = durable(map_arrow(full, pack, "s long, b long, one long, weight long, size int, data binary, center array<double>, radius double, lo array<double>, hi array<double>"))
    bounds = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(lead)]
    meet = spark.createDataFrame(regions(blocks.groupBy("s").agg(*bounds).collect(), lead, limit), "s long, s2 long")

    # blocks of regions that meet: apart, wholly within reach of each other, or to be compared
    flat = blocks.select("s", "b", "one", "weight", "center", "radius")
    other = flat.toDF("s2", "b2", "one2", "weight2", "center2", "radius2")
    near = flat.join(F.broadcast(meet), "s").join(other, "s2").where("b <= b2")
    apart = F.sqrt(F.aggregate(F.zip_with("center", "center2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, d: t + d))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    near = near.withColumn("apart", apart).where(F.col("apart") - F.col("radius") - F.col("radius2") <= reach + SLACK)
    near = durable(near.select("b", "b2", "one", "one2", "weight", "weight2", (F.col("apart") + F.col("radius") + F.col("radius2") <= reach - SLACK).alias("whole")))
    load = blocks.select("b", "size", "data")
    pairs = near.where("NOT whole").select("b", "b2")
    both = pairs.join(load, "b").join(load.toDF("b2", "size2", "data2"), "b2").select("b", "b2", "size", "data", "size2", F.when(F.col("b") != F.col("b2"), F.col("data2")).alias("data2"))
    number = np.float32 if kind == "float" else np.float64

    def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(data, number, n * dim, 16 * n)
        x = matrix(pa.FixedSizeListArray.from_arrays(pa.array(v), dim)) @ basis
        return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), x

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            _, _, n, data, m, more = (batch.column(c)[k].as_py() for c in range(6))
            h, w, x = unpack(data, n)
            if more is None:
                links, label = cross(x, w, None, None, threshold, tile, step, lead)
            else:
                g, u, y = unpack(more, m)
                links, label = cross(x, w, y, u, threshold, tile, step, lead)
                h = np.concatenate([h, g])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(links[some]), pa.array(h[label[some]])], names=["h", "links", "to"])

    # few rows in a task, as each has two whole blocks
    spread = both.repartition(max(1, pairs.count() // 4), "b", "b2")
    found = durable(map_arrow(spread, run, "h long, links long, to long"))

    # of blocks wholly within reach, all rows count, and one row of a partner joins all
    whole = near.where("whole")
    sides = whole.select("b", F.struct("b2", F.col("one2").alias("to")).alias("by"), "weight2").union(whole.where("b <> b2").select("b2", F.struct("b", "one"), "weight"))
    sides = sides.groupBy("b").agg(F.min("by").alias("by"), F.sum("weight2").alias("weight"), F.max(F.col("by.b2") == F.col("b")).alias("own"))
    inside = blocks.select("b", "data", "size").join(sides, "b")

    def members(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, n, to, weight, own in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            h, w = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(weight - w if own else np.full(n, weight)), pa.array(np.full(n, to))], names=["h", "links", "to"])

    counted = found.union(map_arrow(inside.select("data", "size", "by.to", "weight", "own"), members, "h long, links long, to long"))
    edges = counted.select(F.col("h").alias("a"), F.col("to").alias("b")).union(whole.where("b <> b2").select("one", "one2"))
    root = components(edges.where("a <> b")).toDF("h", "root")
    total = counted.groupBy("h").agg(F.sum("links").alias("links"))
    known = heads.select("h", "least", "n", "k1", "k2").join(total, "h", "left").join(root, "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    named = known.join(least, "root").select("k1", "k2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return src.select("id", *digest("v")).join(named, ["k1", "k2"]).select("id", "class_id", "links")


#: The query over ``embeddings`` in SQL.
SQL = """
WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT k, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM x),
e AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.k <> b.k WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
r AS (SELECT k, k AS o FROM n UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.o),
c AS (SELECT r.k, min(n.vec_id) AS class_id FROM r JOIN n ON n.k = r.o GROUP BY r.k),
d AS (SELECT a AS k, count(*) AS links FROM e GROUP BY a)
SELECT n.vec_id, c.class_id, CAST(coalesce(d.links, 0) AS BIGINT) AS links FROM n JOIN c USING (k) LEFT JOIN d USING (k)
"""
