"""SimHash near-duplicates through Golay-code fuzzy hashing.

A text's distinct words vote on 276 bits: 12 segments of 23. The binary Golay code of length 23 is
perfect: each segment lies within 3 bits of exactly one of 4,096 codewords. A segment is decoded
together with its 23 neighbours at one bit, which gives up to 6 codeword indices; two segments that
differ in 2 bits or fewer always share one. A search key is one index of a segment with raw bits of
another. By the pigeonhole principle few differing bits leave segments with so few errors; texts
that share a key are compared by all their bits.

These keys find most groups, but not all pairs within ``MAX_BITS``. A second pass finds the links
between groups that they leave out, all of them. It cuts the bits into a few segments with so many
errors each that near texts stay within them in one segment at least. The bits of a segment with ``d - 1``
errors are points of the space of ``d`` binary dimensions: some vector but 0 is orthogonal to any
``d - 1`` points, so near texts agree in all bits that are not orthogonal to one of the 2**d - 1
vectors. These bits are the keys, by which every two tiles of fingerprints are compared.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import durable, fresh, map_arrow, only

SEGMENTS, SEGMENT_BITS = 12, 23
BITS = SEGMENTS * SEGMENT_BITS
#: Texts are near-duplicates when they differ in at most this many of the 276 bits.
MAX_BITS = 40
#: The decoded segment and, for its key, the segment that gives raw bits, by distance around the ring.
STEPS = (1, 4)
RAW_BITS = 16
#: Texts of a key that one task compares, about. A key that has far more in a sample of one in
#: ``THIN`` is cut into parts, and all pairs of parts are compared.
PART, THIN = 2048, 64
#: Such keys are sent to all tasks up to this number.
BROADCAST_ROWS = 1 << 20
#: Fingerprints of a tile of the second pass, about; fewer are spread over up to ``SPREAD`` tiles of
#: ``LEAST_TILE`` or more. They change the work, not the result.
TILE, LEAST_TILE, SPREAD = 1 << 19, 1 << 14, 3
#: Bits of a key at most (fewer in small tiles), and dimensions of a segment.
KEY_BITS, DIMENSIONS = 20, 7
#: Pairs compared at once and pairs of groups held before they are joined; a fingerprint that meets
#: more than ``MANY`` passes over those of its own group.
AT_ONCE, HELD, MANY = 1 << 16, 1 << 20, 256
WORDS = re.compile(r"\w+")
ROWS = 1 << 16
_TABLES: dict[str, np.ndarray] = {}


def golay_table() -> np.ndarray:
    """The index of the nearest codeword for each of the 2**23 words."""
    if "golay" not in _TABLES:
        codes = np.zeros(4096, np.int64)
        for m in range(4096):
            r = m << 11
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= 0xC75 << (bit - 11)
            codes[m] = m << 11 | r
        table = np.zeros(1 << 23, np.uint16)
        bit = [1 << i for i in range(23)]
        errors = [0, *bit] + [a | b for i, a in enumerate(bit) for b in bit[:i]] + [a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]]
        index = np.arange(4096, dtype=np.uint16)
        for e in errors:
            table[codes ^ e] = index
        _TABLES["golay"] = table
    return _TABLES["golay"]


def votes_table() -> np.ndarray:
    """A row of +1 and -1 for each hash of a word."""
    if "votes" not in _TABLES:
        bits = np.random.default_rng(23).integers(0, 2, (ROWS, BITS), np.int8)
        _TABLES["votes"] = bits * np.int8(2) - np.int8(1)
    return _TABLES["votes"]


def fingerprint(text: str) -> np.ndarray | None:
    """The segments of a text; None without any sign."""
    if not text:
        return None
    low = text.lower()
    words = set(WORDS.findall(low)) or {low}
    rows = [zlib.crc32(w.encode("utf-8", "surrogatepass")) & (ROWS - 1) for w in words]
    total = votes_table()[rows].sum(0, dtype=np.int32)
    return (total > 0).reshape(SEGMENTS, SEGMENT_BITS) @ (1 << np.arange(SEGMENT_BITS))


def pack(segments: np.ndarray) -> np.ndarray:
    """Two segments to a 64-bit number."""
    return segments[..., 0::2].astype(np.int64) << 23 | segments[..., 1::2]


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((*packed.shape[:-1], SEGMENTS), np.int64)
    out[..., 0::2], out[..., 1::2] = packed >> 23, packed & ((1 << 23) - 1)
    return out


def search_keys(segments: np.ndarray, steps: tuple = STEPS, raw_bits: int = RAW_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The row and the key of every search key of several fingerprints."""
    table = golay_table()
    around = segments[:, :, None] ^ np.concatenate([[0], 1 << np.arange(SEGMENT_BITS)])
    index = np.sort(table[around], axis=2)
    fresh = np.ones(index.shape, bool)
    fresh[:, :, 1:] = index[:, :, 1:] != index[:, :, :-1]
    row, seg, k = np.nonzero(fresh)
    code = index[row, seg, k].astype(np.int64)
    rows, keys = [], []
    for n, step in enumerate(steps):
        raw = segments[row, (seg + step) % SEGMENTS] & ((1 << raw_bits) - 1)
        rows.append(row)
        keys.append(((n * SEGMENTS + seg).astype(np.int64) << 40) | (raw << 12) | code)
    return np.concatenate(rows), np.concatenate(keys)


def links(ids: np.ndarray, packed: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the members of a bucket whose trees are its components under the distance.

    Each member is compared with all that no tree has reached yet, so a bucket of copies costs
    little more than its size and no pair within the distance is missed.
    """
    left = np.argsort(ids, kind="stable")
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(packed[left] ^ packed[at]).sum(1) <= max_bits
            found = left[near]
            a.append(np.full(len(found), ids[at]))
            b.append(ids[found])
            queue.extend(found.tolist())
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def dense(packed: np.ndarray) -> list[np.ndarray]:
    """The bits of packed fingerprints in five words; unsigned, as of a signed number ``bitwise_count``
    takes the absolute value."""
    w = packed.astype(np.uint64).T
    n = {k: np.uint64(k) for k in (8, 10, 18, 26, 28, 36, 38, 46, 56)}
    return [w[0] | w[1] << n[46], w[1] >> n[18] | w[2] << n[28], w[2] >> n[36] | w[3] << n[10] | w[4] << n[56], w[4] >> n[8] | w[5] << n[38], w[5] >> n[26]]


def points(bits: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A point for each bit of a segment, and for each vector which bits are not orthogonal to it.

    Of many random choices that which leaves the keys the most bits; any choice is right.
    """
    if (bits, dim) not in _TABLES:
        rng = np.random.default_rng(41)
        vectors = np.arange(1, 1 << dim)
        best = None
        for _ in range(50):
            chosen = np.resize(rng.permutation(vectors), bits)
            kept = (np.bitwise_count(vectors[:, None] & chosen) & 1).astype(bool)
            met = (0.5 ** kept.sum(1)).sum()
            if best is None or met < best[0]:
                best = met, chosen, kept
        _TABLES[bits, dim] = best[1:]
    return _TABLES[bits, dim]


def layout(max_bits: int, a: int, b: int, width: int) -> list[tuple[np.ndarray, int]]:
    """The bits and dimensions of each segment, which are more than ``max_bits`` in all.

    The number of segments is that of least work for tiles of ``a`` and ``b`` fingerprints, about.
    """
    best = None
    least = -(-(max_bits + 1) // DIMENSIONS)
    for n in range(least, least + 9):
        dims = [len(x) for x in np.array_split(np.arange(max_bits + 1), n)]
        segs = [(seg, d) for seg, d in zip(np.array_split(np.arange(BITS), n), dims, strict=True) if d]
        kept = np.concatenate([points(len(seg), d)[1].sum(1) for seg, d in segs])
        work = len(kept) * (a + b) * 80 + a * b * (0.51 ** np.minimum(kept, width)).sum() * 70
        if best is None or work < best[0]:
            best = work, segs
    return best[1]


def cover_keys(words: list[np.ndarray], segs: list[tuple[np.ndarray, int]], width: int) -> Iterator[np.ndarray]:
    """Keys of ``width`` bits or fewer, one array each; near fingerprints share one at least."""
    for seg, dim in segs:
        kept = points(len(seg), dim)[1]
        chunks = np.array_split(np.arange(len(seg)), max(1, -(-len(seg) // 13)))
        values = []
        for chunk in chunks:
            value = np.zeros(len(words[0]), np.uint16)
            for k, b in enumerate(seg[chunk].tolist()):
                value |= (words[b >> 6] >> np.uint64(b & 63) & np.uint64(1)).astype(np.uint16) << np.uint16(k)
            values.append(value)
        for use in kept:
            key, at = np.zeros(len(words[0]), np.uint32), 0
            for chunk, value in zip(chunks, values, strict=True):
                of = np.zeros(1 << len(chunk), np.uint32)
                each = np.arange(1 << len(chunk), dtype=np.uint32)
                for k in np.flatnonzero(use[chunk]).tolist():
                    if at < width:
                        of |= (each >> np.uint32(k) & np.uint32(1)) << np.uint32(at)
                        at += 1
                key |= of[value]
            yield key


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, which gives each node the least of its group, after the edges ``a``, ``b``."""
    while True:
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            return parent
        parent[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def bridges(names: list[np.ndarray], packed: list[np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the groups of two tiles wherever a member of each is within the distance.

    ``names`` has the group of each fingerprint of either tile, which may be the same. A pair of one
    group is left alone; groups that are found to be linked count as one from then on, so the edges
    are a forest however many pairs there are.
    """
    known, node = np.unique(np.concatenate(names), return_inverse=True)
    parent = np.arange(len(known))
    x, y = np.split(node, [len(names[0])])
    left, right = (dense(p) for p in packed)
    width = min(KEY_BITS, max(len(x), len(y)).bit_length() + 1)
    segs = layout(max_bits, len(x), len(y), width)
    by = np.argsort(y, kind="stable")
    held, size = [], 0
    for p, q in zip(cover_keys(left, segs, width), cover_keys(right, segs, width), strict=True):
        # the right by key and group; numpy's stable sort of 16 bits is in linear time
        order = by[np.argsort(q[by].astype(np.uint16), kind="stable")]
        order = order[np.argsort((q[order] >> np.uint32(16)).astype(np.uint16), kind="stable")]
        start = np.zeros((1 << width) + 1, np.int32)
        np.cumsum(np.bincount(q, minlength=1 << width), out=start[1:])
        row = np.arange(len(p))
        begin, end = start[p], start[p + np.uint32(1)]
        many = end - begin > MANY
        if many.any():
            code = q[order].astype(np.int64) * len(known) + y[order]
            own = p[many].astype(np.int64) * len(known) + x[many]
            row = np.concatenate([row, row[many]])
            begin, end = np.concatenate([begin, np.searchsorted(code, own, "right")]), np.concatenate([end, end[many]])
            end[: len(p)][many] = np.searchsorted(code, own, "left")
        some = end > begin
        row, begin, end = row[some], begin[some], end[some]
        total = np.concatenate([[0], np.cumsum(end - begin, dtype=np.int64)])
        s, fresher = 0, False
        while s < len(row):
            e = max(s + 1, int(np.searchsorted(total, total[s] + AT_ONCE, "right")) - 1)
            count = total[s + 1 : e + 1] - total[s:e]
            i = np.repeat(row[s:e], count)
            j = order[np.arange(total[s], total[e]) + np.repeat(begin[s:e] - total[s:e], count)]
            d = np.bitwise_count(left[0][i] ^ right[0][j]).astype(np.uint16)
            for k in range(1, 5):
                d += np.bitwise_count(left[k][i] ^ right[k][j])
                near = np.flatnonzero(d <= max_bits)
                i, j, d = i[near], j[near], d[near]
            u, v = parent[x[i]], parent[y[j]]
            other = u != v
            if other.any():
                held.append(np.unique(u[other] * len(known) + v[other]))
                size += len(held[-1])
            if held and (size > HELD or e == len(row)):
                parent = join(parent, *np.divmod(np.concatenate(held), len(known)))
                held, size, fresher = [], 0, True
            s = e
        if fresher:
            x, y = parent[x], parent[y]
            by = np.argsort(y, kind="stable")
    moved = np.flatnonzero(parent != np.arange(len(known)))
    return known[moved], known[parent[moved]]


def missed(known: DataFrame, count: int, max_bits: int = MAX_BITS, tile: int = TILE, least: int = LEAST_TILE) -> DataFrame:
    """Edges ``a``, ``b`` between the groups ``root`` of ``known`` that have fingerprints ``fp`` within the distance.

    No pair is left out: every two tiles meet. ``count``, the rows, sets the number of tiles.
    """
    tiles = max(-(-count // tile), min(SPREAD, -(-count // least)), 1)

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packed = batch.column(1).flatten().to_numpy().reshape(-1, SEGMENTS // 2)
        body = np.column_stack([batch.column(0).to_numpy(), packed]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(body) % tiles], pa.int32()), pa.array([body], pa.binary())], names=["tile", "body"])

    def compare(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        held = {low: [], high: []}
        for t, body in zip(group.column("tile"), group.column("body"), strict=True):
            held[t.as_py()].append(body.as_buffer())
        sides = {t: np.concatenate([np.zeros((0, 1 + SEGMENTS // 2), np.int64), *(np.frombuffer(b, np.int64).reshape(-1, 1 + SEGMENTS // 2) for b in bodies)]) for t, bodies in held.items()}
        a, b = bridges([sides[t][:, 0] for t in (low, high)], [sides[t][:, 1:] for t in (low, high)], max_bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = map_arrow(known.select("root", "fp"), block, "tile int, body binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    paired = blocks.withColumn("other", other).select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "body")
    return paired.repartition(tiles * (tiles + 1), "low", "high").groupBy("low", "high").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """``id`` and ``root``, the least id of its component, of each end of the edges ``a``, ``b``.

    Alternates large and small stars until nothing changes; each round is cut from its lineage by a
    checkpoint. The rounds grow with the logarithm of a component's size, so ``limit`` is never
    reached; a RuntimeError there rather than a wrong result.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(limit):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = durable(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = now
    raise RuntimeError("components did not settle")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp``, six numbers, of each row with an id and a text that isn't empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, out = [], []
        for i, t in enumerate(batch.column(1)):
            fp = fingerprint(t.as_py())
            if fp is not None:
                keep.append(i)
                out.append(pack(fp))
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SEGMENTS // 2), pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), lists], names=["id", "fp"])

    rows = only(docs, id_col, text_col).where(F.col(f"`{id_col}`").isNotNull() & (F.col(f"`{text_col}`") != ""))
    return map_arrow(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, fp array<long>")


def buckets(keyed: DataFrame, keys_of: Callable[[DataFrame], DataFrame], heads: DataFrame) -> DataFrame:
    """``heads``, each a sorted set of fingerprints to be compared with one another.

    The sets are those of each key. A key with many heads, as a sample tells, gives the union of
    each two of its parts instead; a part holds the heads with the same lower bits, so that keys
    with the same heads have the same parts and each two are compared once.
    """
    thin = keys_of(heads.where(F.pmod(F.xxhash64("head"), F.lit(THIN)) == 0)).groupBy("key").agg((F.count("*") * THIN).alias("size"))
    large = durable(thin.where(F.col("size") > 4 * PART).select("key", F.expr(f"shiftleft(1, cast(ceil(log2(size / {PART})) as int))").alias("parts")))
    many = large.count()
    if many:
        keyed = keyed.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "key", "left").withColumn("part", F.pmod(F.xxhash64("head"), F.coalesce("parts", F.lit(1))))
    else:
        keyed = keyed.withColumns({"parts": F.lit(None).cast("int"), "part": F.lit(0)})
    sets = keyed.groupBy("key", "part").agg(F.array_sort(F.collect_set("head")).alias("heads"), F.first("parts").alias("parts"))
    one = sets.where("parts IS NULL AND size(heads) > 1").select("heads")
    if not many:
        return one.distinct()
    some = durable(sets.where("parts IS NOT NULL").select("key", F.xxhash64("heads", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "heads").alias("h2"), "heads"))
    name = some.select("key", F.struct("h1", "h2").alias("p"))
    two = name.join(name.toDF("key", "q"), "key").where("p < q").select("p", "q").distinct()
    body = some.select(F.struct("h1", "h2").alias("p"), "heads").dropDuplicates(["p"])
    lone = some.groupBy("key").agg(F.count("*").alias("n"), F.first("heads").alias("heads")).where("n = 1").select("heads")
    pairs = two.join(body, "p").join(body.toDF("q", "more"), "q").select(F.array_sort(F.array_union("heads", "more")).alias("heads"))
    return one.union(lone).distinct().union(pairs)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, steps: tuple = STEPS, raw_bits: int = RAW_BITS) -> DataFrame:
    """``id`` and ``root`` of every document in a group of near-duplicates of two or more.

    A group is a component of the relation "differs in ``max_bits`` bits or fewer", whole whatever
    the search keys find; its root is the least id. The order and number of a text's words play no part. Rows with a null id or text or an
    empty text are in no group; texts without words count as one word, long texts are read whole.
    Rows of one id are one document; where their texts differ it is in the group of the least root.
    Ids may be of any type that can be ordered. Other columns are not read. An empty table gives an
    empty result.
    """
    fp = durable(fingerprints(docs, id_col, text_col))
    # equal fingerprints are compared once, under a number that the checkpoint fixes
    equal = fp.groupBy("fp").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    heads = durable(equal.withColumn("head", F.monotonically_increasing_id()))
    # a head brings more than a hundred keys: few heads in a task
    count = heads.count()
    few = heads.repartition(max(1, count // 8192), "head").select("head", "fp")

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy()
        packed = batch.column(1).flatten().to_numpy().reshape(-1, SEGMENTS // 2)
        for at in range(0, len(ids), 4096):
            row, key = search_keys(unpack(packed[at : at + 4096]), steps, raw_bits)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + row]), pa.array(key)], names=["head", "key"])

    keys_of = lambda h: map_arrow(h, emit, "head long, key long")
    sets = buckets(keys_of(few), keys_of, few)
    sets = sets.select(F.xxhash64("heads", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "heads").alias("h2"), F.explode("heads").alias("head"))
    full = sets.join(heads.select("head", "fp"), "head").groupBy("h1", "h2").agg(F.collect_list(F.struct("head", "fp")).alias("members"))

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lists = batch.column(0)
        flat = lists.flatten()
        ids = flat.field("head").to_numpy()
        packed = flat.field("fp").flatten().to_numpy().reshape(-1, SEGMENTS // 2)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            x, y = links(ids[s:e], packed[s:e], max_bits)
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    near = map_arrow(full.select("members"), verify, "a long, b long").distinct()
    tree = components(near).toDF("head", "root")
    known = durable(heads.join(tree, "head", "left").withColumn("root", F.coalesce("root", "head")))
    rest = components(missed(known, count, max_bits)).toDF("root", "base")
    known = known.join(rest, "root", "left").withColumn("root", F.coalesce("base", "root")).drop("base")
    of = known.groupBy("root").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("root", F.col("least").alias("first"))
    found = fp.join(known.join(of, "root").select("fp", "first"), "fp")
    return found.groupBy("id").agg(F.min("first").alias("root"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``doc_id`` of each document to drop and ``kept_doc_id``, the one of its group that stays.

    Nulls, empty and long texts, repeated rows, clashing columns and empty tables as in ``groups``.
    """
    return groups(docs, id_col, text_col, **how).where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The documents with one of each group, its columns as they were.

    Rows in no group stay, those with a null id or a null or empty text among them, and so do all
    rows of the document that stays. Columns of any name are carried; an empty table gives an empty
    result.
    """
    (drop,) = fresh(docs, "__drop")
    gone = duplicates(docs, id_col, text_col, **how).select(F.col("doc_id").alias(drop))
    return docs.join(gone, docs[f"`{id_col}`"] == F.col(drop), "left_anti")
