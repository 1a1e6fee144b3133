"""Substring deduplication by content-defined chunking.

A gear hash rolls over the text; a chunk ends where it falls under a threshold, and after each line
break. The cuts depend on the 16 signs before them alone, so an insertion moves no cut beyond its
neighbourhood. Chunks are compared by digest over the whole corpus. The first place of a chunk keeps
it. Elsewhere a run of repeated chunks is an anchor: it is followed outward in the first copy,
character by character, to the passage's true ends at words, and cut out when it has enough words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import durable, map_arrow, slices
from callweave.session import ship

#: Mean length of a chunk, in characters, without line breaks.
CHUNK = 40
WINDOW = 16
#: Words of a repeated passage that is cut out.
MIN_WORDS = 30
#: Places of one chunk that a task puts in order, about: a chunk that has more, as the documents of
#: one in ``THIN`` tell, is dealt to several tasks.
PLACES, THIN = 1 << 20, 64
#: Chunks with so many places are sent to all tasks up to this number.
BROADCAST_ROWS = 1 << 20
GAPS = " \n\t"
WORD = re.compile(f"[^{GAPS}]+")
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 4096, np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash at each place, over the last 16 code points, high half mixed in."""
    h = _GEAR[codes & np.uint32(4095)]
    width = 1
    while width < WINDOW:
        moved = h[:-width] << np.uint32(width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += moved
        width *= 2
    h ^= h >> np.uint32(16)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def cuts(text: str, chunk: int = CHUNK) -> np.ndarray:
    """Where chunks end, the text's end included."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    end = (gear(codes) < 65536 // chunk) | (codes == 10)
    end[-1] = True
    return np.flatnonzero(end) + 1


def renamed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with columns ``key`` and ``text``, ``tag``, 32 bits of a digest of the text, which is
    a row's key with the id, and the others as ``c0`` and so on, so that no name clashes."""
    other = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(other)]
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("key"), text.alias("text"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tag"), *rest)


def chunks(src: DataFrame, chunk: int) -> DataFrame:
    """``digest``, ``id``, ``place`` and ``pack`` of each chunk of ``renamed`` rows.

    A place is the tag of the row's text above the chunk's start. A pack is the chunk's size above
    its words and the most words that a repeat can hold before the chunk, and after it, when no
    neighbouring chunk repeats whole.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(1).to_pylist()
        tags = batch.column(2).to_numpy().astype(np.int64) << 32
        for a, b in slices(every):
            texts = every[a:b]
            size = np.array([len(t) for t in texts])
            stop = np.cumsum(size)
            begin = stop - size
            joined = "".join(texts)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            end = (gear(codes) < 65536 // chunk) | (codes == 10)
            # the first signs of a text see the text before: their cuts are found apart
            for s, n in zip(begin.tolist(), size.tolist(), strict=True):
                m = min(n, WINDOW)
                head = codes[s : s + m]
                end[s : s + m] = (gear(head) < 65536 // chunk) | (head == 10)
            end[stop - 1] = True
            at = np.flatnonzero(end) + 1
            first = np.concatenate([[0], at[:-1]])
            gap = (codes == 32) | (codes == 10) | (codes == 9)
            word = ~gap
            word[1:] &= gap[:-1]
            words = np.add.reduceat(word.astype(np.int64), first)
            doc = np.searchsorted(stop, first, side="right")
            # a cut whose window lies in a repeat is in both copies
            so_far = np.concatenate([[0], np.cumsum(word)])
            left = np.where(first > begin[doc], np.maximum(np.concatenate([[0], first[:-1]]) - WINDOW, begin[doc]), first)
            right = np.minimum(at[np.minimum(np.searchsorted(at, at + WINDOW), len(at) - 1)], stop[doc])
            before, after = np.minimum(so_far[first] - so_far[left] + 1, 1023), np.minimum(so_far[right] - so_far[at] + 1, 1023)
            pack = (at - first) << 32 | np.minimum(words, 4095) << 20 | before << 10 | after
            digest = xxhash.xxh3_64_intdigest
            digests = np.array([digest(joined[s:e].encode("utf-8", "surrogatepass")) for s, e in zip(first.tolist(), at.tolist(), strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests), batch.column(0).take(pa.array(a + doc)), pa.array(tags[a + doc] | (first - begin[doc])), pa.array(pack)], names=["digest", "id", "place", "pack"])

    rows = src.select("key", "text", "tag").where("key IS NOT NULL AND text <> ''")
    return map_arrow(rows, run, f"digest long, id {src.schema['key'].dataType.simpleString()}, place long, pack long")


def later_chunks(src: DataFrame, chunk: int) -> DataFrame:
    """``id``, ``place`` and ``pack`` of the chunks that have an earlier place, with it as ``first``
    and ``at``.

    The first place of a chunk is that of least id, then least place. Rows equal in id and text are
    one text; texts that share an id are told apart by their tags. Chunks move once, to be read in
    order of their digests; those of one chunk in very many places move to several tasks, and the
    least of what these find is first.
    """
    kind = src.schema["key"].dataType.simpleString()
    every = chunks(src, chunk)
    thin = chunks(src.where(F.pmod(F.xxhash64("key"), F.lit(THIN)) == 0), chunk).groupBy("digest").agg(F.count("*").alias("n"))
    large = durable(thin.where(F.col("n") * THIN >= PLACES).select("digest", F.ceil(F.col("n") * THIN / PLACES).cast("int").alias("parts")))
    many = large.count()
    if many:
        every = every.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "digest", "left").withColumn("part", F.pmod(F.xxhash64("id", "place"), F.col("parts")))
    else:
        every = every.withColumn("part", F.lit(None).cast("long"))
    ordered = every.repartition("digest", "part").sortWithinPartitions("digest", "part", "id", "place").select("digest", "part", "id", "place", "pack")
    ship(src.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # digest, part, and first place of the rows before
        for b in batches:
            if not b.num_rows:
                continue
            digest, place = b.column(0).to_numpy(), b.column(3).to_numpy()
            part = b.column(1).fill_null(-1).to_numpy()
            key = np.arange(b.num_rows)
            same = (digest[1:] == digest[:-1]) & (part[1:] == part[:-1])
            key[1:][same] = 0
            key = np.maximum.accumulate(key) + 1
            ids, places = b.column(2), place
            if last is not None and last[0] == (digest[0], part[0]):
                key[key == 1] = 0
                ids, places = pa.concat_arrays([last[1], ids]), np.concatenate([last[2], place])
            else:
                ids, places = pa.concat_arrays([ids.slice(0, 1), ids]), np.concatenate([place[:1], place])
            first, at = ids.take(pa.array(key)), places[key]
            keep = (at != place) | np.asarray(pc.not_equal(first, b.column(2))) | (part >= 0)
            last = ((digest[-1], part[-1]), first.slice(len(first) - 1), at[-1:])
            which = pa.array(np.flatnonzero(keep))
            if len(which):
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(which) for k in (0, 1, 2, 3, 4)), first.take(which), pa.array(at).take(which)], names=["digest", "part", "id", "place", "pack", "first", "at"])

    marked = ordered.mapInArrow(mark, f"digest long, part long, id {kind}, place long, pack long, first {kind}, at long")
    if not many:
        return marked.select("id", "place", "pack", "first", "at")
    apart = marked.where("part IS NOT NULL")
    least = apart.groupBy("digest").agg(F.min(F.struct("first", "at")).alias("least"))
    joined = apart.join(F.broadcast(least) if many <= BROADCAST_ROWS else least, "digest").select("id", "place", "pack", "least.first", "least.at")
    return marked.where("part IS NULL").select(*joined.columns).union(joined.where("id <> first OR place <> at"))


def by_row(later: DataFrame) -> DataFrame:
    """``id``, ``tag`` and ``found``, the chunks of a row by start, each once."""
    found = F.array_sort(F.collect_set(F.struct(F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("start"), "pack", "first", "at")))
    return later.groupBy("id", F.shiftright("place", 32).cast("int").alias("tag")).agg(found.alias("found"))


def edges(src: DataFrame, chunk: int, min_words: int) -> DataFrame:
    """The ends of the runs that may belong to a passage of ``min_words``: row and run, and the row
    (``first``, ``of``) and the ``edge`` to follow there, twice its position, and 1 for a right end.

    A run is of neighbouring chunks that have an earlier place. Each alignment that it has with a
    first copy is followed from both of its ends.
    """
    rows = by_row(later_chunks(src, chunk))
    kind = src.schema["key"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(2)
        flat = lists.flatten()
        part = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        start = part["start"].astype(np.int64)
        end = start + (part["pack"] >> 32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1])
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(row))
        pack = part["pack"]
        most = np.add.reduceat(pack >> 20 & 4095, at) + (pack[at] >> 10 & 1023) + (pack[stop - 1] & 1023)
        keep = most >= min_words
        of, ahead = part["at"] >> 32, (part["at"] & 0x7FFFFFFF) - start
        out: list[tuple] = []
        for s, e in zip(at[keep].tolist(), stop[keep].tolist(), strict=True):
            a, b = int(start[s]), int(end[e - 1])
            for first, tag, d in set(zip(part["first"][s:e].tolist(), of[s:e].tolist(), ahead[s:e].tolist(), strict=True)):
                out += [(row[s], a, b, first, tag, 2 * p + right) for p, right in ((a + d, 0), (b + d, 1)) if p >= 0]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        which = pa.array(cols[0], pa.int64())
        kinds = (pa.int32(), pa.int32(), flat.field(2).type, pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=["id", "tag", "a", "b", "first", "of", "edge"])

    return map_arrow(rows, run, f"id {kind}, tag int, a int, b int, first {kind}, of int, edge long")


def beside(src: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``tag``, text and ``found`` of the rows that have any. All columns of ``src`` are named,
    so that one shuffle of it serves every such join."""
    rest = [F.col(c).isNull().cast("int") for c in src.columns if c not in ("key", "text", "tag")]
    joined = src.join(found.toDF("id", "of", "found"), (F.col("key") == F.col("id")) & (F.col("tag") == F.col("of")))
    return joined.select("id", "of", "text", "found", sum(rest, F.lit(0)).alias("rest"))


def parts(text: str, wanted: list[int], chunk: int) -> Iterator[tuple[int, str]]:
    """What lies outward of the wanted edges, as far as a repeat without a whole chunk can reach."""
    at = cuts(text, chunk)
    for edge in wanted:
        p = edge >> 1
        if p > len(text):
            continue
        if edge & 1:
            k = int(np.searchsorted(at, p + WINDOW))
            yield edge, text[p : int(at[k]) + 1 if k < len(at) else len(text)]
        else:
            k = int(np.searchsorted(at, p))
            yield edge, text[max(0, int(at[k - 1]) - WINDOW - 1) if k else 0 : p]


def left_end(text: str, a: int, b: int, part: str) -> int:
    """Where the repeat that reaches from ``a`` to ``b`` begins, at a word, when ``part`` lies before
    its first copy."""
    n = 0
    while n < len(part) and n < a and text[a - 1 - n] == part[-1 - n]:
        n += 1
    p = a - n
    if not (text[p] in GAPS or ((p == 0 or text[p - 1] in GAPS) and (n == len(part) or part[-1 - n] in GAPS))):
        p += 1
        while p < b and text[p] not in GAPS and text[p - 1] not in GAPS:
            p += 1
    while 0 < p < b and text[p] in GAPS and text[p - 1] not in GAPS:  # words around it stay apart
        p += 1
    return p


def right_end(text: str, a: int, b: int, part: str) -> int:
    """As ``left_end``, for the end and what lies after the first copy."""
    n, most = 0, min(len(part), len(text) - b)
    while n < most and text[b + n] == part[n]:
        n += 1
    q = b + n
    if not (text[q - 1] in GAPS or ((q == len(text) or text[q] in GAPS) and (n == len(part) or part[n] in GAPS))):
        q -= 1
        while q > a and text[q] not in GAPS and text[q - 1] not in GAPS:
            q -= 1
    return q


def repeats(src: DataFrame, chunk: int, min_words: int) -> DataFrame:
    """The passages to cut of ``renamed`` rows without null ids: ``id`` and ``of`` (the tag) of a row,
    their ``spans`` (start and length in characters) in order, and ``first_ids``, the documents that
    keep a copy.

    A passage is cut when it holds ``min_words`` words or more. Rows with a null or empty text have
    none. Rows equal in id and text each lose the same.
    """
    if not 0 < min_words < 1000:
        raise ValueError("min_words is from 1 to 999")
    sides = durable(edges(src, chunk, min_words))
    wanted = sides.groupBy("first", "of").agg(F.collect_set("edge").alias("edges"))
    kind = src.schema["key"].dataType.simpleString()

    def look(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, found = [], []
        for i, (text, edge) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            new = list(parts(text, edge, chunk))
            rows += [i] * len(new)
            found += new
        which = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array([e for e, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["first", "of", "edge", "part"])

    seen = map_arrow(beside(src, wanted), look, f"first {kind}, of int, edge long, part string")
    rows = sides.join(seen, ["first", "of", "edge"]).groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b", F.col("edge").bitwiseAND(F.lit(1)).alias("right"), "first", "part")).alias("found"))

    def follow(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, out, by = [], [], []
        for i, (text, found) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            reach: dict[tuple, list] = {}
            for f in found:
                a, b = f["a"], f["b"]
                run = reach.setdefault((a, b), [b, a, set()])
                run[2].add(f["first"])
                if f["right"]:
                    run[1] = max(run[1], right_end(text, a, b, f["part"]))
                else:
                    run[0] = min(run[0], left_end(text, a, b, f["part"]))
            spans: list[list[int]] = []
            firsts: set = set()
            for p, q, ids in sorted(reach.values(), key=lambda r: r[:2]):
                if len(WORD.findall(text, p, q)) >= min_words:
                    firsts |= ids
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = max(q, spans[-1][1])
                    else:
                        spans.append([p, q])
            if spans:
                which.append(i)
                out.append([{"start": p, "length": q - p} for p, q in spans])
                by.append(sorted(firsts))
        at = pa.array(which, pa.int64())
        form = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, form), pa.array(by, pa.list_(batch.column(0).type))], names=["id", "of", "spans", "first_ids"])

    spans = f"id {kind}, of int, spans array<struct<start:int,length:int>>, first_ids array<{kind}>"
    return map_arrow(beside(src, rows), follow, spans).dropDuplicates(["id", "of"])


def cut_out(text: str = "text", spans: str = "spans") -> F.Column:
    """The text without its spans; null spans leave it as it is."""
    starts = F.transform(F.col(spans), lambda s: s["start"] + s["length"])
    from_ = F.concat(F.array(F.lit(0)), starts)
    to = F.concat(F.transform(F.col(spans), lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(from_, to, lambda a, b: F.substring(F.col(text), a + 1, F.greatest(b - a, F.lit(0))))
    return F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, repeated passages cut out of ``text_col``; a text may end up empty.

    Rows with a null id, or a null or empty text, stay as they are. Rows equal in id and text lose
    the same; different texts of one id lose what is theirs. Texts of any length are read whole. Ids
    may be of any type that can be ordered, columns of any name are carried, and an empty table
    gives an empty result.
    """
    every = renamed(docs, id_col, text_col)
    src = every.where("key IS NOT NULL")
    found = repeats(src, chunk, min_words).drop("first_ids")
    joined = src.join(found, (F.col("key") == F.col("id")) & (F.col("tag") == F.col("of")), "left")
    done = joined.withColumn("text", cut_out()).select(*every.columns).union(every.where("key IS NULL"))
    other = iter(f"c{k}" for k in range(len(docs.columns)))
    back = [F.col("key" if c == id_col else "text" if c == text_col else next(other)).alias(c) for c in docs.columns]
    return done.select(*back)


def changed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, min_words: int = MIN_WORDS) -> DataFrame:
    """Of the documents that lose a passage: ``doc_id``, ``first_doc_ids`` (documents that keep a
    copy), ``removed_chars``, ``spans`` and the remaining ``text``.

    Nulls, empty and long texts, repeated rows and empty tables as in ``dedup``; other columns are
    not read.
    """
    src = renamed(docs, id_col, text_col).select("key", "text", "tag").where("key IS NOT NULL")
    joined = src.join(repeats(src, chunk, min_words), (F.col("key") == F.col("id")) & (F.col("tag") == F.col("of")))
    removed = F.aggregate("spans", F.lit(0), lambda a, s: a + s["length"])
    return joined.select(F.col("id").alias("doc_id"), F.col("first_ids").alias("first_doc_ids"), removed.alias("removed_chars"), "spans", cut_out().alias("text"))
