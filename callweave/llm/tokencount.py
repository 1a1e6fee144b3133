"""Token counts that follow edits.

Each document keeps its pre-tokens in leaves, and trees of sums over the leaves' characters and
token counts. An edit finds its leaf down the tree and is answered by encoding again only the
pre-tokens that it touches, with as much before them as can look into it and as much behind as it
takes to meet an old pre-token border again. The changed leaves are replaced and the sums above
them brought up to date. ``state`` is the table of all documents' pre-tokens and counts, and
``apply_edits`` brings the rows that are edited up to date without encoding the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.bpe import VOCAB, Codec, code_points, codec, pretokens
from callweave.llm.common import map_arrow, only, text_slices, without, written

#: Pre-tokens in a leaf, and children of a node.
LEAF, FAN = 32, 8
#: A pre-token is independent of what lies this far behind its end.
LOOK = 2
#: Characters that a task holds at once while it makes or edits states, about.
STATE_CHARS = 500_000
#: Characters that are split again at once while looking for an old border.
REACH = 256


class Tree:
    """A text in leaves, of which each has its part, the lengths of its pre-tokens and their tokens.

    ``chars[0]`` and ``levels[0]`` are the characters and tokens of each leaf, each next level sums
    ``FAN`` entries of the one below, and the last holds the total alone.
    """

    def __init__(self, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.encoded = 0
        self.leaves: list[tuple[str, np.ndarray, np.ndarray]] = []
        self.put(0, 0, text, sizes, counts)

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.leaves)

    @property
    def sizes(self) -> np.ndarray:
        return np.concatenate([s for _, s, _ in self.leaves]) if self.leaves else np.zeros(0, np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.concatenate([k for _, _, k in self.leaves]) if self.leaves else np.zeros(0, np.int64)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def sums(self) -> None:
        self.chars, self.levels = ([np.array([f(leaf) for leaf in self.leaves], np.int64)] for f in (lambda x: len(x[0]), lambda x: int(x[2].sum())))
        for levels in (self.chars, self.levels):
            while len(levels[-1]) > 1:
                levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))

    def put(self, first: int, stop: int, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Replace some leaves by such with this text, and bring the sums up to date: those above the
        leaves when their number stays, as it does while they are of a fair size, else all."""
        n, old = len(sizes), stop - first
        parts = old if old and old <= n <= 4 * LEAF * old else -(-n // LEAF)
        cut = np.arange(parts + 1) * n // max(1, parts)
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut].tolist()
        self.leaves[first:stop] = [(text[p:q], sizes[i:j], counts[i:j]) for p, q, i, j in zip(ends, ends[1:], cut.tolist(), cut[1:].tolist())]
        if parts != old or not old:
            self.sums()
            return
        for leaf in range(first, stop):
            part, _, k = self.leaves[leaf]
            for levels, now in ((self.chars, len(part)), (self.levels, int(k.sum()))):
                change, at = now - int(levels[0][leaf]), leaf
                for level in levels:
                    level[at] += change
                    at //= FAN

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for those behind, and where it begins."""
        leaf = begin = 0
        for level in reversed(self.chars[:-1]):
            ends = np.cumsum(level[leaf * FAN : leaf * FAN + FAN])
            k = min(int(np.searchsorted(ends, place - begin, side="right")), len(ends) - 1)
            begin += int(ends[k - 1]) if k else 0
            leaf = leaf * FAN + k
        return leaf, begin

    def edit(self, c: Codec, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end. Places beyond the text count as its end."""
        n = int(self.chars[-1][0]) if self.leaves else 0
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not self.leaves:
            sizes, counts = split_counts(c, [new])[0]
            self.encoded += len(sizes)
            self.put(0, 0, new, sizes, counts)
            return
        # the last pre-token that may look into the edit: all that end LOOK before it stay
        leaf, base = self.find(max(start - LOOK, 0))
        own = np.cumsum(self.leaves[leaf][1]) - self.leaves[leaf][1]
        at = max(int(np.searchsorted(own, start - LOOK - base, side="right")) - 1, 0)
        s, e, shift = start - base, end - base, len(new) - (end - start)
        # split anew from there until a border of old lies at the same place
        stop, parts, held, reach = leaf, [], 0, REACH
        while True:
            while stop < len(self.leaves) and held < e + reach:
                parts.append(self.leaves[stop])
                held += len(parts[-1][0])
                stop += 1
            old = "".join(p for p, _, _ in parts)
            text = old[:s] + new + old[e:]
            sizes = np.concatenate([z for _, z, _ in parts])
            begin = int(own[at])
            codes, zero = code_points([text[begin:]])
            cut = (pretokens(codes, zero) + begin) if len(codes) else np.zeros(0, np.int64)
            last = stop == len(self.leaves)
            if not last:
                cut = cut[cut <= len(text) - LOOK - 1]  # borders that the end of the piece can't have moved
            starts = np.cumsum(sizes) - sizes
            late = cut[(cut >= s + len(new)) & (cut - shift >= e)]
            late = late[np.isin(late - shift, starts)]
            if len(late) or last:
                break
            reach *= 4
        border = int(late[0]) if len(late) else len(text)
        fresh = cut[cut < border]
        self.encoded += len(fresh)
        counts = np.concatenate([k for _, _, k in parts])
        behind = int(np.searchsorted(starts, border - shift)) if len(late) else len(starts)
        # whole leaves behind the border stay
        upto = np.cumsum([len(z) for _, z, _ in parts])
        used = int(np.searchsorted(upto, behind)) + 1
        stop, right = leaf + used, int(upto[used - 1])
        end_at = int(starts[right]) if right < len(starts) else len(old)
        sizes = np.concatenate([sizes[:at], np.diff(np.append(fresh, border)), sizes[behind:right]])
        counts = np.concatenate([counts[:at], c.encode_pieces(text, np.append(fresh, border)), counts[behind:right]])
        self.put(leaf, stop, text[: end_at + shift], sizes, counts)


def split_counts(c: Codec, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the lengths of its pre-tokens and their token counts."""
    codes, begin = code_points(texts)
    _, _, count, words = c.encode_batch(texts)
    start = pretokens(codes, begin) if len(codes) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(codes)))
    ends = np.cumsum(words)
    return [(size[e - w : e], count[e - w : e].astype(np.int64)) for e, w in zip(ends.tolist(), words.tolist(), strict=True)]


def build(texts: list[str], c: Codec) -> list[Tree]:
    return [Tree(t, s, k) for t, (s, k) in zip(texts, split_counts(c, texts), strict=True)]


STATE = "text string, sizes binary, counts binary, tokens int"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in a byte each, or in four where one needs more; the first byte tells which."""
    width = "<u1" if not len(numbers) or numbers.max() < 256 else "<u4"
    return width[2].encode() + numbers.astype(width).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{chr(data[0])}", offset=1).astype(np.int64)


def state(docs: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """The id, ``text``, ``sizes`` and ``counts`` (of its pre-tokens: characters and tokens, ``packed``)
    and ``tokens`` of each row, and its ``edits`` where a column has them; to be written once and kept.

    A null text has nulls, an empty one no pre-tokens and 0. Texts of any length are encoded whole,
    other columns are not read, repeated rows give repeated results, and an empty table gives an
    empty one.
    """
    with open(vocab, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    more = [edits_col] if edits_col else []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for a, b, texts in text_slices(batch.column(1), STATE_CHARS):
            nulls = np.array([t is None for t in texts])
            parts = split_counts(c, [t or "" for t in texts])
            total = np.array([k.sum() for _, k in parts], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([None if x else packed(p[k]) for x, p in zip(nulls, parts, strict=True)], pa.binary()) for k in (0, 1)), pa.array(total, mask=nulls), *(batch.column(2).slice(a, b - a) for _ in more)], names=[id_col, "text", "sizes", "counts", "tokens", *("edits" for _ in more)])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    return map_arrow(only(docs, id_col, text_col, *more), run, ", ".join([f"`{id_col}` {kind(id_col)}, {STATE}", *(f"edits {kind(c)}" for c in more)]))


def apply_edits(kept: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", edits_col: str = "edits", whole: bool = True) -> DataFrame:
    """Rows of a ``state`` table brought up to date with their edits: its columns, and
    ``tokens_before``, ``pretokens`` (before) and ``reencoded``, the pre-tokens that were encoded.
    Unless ``whole`` the id and the numbers alone.

    ``edits_col`` holds an array of structs ``start``, ``end``, ``text``: each replaces characters
    of the text as the edits before it left it. Places beyond a text count as its end, a null text
    of an edit as empty, a null edit as none; a null place means 0. A null text stays null; null or
    no edits leave a row as it is. Join the table with the edits by id first, so that only edited
    rows are read here; texts of any length are followed whole, repeated rows give repeated results,
    other columns are not read and an empty table gives an empty one.
    """
    with open(vocab, "rb") as f:
        shared = kept.sparkSession.sparkContext.broadcast(f.read())

    names = ["text", "sizes", "counts", "tokens", "tokens_before", "pretokens", "reencoded"]
    names = names if whole else names[3:]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        ids, texts, sizes, counts, edits = batch.columns
        rows: list = []

        def done() -> pa.RecordBatch:
            last = start + len(rows)
            nulls = np.array([r is None for r in rows])
            trees = [r or (None, None, None, 0, 0, 0, 0) for r in rows]
            numbers = [pa.array(np.array([t[k] for t in trees], np.int32), mask=nulls) for k in (3, 4, 5, 6)]
            body = [pa.array([t[k] for t in trees], kind) for k, kind in ((0, pa.string()), (1, pa.binary()), (2, pa.binary()))] if whole else []
            return pa.RecordBatch.from_arrays([ids.slice(start, last - start), *body, *numbers], names=[id_col, *names])

        start = held = 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if text is None:
                rows.append(None)
            else:
                s, k = unpacked(sizes[i].as_py()), unpacked(counts[i].as_py())
                before = int(k.sum())
                some = [e for e in edits[i].as_py() or [] if e is not None]
                if some:
                    tree = Tree(text, s, k)
                    for e in some:
                        tree.edit(c, e["start"] or 0, e["end"] or 0, e["text"] or "")
                    body = (tree.text, packed(tree.sizes), packed(tree.counts)) if whole else (None,) * 3
                    rows.append((*body, tree.total, before, len(s), tree.encoded))
                else:
                    rows.append((*((text, packed(s), packed(k)) if whole else (None,) * 3), before, before, len(s), 0))
                held += len(text) if whole else 0
            if held > STATE_CHARS:
                yield done()
                start, held, rows = start + len(rows), 0, []
        if rows:
            yield done()

    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {STATE if whole else 'tokens int'}, tokens_before int, pretokens int, reencoded int"
    return map_arrow(only(kept, id_col, "text", "sizes", "counts", edits_col), run, schema)


def edits_of(text: Column) -> Column:
    """Edits for a corpus that comes without any: cut the second line, put a notice in the middle,
    and write the first word, up to 20 characters, in capitals. Null for a null text."""
    first = F.instr(text, "\n")
    second = F.call_function("locate", F.lit("\n"), text, first + 1)
    n = F.length(text)
    edit = lambda s, e, new: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), new.alias("text"))
    cut = F.when((first > 0) & (second > 0), edit(first, second, F.lit("")))
    half = F.floor(n / 2)
    word = F.substring(F.substring_index(text, " ", 1), 1, 20)
    return F.when(text.isNotNull(), F.filter(F.array(edit(half, half, F.lit("\n[revised]\n")), cut, edit(F.lit(0), F.length(word), F.upper(word))), lambda e: e.isNotNull()))


def recount(docs: DataFrame, edits_col: str = "edits", vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``tokens_before``, ``tokens_after``, ``pretokens`` (before) and ``reencoded``, the
    pre-tokens that were encoded again, of a table that has its edits beside the texts.

    The ``state`` of all rows is written to the shared folder, and the edits are applied to that
    table. Nulls, empty and long texts, repeated rows and empty tables as in ``apply_edits``.
    """
    kept = written(state(docs, vocab, id_col, text_col, edits_col), "state")
    out = apply_edits(kept, vocab, id_col, whole=False)
    return out.select(id_col, "tokens_before", F.col("tokens").alias("tokens_after"), "pretokens", "reencoded")


def with_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``edits``, those of ``edits_of``; a column of that name is replaced."""
    return without(docs, "edits").withColumn("edits", edits_of(F.col(f"`{text_col}`")))
