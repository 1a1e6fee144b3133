"""Byte-level BPE by speculation, over whole batches.

A batch is cut into pre-tokens by class comparisons on its code points. Pre-tokens that the worker
has not met are split by greedy longest match, all at once along a trie. Such a split is the true
one exactly when every adjacent pair is compatible, that is, merging the bytes of the pair alone
gives that pair again. The pairs of the batch are tested together against a memo of pairs already
judged; only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from callweave.llm.common import map_arrow, only, slices

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker remembers; at the bound the memory is emptied.
CACHE_WORDS = 500_000
#: Longer words, in bytes, are merged one by one.
WIDE = 32
NONE = np.int32(-1)
BIG = np.int32(1 << 30)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_LIVE: dict[int, "Codec"] = {}
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        lut = np.zeros(0x110000, np.uint8)
        for code, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            lut[np.frombuffer("".join(regex.findall(p, every)).encode("utf-32-le"), "<u4")] = code
        _CLASSES.append(lut)
    return _CLASSES[0]


class IntTable:
    """Open addressing from 64-bit keys to int32, in arrays."""

    def __init__(self, bits: int) -> None:
        self.shift, self.size, self.n = np.uint64(64 - bits), 1 << bits, 0
        self.keys = np.zeros(self.size, np.uint64)
        self.vals = np.full(self.size, NONE, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.vals[slot]
        todo = np.flatnonzero((out != NONE) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = s = (slot[todo] + 1) & (self.size - 1)
            out[todo] = v = self.vals[s]
            todo = todo[(v != NONE) & (self.keys[s] != keys[todo])]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add keys that are distinct and not yet there."""
        self.n += len(keys)
        if self.n * 2 > self.size:
            raise OverflowError("table is full")
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.vals[s] == NONE
            _, first = np.unique(s, return_index=True)
            win = np.zeros(len(todo), bool)
            win[first] = True
            win &= free
            self.keys[s[win]] = keys[todo[win]]
            self.vals[s[win]] = vals[todo[win]]
            todo = todo[~win]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each of several ranges, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Codec:
    """The vocabulary with what has been learned about its words and pairs."""

    def __init__(self, data: bytes, cache_words: int = CACHE_WORDS) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in data.splitlines():
            if line.strip():
                tok, rank = line.split()
                self.ranks[base64.b64decode(tok)] = int(rank)
        size = max(self.ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * size
        for tok, rank in self.ranks.items():
            self.pieces[rank] = tok
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._build_pairs()
        self._build_trie()
        rng = np.random.default_rng(20240229)
        self.mix = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self.cache_words = cache_words
        self.judged = IntTable(20)
        self.forget()
        self.recent: dict[bytes, int] = {}
        self.exact_words = self.guessed_words = 0

    def _build_pairs(self) -> None:
        ranks, keys, vals = self.ranks, [], []
        for tok, rank in ranks.items():
            for i in range(1, len(tok)):
                a = ranks.get(tok[:i])
                if a is not None and (b := ranks.get(tok[i:])) is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        self.pairs = IntTable(max(4, int(2.5 * len(keys) + 2).bit_length()))
        self.pairs.put(np.array(keys, np.uint64), np.array(vals, np.int32))

    def _build_trie(self) -> None:
        nodes, keys, vals, ends = {b"": 0}, [], [], {}
        for tok, rank in self.ranks.items():
            at = 0
            for i in range(len(tok)):
                p = tok[: i + 1]
                nxt = nodes.get(p)
                if nxt is None:
                    nxt = nodes[p] = len(nodes)
                    keys.append(at << 8 | tok[i])
                    vals.append(nxt)
                at = nxt
            ends[at] = rank
        self.trie = IntTable(int(2.5 * len(keys) + 2).bit_length())
        self.trie.put(np.array(keys, np.uint64), np.array(vals, np.int32))
        self.node_token = np.full(len(nodes), NONE, np.int32)
        self.node_token[list(ends)] = list(ends.values())

    def forget(self) -> None:
        self.known = IntTable((2 * self.cache_words).bit_length())
        self.word_tokens = np.empty(1 << 16, np.int32)
        self.word_start = np.zeros(0, np.int64)
        self.word_count = np.zeros(0, np.int64)
        self.filled = 0

    # exact merging

    def merge(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a heap over a linked list."""
        if word in self.ranks:
            return [self.ranks[word]]
        pieces, ranks = self.pieces, self.ranks
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(pieces[ids[i]] + pieces[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [t for t in ids if t >= 0]

    def merge_all(self, grid: np.ndarray) -> np.ndarray:
        """Exact merges of rows of tokens, -1 past the end, in step: each round merges every row's
        lowest pair."""
        grid = grid.copy()
        rows = np.arange(len(grid))
        work, width = grid, grid.shape[1]
        cols = np.arange(width)
        while len(rows) and width > 1:
            key = work[:, :-1].astype(np.uint64) << np.uint64(32) | work[:, 1:].astype(np.uint32).astype(np.uint64)
            rank = self.pairs.get(key.ravel()).reshape(key.shape)
            rank[(rank == NONE) | (work[:, 1:] == NONE)] = BIG
            at = rank.argmin(1)
            low = rank[np.arange(len(rows)), at]
            go = low != BIG
            grid[rows[~go], :] = work[~go]
            rows, work, at, low = rows[go], work[go], at[go], low[go]
            shifted = np.concatenate([work[:, 1:], np.full((len(work), 1), NONE, np.int32)], 1)
            work = np.where(cols > at[:, None], shifted, work)
            work[np.arange(len(rows)), at] = low
        if len(rows):
            grid[rows] = work
        return grid

    # speculation

    def greedy_all(self, grid: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Longest match of rows of bytes, as rows of tokens."""
        out = np.full(grid.shape, NONE, np.int32)
        rows, pos, count = np.arange(len(grid)), np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
        while len(rows):
            live, at = rows, pos[rows]
            node = np.zeros(len(live), np.int64)
            best, far = np.full(len(grid), NONE, np.int32), np.zeros(len(grid), np.int64)
            while len(live):
                nxt = self.trie.get(node.astype(np.uint64) << np.uint64(8) | grid[live, at].astype(np.uint64))
                ok = nxt != NONE
                live, at, node = live[ok], at[ok] + 1, nxt[ok]
                tok = self.node_token[node]
                hit = tok != NONE
                best[live[hit]], far[live[hit]] = tok[hit], at[hit]
                more = at < length[live]
                live, at, node = live[more], at[more], node[more]
            out[rows, count[rows]] = best[rows]
            count[rows] += 1
            pos[rows] = far[rows]
            rows = rows[pos[rows] < length[rows]]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging its bytes gives it again."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        verdict = self.judged.get(key)
        new = np.unique(key[verdict == NONE])
        if len(new):
            if (self.judged.n + len(new)) * 2 > self.judged.size:
                self.judged = IntTable(max(20, (4 * len(new)).bit_length()))
                new = np.unique(key)
            a, b = (new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
            both = self.lengths[a] + self.lengths[b]
            good = np.zeros(len(new), np.int32)
            short = np.flatnonzero(both <= WIDE)
            if len(short):
                grid = np.full((len(short), int(both[short].max())), NONE, np.int32)
                for tok, base in ((a[short], np.zeros(len(short), np.int64)), (b[short], self.lengths[a[short]])):
                    n = self.lengths[tok]
                    grid[np.repeat(np.arange(len(short)), n), ranges(base, n)] = self.single[self.pool[ranges(self.starts[tok], n)]]
                done = self.merge_all(grid)
                good[short] = (done[:, 0] == a[short]) & (done[:, 1] == b[short]) & (True if done.shape[1] < 3 else done[:, 2] == NONE)
            for i in np.flatnonzero(both > WIDE).tolist():
                good[i] = self.merge(self.pieces[a[i]] + self.pieces[b[i]]) == [a[i], b[i]]
            self.judged.put(new, good)
            verdict = self.judged.get(key)
        return verdict == 1

    def learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Tokens of distinct new words, given by their places in ``data``."""
        tokens: list[np.ndarray] = []
        count = np.zeros(len(keys), np.int64)
        narrow = np.flatnonzero(length <= WIDE)
        if len(narrow):
            n = length[narrow]
            grid = np.zeros((len(narrow), int(n.max())), np.uint8)
            grid[np.repeat(np.arange(len(narrow)), n), ranges(np.zeros(len(narrow), np.int64), n)] = data[ranges(start[narrow], n)]
            guess = self.greedy_all(grid, n)
            row, col = np.nonzero(guess[:, 1:] != NONE)
            wrong = np.zeros(len(narrow), bool)
            if len(row):
                wrong[row[~self.compatible(guess[row, col], guess[row, col + 1])]] = True
            if wrong.any():
                byte = self.single[grid[wrong]]
                byte[np.arange(grid.shape[1]) >= n[wrong][:, None]] = NONE
                guess[wrong] = self.merge_all(byte)
            self.exact_words += int(wrong.sum())
            self.guessed_words += int(len(wrong) - wrong.sum())
            count[narrow] = (guess != NONE).sum(1)
            tokens.append(guess[guess != NONE])
        for i in np.flatnonzero(length > WIDE).tolist():
            ids = self.merge(data[start[i] : start[i] + length[i]].tobytes())
            count[i] = len(ids)
            tokens.append(np.array(ids, np.int32))
        order = np.concatenate([narrow, np.flatnonzero(length > WIDE)])
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        if self.filled + len(flat) > len(self.word_tokens):
            self.word_tokens = np.concatenate([self.word_tokens[: self.filled], np.empty(self.filled + 2 * len(flat), np.int32)])
        self.word_tokens[self.filled : self.filled + len(flat)] = flat
        n = count[order]
        at = len(self.word_start)
        self.word_start = np.concatenate([self.word_start, self.filled + np.cumsum(n) - n])
        self.word_count = np.concatenate([self.word_count, n])
        self.filled += len(flat)
        self.known.put(keys[order], np.arange(at, at + len(order), dtype=np.int32))

    # whole batches

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n + 1).bit_length()
            r = np.uint64(0xD6E8FEB86659FD93)
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, r, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(pow(int(r), -1, 1 << 64)), np.uint64)]))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all texts; how many each has; its pre-tokens' tokens; its pre-tokens."""
        codes, begin = code_points(texts)
        if not len(codes):
            zero = np.zeros(len(texts), np.int64)
            return np.zeros(0, np.int32), zero, np.zeros(0, np.int64), zero
        start = pretokens(codes, begin)
        width = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int8)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        first = place[start]
        size = np.diff(np.concatenate([first, [len(data)]]))
        self._powers(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.mix[data] * self.power[: len(data)])])
        key = (total[first + size] - total[first]) * self.inverse[first] ^ size.astype(np.uint64)
        word = self.known.get(key)
        miss = np.flatnonzero(word == NONE)
        if len(miss):
            new, at = np.unique(key[miss], return_index=True)
            if self.known.n + len(new) > self.cache_words:
                self.forget()
                new, at = np.unique(key, return_index=True)
                miss = np.arange(len(key))
                if len(new) > self.cache_words:
                    self.known = IntTable((4 * len(new)).bit_length())
            at = miss[at]
            self.learn(new, data, first[at], size[at])
            word = self.known.get(key)
        count = self.word_count[word]
        flat = self.word_tokens[ranges(self.word_start[word], count)]
        of_text = np.searchsorted(start, begin)
        words = np.diff(np.append(of_text, len(start)))
        ends = np.concatenate([[0], np.cumsum(count)])
        return flat, ends[of_text + words] - ends[of_text], count, words

    def encode_pieces(self, text: str, cuts: np.ndarray) -> np.ndarray:
        """Token counts of the few pre-tokens of one text between neighbouring cuts."""
        pieces = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        memo = self.recent
        if len(memo) > 100_000:
            memo.clear()
        for p in pieces:
            if p not in memo:
                memo[p] = len(self.merge(p))
        return np.array([memo[p] for p in pieces], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.pool[ranges(self.starts[ids], self.lengths[ids])].tobytes() if len(ids) else b""

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(size) - size


def pretokens(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: contractions, then runs of letters, numbers or other signs with the
    blank before them, then white space, of which the last before a sign stands apart.

    What starts at a place depends on no more than the two code points behind the pre-token.
    """
    n = len(codes)
    cls = classes()[codes]
    first = np.zeros(n + 1, bool)  # of a text
    first[begin[begin < n]] = True
    first[n] = True
    space = cls == SPACE
    edge = np.ones(n, bool)  # of a run of one class
    edge[1:] = cls[1:] != cls[:-1]
    edge |= first[:-1]
    last = np.zeros(n, bool)  # white space before a sign of the same text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    blank = last & (codes == 32)
    start = edge | last
    start[1:] &= ~blank[:-1]
    quote = np.flatnonzero((codes == 39) & start & edge)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        a = codes[quote + 1]
        two = quote + 2
        b = np.where(first[np.minimum(two, n)], 0, codes[np.minimum(two, n - 1)])
        one = np.isin(a, [115, 100, 109, 116])
        pair = ((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101))
        start[quote[one | pair] + 1] = False
        end = np.concatenate([quote[one] + 2, quote[pair] + 3])
        end = end[end < n]
        # the blank of " x" keeps its sign; other signs begin anew
        start[end] = True
    return np.flatnonzero(start)


def codec(data: bytes) -> Codec:
    """One codec for each vocabulary in a worker process."""
    k = hash(data)
    if k not in _LIVE:
        _LIVE.clear()
        _LIVE[k] = Codec(data)
    return _LIVE[k]


def encode(docs: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text, decoded again to prove the round trip.

    Returns one row for each input row: the id, ``token_ids``, ``n_tokens`` and ``lossless`` (the
    decoded bytes equal the text's). A null text gives nulls in all three, an empty text an empty
    list, 0 and true. Other columns are not read; repeated rows give repeated results; an empty
    table gives an empty one. Texts of any length are encoded whole.
    """
    with open(vocab, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        every = batch.column(1).to_pylist()
        for a, b in slices(every):
            nulls = np.array([t is None for t in every[a:b]])
            texts = [t or "" for t in every[a:b]]
            flat, n, _, _ = c.encode_batch(texts)
            ends = np.cumsum(n)
            size = np.concatenate([[0], np.cumsum(c.lengths[flat])])
            size = size[ends] - size[ends - n]
            back, at, same = memoryview(c.decode_bytes(flat)), 0, []
            for t, s in zip(texts, size.tolist(), strict=True):
                same.append(back[at : at + s] == t.encode("utf-8", "surrogatepass"))
                at += s
            if not all(same):  # two words with one 64-bit key
                parts = [flat[e - k : e] if ok else merge_words(c, t) for t, ok, e, k in zip(texts, same, ends, n, strict=True)]
                flat, n = np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts])
                same = [c.decode_bytes(p) == t.encode("utf-8", "surrogatepass") for t, p in zip(texts, parts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(nulls))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(n.astype(np.int32), mask=nulls), pa.array(np.array(same), mask=nulls)], names=[id_col, "token_ids", "n_tokens", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(only(docs, id_col, text_col), run, f"`{id_col}` {kind}, token_ids array<int>, n_tokens int, lossless boolean")


def merge_words(c: Codec, text: str) -> np.ndarray:
    """Exact merging of every pre-token of one text."""
    codes, begin = code_points([text])
    cuts = [*pretokens(codes, begin).tolist(), len(text)]
    return np.array([t for a, b in zip(cuts, cuts[1:]) for t in c.merge(text[a:b].encode("utf-8", "surrogatepass"))], np.int32)


def decode(tokens: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """Text of each list of ids; null gives null, an empty list an empty text, an unknown id an error."""
    with open(vocab, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        out = [None if not ids.is_valid else c.decode(np.array(ids.as_py(), np.int64)) for ids in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_arrow(only(tokens, id_col, tokens_col), run, f"`{id_col}` {kind}, text string")
