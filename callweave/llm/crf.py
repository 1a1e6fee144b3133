"""Line labelling by a linear-chain conditional random field.

Each line of a document is content or boilerplate. Features of a line come from class counts over
its code points, for a whole batch at once; the most likely labels of a document's lines are found
by Viterbi decoding, and the share of its characters that lie in content decides whether it stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.bpe import LETTER, NUMBER, SPACE, classes
from callweave.llm.common import map_arrow, only, slices

#: Labelled documents that the field is trained on, at most.
SAMPLE = 3_000
#: Content share that keeps a document.
MIN_SHARE = 0.5
ROUNDS = 150
CONTENT, BOILER = 0, 1
#: Bin edges of each number of a line; a feature is one bin.
EDGES = {
    "chars": (1, 20, 60, 200, 800, 4000),
    "words": (1, 3, 8, 30, 150),
    "word_length": (2.0, 3.5, 5.0, 7.0, 9.0, 14.0),
    "upper": (0.01, 0.05, 0.15, 0.4, 0.7),
    "symbols": (0.01, 0.03, 0.06, 0.12, 0.25),
    "digits": (0.005, 0.03, 0.1, 0.3),
    "same_word": (0.001, 0.05, 0.2, 0.5),
    "new_words": (0.2, 0.4, 0.6, 0.8, 0.95),
    "copies": (1.5, 2.5, 4.5),
    "ends": (0.5,),
}
WIDTHS = {k: len(v) + 1 for k, v in EDGES.items()}
OFFSETS = dict(zip(WIDTHS, np.concatenate([[0], np.cumsum(list(WIDTHS.values()))[:-1]]).tolist(), strict=True))
FEATURES = sum(WIDTHS.values())
_CAPITALS: list[np.ndarray] = []
_R = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n + 1).bit_length())
    if size not in _POWERS:
        back = np.uint64(pow(int(_R), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _POWERS[size] = tuple(np.cumprod(np.concatenate([one, np.full(size, r, np.uint64)])) for r in (_R, back))
    return _POWERS[size]


def capitals() -> np.ndarray:
    """Whether each code point is a capital letter."""
    if not _CAPITALS:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        mask = np.zeros(0x110000, bool)
        mask[np.frombuffer("".join(regex.findall(r"\p{Lu}", every)).encode("utf-32-le"), "<u4")] = True
        _CAPITALS.append(mask)
    return _CAPITALS[0]


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, the length and the feature numbers of each line of some texts without nulls.

    Lines are parted by a line feed, which belongs to the line before it; an empty text has none.
    """
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(EDGES)), np.int32)
    end = codes == 10
    end[stop[size > 0] - 1] = True
    at = np.flatnonzero(end) + 1
    first = np.concatenate([[0], at[:-1]])
    doc = np.searchsorted(stop, first, side="right")
    cls = classes()[codes]
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), first).astype(float)
    chars = (at - first).astype(float)
    letter, space = cls == LETTER, cls == SPACE
    upper = capitals()[codes]
    plain = (codes == 46) | (codes == 44)
    symbol = ~letter & ~space & (cls != NUMBER) & ~plain
    edge = np.zeros(n, bool)
    edge[first] = True
    begin = ~space
    begin[1:] &= space[:-1] | edge[1:]
    start = np.flatnonzero(begin)
    finish = ~space
    finish[:-1] &= space[1:] | edge[1:]
    finish = np.flatnonzero(finish) + 1
    power, back = powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D)) * power[:n])])
    word = (total[finish] - total[start]) * back[start]
    owner = np.searchsorted(first, start, side="right") - 1
    words = np.bincount(owner, minlength=len(first)).astype(float)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, len(first))
    mixed = (word ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    _, pick = np.unique(mixed, return_index=True)
    distinct = np.bincount(owner[pick], minlength=len(first)).astype(float)
    line = (total[at] - total[first]) * back[first]
    _, inverse, copies = np.unique((line ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    last = codes[np.maximum(np.where(codes[at - 1] == 10, at - 2, at - 1), first)]
    per = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    visible = count(~space)
    value = {
        "chars": chars, "words": words, "word_length": per(visible, words), "upper": per(count(upper), visible), "symbols": per(count(symbol), visible), "digits": per(count(cls == NUMBER), visible),
        "same_word": per(repeats, words), "new_words": per(distinct, words), "copies": copies[inverse].astype(float), "ends": np.isin(last, [46, 33, 63]).astype(float),
    }
    return doc, (at - first), np.stack([np.searchsorted(e, value[k], side="right") + OFFSETS[k] for k, e in EDGES.items()], 1).astype(np.int32)


@dataclass
class Field:
    """Weights: of features by label, of steps from label to label, of the first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray
    sample: int = 0


def viterbi(unary: np.ndarray, field: Field) -> np.ndarray:
    """The most likely labels of one document's lines; of equals, content."""
    n = len(unary)
    (s00, s01), (s10, s11) = field.step.tolist()
    a, b = (unary[0] + field.first).tolist()
    back = []
    for u, v in unary[1:].tolist():
        x, y = a + s00, b + s10
        p, q = a + s01, b + s11
        back.append((y > x, q > p))
        a, b = (y if y > x else x) + u, (q if q > p else p) + v
    out = np.zeros(n, np.int8)
    at = int(b > a)
    out[n - 1] = at
    for i in range(n - 2, -1, -1):
        at = int(back[i][at])
        out[i] = at
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; the gradient comes from forward and backward sums.

    Each document gives the feature numbers of its lines and their labels. Documents run side by
    side, the longest first, so that each step covers those that are still running.
    """
    docs = sorted((d for d in docs if len(d[1])), key=lambda d: -len(d[1]))
    theta = np.zeros(FEATURES * 2 + 6)
    if not docs:
        return Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    size = np.array([len(d[1]) for d in docs])
    longest = int(size[0])
    live = [int((size > t).sum()) for t in range(longest)]
    grid = np.full((longest, len(docs)), -1, np.int64)
    offset = np.cumsum(size) - size
    for i, (s, o) in enumerate(zip(size.tolist(), offset.tolist(), strict=True)):
        grid[:s, i] = np.arange(o, o + s)
    feats = np.concatenate([d[0] for d in docs])
    gold = np.concatenate([d[1] for d in docs]).astype(np.int64)
    starts = offset
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    seen_emit = np.stack([np.bincount(feats[gold == k].ravel(), minlength=FEATURES) for k in (0, 1)], 1).astype(float)
    seen_step = np.bincount(gold[inner - 1] * 2 + gold[inner], minlength=4).reshape(2, 2).astype(float)
    seen_first = np.bincount(gold[starts], minlength=2).astype(float)
    lines, m, v = len(gold), np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        emit, step, first = theta[: 2 * FEATURES].reshape(FEATURES, 2), theta[2 * FEATURES : -2].reshape(2, 2), theta[-2:]
        unary = emit[feats].sum(1)
        alpha, beta = np.zeros((lines, 2)), np.zeros((lines, 2))
        a = unary[grid[0]] + first
        alpha[grid[0]] = a
        for t in range(1, longest):
            k = live[t]
            a = np.logaddexp(a[:k, 0, None] + step[0], a[:k, 1, None] + step[1]) + unary[grid[t, :k]]
            alpha[grid[t, :k]] = a
        b = np.zeros((live[-1], 2))
        for t in range(longest - 2, -1, -1):
            nxt = unary[grid[t + 1, : live[t + 1]]] + b
            b = np.zeros((live[t], 2))
            b[: live[t + 1]] = np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None])
            beta[grid[t, : live[t]]] = b
        both = alpha + beta
        norm = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both - norm[:, None])
        pair = np.exp(alpha[inner - 1][:, :, None] + step + (unary + beta)[inner][:, None, :] - norm[inner][:, None, None])
        want_emit = np.stack([np.bincount(feats.ravel(), np.repeat(p[:, k], feats.shape[1]), FEATURES) for k in (0, 1)], 1)
        grad = np.concatenate([(seen_emit - want_emit).ravel(), (seen_step - pair.sum(0)).ravel(), seen_first - p[starts].sum(0)]) / lines - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Field(theta[: 2 * FEATURES].reshape(FEATURES, 2), theta[2 * FEATURES : -2].reshape(2, 2), theta[-2:], len(docs))


def spliced(docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lines of each document with those of one of the other label in their midst.

    Labels mark whole documents, so that these are the only sequences in which a label changes.
    Partners go round, in the order given.
    """
    sides = [[d for d in docs if len(d[1]) and d[1][0] == k] for k in (CONTENT, BOILER)]
    if not all(sides):
        return []
    out, turn = [], [0, 0]
    for d in docs:
        if len(d[1]) > 1:
            other = 1 - int(d[1][0])
            guest = sides[other][turn[other] % len(sides[other])]
            turn[other] += 1
            at = 1 + len(out) % (len(d[1]) - 1)
            out.append(tuple(np.concatenate([a[:at], b, a[at:]]) for a, b in zip(d, guest, strict=True)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field trained on at most ``sample`` labelled documents, those least by a hash of their id.

    No table labels lines, so a line takes its document's label: content where quality is 1,
    boilerplate where it is 0. For lines of both kinds in one document the field is trained on
    ``spliced`` documents as well. Only the features of the sample reach the driver. Null labels,
    ids and texts don't count; without labelled documents every line is content. Several labels of
    one document count each; columns of any name may be there.
    """
    lab = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    lab = lab.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    text = only(docs, id_col, text_col).toDF("id", "text").where(F.col("text").isNotNull())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            doc, _, feats = lines_of(texts[a:b])
            n = np.bincount(doc, minlength=b - a)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n) * feats.shape[1]]).astype(np.int32)), pa.array(feats.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, batch.column(2).slice(a, b - a)], names=["id", "feats", "quality"])

    rows = map_arrow(text.join(F.broadcast(lab), "id").select("id", "text", "quality"), run, "id long, feats array<int>, quality int").toPandas()
    rows = rows.sort_values(["id", "quality"])
    train_on = []
    for f, q in zip(rows.feats, rows.quality, strict=True):
        x = np.asarray(f, np.int64).reshape(-1, len(EDGES))
        train_on.append((x, np.full(len(x), CONTENT if q else BOILER)))
    return train(train_on + spliced(train_on))


def shares(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_lines``, ``content_lines`` and ``content_share`` of each row, by characters.

    A null or empty text has no lines and a null share. Other columns are not read, repeated rows
    give repeated results, long texts are read whole.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(1).to_pylist()
        for a, b in slices(every):
            doc, size, feats = lines_of([t or "" for t in every[a:b]])
            unary = field.emit[feats].sum(1) if len(feats) else np.zeros((0, 2))
            n = np.bincount(doc, minlength=b - a)
            stop = np.cumsum(n)
            lines, chars = np.zeros(b - a, np.int32), np.zeros(b - a)
            for i in np.flatnonzero(n).tolist():
                s, e = int(stop[i] - n[i]), int(stop[i])
                content = viterbi(unary[s:e], field) == CONTENT
                lines[i] = content.sum()
                chars[i] = size[s:e][content].sum()
            whole = np.bincount(doc, size, b - a)
            share = np.divide(chars, whole, out=np.zeros(b - a), where=whole > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(lines), pa.array(share, mask=whole == 0)], names=[id_col, "n_lines", "content_lines", "content_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(only(docs, id_col, text_col), run, f"`{id_col}` {kind}, n_lines int, content_lines int, content_share double")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, **how: object) -> DataFrame:
    """Of the documents with a content share of ``min_share`` or more, what ``shares`` gives.

    Rows with a null or empty text have no share and go; repeated rows are judged alike, long texts
    are read whole, columns of any name may be there, and an empty table gives an empty result.
    """
    return shares(docs, fit(docs, labels, id_col, text_col, **how), id_col, text_col).where(F.col("content_share") >= min_share)
