"""A quality classifier made of sparse rules.

Boosted shallow trees over text statistics are grown on a bounded sample of labelled documents.
Each path of a tree is a rule, a conjunction of comparisons. A lasso logistic regression keeps few
rules, and the rules with their weights are compiled into one Spark column expression, so scoring
is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import durable, fresh, only, without

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Toxic documents of the sample that a word of the learned lexicon is in, and its odds there.
LEXICON_DOCS, LEXICON_ODDS = 5, 30.0
TREES, DEPTH, RATE, BINS, LEAST = 24, 3, 0.3, 48, 6
PENALTY = 0.002
CUT = 0.5


def statistics(text: Column, lexicon: list[str]) -> dict[str, Column]:
    """The statistics of a text that rules compare, as column expressions.

    Words of the lexicon are runs of letters, as it is learned, and every occurrence counts.
    """
    chars = F.length(text)
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    tokens = F.split(F.lower(text), r"[\s.,;:!?]+")
    listed = F.size(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w.isin(lexicon))).cast("double") if lexicon else F.lit(0.0)
    sizes = lambda t, d: F.struct(F.size(t).cast("double").alias("words"), F.size(d).cast("double").alias("distinct"))
    words = F.transform(F.array(tokens), lambda t: F.transform(F.array(F.array_distinct(t)), lambda d: sizes(t, d))[0])[0]
    lines = F.transform(F.array(F.split(text, "\n")), lambda t: per(F.size(F.array_distinct(t)), F.size(t)))[0]
    return {"words": words, "lexicon": listed, "upper": per(count(r"\p{Lu}"), chars), "symbols": per(count(r"[^\p{L}\p{N}\s.,]"), chars), "bars": count(r" \| "), "digits": per(count("[0-9]"), chars), "stops": count(r"[.!?]\s"), "new_lines": lines, "chars": chars.cast("double")}


def derived(stats: str) -> dict[str, Column]:
    """The numbers that rules name, from a struct of statistics."""
    c = lambda k: F.col(f"{stats}.{k}")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    words = c("words.words")
    return {"words": words, "word_length": per(c("chars"), words), "upper": c("upper"), "symbols": c("symbols"), "bars": per(c("bars"), words), "digits": c("digits"), "stops": per(c("stops"), words), "new_words": per(c("words.distinct"), words), "new_lines": c("new_lines"), "lexicon": c("lexicon")}


def measured(docs: DataFrame, text: Column, lexicon: list[str], name: str) -> DataFrame:
    """The rows with a column of that name, null for a null or blank text. A generator keeps the
    optimizer from evaluating the statistics again for each use."""
    stats = F.struct(*[c.alias(k) for k, c in statistics(text, lexicon).items()])
    return docs.withColumn(name, F.explode(F.array(F.when(text.rlike(r"\S"), stats))))


Rule = tuple[tuple[str, str, float], ...]


@dataclass
class Model:
    lexicon: list[str]
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    sample: int = 0

    def score(self, stats: str) -> Column:
        """The log-odds of a good document, over a struct of its statistics."""
        total, value = F.lit(float(self.bias)), derived(stats)
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = None
            for name, op, at in rule:
                one = value[name] <= F.lit(at) if op == "<=" else value[name] > F.lit(at)
                hit = one if hit is None else hit & one
            total = total + F.when(hit, F.lit(float(w))).otherwise(F.lit(0.0))
        return total


def grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """The paths of boosted trees, to inner nodes as well as to leaves."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # midpoints between neighbours, so that a value and its rounding fall on one side
    edges = [np.unique([(e + (v := x[:, j])[v > e].min()) / 2 for e in es if (x[:, j] > e).any()]) for j, es in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        step = np.zeros(len(y))
        todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            if path:
                rules.setdefault(tuple(sorted(path)), None)
            best = (1e-6, -1, 0)
            if len(path) < DEPTH and len(rows) >= 2 * LEAST:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                step[rows] = RATE * g[rows].sum() / (h[rows].sum() + 1)
                continue
            _, j, k = best
            left = binned[rows, j] <= k
            at = float(edges[j][k])
            todo.append((rows[left], (*path, (names[j], "<=", at))))
            todo.append((rows[~left], (*path, (names[j], ">", at))))
        score += step
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, at in rule:
        v = x[:, names.index(name)]
        out &= v <= at if op == "<=" else v > at
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient; the bias is free."""
    a = np.concatenate([r, np.ones((len(r), 1))], 1)
    step = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(a)
        new = z - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def learn_lexicon(text: DataFrame) -> list[str]:
    """Words of the sample that mark toxic documents: seen in enough of them, and rarely elsewhere.
    All of them: their number is bounded by the sample alone."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)))
    n = text.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not n or not n.t or not n.c:
        return []
    seen = text.select("toxic", word.alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    odds = (F.col("t") / n.t) / ((F.col("c") + 0.5) / n.c)
    return sorted(r.word for r in seen.where((F.col("t") >= LEXICON_DOCS) & (odds >= LEXICON_ODDS)).collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model of "good quality and not toxic" from at most ``sample`` labelled documents.

    The sample is the labelled documents least by a hash of their id. Labels with nulls, and those
    whose document is missing or has a null text, don't count; several labels of one document count
    each. Without both kinds of label the model accepts every text.
    """
    lab = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    lab = lab.orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(sample)
    text = only(docs, id_col, text_col).toDF("id", "text").where(F.col("text").isNotNull())
    chosen = durable(text.join(F.broadcast(lab), "id"))
    lexicon = learn_lexicon(chosen)
    stats = derived("__stats")
    marked = measured(chosen, F.col("text"), lexicon, "__stats").where("__stats IS NOT NULL")
    rows = marked.select("id", (F.col("quality") * (1 - F.col("toxic"))).alias("__y"), *[c.alias(k) for k, c in stats.items()]).orderBy("id", "__y").toPandas()
    y = (rows["__y"].to_numpy() > 0).astype(float)
    names = list(stats)
    x = rows[names].to_numpy(float)
    model = Model(lexicon, sample=len(y))
    if len(y) == 0 or y.min() == y.max():
        return model
    rules = grow(x, y, names)
    if not rules:
        return model
    r = np.stack([holds(q, x, names) for q in rules], 1).astype(float)
    w, model.bias = lasso(r, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    model.rules, model.weights = [rules[k] for k in kept], w[kept].tolist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns and ``quality_score``, the probability that a document is good.

    A null or blank text gets null. A column ``quality_score`` of the input is replaced.
    """
    docs = without(docs, "quality_score")
    (name,) = fresh(docs, "__stats")
    base = measured(docs, F.col(f"`{text_col}`"), model.lexicon, name)
    p = 1 / (1 + F.exp(-model.score(name)))
    return base.withColumn("quality_score", F.when(F.col(name).isNotNull(), p)).drop(name)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **how: object) -> DataFrame:
    """The documents whose ``quality_score`` is ``cut`` or more; null and blank texts go.

    Columns stay as they were, with ``quality_score`` added. Repeated rows are judged alike. An
    empty table gives an empty result.
    """
    return score(docs, fit(docs, labels, id_col, text_col, **how), text_col).where(F.col("quality_score") >= cut)
