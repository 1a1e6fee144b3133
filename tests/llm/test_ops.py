"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables
and columns with clashing names."""

import html
import itertools
import json
import math
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from callweave.llm import bpe, cdc, chat, crf, embed, htmlx, mixing, queries, rules, simhash, tokencount

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()
FOREIGN = ["\u041c\u041e\u0421\u041a\u0412\u0410 \u0438 \u041a\u0438\u0435\u0432. \u0414\u0430! \u0414\u0430!", "\u6f22\u5b57\u3068\u304b\u306a\u3001\u4eba\u3002 123", "\U0001f600\U0001f600 \u2605\u2605\u2605 wow", "\u00ab\u00c9t\u00e9\u00bb | a\u0301 \u2014 \u201cquoted\u201d\nx\nx\n", " . lead, and trail ;", "one", "\u0661\u0662 7 idiot (Idiot) idiots"]
needs_vocab = pytest.mark.skipif(not os.path.exists(bpe.VOCAB), reason="no vocabulary here")


def prose(rng, n, tag=""):
    return " ".join(rng.choice(WORDS) + tag + str(rng.randint(0, 400)) for _ in range(n))


def table(spark, texts, start=0, source="s"):
    return spark.createDataFrame([(i + start, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls in every column, an empty and a blank text, one long text, repeated rows, a null id."""
    long = prose(random.Random(1), 20_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n ", "en", "a", 4), (4, long, "en", "b", len(long)), (5, "one two three", None, None, 13), (5, "one two three", None, None, 13), (None, "four five six", "en", "a", 13), (6, "!!! ???", "en", "b", 7)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1 SimHash


def test_golay_code_is_perfect():
    t = simhash.golay_table()
    assert np.array_equal(np.bincount(t), np.full(4096, 2048))


def test_near_segments_share_a_codeword():
    rng = np.random.default_rng(0)
    t = simhash.golay_table()
    around = np.concatenate([[0], 1 << np.arange(23)])
    for _ in range(500):
        a = int(rng.integers(1 << 23))
        i, j = rng.choice(23, 2, replace=False)
        b = a ^ 1 << int(i) ^ 1 << int(j)
        assert set(t[a ^ around]) & set(t[b ^ around])


def near_corpus(rng):
    texts = []
    for g in range(30):
        base = prose(rng, rng.randint(60, 200), f"g{g}").split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for k in range(max(1, len(copy) // 30)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += [prose(rng, 80, f"x{k}") for k in range(60)]
    rng.shuffle(texts)
    return texts


def brute_groups(texts, keyed=False):
    """The root of each text but roots; where ``keyed``, near texts must share a search key too."""
    fps = [simhash.pack(simhash.fingerprint(t)) for t in texts]
    keys = [set(simhash.search_keys(simhash.fingerprint(t)[None])[1].tolist()) for t in texts] if keyed else None
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= simhash.MAX_BITS and (not keyed or keys[i] & keys[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts)) if find(i) != i}


def test_simhash_against_all_pairs(spark):
    texts = near_corpus(random.Random(4))
    want = brute_groups(texts)
    got = {r.doc_id: r.kept_doc_id for r in simhash.duplicates(table(spark, texts)).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.9 * len(want) and len(want) > 40
    kept = {r.doc_id for r in simhash.dedup(table(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - set(got)


def test_simhash_of_names_and_clashing_columns(spark):
    texts = near_corpus(random.Random(5))[:120]
    names = {f"d{i:03}": t for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in names.items()], "doc_id string, text string, __drop int, head int")
    plain = {(f"d{r.doc_id:03}", f"d{r.kept_doc_id:03}") for r in simhash.duplicates(table(spark, texts)).collect()}
    assert {tuple(r) for r in simhash.duplicates(docs).collect()} == plain and plain
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len(plain)


def test_large_keys_are_compared_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 300).split()
    texts = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(120)] + [prose(rng, 80, f"x{k}") for k in range(40)]
    want = brute_groups(texts)
    assert len(want) > 100
    monkeypatch.setattr(simhash, "PART", 8)
    monkeypatch.setattr(simhash, "THIN", 1)
    got = {r.doc_id: r.kept_doc_id for r in simhash.duplicates(table(spark, texts)).collect()}
    assert got == want


def test_simhash_finds_pairs_without_a_shared_key(spark):
    rng = random.Random(12)
    texts = []
    for g in range(60):
        base = prose(rng, 60, f"g{g}").split()
        texts += [" ".join(base), " ".join([f"edit{g}x{k}" for k in range(3)] + base[3:])]
    want = brute_groups(texts)
    assert len(set(want) - set(brute_groups(texts, keyed=True))) > 3
    docs = table(spark, texts)
    assert {r.doc_id: r.kept_doc_id for r in simhash.duplicates(docs).collect()} == want
    # the second pass alone, over several tiles
    fps = simhash.fingerprints(docs).repartition(12).selectExpr("id AS root", "fp")
    edges = simhash.missed(fps, len(texts), tile=40, least=8)
    assert {r.id: r.root for r in simhash.components(edges).collect() if r.id != r.root} == want


def test_bridges_join_what_all_pairs_join():
    rng = np.random.default_rng(9)

    def flipped(of, n):
        bits = of.copy()
        bits[rng.choice(276, n, replace=False)] ^= 1
        return bits

    base = rng.integers(0, 2, (300, 276))
    bits = np.concatenate([base, [flipped(b, int(rng.integers(30, 50))) for b in base], np.repeat(base[:1], 300, 0)])
    bits[600:, :9] ^= rng.integers(0, 2, (300, 9))
    packed = simhash.pack(bits.reshape(-1, 12, 23) @ (1 << np.arange(23)))
    distance = np.bitwise_count(packed[:, None] ^ packed).sum(2)
    for most in (0, 5, 40, 41):
        want = simhash.join(np.arange(900), *np.nonzero(distance <= most))
        half = np.arange(900) % 2 == 0
        for sides in ((half, half), (half, ~half), (~half, ~half)):
            names, rows = [np.flatnonzero(s) for s in sides], [packed[s] for s in sides]
            u, v = np.nonzero(distance[np.ix_(*sides)] <= most)
            assert np.array_equal(simhash.join(np.arange(900), *simhash.bridges(names, rows, most)), simhash.join(np.arange(900), names[0][u], names[1][v]))
        # members of one group need no edge
        assert not len(simhash.bridges([want, want], [packed, packed], most)[0])
    assert (distance[np.arange(300), np.arange(300, 600)] == 40).any()


def test_links_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 46, (4, 6))
    packed = np.concatenate([b ^ (1 << rng.integers(0, 46, (20, 6))) for b in base])
    ids = rng.permutation(80)
    a, b = simhash.links(ids, packed, 14)
    group = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        group[y] = group.get(x, x)
    parts = defaultdict(set)
    for i in ids.tolist():
        parts[group.get(i, i)].add(i)
    assert sorted(map(len, parts.values())) == [20] * 4


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys([100, 101, 102], 100)


def test_simhash_odd_rows(spark):
    docs = odd(spark).withColumn("id", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("fp", F.lit(2))
    assert simhash.duplicates(docs).count() == 0
    assert simhash.dedup(docs).count() == 8
    assert simhash.dedup(docs).columns == docs.columns
    assert simhash.duplicates(docs.limit(0)).count() == 0
    twice = table(spark, ["same words here", "same words here", "", None])
    assert [tuple(r) for r in simhash.duplicates(twice).collect()] == [(1, 0)]


# 2 CRF


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(40):
        f = crf.Field(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        u = rng.normal(size=(rng.integers(1, 9), 2))
        score = lambda p: f.first[p[0]] + sum(u[i, y] for i, y in enumerate(p)) + sum(f.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(u)), key=score)
        assert tuple(crf.viterbi(u, f)) == best


def test_training_raises_the_likelihood_of_structure():
    rng = np.random.default_rng(6)
    docs = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 4), 5)
        x = np.stack([np.where(rng.random(20) < 0.8, y, 1 - y), np.full(20, 7)], 1)
        docs.append((x, y))
    f = crf.train(docs, rounds=120)
    alone = linked = 0
    for x, y in docs:
        u = f.emit[x].sum(1)
        alone += (u.argmax(1) == y).mean()
        linked += (crf.viterbi(u, f) == y).mean()
    assert linked > alone and linked / 60 > 0.85


def junk(rng):
    return "\n".join(" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(12)) for _ in range(6))


def marked(spark, n=60):
    rng = random.Random(8)
    good = ["\n".join(prose(rng, 15).capitalize() + "." for _ in range(6)) for _ in range(n)]
    bad = [junk(rng) for _ in range(n)]
    docs = table(spark, good + bad)
    return docs, labels(spark, [(i, int(i < n), 0) for i in range(0, 2 * n, 2)])


def test_crf_keeps_content(spark):
    docs, lab = marked(spark)
    kept = {r.doc_id for r in crf.keep(docs, lab).collect()}
    assert kept == set(range(60))


def brute_features(text):
    """The lines of a text with the feature numbers of each, counted line by line."""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:] * (lines[-1] != "")
    out = []
    for line in lines:
        kind = [unicodedata.category(c) for c in line]
        shown = [c for c in line if not regex.match(r"\s", c)]
        words = [w for w in regex.split(r"\s+", line) if w]
        symbols = sum(k[0] not in "LN" and not regex.match(r"\s", c) and c not in ".," for c, k in zip(line, kind, strict=True))
        body = line[:-1] if line.endswith("\n") and len(line) > 1 else line
        per = lambda a, b: a / b if b else 0.0
        value = {
            "chars": len(line), "words": len(words), "word_length": per(len(shown), len(words)), "upper": per(kind.count("Lu"), len(shown)), "symbols": per(symbols, len(shown)), "digits": per(sum(k[0] == "N" for k in kind), len(shown)),
            "same_word": per(sum(a == b for a, b in zip(words, words[1:])), len(words)), "new_words": per(len(set(words)), len(words)), "copies": lines.count(line), "ends": float(body[-1] in ".!?"),
        }
        out.append((len(line), [crf.OFFSETS[k] + sum(value[k] >= e for e in edges) for k, edges in crf.EDGES.items()]))
    return out


def brute_share(text, f):
    """Lines, content lines and content share, by the best of the labels of all lines."""
    rows = brute_features(text)
    best = {0: (0.0, ()), 1: (0.0, ())}
    for n, (_, feats) in enumerate(rows):
        u = [sum(f.emit[k, y] for k in feats) for y in (0, 1)]
        best = {y: max(((best[x][0] + (f.step[x, y] if n else f.first[y]) + u[y], (*best[x][1], y)) for x in ((0, 1) if n else (y,))), key=lambda b: b[0]) for y in (0, 1)}
    labels_ = max(best.values(), key=lambda b: b[0])[1]
    size = [n for n, _ in rows]
    content = [n for n, y in zip(size, labels_, strict=True) if y == crf.CONTENT]
    return len(rows), len(content), sum(content) / sum(size)


def test_line_query_against_loops(spark, sf):
    """``op2_crf`` over a whole table, and foreign signs, against features and labels by loops."""
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    f = crf.fit(d, lab)
    texts = {r.doc_id: r.text for r in d.collect() if r.text}
    want = {i: brute_share(t, f) for i, t in texts.items()}
    got = {r.doc_id: (r.n_lines, r.content_lines, r.content_share) for r in queries.op2_crf(spark, sf).collect()}
    keep = {i for i, w in want.items() if w[2] >= crf.MIN_SHARE}
    assert set(got) == keep and len(keep) < len(texts)
    assert all(got[i] == pytest.approx(want[i]) for i in keep)
    odd_texts = [*FOREIGN, "\n\n a\n", "x\u00a0y\u2003z\n\n", "\n"]
    rows = crf.shares(table(spark, odd_texts), f).orderBy("doc_id").collect()
    assert [(r.n_lines, r.content_lines, r.content_share) for r in rows] == [pytest.approx(brute_share(t, f)) for t in odd_texts]


def test_spliced_lines_are_found(spark):
    """Documents of good quality with one of bad quality in their midst, none of them trained on. Some
    lines of bad documents are prose, so a part counts as found with four fifths of its signs."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    f = crf.fit(d, lab.where("doc_id % 2 = 0"))
    rest = d.join(lab.where("doc_id % 2 = 1"), "doc_id").where("toxic = 0").orderBy("doc_id").select("quality", "text").collect()
    good = [r.text for r in rest if r.quality == 1 and r.text.count("\n") >= 3]
    bad = [r.text for r in rest if r.quality == 0 and len(r.text) < 2000]
    found, errors, content, n = 0, 0, 0, min(len(good), len(bad), 60)
    assert n >= 20
    for g, b in zip(good[:n], bad[:n], strict=True):
        lines = g.rstrip("\n").split("\n")
        k = len(lines) // 2
        text = "\n".join([*lines[:k], b.rstrip("\n"), *lines[k:]])
        truth = np.array([0] * k + [1] * (b.rstrip("\n").count("\n") + 1) + [0] * (len(lines) - k))
        _, size, feats = crf.lines_of([text])
        y = crf.viterbi(f.emit[feats].sum(1), f)
        errors += int((y[truth == 0] == 1).sum())
        content += len(lines)
        found += size[(y == 1) & (truth == 1)].sum() >= 0.8 * size[truth == 1].sum()
    assert found >= 0.9 * n and errors <= 0.02 * content


def test_crf_odd_rows(spark):
    docs, lab = marked(spark)
    f = crf.fit(docs, lab)
    rows = crf.shares(odd(spark).withColumn("content_share", F.lit("clash")), f).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].content_share is None and by[2].content_share is None and by[2].n_lines == 0
    assert by[4].content_share == 1.0 and by[4].n_lines == 1 and by[3].n_lines == 2
    assert crf.shares(docs.limit(0), f).count() == 0
    nobody = crf.fit(docs, labels(spark, [(None, 1, 0), (3, None, 0)]))
    assert nobody.sample == 0 and crf.shares(docs, nobody).where("content_share < 1").count() == 0


# 3 chat


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node int, parent int, role string, text string, score double")


def brute_paths(rows):
    nodes = {(t, n): (p, s or 0.0) for t, n, p, *_, s in rows if t is not None and n is not None}
    kids = defaultdict(list)
    for (t, n), (p, _) in nodes.items():
        if (t, p) in nodes:
            kids[t, p].append(n)
    out = set()

    def go(t, path, total):
        if not kids[t, path[-1]]:
            out.add((t, path, round(total / len(path), 9)))
        for k in kids[t, path[-1]]:
            go(t, (*path, k), total + nodes[t, k][1])

    for (t, n), (p, s) in nodes.items():
        if (t, p) not in nodes:
            go(t, (n,), s)
    return out


def test_paths_against_recursion(spark):
    rng = random.Random(9)
    rows = [(t, n, rng.choice([None, *range(1, n)]) if n > 1 else None, rng.choice(["user", "assistant", None]), f"t{n}", rng.choice([0.5, 0.25, None, 1.0])) for t in range(6) for n in range(1, 14)]
    got = {(r.tree, tuple(r.nodes), round(r.score, 9)) for r in chat.paths(tree(spark, rows)).collect()}
    assert got == brute_paths(rows)


def test_repeated_nodes_count_once(spark):
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 2, "user", "b", 0.5)]
    want = [tuple(r) for r in chat.conversations(tree(spark, rows)).collect()]
    more = [rows[0], rows[0], rows[1], (1, 2, 1, "assistant", "other", 0.7), (1, 3, 2, "user", "b", 0.5)]
    assert [tuple(r) for r in chat.conversations(tree(spark, rows + more)).collect()] == want


def test_deep_trees_take_few_steps(spark):
    rows = [(1, n, n - 1 or None, "user", f"t{n}", 1.0) for n in range(1, 201)] + [(2, n, n % 7 + 1, "user", "x", 1.0) for n in range(1, 8)]
    leaves, steps = chat.climb(chat.single(tree(spark, rows)))
    assert [tuple(r) for r in leaves.collect()] == [(1, 200, 200, 1.0)] and len(steps) <= 10
    assert chat.conversations(tree(spark, rows)).first().conversation.count(chat.END) == 200


def test_chat_ranks_and_formats(spark):
    rows = [(1, 1, None, "user", "hi ", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", None, 0.5), (1, 4, 3, None, "", None), (2, 1, 9, "system", "s", None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (None, 1, None, "user", "x", 1.0), (4, None, None, "user", "x", 1.0)]
    out = chat.conversations(tree(spark, rows).withColumn("branch", F.lit("clash")), top=1).orderBy("tree").collect()
    assert [(r.tree, r.leaf, r.branch) for r in out] == [(1, 2, 1), (2, 1, 1)]
    assert out[0].conversation == "<|user|>\nhi\n<|end|>\n<|assistant|>\na\n<|end|>"
    both = chat.conversations(tree(spark, rows)).where("tree = 1 AND branch = 2").first()
    assert both.conversation.endswith("<|assistant|>\n\n<|end|>\n<|user|>\n\n<|end|>")
    assert chat.conversations(tree(spark, [])).count() == 0


def test_threads_of_odd_turns(spark):
    c = spark.createDataFrame([(1, 0, "user", "a a b"), (1, 0, "user", "a a b"), (1, 0, None, None), (1, 1, "assistant", " "), (None, 0, "user", "x"), (1, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = [(r.node, r.parent, r.role, r.score) for r in chat.threads(c).orderBy("node").collect()]
    assert got == [(1, None, None, 0.0), (2, 1, "user", 2 / 3), (3, 2, "assistant", 0.0)]


# 4 HTML


def page(body, cls="post-17"):
    return f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>menu one</a></li></ul></nav><script>var t='</p>';</script><div class='{cls}'><p>{body}<p>{body} &amp; more<br>again</div><div class=ad>buy <b>now</b></div><footer>me</footer></body></html>"


def test_html_follows_the_host(spark):
    text = prose(random.Random(1), 40)
    rows = [(i, f"http://Blog.example.com:80/{i}", page(text, f"post-{i} main")) for i in range(5)]
    # the page's own best would be its long advertisement; the host knows better
    long_ad = page("short").replace("buy <b>now</b>", "<p>" + text * 3 + "</p>").replace("post-17", "main post-9")
    rows += [(9, "http://blog.example.com/9", long_ad)]
    got = {r.page_id: r for r in htmlx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.path == "html>body>div.main.post" and r.consensus and r.host == "blog.example.com" for r in got.values())
    assert got[9].text == "short\nshort & more\nagain"
    assert got[0].text == f"{text}\n{text} & more\nagain"


def test_html_keeps_the_text_after_open_and_empty_elements():
    say = lambda page: htmlx.tidy(htmlx.walk(page)[0])
    for top in ("<head><title>t</title><meta a=b>", "<head><title>t</title></head>", "<head><style>x</style><title>t</title><body>", "<head>"):
        assert say(f"<html>{top}<div><p>main text</div>") == "main text"
    assert say("<head><title>t</title>plain") == "plain" and say("<head><title>t</title></head>plain") == "plain"
    for mark in ("<svg a='b'/>", "<svg/>", "<noscript>", "<template>", "<svg>"):
        assert say(f"<p>one</p>{mark}<p>two</p>") == "one\ntwo"
    assert say("<p>a<svg><text>no</text></svg>b<script>no</script>c<noscript>no</noscript>") == "abc"


def test_html_paths_below_deep_nesting():
    inline = "<body>" + "<b>" * 300 + "<div class=main><p>text</div><div class=side>x</div>"
    paths = {b[0] for b in htmlx.walk(inline)[1]}
    assert len(paths) == 3 and paths == {b[0] for b in htmlx.walk(inline)[1]}
    deep = "<body><div class=outer>" + "<section>" * 300 + "in" + "</section>" * 300 + "<p>still outer</p></div>"
    boxes = htmlx.walk(deep)[1]
    assert len(boxes) == 302 and boxes[1][0] == "body>div.outer" and boxes[1][3] == len("in" + "stillouter")


class Page(HTMLParser):
    """Pieces of a page, each with its chain of open elements, and its containers, by the standard
    library's parser. For pages whose only open ends are those of p, b, body and html."""

    HELD = ("body", "div", "article", "main", "section", "td")
    BLOCKS = ("p", "div", "article", "main", "section", "li", "ul", "ol", "h1", "h2", "h3", "table", "blockquote", "pre", "header", "footer", "nav", "aside", "form")

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.stack, self.pieces, self.held = [], [], []
        self.feed(page)
        self.close()
        while self.stack:
            self.leave()

    def leave(self):
        node = self.stack.pop()
        if node["tag"] in self.HELD:
            node["stop"] = len(self.pieces)

    def handle_starttag(self, tag, attrs):
        if tag in (*self.BLOCKS, "br"):
            self.pieces.append(("\n", []))
        if tag in ("br", "meta", "img", "link", "hr", "input"):
            return
        if tag in self.BLOCKS:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k]["tag"] == "p":
                    while len(self.stack) > k:
                        self.leave()
                    break
                if self.stack[k]["tag"] in (*self.HELD, "ul"):
                    break
        names = sorted({re.sub("[0-9]+", "", c).strip("-_") for c in (dict(attrs).get("class") or "").split()} - {""})
        path = (self.stack[-1]["path"] + ">" if self.stack else "") + ".".join([tag, *names])
        self.stack.append({"tag": tag, "path": path, "start": len(self.pieces)})
        if tag in self.HELD:
            self.held.append(self.stack[-1])

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.pieces.append(("\n", []))
        if any(n["tag"] == tag for n in self.stack):
            while self.stack[-1]["tag"] != tag:
                self.leave()
            self.leave()

    def handle_data(self, data):
        if not any(n["tag"] in ("head", "script", "style") for n in self.stack):
            self.pieces.append((data, [n["tag"] for n in self.stack]))

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def worth(self, box):
        inside = [(len(re.sub("[ \n]", "", t)), chain) for t, chain in self.pieces[box["start"] : box["stop"]]]
        share = lambda *tags: sum(n for n, chain in inside if set(tags) & set(chain))
        n, links, chrome, paras = sum(n for n, _ in inside), share("a"), share("nav", "footer", "header", "aside", "form", "button"), share("p")
        return paras + 0.25 * (n - paras) - 1.5 * (links + chrome) - 0.5 * max(0, n - paras - links - chrome)

    def best(self):
        good = [(self.worth(b), b) for b in self.held]
        top = max((w for w, _ in good if w > 0), default=None)
        own = [b for w, b in good if w == top]
        return (top, max(own, key=lambda b: (b["start"], -b["stop"]) if b["start"] >= own[0]["start"] and b["stop"] <= own[0]["stop"] else (-1, 0))) if own else None

    def text(self, boxes):
        out = []
        for b in boxes:
            raw = "".join(t if t == "\n" and not chain else html.unescape(t).replace("\n", " ") for t, chain in self.pieces[b["start"] : b["stop"]])
            lines = [re.sub("[ \t]+", " ", x).strip() for x in raw.split("\n")]
            out.append("\n".join(x for x in lines if x))
        return "\n".join(x for x in out if x)


def test_html_query_against_another_parser(spark, sf):
    """``op4_html`` over a whole table: votes, winning paths, and the texts along them."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    pages = {r.page_id: (re.match(r"\w+://([^/?#:]+)", r.url)[1].lower(), Page(r.html)) for r in rows}
    votes, score = defaultdict(Counter), defaultdict(float)
    for host, page in pages.values():
        if best := page.best():
            votes[host][best[1]["path"]] += 1
            score[host, best[1]["path"]] += best[0]
    win = {h: sorted(v, key=lambda p: (-v[p], -round(score[h, p], 3), -len(p), p))[0] for h, v in votes.items()}
    got = queries.op4_html(spark, sf).collect()
    assert len(got) == len(rows) > 0
    for r in got:
        host, page = pages[r.page_id]
        on = [b for b in page.held if b["path"] == win[host]]
        own = on or [page.best()[1]]
        assert (r.host, r.path, r.consensus) == (host, own[0]["path"], bool(on)), r.page_id
        assert r.text == page.text(own), r.page_id


def test_html_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "nonsense", "just text < and & more"), (4, "http://a.b/", "<div><p>un</div>closed <!-- x"), (4, "http://a.b/", "<div><p>un</div>closed <!-- x"), (5, "http://a.b/", "<div>" * 3000 + "deep"), (None, "http://a.b/", "<p>no id</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    got = htmlx.extract(docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text is None and by[2].text == "" and by[3].text == "just text < and & more" and by[3].host == ""
    assert by[4].text.startswith("un") and by[None].text == "no id" and by[5].text == "deep"
    assert htmlx.extract(docs.limit(0)).count() == 0


# 5 mixing


def test_tree_gives_every_block_once():
    blocks = np.array([17, 0, 5, 40, 1])
    for shards in (1, 2, 7, 16):
        parts = [mixing.shard_part(s, blocks, shards, 3) for s in range(shards)]
        for k in range(len(blocks)):
            taken = [b for first, n in parts for b in range(first[k], first[k] + n[k])]
            assert sorted(taken) == list(range(blocks[k]))
        sizes = [int(n.sum()) for _, n in parts]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 63


def test_tree_is_hypergeometric():
    """The first of two shards against drawing half of an urn, many times."""
    blocks, n = np.array([6, 2]), 4000
    got = Counter(int(mixing.shard_part(0, blocks, 2, seed)[1][1]) for seed in range(n))
    for k in range(3):
        p = math.comb(2, k) * math.comb(6, 4 - k) / math.comb(8, 4)
        assert abs(got[k] / n - p) < 0.03


def test_mixture_is_exact(spark):
    docs = table(spark, [f"a{i}" for i in range(900)], 0, "a").union(table(spark, [f"b{i}" for i in range(300)], 1000, "b")).union(table(spark, [f"c{i}" for i in range(50)], 2000, "c"))
    out = mixing.mix(docs, {"a": 2, "b": 1, "d": 4}, block=8, shard_blocks=4, bucket=64).collect()
    assert Counter(r.source for r in out) == {"a": 600, "b": 300}
    assert len({r.doc_id for r in out}) == 900
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    assert len(shards) == -(-113 // 4)
    for rows in shards.values():
        assert sorted(r.shard_pos for r in rows) == list(range(len(rows))) and len(rows) <= 32
    again = mixing.mix(docs.repartition(7), {"a": 2, "b": 1, "d": 4}, block=8, shard_blocks=4, bucket=64).collect()
    assert {(r.doc_id, r.shard, r.shard_pos) for r in out} == {(r.doc_id, r.shard, r.shard_pos) for r in again}
    other = mixing.mix(docs, {"a": 2, "b": 1}, block=8, shard_blocks=4, seed=99).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in out}


def brute_layout(rows, quota, block, shard_blocks, seed):
    """The shard and place of each row of (source, hash, order hash, id), from the whole tree at once."""
    names = sorted(quota, key=lambda s: (s is None, str(s)))
    blocks = np.array([-(-quota[s] // block) for s in names])
    shards = -(-int(blocks.sum()) // shard_blocks)
    size = [int(blocks.sum()) // shards + (k < int(blocks.sum()) % shards) for k in range(shards)]
    owner = {}

    def part(lo, hi, count, first):
        if hi - lo == 1:
            owner.update({(k, b): lo for k in range(len(names)) for b in range(first[k], first[k] + count[k])})
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(count, sum(size[lo:mid]), method="marginals")
        part(lo, mid, left, first)
        part(mid, hi, count - left, first + left)

    part(0, shards, blocks, np.zeros(len(names), int))
    held = defaultdict(list)
    for k, s in enumerate(names):
        for rank, (h, order, i) in enumerate(sorted(r[1:] for r in rows if r[0] == s)[: quota[s]]):
            held[owner[k, rank // block]].append((order, k, rank, i))
    return {(i, shard, pos) for shard, v in held.items() for pos, (*_, i) in enumerate(sorted(v))}


def test_layout_against_the_whole_tree(spark):
    docs = table(spark, [f"a{i}" for i in range(700)], 0, "a").union(table(spark, [f"b{i}" for i in range(210)], 1000, "b")).union(table(spark, [f"c{i}" for i in range(40)], 2000, None))
    h = mixing.row_hash(docs, 5)
    rows = [tuple(r) for r in docs.select("source", h.alias("h"), F.xxhash64(F.lit(6), h), "doc_id").collect()]
    want = brute_layout(rows, mixing.quotas({"a": 700, "b": 210, None: 40}, {"a": 5, "b": 2, None: 1}), 8, 4, 5)
    got = mixing.mix(docs, {"a": 5, "b": 2, None: 1}, block=8, shard_blocks=4, bucket=64, seed=5)
    assert {(r.doc_id, r.shard, r.shard_pos) for r in got.collect()} == want and len(want) > 300


def test_mixture_query_against_the_whole_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    h = mixing.row_hash(docs, mixing.SEED)
    rows = [tuple(r) for r in docs.select("source", h.alias("h"), F.xxhash64(F.lit(mixing.SEED + 1), h), "doc_id").collect()]
    counts = Counter(r[0] for r in rows)
    want = brute_layout(rows, mixing.filled(counts, mixing.target_weights(counts)), mixing.BLOCK, mixing.SHARD_BLOCKS, mixing.SEED)
    assert {(r.doc_id, r.shard, r.shard_pos) for r in queries.op5_mixing(spark, sf).collect()} == want


def test_mixing_carries_columns_of_any_name(spark):
    docs = table(spark, [f"a{i}" for i in range(50)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in ("k", "h", "__k", "__row", "bucket", "rank", "start", "row")})
    out = mixing.mix(docs, {"s": 1})
    assert out.columns == [*docs.columns, "shard", "shard_pos"] and out.count() == 50
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in ("k", "h", "__k", "__row", "bucket", "rank", "start", "row"))


def test_mixing_odd_rows(spark):
    docs = odd(spark).withColumn("shard", F.lit("clash")).withColumn("extra", F.lit(1))
    out = mixing.mix(docs, {"a": 1, "b": 1, None: 1})
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "shard", "shard_pos"]
    assert Counter(r.source for r in out.collect()) == {"a": 2, "b": 2, None: 2}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {}).count() == 0
    assert mixing.mix(docs).count() > 0


def test_tiny_sources_do_not_shrink_the_mixture(spark):
    even = {f"s{i}": 500 for i in range(20)}
    for tiny in ({"t": 1}, {None: 1}, {"t": 1, None: 3}):
        counts = even | tiny
        assert mixing.filled(counts, mixing.target_weights(counts)) == counts
    counts = {"a": 1_000_000, "b": 100_000, "c": 1}
    got = mixing.filled(counts, mixing.target_weights(counts))
    assert got["b"] == 100_000 and got["c"] == 1 and abs(got["a"] / 100_000 - 10**0.8) < 1e-4
    many = {"big": 90_000} | {f"t{i}": 10 for i in range(1000)}
    assert sum(mixing.filled(many, mixing.target_weights(many)).values()) >= 50_000
    docs = table(spark, [f"a{i}" for i in range(300)], 0, "a").union(table(spark, ["one"], 300, None)).union(table(spark, ["two"], 301, "b"))
    assert Counter(r.source for r in mixing.mix(docs).collect()) == {"a": 300, "b": 1, None: 1}


# 6 token counts


@pytest.fixture(scope="module")
def codec():
    if not os.path.exists(bpe.VOCAB):
        pytest.skip("no vocabulary here")
    with open(bpe.VOCAB, "rb") as f:
        return bpe.Codec(f.read())


SIGNS = "  \n\t'''srevmlltd.,!aéZ12²日🎉 \n  "


def test_edits_against_encoding_again(codec):
    rng = random.Random(5)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 500))) for _ in range(150)] + ["", " ", prose(rng, 900)]
    for t in tokencount.build(texts, codec):
        for _ in range(5):
            n = len(t.text)
            s = rng.randint(0, n + 2)
            e = s + rng.choice([0, 0, 3, 200])
            new = "".join(rng.choices(SIGNS, k=rng.choice([0, 1, 2, 40])))
            want = t.text[: min(s, n)] + new + t.text[min(e, n) :] if e < n else t.text[: min(s, n)] + new
            t.edit(codec, s, e, new)
            assert t.text == want
            codes, zero = bpe.code_points([want])
            borders = bpe.pretokens(codes, zero).tolist() if want else []
            assert (np.cumsum(t.sizes) - t.sizes).tolist() == borders and int(t.sizes.sum()) == len(want)
            assert all(int(level.sum()) == t.total for level in t.levels) and all(int(level.sum()) == len(want) for level in t.chars)
            assert all(len(part) == size.sum() and len(size) == len(count) > 0 for part, size, count in t.leaves)
            assert t.total == len(codec.encode(want))


def test_small_edit_of_a_long_text_is_local(codec):
    t = tokencount.build([prose(random.Random(2), 20_000)], codec)[0]
    t.edit(codec, 60_000, 60_003, "xyz")
    assert t.encoded < 10


@needs_vocab
def test_kept_state_follows_rounds_of_edits(spark, codec, tmp_path):
    """Edits of a few rows of a written table, twice, against encoding their texts anew."""
    rng = random.Random(15)
    texts = {f"d{i}": prose(rng, rng.randint(0, 300)) for i in range(40)} | {"none": None, "empty": ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    tokencount.state(docs).write.parquet(f"{tmp_path}/0")
    kept = spark.read.parquet(f"{tmp_path}/0")
    for turn in range(2):
        edits = {k: [(rng.randint(0, 400), rng.randint(0, 400), prose(rng, rng.randint(0, 4))) for _ in range(3)] for k in rng.sample(sorted(texts), 12)}
        table_of = spark.createDataFrame([(k, v) for k, v in edits.items()], "doc_id string, edits array<struct<start:int,end:int,text:string>>")
        new = tokencount.apply_edits(kept.join(table_of, "doc_id"))
        rows = {r.doc_id: r for r in new.collect()}
        assert set(rows) == set(edits)
        for k, r in rows.items():
            if texts[k] is None:
                assert r.text is None and r.tokens is None and r.sizes is None
                continue
            before = len(codec.encode(texts[k]))
            for s, e, t in edits[k]:
                n = len(texts[k])
                texts[k] = texts[k][: min(s, n)] + t + texts[k][max(min(e, n), min(s, n)) :]
            assert r.text == texts[k] and r.tokens == len(codec.encode(texts[k])) == tokencount.unpacked(r.counts).sum() and r.tokens_before == before
            assert tokencount.unpacked(r.sizes).sum() == len(texts[k])
        kept.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.select(*kept.columns)).write.parquet(f"{tmp_path}/{turn + 1}")
        kept = spark.read.parquet(f"{tmp_path}/{turn + 1}")
    assert tokencount.apply_edits(kept.limit(0).withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))).count() == 0


def test_packed_numbers():
    for x in ([], [0, 1, 255], [3, 256], [70_000, 2]):
        assert tokencount.unpacked(tokencount.packed(np.array(x, np.int64))).tolist() == x


@needs_vocab
def test_recount_odd_rows(spark):
    docs = tokencount.with_edits(odd(spark).withColumn("edits", F.lit(1)).withColumn("tokens_before", F.lit("clash")))
    rows = tokencount.recount(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and by[1].tokens_after is None and by[2].tokens_before == 0 and by[2].tokens_after > 0
    none = odd(spark).withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))
    assert all(r.tokens_before == r.tokens_after and not r.reencoded for r in tokencount.recount(none).collect())
    nulls = table(spark, ["some words"]).withColumn("edits", F.expr("array(null, struct(cast(null as int) as start, 4 as end, cast(null as string) as text))"))
    assert tokencount.recount(nulls).first().tokens_after == 1
    assert tokencount.recount(docs.limit(0)).count() == 0


@needs_vocab
def test_recount_query_against_encoding_again(spark, sf, codec):
    docs = tokencount.with_edits(spark.read.parquet(f"{sf}/documents.parquet"))
    src = {r.doc_id: r for r in docs.collect()}
    for r in tokencount.recount(docs).collect():
        text = src[r.doc_id].text
        assert r.tokens_before == len(codec.encode(text))
        for e in src[r.doc_id].edits:
            text = text[: e.start] + e.text + text[e.end :]
        assert r.tokens_after == len(codec.encode(text)) and r.reencoded <= r.pretokens + 30


# 7 substring dedup


def brute_repeats(texts, min_words=cdc.MIN_WORDS):
    """The spans to cut of each text by its number, from a table of all chunks: each run of chunks
    with an earlier place is followed in the whole of the texts that have them first."""
    blank = " \n\t"
    first, spans = {}, {}
    chunks = {i: [(0 if k == 0 else int(c[k - 1]), int(c[k])) for k in range(len(c))] for i, t in enumerate(texts) if t for c in [cdc.cuts(t)]}
    for i in sorted(chunks):
        for s, e in chunks[i]:
            first.setdefault(texts[i][s:e], (i, s))

    def outward(t, a, b, u, d):
        """The longest whole words around t[a:b] that u has too, d signs further on."""
        p, q = a, b
        while p > 0 and p + d > 0 and t[p - 1] == u[p + d - 1]:
            p -= 1
        while q < len(t) and q + d < len(u) and t[q] == u[q + d]:
            q += 1
        free = lambda x, k: k <= 0 or k >= len(x) or x[k - 1] in blank or x[k] in blank
        while p < b and not (free(t, p) and free(u, p + d)) and t[p] not in blank:
            p += 1
        while 0 < p < b and t[p] in blank and t[p - 1] not in blank:
            p += 1
        while q > a and not (free(t, q) and free(u, q + d)) and t[q - 1] not in blank:
            q -= 1
        return p, q

    for i in sorted(chunks):
        runs, run = [], []
        for s, e in [*chunks[i], (None, None)]:
            if s is not None and first[texts[i][s:e]] != (i, s):
                run.append((s, e))
                continue
            if run:
                runs.append(run)
            run = []
        for run in runs:
            a, b = run[0][0], run[-1][1]
            ends = [outward(texts[i], a, b, texts[j], at - s) for s, e in run for j, at in [first[texts[i][s:e]]]]
            p, q = min(p for p, _ in ends), max(q for _, q in ends)
            if len(re.findall(r"[^ \n\t]+", texts[i][p:q])) >= min_words:
                old = spans.setdefault(i, [])
                if old and p <= old[-1][1]:
                    old[-1] = (old[-1][0], max(q, old[-1][1]))
                else:
                    old.append((p, q))
    return {i: [(p, q - p) for p, q in v] for i, v in spans.items()}


def test_cuts_resist_shifts():
    t = prose(random.Random(3), 600)
    a, b = cdc.cuts(t), cdc.cuts("Inserted. " + t)
    assert len(set(a.tolist()) & {x - 10 for x in b.tolist()}) > 0.95 * len(a)


def test_repeats_against_brute_force(spark):
    rng = random.Random(11)
    passage = [prose(rng, 70, "p") for _ in range(4)]
    texts = [prose(rng, 80, f"d{i}") + rng.choice(["\n", " ", " é日 "]) + rng.choice(passage) + " " + prose(rng, 30, f"e{i}") for i in range(40)]
    texts += [texts[0], "", None, "short", "short"]
    want = brute_repeats(texts)
    docs = table(spark, texts)
    got = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in cdc.changed(docs).collect()}
    assert got == want and len(want) > 30
    for r in cdc.changed(docs).collect():
        left, at = "", 0
        for s, n in want[r.doc_id]:
            left, at = left + texts[r.doc_id][at:s], s + n
        assert r.text == left + texts[r.doc_id][at:] and r.removed_chars == len(texts[r.doc_id]) - len(r.text)
    whole = {r.doc_id: r.text for r in cdc.dedup(docs).collect()}
    assert len(whole) == len(texts) and whole[len(texts) - 5] == "" and all(whole[i] == texts[i] for i in whole if i not in want)


def test_chunks_in_very_many_places(spark, monkeypatch):
    rng = random.Random(12)
    passage = prose(rng, 45, "p")
    texts = [f"{prose(rng, 20, f'd{i}')} {passage} {prose(rng, 20, f'e{i}')}" for i in range(60)]
    want = brute_repeats(texts)
    assert len(want) == 59
    monkeypatch.setattr(cdc, "PLACES", 8)
    monkeypatch.setattr(cdc, "THIN", 1)
    for names in (range(60), [f"n{i:02}" for i in range(60)]):
        kind = "long" if isinstance(names, range) else "string"
        docs = spark.createDataFrame([(n, t, 1, 2) for n, t in zip(names, texts, strict=True)], f"doc_id {kind}, text string, __id int, __spans int")
        rows = cdc.changed(docs).collect()
        assert {names.index(r.doc_id): [(s.start, s.length) for s in r.spans] for r in rows} == want
        assert all(names[0] in r.first_doc_ids for r in rows)
    assert cdc.dedup(docs).columns == docs.columns and cdc.dedup(docs).count() == 60


def test_query_cuts_what_brute_force_cuts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {rows[i].doc_id: v for i, v in brute_repeats([r.text for r in rows]).items()}
    got = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in queries.op7_substring_dedup(spark, sf).collect()}
    assert got == want and want


def test_cdc_odd_rows(spark):
    docs = odd(spark).withColumn("id", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("digest", F.lit(2))
    assert cdc.dedup(docs).columns == docs.columns and cdc.dedup(docs).count() == 8
    assert cdc.changed(docs).count() == 0 and cdc.changed(docs.limit(0)).count() == 0 and cdc.dedup(docs.limit(0)).count() == 0
    line = prose(random.Random(1), 40) + "\n"
    assert cdc.changed(table(spark, [line * 3])).first().text == line


def test_repeated_rows_lose_what_one_row_would(spark):
    rng = random.Random(21)
    passage = prose(rng, 56, "p")
    texts = ["\n".join([prose(rng, 40, "a"), passage, prose(rng, 40, "b")]), "\n".join([prose(rng, 40, "c"), passage, prose(rng, 40, "d")]), "\n".join([prose(rng, 90, "e"), passage])]
    once = table(spark, texts[:2])
    want = {r.doc_id: (r.spans, r.removed_chars, r.text) for r in cdc.changed(once).collect()}
    assert list(want) == [1]
    got = cdc.changed(once.union(once.where("doc_id = 1"))).collect()
    assert [(r.spans, r.removed_chars, r.text) for r in got] == [want[1]] * 2
    shared = once.union(table(spark, texts[2:], 1))  # a second text under id 1
    texts_of = sorted(r.text for r in cdc.changed(shared).collect())
    assert len(texts_of) == 2 and all(passage[20:-60] not in t for t in texts_of)
    assert cdc.dedup(shared).count() == 3 and sorted(r.text for r in cdc.dedup(shared).where("doc_id = 1").collect()) == texts_of


def test_short_inline_passages_are_cut_to_their_ends(spark):
    """51-word passages between unrelated words, against the words that were put in."""
    rng = random.Random(31)
    want, texts = {}, []
    for i in range(150):
        passage = prose(rng, 51, f"p{i}x")
        before, after = prose(rng, 20, f"l{i}x"), prose(rng, 20, f"r{i}x")
        texts += [f"{prose(rng, 15, f'a{i}x')} {passage} {prose(rng, 15, f'b{i}x')}", f"{before} {passage} {after}"]
        want[2 * i + 1] = f"{before} {after}"
    texts += [None, "", texts[1]]
    docs = table(spark, texts)
    got = {r.doc_id: r.text for r in cdc.changed(docs).collect()}
    caught = [i for i in want if i in got]
    assert len(caught) >= 0.99 * len(want) and all(got[i] == want[i] for i in caught) and set(got) <= set(want) | {302}
    assert got[302] == ""
    left = docs.union(spark.createDataFrame([(None, "no id", "en", "s", 5)], DOCS))
    whole = cdc.dedup(left)
    assert whole.columns == docs.columns
    rows = {r.doc_id: r.text for r in whole.collect()}
    assert len(rows) == len(texts) + 1 and rows[None] == "no id" and all(rows[i] == got.get(i, t) for i, t in enumerate(texts))


# 8 BPE


def test_encoding_against_plain_merging(codec):
    rng = random.Random(7)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 60))) for _ in range(800)] + ["", "a" * 500, "word's it'll 'tis we've", "\ud800 lone"]
    flat, n, count, words = codec.encode_batch(texts)
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends.tolist(), n.tolist(), strict=True):
        ids = flat[e - k : e]
        assert ids.tolist() == bpe.merge_words(codec, t).tolist()
        assert codec.decode_bytes(ids) == t.encode("utf-8", "surrogatepass")
    assert int(words.sum()) == len(count) and int(count.sum()) == len(flat)


def test_merging_against_the_definition(codec):
    rng = random.Random(8)
    for _ in range(300):
        w = "".join(rng.choices("theanrgoi é", k=rng.randint(1, 24))).encode()
        parts = [bytes([b]) for b in w]
        while True:
            ranked = [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert codec.merge(w) == [codec.ranks[p] for p in parts]


def test_encoding_against_a_public_library(codec):
    import base64

    import tiktoken

    public = pytest.importorskip("public_tokenizers")
    with open(bpe.VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for t in ["".join(rng.choices(SIGNS + "theandor", k=rng.randint(0, 80))) for _ in range(500)]:
        assert codec.encode(t).tolist() == enc.encode_ordinary(t)


def test_small_memory_gives_the_same(codec):
    with open(bpe.VOCAB, "rb") as f:
        tiny = bpe.Codec(f.read(), cache_words=50)
    for k in range(6):
        t = [prose(random.Random(k), 200)]
        assert np.array_equal(tiny.encode_batch(t)[0], codec.encode_batch(t)[0])


@needs_vocab
def test_bpe_odd_rows(spark):
    docs = odd(spark).withColumn("token_ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    out = bpe.encode(docs)
    rows = out.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and by[1].token_ids is None and by[1].lossless is None and by[2].token_ids == [] and by[2].n_tokens == 0 and by[2].lossless
    assert all(r.lossless for r in rows if r.doc_id != 1)
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert bpe.encode(docs.limit(0)).count() == 0


# 9 embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_classes(rows):
    """Of each row of (id, vector), by its place: the least id of its component, and its links."""
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= embed.THRESHOLD
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[k][0], min(rows[j][0] for j in seen), int(near[k].sum()) - 1))
    return sorted(out)


def cloud(rng):
    """Spread vectors, a chain, a ball within reach of itself, looser groups, and copies."""
    spread = rng.normal(size=(150, 12))
    ball = rng.normal(size=12) + 0.01 * rng.normal(size=(150, 12))
    loose = np.repeat(rng.normal(size=(12, 12)), 10, axis=0) + 0.3 * rng.normal(size=(120, 12))
    angle = np.arange(12) * 0.4
    chain = np.zeros((12, 12))
    chain[:, 3], chain[:, 7] = np.cos(angle), np.sin(angle)
    every = np.concatenate([spread, ball, loose, chain, ball[:20], spread[:7]])
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(every)), every.astype(np.float32), strict=True)]


@pytest.mark.parametrize(("block", "tile"), [(16, 4), (64, 16), (8192, 512)])
def test_classes_against_all_pairs(spark, block, tile):
    rows = cloud(np.random.default_rng(3))
    want = brute_classes(rows)
    assert len({c for _, c, _ in want}) < len(rows) - 200 and max(n for *_, n in want) > 100
    got = embed.classes(vectors(spark, rows), block=block, tile=tile, step=4).collect()
    assert sorted(tuple(r) for r in got) == want


def test_classes_of_names_and_clashing_columns(spark):
    rows = [(f"v{i:03}", v) for i, v in cloud(np.random.default_rng(4))[:200]]
    t = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id string, embedding array<double>, h int, s string, links double")
    got = embed.classes(t, block=32, tile=8).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows)


def test_suffix_bound_saves_work():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    *_, work = embed.compare(x, x, 0.9)
    assert work < 0.4 * 400 * 400 * 64


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [float("inf"), 1.0])]
    t = vectors(spark, rows).withColumn("id", F.lit("clash")).withColumn("x", F.lit(1))
    assert sorted(tuple(r) for r in embed.classes(t).collect()) == [(1, 1, 2), (2, 1, 2), (2, 1, 2)]
    assert embed.classes(t.limit(0)).count() == 0
    assert embed.classes(t.where("vec_id = 5")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert sorted(tuple(r) for r in embed.classes(one).collect()) == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]
    for parts in (1, 2):  # also within one batch
        with pytest.raises(Exception, match="different lengths"):
            embed.classes(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]).repartition(parts, "vec_id"))


# 10 rules


def test_lasso_is_sparse_and_right():
    rng = np.random.default_rng(4)
    r = (rng.random((800, 12)) < 0.5).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(4 * r[:, 3] - 2)))).astype(float)
    w, _ = rules.lasso(r, y, 0.02)
    assert w[3] > 1 and (np.abs(np.delete(w, 3)) < 0.2).all() and (w == 0).sum() >= 6


def brute_statistics(text, lexicon):
    """The numbers that rules name, counted sign by sign and word by word."""
    blank, stop = " \t\n\x0b\f\r", ".,;:!?"
    kind = [unicodedata.category(c) for c in text]
    words, word = [], ""
    for c in text.lower() + "\0":
        if c == "\0" or c in blank + stop:
            words.append(word)
            word = ""
        else:
            word += c
    # an empty word stands at the start and the end only
    words = [w for k, w in enumerate(words) if w or (k == 0 and text[:1] and text[0] in blank + stop) or (k == len(words) - 1 and text[-1:] and text[-1] in blank + stop)]
    runs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(" ")
    lines = text.split("\n")
    n, m = len(text), len(words)
    symbols = sum(k[0] not in "LN" and c not in blank + ".," for c, k in zip(text, kind, strict=True))
    return {
        "words": m, "word_length": n / m, "upper": kind.count("Lu") / n, "symbols": symbols / n, "bars": text.count(" | ") / m, "digits": sum(c in "0123456789" for c in text) / n,
        "stops": sum(a in ".!?" and b in blank for a, b in zip(text, text[1:])) / m, "new_words": len(set(words)) / m, "new_lines": len(set(lines)) / len(lines), "lexicon": sum(r in lexicon for r in runs),
    }


def test_statistics_and_scores_against_loops(spark):
    docs, lab = marked(spark)
    m = rules.fit(docs, lab)
    assert m.rules
    m.lexicon = ["idiot"]
    texts = FOREIGN + [r.text for r in docs.limit(40).collect()]
    stats = rules.derived("__stats")
    base = rules.measured(table(spark, texts), F.col("text"), m.lexicon, "__stats")
    for r in base.select("text", m.score("__stats").alias("got"), *[c.alias(k) for k, c in stats.items()]).collect():
        want = brute_statistics(r.text, m.lexicon)
        assert {k: r[k] for k in stats} == pytest.approx(want), r.text
        score = m.bias
        for rule, w in zip(m.rules, m.weights, strict=True):
            score += w * all(want[k] <= at if op == "<=" else want[k] > at for k, op, at in rule)
        assert abs(r.got - score) < 1e-9


def test_query_scores_every_document_as_loops_do(spark, sf):
    """``op10_rules`` over a whole table: fitted once, each document scored again in Python."""
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = rules.fit(d, lab)
    got = {r.doc_id: r.quality_score for r in queries.op10_rules(spark, sf).collect()}
    want = {}
    for r in d.collect():
        if r.text and not r.text.isspace():
            x = brute_statistics(r.text, set(m.lexicon))
            want[r.doc_id] = 1 / (1 + math.exp(-m.bias - sum(w for rule, w in zip(m.rules, m.weights, strict=True) if all(x[k] <= at if op == "<=" else x[k] > at for k, op, at in rule))))
    assert got == pytest.approx({k: v for k, v in want.items() if v >= rules.CUT})


def test_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    scored = rules.score(d, rules.fit(d, train)).join(test, "doc_id").select((F.col("quality_score") >= rules.CUT).alias("kept"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert np.mean([r.kept == r.good for r in scored]) > 0.9
    assert np.mean([r.kept for r in scored if r.good]) > 0.97


def test_lexicon_words_count_wherever_they_stand(spark):
    texts = ["a \"idiot\" (idiot) *idiot* idiot-like #idiot Idiot, trash### idiots", "idiot", "idiotic", "\u00c9\u0391\u0416a \u00ab\u20ac\u00bb"]
    stats = [r[0] for r in rules.measured(table(spark, texts), F.col("text"), ["idiot", "trash"], "__stats").orderBy("doc_id").select(rules.derived("__stats")["lexicon"]).collect()]
    assert stats == [7, 1, 0, 0]
    upper, symbols = rules.measured(table(spark, texts[3:]), F.col("text"), [], "__stats").select("__stats.upper", "__stats.symbols").first()
    assert (upper, symbols) == (3 / 8, 3 / 8)


def test_rules_odd_rows(spark):
    docs, lab = marked(spark)
    m = rules.fit(docs, lab)
    rows = rules.score(odd(spark).withColumn("quality_score", F.lit("clash")).withColumn("words", F.lit(1)), m).collect()
    by = {r.doc_id: r.quality_score for r in rows}
    clash = odd(spark).withColumn("__stats", F.lit("mine"))
    assert rules.score(clash, m).columns == [*clash.columns, "quality_score"] and {r["__stats"] for r in rules.score(clash, m).collect()} == {"mine"}
    assert len(rows) == 8 and by[1] is None and by[2] is None and by[3] is None and 0 <= by[4] <= 1
    assert rules.keep(docs.limit(0), lab).count() == 0
    same = rules.fit(docs, labels(spark, [(2, 1, 0), (None, 0, 0), (999, 0, 0), (3, None, 1)]))
    assert same.rules == [] and rules.score(docs, same).where("quality_score < 0.5").count() == 0
    none = rules.fit(docs, lab.limit(0))
    assert rules.score(docs, none).where("quality_score < 0.5").count() == 0


# pipeline


@needs_vocab
def test_pipeline_stages_on_a_small_table(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        rows = stage(spark, docs, sf).collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= seen, name
        if k < len(p.STAGES) - 1:
            assert list(rows[0].asDict()) == p.COLUMNS
            docs = spark.createDataFrame(rows, DOCS)
        seen = set(ids)
    assert all(r.lossless for r in rows)
    assert {r.doc_id for r in p.run(spark, sf).collect()} == seen


def plain_tokens(codec, text):
    """Every pre-token of the public pattern, merged by the definition."""
    pieces = regex.findall(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)
    assert "".join(pieces) == text
    return [int(t) for p in pieces for t in codec.merge(p.encode())]


@needs_vocab
def test_encoding_query_against_plain_merging(spark, sf, codec):
    """``op8_bpe`` over a whole table."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.lossless and r.n_tokens == len(r.token_ids) and list(r.token_ids) == plain_tokens(codec, texts[r.doc_id])


@needs_vocab
def test_pipeline_against_brute_force(spark, sf, codec, tmp_path):
    """Every stage again by loops, on what the loops before it kept. Some of the documents share a
    passage here."""
    import corpus_pipeline as p

    given = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    long = [r for r in given if len(r.text.split()) > 200]
    passage = " ".join(long[0].text.split()[20:80])
    shared = {r.doc_id: r.text[: r.text.find(" ", 300)] + " " + passage + r.text[r.text.find(" ", 300) :] for r in long[1:9]}
    spark.createDataFrame([(r.doc_id, shared.get(r.doc_id, r.text), r.lang, r.source, r.n_chars) for r in given], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = rules.fit(d, lab)
    docs = {}
    for r in d.collect():
        x = brute_statistics(r.text, set(m.lexicon)) if r.text and not r.text.isspace() else None
        if x and 1 / (1 + math.exp(-m.bias - sum(w for rule, w in zip(m.rules, m.weights, strict=True) if all(x[k] <= at if op == "<=" else x[k] > at for k, op, at in rule)))) >= rules.CUT:
            docs[r.doc_id] = r
    ids = sorted(docs)
    gone = brute_groups([docs[i].text for i in ids], keyed=True)
    assert len(gone) >= 0.9 * len(brute_groups([docs[i].text for i in ids]))
    ids = [i for k, i in enumerate(ids) if k not in gone]
    cut = {ids[k]: v for k, v in brute_repeats([docs[i].text for i in ids]).items()}
    texts = {}
    for i in ids:
        texts[i] = docs[i].text
        for at, n in reversed(cut.get(i, [])):
            texts[i] = texts[i][:at] + texts[i][at + n :]
    left = spark.createDataFrame([(i, texts[i], docs[i].lang, docs[i].source, docs[i].n_chars) for i in ids], d.schema)
    h = mixing.row_hash(left, mixing.SEED)
    rows = [tuple(r) for r in left.select("source", h.alias("h"), F.xxhash64(F.lit(mixing.SEED + 1), h), "doc_id").collect()]
    counts = Counter(r[0] for r in rows)
    drawn = brute_layout(rows, mixing.filled(counts, mixing.target_weights(counts)), mixing.BLOCK, mixing.SHARD_BLOCKS, mixing.SEED)
    want = {i: plain_tokens(codec, texts[i]) for i, _, _ in drawn}
    got = {r.doc_id: list(r.token_ids) for r in p.run(spark, sf).collect()}
    assert len(ids) < len(docs) < d.count() and cut and set(got) == set(want)
    assert [i for i in want if got[i] != want[i]] == []


@needs_vocab
def test_pipeline_on_odd_documents(spark, sf):
    import corpus_pipeline as p

    docs = odd(spark).withColumns({n: F.lit("clash") for n in ("__stats", "__drop", "tag", "k", "shard", "id", "spans", "quality_score")})
    for k, (name, stage) in enumerate(p.STAGES):
        rows = stage(spark, docs, sf).collect()
        kept = sorted((r.doc_id for r in rows), key=str)
        if name == "quality":
            assert not {1, 2, 3} & set(kept) and set(kept) <= {4, 5, 6, None}, name
        elif name == "mixture":  # a draw: the quotas of the sources exactly, and no row twice
            counts = Counter(r.source for r in docs.collect())
            assert Counter(r.source for r in rows) == mixing.filled(counts, mixing.target_weights(counts)), name
            assert not Counter(kept) - Counter(r.doc_id for r in docs.collect()), name
        else:
            assert kept == sorted((r.doc_id for r in docs.collect()), key=str), name
        if k < len(p.STAGES) - 1:
            assert rows[0].asDict().keys() == dict.fromkeys(p.COLUMNS).keys()
            text = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == text[r.doc_id] for r in rows), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
