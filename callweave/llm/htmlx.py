"""Main text of web pages by consensus of each host.

Every page's containers are scored by the text that they hold. Their paths, with tags and classes
but without numbers, are votes; votes of all pages of a host are counted in Spark, and the pages are
extracted again along the winning path. A page without that path falls back on its own best.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import durable, map_arrow

#: Comments, elements whose content is no text, and tags. A comment, script or style without an
#: end runs to the end of the page; the other elements count as tags then, or when self-closed.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<skip>noscript|template|svg)\b[^>]*(?<!/)>.*?</(?P=skip)\s*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div article main section td".split())
BREAKS = frozenset("p div article main section li ul ol h1 h2 h3 h4 h5 h6 tr table blockquote pre td br header footer nav aside form dl dt dd".split())
#: Elements whose text counts against the containers around them.
CHROME = frozenset("nav footer header aside form button".split())
#: An open p ends before these.
ENDS_P = BREAKS - {"br", "td"}
NAME = re.compile(r"[0-9]+")
SPACES = re.compile(r"[ \t\r\f\v]+")
BLANKS = re.compile(r"\s*\n\s*")
#: Hosts with their paths are sent to all tasks up to this size; then pages need not move.
BROADCAST_BYTES = 32 << 20
#: Tags that do not end an open head.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: Paths of more tags are named by a running digest.
DEEPEST = 200


def step(tag: str, attrs: str) -> str:
    """A tag with its sorted classes, numbers left out."""
    m = CLASS.search(attrs) if attrs else None
    if not m:
        return tag
    names = sorted({NAME.sub("", c).strip("-_") for c in (m[1] or m[2] or m[3] or "").split()} - {""})
    return ".".join([tag, *names])


def walk(page: str) -> tuple[list[str], list[list]]:
    """The text pieces of a page, and its containers: path, first and last piece, letters of text,
    of them in links, of them in navigation and the like, and in paragraphs."""
    pieces: list[str] = []
    boxes: list[list] = []
    stack: list[tuple[str, int]] = []  # tag, box or -1
    open_boxes: list[int] = []
    path: list[str] = []  # of each open tag, the path to it, or its digest
    live: Counter[str] = Counter()  # open tags by name
    head = title = False
    links = chrome = paras = at = 0

    def text(s: str) -> None:
        if s:
            n = len(s) - s.count(" ") - s.count("\n")
            if n:
                s = html.unescape(s) if "&" in s else s
                pieces.append(SPACES.sub(" ", s.replace("\n", " ")))
                if open_boxes:
                    b = boxes[open_boxes[-1]]
                    b[3] += n
                    b[4] += n if links else 0
                    b[5] += n if chrome else 0
                    b[6] += n if paras else 0
            else:
                pieces.append(" ")

    def leave() -> None:
        nonlocal links, chrome, paras
        tag, box = stack.pop()
        path.pop()
        live[tag] -= 1
        links -= tag == "a"
        chrome -= tag in CHROME
        paras -= tag == "p"
        if box >= 0:
            open_boxes.pop()
            b = boxes[box]
            b[2] = len(pieces)
            if open_boxes:
                up = boxes[open_boxes[-1]]
                for k in (3, 4, 5, 6):
                    up[k] += b[k]

    for m in TOKEN.finditer(page):
        tag = m["tag"] and m["tag"].lower()
        before, at = page[at : m.start()], m.end()
        if head and (before.isspace() or title or not before) and (tag is None or tag in HEAD):
            title = tag == "title" and not m["end"] or (title and tag != "title")
            head = not (tag == "head" and m["end"])
            continue
        if not (head and title):
            text(before)
        head = title = False
        if tag is None:
            continue
        if tag == "head":
            head = not m["end"]
            continue
        if tag in BREAKS:
            pieces.append("\n")
        if m["end"]:
            if not live[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        leave()
                    break
                if stack[i][0] in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if (tag in ENDS_P and live["p"]) or (tag in ("li", "tr", "td") and (live["p"] or live[tag])):
            # an open p, li, tr or td of the same container ends here
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or (name == tag and tag in ("li", "tr", "td")):
                    while len(stack) > i:
                        leave()
                    break
                if name in CONTAINERS or name in ("ul", "ol", "table"):
                    break
        box = -1
        own = step(tag, m["attrs"])
        whole = f"{path[-1]}>{own}" if path else own
        path.append(whole if len(path) < DEEPEST else "#" + blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
        if tag in CONTAINERS:
            box = len(boxes)
            boxes.append([path[-1], len(pieces), 0, 0, 0, 0, 0])
            open_boxes.append(box)
        stack.append((tag, box))
        live[tag] += 1
        links += tag == "a"
        chrome += tag in CHROME
        paras += tag == "p"
    if not (head and title):
        text(page[at:])
    while stack:
        leave()
    return pieces, boxes


def worth(box: list) -> float:
    """The score of a container: its running text, less what navigation, links and loose text take."""
    _, _, _, n, links, chrome, paras = box
    loose = max(0, n - paras - links - chrome)
    return paras + 0.25 * (n - paras) - 1.5 * (links + chrome) - 0.5 * loose


def tidy(pieces: list[str]) -> str:
    return BLANKS.sub("\n", SPACES.sub(" ", "".join(pieces))).strip()


def best_box(boxes: list[list]) -> list | None:
    """The container of greatest score, of equals the innermost and first; None if none is positive."""
    top = None
    for b in boxes:
        if (w := worth(b)) > 0 and (top is None or w > top[0] or (w == top[0] and b[1] >= top[1][1] and b[2] <= top[1][2])):
            top = (w, b)
    return top[1] if top else None


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without port; empty when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path``, ``votes`` and ``score``: each page with a container of positive score votes
    for the path of its best; ``score`` sums theirs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = best_box(walk(page)[1])
            if own:
                hosts.append(host)
                paths.append(own[0])
                scores.append(worth(own))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    src = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where(F.col("html") != "")
    cast = map_arrow(src, run, "host string, path string, score double")
    return cast.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winners(voted: DataFrame) -> DataFrame:
    """``host`` and ``path``: most votes; of equals the greater score, the longer path, then by name."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("score", 3)), F.desc(F.length("path")), "path")
    return voted.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, ``host``, ``path``, ``consensus`` (whether the page has its host's path) and ``text``.

    One row for each input row. Pages with an unreadable or null address share the host "". All
    containers on the winning path are joined, in order. A null page gives a null text, a page
    without text, or without a container that scores, what text it has outside of scripts. Other
    columns are not read; repeated rows vote and return each; an empty table gives an empty result.
    """
    best = durable(winners(votes(pages, url_col, html_col)).withColumnRenamed("path", "__win"))
    size = best.agg(F.sum(F.length("host") + F.length("__win") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else a join by host, whose large hosts the session's skew join splits
        best = F.broadcast(best)
    src = pages.select(F.col(f"`{id_col}`").alias("__id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("__html"))
    joined = src.join(best, "host", "left").select("__id", "host", "__html", "__win")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out_path, agreed, texts = [], [], []
        for page, win in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if page is None:
                out_path.append(None)
                agreed.append(False)
                texts.append(None)
                continue
            pieces, boxes = walk(page)
            on = [b for b in boxes if b[0] == win]
            own = best_box(boxes) if not on else None
            out_path.append(win if on else own[0] if own else None)
            agreed.append(bool(on))
            texts.append("\n".join(filter(None, (tidy(pieces[b[1] : b[2]]) for b in on))) if on else tidy(pieces[own[1] : own[2]] if own else pieces))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_path, pa.string()), pa.array(agreed, pa.bool_()), pa.array(texts, pa.string())], names=[id_col, "host", "path", "consensus", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_arrow(joined, run, f"`{id_col}` {kind}, host string, path string, consensus boolean, text string")
