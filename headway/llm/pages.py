"""Main text of web pages by consensus of host paths.

Each page scores its containers and votes for the generalised tag-class path of the best one; Spark adds
up the votes of a host and the path with the most weight wins. The pages are then read again with the
winning path of their host. The body takes part in the vote; where it wins, each page keeps its own best
container. So does a page where less than half of that container's weight lies on the winning path: a
page of another template, say, whose teaser shares the path.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headway.llm import text as tx
from headway.session import materialise

_RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|math|canvas|title"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*?)>", re.S | re.I)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul"
    .split())
_CONTAINER = frozenset("article body center div main section td".split())
_FURNITURE = frozenset("aside button footer form head menu nav dialog".split())
#: Names of classes, ids and roles that mark furniture, whole words between dashes and underscores.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary"
    " contentinfo cookie cookies consent disqus footer gdpr masthead menu menubar modal nav navbar navigation"
    " newsletter notice notices overlay pager pagination popup promo promoted recommended related replies reply"
    " search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar widget"
    " widgets".split())
#: Of these, what readers wrote; other words yield to a class that names the text itself.
_READERS_WORDS = frozenset("comment comments disqus replies reply".split())
_TEXT_WORDS = frozenset("article body content entry main post story text".split())
#: Longer paths continue with their digest, so that deep nesting costs no more than its depth.
_LONGEST_PATH = 1000
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_TOP_TAGS = frozenset(("article", "main"))


@dataclass
class Node:
    path: str
    tag: str
    parent: int
    first: int            # blocks from here
    last: int = -1        # up to here


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised tag and classes, and whether they name furniture.

    A class that only names the text, such as ``post`` or ``entry-content``, outweighs one like ``share-enabled``.
    """
    found, words, text = [], set(), False
    for m in _CLASS.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for token in value.split():
            parts = {w for w in re.split(r"[_-]+", token) if w}
            words |= parts
            text = text or bool(parts) and parts <= _TEXT_WORDS
        if m[1].lower() == "class":
            found += value.split()
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in found})
    named = not words.isdisjoint(_FURNITURE_WORDS)
    return ".".join([tag, *classes]), named and not (text and words.isdisjoint(_READERS_WORDS))


def parse(source: str) -> Page:
    """Blocks of text outside furniture, and the containers they lie in.

    Where class names would leave nothing of a page, only its tags tell what furniture is.
    """
    page = _parse(source, True)
    return page if page.blocks else _parse(source, False)


def _parse(source: str, by_name: bool) -> Page:
    page, text, links = Page(), [], 0
    open_links = open_tops = 0
    stack: list[tuple[str, int, bool, str]] = []     # tag, node, in furniture, path
    page.nodes.append(Node("", "html", -1, 0))

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                page.blocks.append(block)
                page.linked.append(min(links, len(block)))
            text.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal open_links, open_tops
        while len(stack) > k:
            tag, node, _, _ = stack.pop()
            open_links -= tag == "a"
            open_tops -= tag in _TOP_TAGS
            if node >= 0:
                page.nodes[node].last = len(page.blocks)

    def add(piece: str) -> None:
        nonlocal links
        if piece and not (stack and stack[-1][2]):
            text.append(piece)
            if open_links:
                links += len(piece)

    at = 0
    for m in _TAG.finditer(source):
        add(source[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[0] in _BLOCK for s in stack[k:]):
                        flush()
                    close(k)
                    break
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in _CONTAINER or stack[k][0] in ("table", "ul", "ol", "dl"):
                    break
        above, path = (stack[-1][2], stack[-1][3]) if stack else (False, "")
        node = -1
        label, named = _label(tag, m[4]) if m[4] and m[4].strip() else (tag, False)
        furniture = above or tag in _FURNITURE or (tag == "header" and not open_tops) \
            or (by_name and named and tag not in ("html", "body", *_TOP_TAGS))
        if tag in _BLOCK and tag not in ("html", "body"):
            path = f"{path}>{label}" if len(path) < _LONGEST_PATH \
                else f"{hashlib.md5(path.encode('utf-8', 'surrogatepass')).hexdigest()}>{label}"
        if tag in _CONTAINER and not furniture:
            parent = next((s[1] for s in reversed(stack) if s[1] >= 0), 0)
            node = len(page.nodes)
            page.nodes.append(Node(path, tag, parent, len(page.blocks)))
        open_links += tag == "a"
        open_tops += tag in _TOP_TAGS
        stack.append((tag, node, furniture, path))
    add(source[at:])
    flush()
    close(0)
    page.nodes[0].last = len(page.blocks)
    return page


def scores(page: Page) -> list[float]:
    """Weight of each container: its text less twice its links, more in an article or main element.

    A container that merely wraps another one weighs nothing.
    """
    own = [0.0] * (len(page.blocks) + 1)
    for k, block in enumerate(page.blocks):
        own[k + 1] = own[k] + max(0, len(block) - 2 * page.linked[k])
    weights = [(own[n.last] - own[n.first]) * (1.3 if n.tag in _TOP_TAGS else 1.0) for n in page.nodes]
    out = list(weights)
    for k in range(len(page.nodes) - 1, 0, -1):
        parent = page.nodes[k].parent
        # An inner container with nine tenths of the text stands for the outer one.
        if weights[k] > 0 and weights[k] >= 0.9 * weights[parent]:
            out[parent] = 0.0
    return out


def _best(page: Page) -> int:
    weights = scores(page)
    return max(range(len(weights)), key=lambda k: (weights[k], -k))


def _within(nodes: list[Node]) -> list[int]:
    """Blocks of the containers, each once."""
    out, upto = [], 0
    for n in nodes:
        out += range(max(n.first, upto), n.last)
        upto = max(upto, n.last)
    return out


def extract(source: str, path: str | None) -> str:
    page = parse(source)
    best = page.nodes[_best(page)]
    own, keep = _within([best]), _within([n for n in page.nodes if n.path == path] if path else [])

    def weight(blocks: list[int]) -> int:
        return sum(max(0, len(page.blocks[k]) - 2 * page.linked[k]) for k in blocks)

    if not keep or 2 * weight(keep) < weight(own):
        keep = own
    return "\n".join(page.blocks[k] for k in keep)


def _votes(batches):
    for batch in tx.slices(batches):
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(source or "")
            k = _best(page)
            weight = sum(len(b) for b in page.blocks[page.nodes[k].first:page.nodes[k].last])
            if weight:
                rows.append((host, page.nodes[k].path, min(weight, 10_000)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["host", "path", "weight"])


def _texts(batches):
    for batch in tx.slices(batches, text=2):
        found = [extract(h, p) for h, p in zip(
            pc.fill_null(batch.column(2), "").to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()),
             pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host. A page's weight in the vote is bounded, its text is not."""
    votes = _plain(pages).select("host", "html").mapInArrow(_votes, "host string, path string, weight long")
    totals = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return totals.groupBy("host").agg(F.max_by("path", F.struct("weight", "path")).alias("path"))


def _plain(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(pages["url"].cast("string"), F.lit(""))),
                            r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        pages["html"].cast("string").alias("html"), host.alias("host"))


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty markup gives an empty text. Pages without a host share one vote. Rows that repeat an
    id are read each. An empty table gives no rows.
    """
    winners = materialise(host_paths(pages), "host-paths")
    rows = _plain(pages).join(winners.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host"), "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long")
