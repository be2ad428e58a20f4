"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its block elements.  Every node is content or not.
Unary potentials come from a node's tag, names, text and links; a parent and
a child have a potential for agreeing.  Sum-product messages run upward and
then downward, which is exact on a tree, and give each node's marginal; the
text of nodes with a marginal of at least one half is the result.

Weights are learned by maximum pseudo-likelihood (logistic in a node's
features and its neighbours' labels) from labelled pages.  ``train`` takes
any; without any, seeded ones are written by ``labelled_pages``: articles in
different mark-up amid menus, headers, footers, sidebars, notices, adverts,
forms and comments.

Text: character references are decoded, white space within a block becomes
one space, blocks are trimmed and joined by two line feeds in page order; a
line break within a block is white space.  Nothing is dropped by length.

Defined cases: null html counts as empty and gives the empty text; unclosed
or stray tags are repaired as browsers do for paragraphs, list items and
cells; a page that ends within a tag or a comment loses that tag; rows that
repeat an id get a row each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = {t: re.compile(rf"</{t}(?![a-zA-Z0-9:-])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "xmp", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr"))}

_KINDS = [
    "article main", "section div center hgroup", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd dir", "table tbody thead tfoot tr td th caption",
    "nav menu", "header", "footer", "aside", "form fieldset legend button dialog search", "figure figcaption", "address details summary", "body html", "head",
]
_KIND = {t: i for i, kind in enumerate(_KINDS) for t in kind.split()}
_BAD_TAGS = frozenset("nav menu footer aside form button dialog search head".split())
_BAD_NAMES = [
    frozenset(x.split())
    for x in (
        "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar skip toc",
        "foot footer copyright legal colophon",
        "header masthead banner logo topbar branding",
        "side sidebar widget widgets related recommended recommendations popular trending rail more",
        "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner newsletter subscribe subscription share sharing social",
        "comment comments reply replies disqus discussion respond reader readers",
        "cookie cookies consent notice notices alert alerts popup modal overlay gdpr warning message",
        "form search login signin signup register contact",
        "hidden invisible",
    )
]
_GOOD_NAMES = frozenset("article content post entry story main text body prose page".split())
_ROLES = {"navigation": 0, "contentinfo": 1, "banner": 2, "complementary": 3, "search": 7, "form": 7, "alert": 6, "dialog": 6, "alertdialog": 6}
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

N_FEATURES = 1 + len(_KINDS) + 1 + len(_BAD_NAMES) + 2 + 3 + 9


class Node:
    __slots__ = ("bad", "bad_above", "chars", "good", "good_above", "kids", "label", "links", "parent", "rights", "runs", "tag", "total", "total_links")

    def __init__(self, tag: str, parent: int, attributes: str, labelled: bool = False):
        self.tag, self.parent, self.kids, self.runs = tag, parent, 0, 0
        self.chars = self.links = self.total = self.total_links = 0
        self.bad, self.good, self.label, self.rights = 0, False, None, False
        if attributes and tag not in ("body", "html"):
            for name, value in _ATTR.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    before = ""
                    for word in map(str.lower, _SPLIT.split(value)):
                        if before not in ("has", "with", "no", "without"):
                            for i, names in enumerate(_BAD_NAMES):
                                if word in names:
                                    self.bad |= 1 << i
                            self.good |= word in _GOOD_NAMES
                        before = word
                elif name == "role":
                    self.good |= value in ("main", "article")
                    self.bad |= 1 << _ROLES[value] if value in _ROLES else 0
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.bad |= 1 << 8
                elif labelled and name == "data-label":
                    self.label = int(value)


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and the text runs (node, text) in page order; labelled: data-label attributes are labels."""
    nodes, runs = [Node("html", -1, "")], []
    stack, text, anchors, linked = [0], [], 0, 0
    # Where in the stack each tag is open.
    opened: dict[str, list[int]] = {}
    at, end = 0, len(page)

    def flush():
        nonlocal text, linked
        if text:
            run = " ".join("".join(text).split())
            if run:
                node = nodes[stack[-1]]
                node.chars += len(run)
                node.links += min(linked, len(run))
                node.runs += 1
                node.rights |= len(run) < 300 and bool(_RIGHTS.search(run))
                runs.append((stack[-1], run))
            text, linked = [], 0

    def say(piece: str):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if anchors:
                linked += len(piece)

    def nearest(tags) -> int:
        return max((o[-1] for t in tags if (o := opened.get(t))), default=0)

    def shut(depth: int):
        for i in stack[depth:]:
            opened[nodes[i].tag].pop()
        del stack[depth:]

    def close(tags, stops=()):
        """End the nearest open one of ``tags`` and all within it, unless one of ``stops`` lies nearer."""
        depth = nearest(tags)
        if depth and depth > nearest(stops):
            flush()
            shut(depth)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCK:
                if tag == "p":
                    # A stray end of a paragraph is an empty paragraph.
                    flush()
                close((tag,) if tag[0] != "h" or len(tag) != 2 else ("h1", "h2", "h3", "h4", "h5", "h6"), ("table",) if tag in ("td", "th", "tr", "li", "p") else ())
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _RAW and not m[3].endswith("/"):
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            anchors = 1
        elif tag == "body":
            close(("head",))
            flush()
        elif tag == "html":
            continue
        elif tag in _BLOCK:
            flush()
            if tag != "head" and nodes[stack[-1]].tag == "head":
                shut(len(stack) - 1)
            close(("p",), ("table", "button", "td", "th"))
            if tag in _CLOSES:
                for t in _CLOSES[tag][0].split():
                    close((t,), _CLOSES[tag][1])
            if not m[3].endswith("/"):
                parent = stack[-1]
                nodes[parent].kids += 1
                opened.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes))
                nodes.append(Node(tag, parent, m[3], labelled))
            anchors = 0 if tag not in ("button", "li") else anchors
    flush()
    for n in nodes:
        n.total += n.chars
        n.total_links += n.links
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.total += nodes[i].total
        up.total_links += nodes[i].total_links
    for n in nodes:
        above = nodes[n.parent] if n.parent >= 0 else None
        n.bad_above = (above.bad_above if above else False) or n.tag in _BAD_TAGS or n.bad != 0 and not (n.good and n.tag in ("article", "main"))
        n.good_above = (above.good_above if above else False) or n.tag in ("article", "main") or n.good
    return nodes, runs


def unary(nodes: list[Node]) -> np.ndarray:
    """Feature rows of a page's nodes."""
    out = np.zeros((len(nodes), N_FEATURES))
    whole = max(1, nodes[0].total)
    for i, n in enumerate(nodes):
        row = out[i]
        row[0] = 1
        row[1 + _KIND.get(n.tag, len(_KINDS))] = 1
        c = 2 + len(_KINDS)
        for b in range(len(_BAD_NAMES)):
            row[c + b] = n.bad >> b & 1
        c += len(_BAD_NAMES)
        row[c], row[c + 1] = n.good, n.rights
        row[c + 2], row[c + 3], row[c + 4] = n.bad_above, n.good_above, n.bad_above and n.good_above
        c += 5
        row[c] = math.log1p(n.chars) / 4
        row[c + 1] = n.links / n.chars if n.chars else 0
        row[c + 2] = math.log1p(n.total) / 4
        row[c + 3] = n.total_links / n.total if n.total else 0
        row[c + 4] = n.total / whole
        row[c + 5] = n.chars > 80
        row[c + 6] = n.chars == 0
        row[c + 7] = n.total == 0
        row[c + 8] = n.tag == "header" and n.good_above
    return out


class Model:
    """weights: unary log-odds of content; both, neither: log-potentials of a parent and a child that agree."""

    def __init__(self, weights: np.ndarray, both: float, neither: float):
        self.weights, self.both, self.neither = weights, both, neither

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by one upward and one downward sweep of messages."""
        odds = (unary(nodes) @ self.weights).tolist()
        both, neither = math.exp(self.both), math.exp(self.neither)
        # In log-odds a message through an edge is f(z) = log((both e^z + 1) / (e^z + neither)).
        def through(z: float) -> float:
            if z > 0:
                e = math.exp(-min(z, 700))
                return math.log((both + e) / (1 + neither * e))
            e = math.exp(max(z, -700))
            return math.log((both * e + 1) / (e + neither))

        inward, up = odds[:], [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            up[i] = through(inward[i])
            inward[nodes[i].parent] += up[i]
        belief = inward[:]
        for i in range(1, len(nodes)):
            belief[i] += through(belief[nodes[i].parent] - up[i])
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) for z in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = parse(page)
        if not runs:
            return ""
        p = self.marginals(nodes)
        return "\n\n".join(run for node, run in runs if p[node] >= 0.5)


def train(pages: list[str], ridge: float = 0.3, rounds: int = 12) -> Model:
    """Weights from pages whose elements carry data-label="0" or "1"; others take their parent's label."""
    rows, labels = [], []
    for page in pages:
        nodes, _ = parse(page, labelled=True)
        y = np.zeros(len(nodes))
        for i, n in enumerate(nodes):
            y[i] = n.label if n.label is not None else (y[n.parent] if i else 1)
        agree, differ = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, n in enumerate(nodes):
            if i:
                for a, b in ((i, n.parent), (n.parent, i)):
                    agree[a] += y[b]
                    differ[a] += 1 - y[b]
        rows.append(np.column_stack((unary(nodes), agree, -differ)))
        labels.append(y)
    x, y = np.concatenate(rows), np.concatenate(labels)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return Model(w[:-2], float(max(w[-2], 0)), float(max(w[-1], 0)))


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Seeded pages with labels, in the kinds of mark-up that sites use."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        made = ["".join(r.choice(["ka", "lo", "mi", "ten", "ur", "ves", "an", "o"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        return " ".join(made).capitalize() + r.choice([".", ".", "", "!", "?"])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def box(tags: list[str], names: list[str], inner: str, label: int) -> str:
        tag, name = r.choice(tags), r.choice(names)
        attr = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-label="{label}">{inner}</{tag}>'

    def paragraph() -> str:
        inner = words(2, 90)
        if r.random() < 0.3:
            inner = f"<b>{inner}<br>{words(1, 20)}" if r.random() < 0.4 else f'{inner} <a href="#">{words(1, 4)}</a> {words(3, 20)}'
        return f"<p>{inner}" + ("</p>" if r.random() < 0.85 else "")

    def article() -> str:
        parts = [f"<h1>{words(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 8)):
            x = r.random()
            parts.append(
                paragraph() if x < 0.72 else f"<h2>{words(1, 6)}</h2>" if x < 0.8 else "<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
                if x < 0.86 else f"<blockquote>{words(5, 40)}</blockquote>" if x < 0.9 else f"<pre>{words(3, 20)}</pre>" if x < 0.92
                else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 6)}</td></tr></table>" if x < 0.95
                else box(["div", "aside"], ["ad", "advert", "related", "share", "newsletter", "sidebar"], f"<p>{words(2, 25)}</p>", 0)
            )
        if r.random() < 0.12:
            parts.insert(0, f'<header data-label="1">{parts.pop(0)}</header>')
        return box(["article", "article", "main", "div", "section", "div"], ["", "", "content", "post", "article-body", "entry-content", "story", "main"], "".join(parts), 1)

    def page() -> str:
        before = [box(["nav", "nav", "div", "ul"], ["", "menu", "navbar", "main-nav", "breadcrumb"], links(r.randint(2, 8)), 0)] if r.random() < 0.9 else []
        if r.random() < 0.5:
            before.insert(0, box(["header", "header", "div"], ["", "header", "masthead", "site-header"], f"<div>{words(1, 4)}</div>" + (f"<p>{words(2, 12)}</p>" if r.random() < 0.5 else ""), 0))
        if r.random() < 0.5:
            before.append(box(["div"], ["ad", "ads", "advert", "ad-banner", "sponsored"], words(3, 15), 0))
        if r.random() < 0.3:
            before.append(box(["div", "section"], ["cookie-notice", "notice", "alert", "consent-banner", "popup"], f"<p>{words(4, 30)}</p><button>{words(1, 2)}</button>", 0))
        after = []
        if r.random() < 0.4:
            after.append(box(["aside", "aside", "div"], ["", "sidebar", "related", "widget-area", "popular"], f"<h3>{words(1, 3)}</h3>" + links(r.randint(2, 5)) + (f"<p>{words(3, 30)}</p>" if r.random() < 0.6 else ""), 0))
        if r.random() < 0.4:
            one = "".join(box(["div", "li", "article"], ["comment", "comment-body", "reply"], f"<p>{words(3, 60)}</p>", 0) for _ in range(r.randint(1, 4)))
            after.append(box(["section", "div", "ol"], ["comments", "comment-list", "discussion", "reader-comments"], f"<h3>{words(1, 3)}</h3>{one}", 0))
        if r.random() < 0.3:
            after.append(box(["form"], ["", "search", "newsletter", "contact-form"], f"<label>{words(1, 4)}</label><p>{words(2, 12)}</p><input><button>{words(1, 2)}</button>", 0))
        if r.random() < 0.9:
            after.append(box(["footer", "footer", "div"], ["", "footer", "site-footer", "copyright"], f"&copy; {words(1, 6)} {words(0, 20) if r.random() < 0.7 else ''}", 0))
        inner = "".join(before) + article() + "".join(after)
        if r.random() < 0.35:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "has-sidebar"])}" data-label="1">{inner}</div>'
        return f'<html><head data-label="0"><title>{words(2, 8)}</title></head><body data-label="1">{inner}</body></html>'

    return [page() for _ in range(count)]


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    model = model or default_model()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [model.extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "t", "n"])

    some = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(page).alias("h"))
    return some.mapInArrow(run, "k long, u string, t string, n long").toDF(key, url, "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
