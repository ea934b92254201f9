"""Main-text extraction: gradient-boosted trees over DOM nodes, then hierarchical decoding.

A page becomes a tree of block elements with its text runs as leaves. Every node is
described by its subtree's density, its attribute tokens, depth and siblings; the trees
give the log-odds that it holds main text. Decoding picks the labelling of highest
likelihood in which a node is kept only if its parent is, so an ancestor and a descendant
never contradict each other. The runs kept, in page order, are the text.

The trees are Spark ML's, trained on a bounded sample of pages (``SAMPLE_PAGES``): as they
are, where a page marks its article, and set anew into varied templates with the menus,
notices, sidebars, adverts, forms and reader comments that pages have. Their nodes (about
``TREES`` x 31) are what is sent to the tasks; every page is read whole, in one scan.
"""
from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import written

SAMPLE_PAGES = 300
SAMPLE_CHARS = 200_000
#: Templates that each sampled page's text is set into.
TEMPLATES = 3
TREES, TREE_DEPTH = 20, 4
#: Pages scored together inside a task.
BATCH = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SPACE = re.compile(r"\s+")

BLOCKS = frozenset("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside
form fieldset table thead tbody tfoot tr td th caption pre blockquote figure figcaption address details summary dialog
center hgroup search menu""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements left out up to their closing tag. Without one, code goes on to the end of the page; of
#: the others only the tag is left out.
CODE = frozenset("script style".split())
SKIPPED = CODE | frozenset("title noscript template svg iframe select textarea".split())
_CLOSING = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in SKIPPED}
#: What an opening tag closes, up to the nearest container of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Attribute tokens (of class, id, role) by what they say of an element.
GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "head": "header masthead topbar banner logo brand",
    "foot": "footer colophon copyright bottom",
    "side": "sidebar aside widget widgets rail complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall announcement",
    "form": "form search login signup newsletter subscribe subscription contact",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback",
    "more": "share sharing social related recommended recommendations tags meta byline trending popular",
}
MAIN = frozenset("article main content post entry story text body".split())
#: Tokens that say where or how, not what: "comment-list" is comments, "contact-history" is history.
STRUCTURE = frozenset("""wrapper wrap container box block area section inner outer list item items slot unit panel row
col column group holder region zone module bar links left right top main body content text""".split())
_GROUP_OF = {t: g for g, ts in GROUPS.items() for t in ts.split()}
_TAG_GROUP = {"nav": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form",
              "dialog": "notice", "search": "form", "menu": "nav"}
_GROUP_NAMES = [*GROUPS]
_TAGS = ["html", "body", "article", "main", "section", "div", "p", "h", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "td"]
_TAG_NO = {t: i for i, t in enumerate(_TAGS)} | {f"h{i}": 7 for i in range(1, 7)} | {"ol": 8, "dl": 8, "dt": 9, "dd": 9, "th": 16, "tr": 15}
FEATURES = 14 + len(_TAGS) + 2 * len(_GROUP_NAMES) + 5


def group_of(names: str) -> tuple[str | None, bool]:
    """What a class, id or role says of its element, and whether some name mentions a group's word.

    A name's last token that isn't structure names the thing.
    """
    found, mentions = None, False
    for name in names.split():
        tokens = [w for w in (t.lower() for t in _WORD.findall(name)) if not w.isdigit()]
        mentions = mentions or any(t in _GROUP_OF for t in tokens)
        while len(tokens) > 1 and tokens[-1] in STRUCTURE:
            tokens.pop()
        if found is None and tokens:
            found = _GROUP_OF.get(tokens[-1])
    return found, mentions


class Node:
    __slots__ = ("chars", "children", "group", "keep", "links", "main", "mentions", "paragraph", "parent", "pieces", "points", "runs", "start", "tag", "tags", "words")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.words = self.links = self.points = self.paragraph = self.tags = self.start = 0
        self.runs, self.pieces, self.keep = 0, None, None
        self.group, self.main, self.mentions = _TAG_GROUP.get(tag), tag in ("article", "main"), False
        if attrs:
            for name, *values in _ATTR.findall(attrs):
                name = name.lower()
                if name in ("class", "id", "role") and tag not in ("html", "body"):
                    value = html.unescape("".join(values))
                    group, mentions = group_of(value)
                    if tag not in ("article", "main"):
                        self.group = group or self.group
                    self.mentions = self.mentions or mentions
                    self.main = self.main or any(w.lower() in MAIN for w in _WORD.findall(value))
                elif name == "data-keep":
                    self.keep = "".join(values) == "1"
        if self.group:
            self.main = False


def parse(page: str | None) -> list[Node]:
    """The page's block elements and text runs in page order; the first is the root."""
    root = Node("html", None)
    nodes, stack = [root], [root]
    inline: list[str] = []  # open inline elements, for link text
    run = None
    unclosed = set()  # skipped elements that no closing tag follows any more
    page = page or ""

    def text(raw: str):
        nonlocal run
        if not raw:
            return
        if run is None:
            if not raw.strip():
                return
            run = Node("#", stack[-1])
            run.pieces = []
            stack[-1].children.append(run)
            nodes.append(run)
        plain = html.unescape(raw)
        run.pieces.append(plain)
        if "a" in inline:
            run.links += len(plain)

    def close(until: int):
        nonlocal run
        run = None
        del stack[until:]
        inline.clear()

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        end, tag, attrs = m[1], m[2], m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            closing = None
            if not end and tag not in unclosed and not (tag == "svg" and attrs.endswith("/")):
                closing = _CLOSING[tag].search(page, at)
                if closing is None:
                    unclosed.add(tag)
            if closing:
                at = closing.end()
            elif tag in CODE and not end:
                at = len(page)
            if run:
                run.pieces.append(" ")
        elif tag == "head":
            run = None
        elif tag in BLOCKS:
            if tag in ("html", "body") and (end or stack[-1] is root and tag == "html"):
                run = None
                continue
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    run = None
                continue
            run = None
            closes, stop = CLOSES.get(tag, ({"p"}, set()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes or stack[i].tag == "p":
                    close(i)
                    if stack[-1].tag not in closes:
                        break
                elif stack[i].tag in stop or not stop:
                    break
            node = Node(tag, stack[-1], attrs)
            stack[-1].children.append(node)
            nodes.append(node)
            stack.append(node)
        elif tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and run:
                run.pieces.append("" if tag == "wbr" else " ")
            stack[-1].tags += 1
        else:
            stack[-1].tags += 1
            if end:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag):]
            else:
                inline.append(tag)
    text(page[at:])
    return nodes


def run_text(run: Node) -> str:
    return _SPACE.sub(" ", "".join(run.pieces)).strip()


def describe(nodes: list[Node]) -> np.ndarray:
    """The feature matrix of a page's nodes, in their order."""
    total = 0
    for v in nodes:
        v.start = total
        if v.pieces is not None:
            s = run_text(v)
            v.chars, v.words, v.runs = len(s), s.count(" ") + 1, 1
            v.points = s.count(".") + s.count("!") + s.count("?") + s.count(",")
            v.paragraph = v.chars if v.parent.tag == "p" else 0
            total += v.chars
    for v in reversed(nodes):
        if v.parent is not None:
            u = v.parent
            u.chars += v.chars
            u.words += v.words
            u.links += v.links
            u.points += v.points
            u.paragraph += v.paragraph
            u.runs += v.runs
            u.tags += v.tags + (v.pieces is None)
    x = np.zeros((len(nodes), FEATURES))
    place = {}
    tags, own, above = 14, 14 + len(_TAGS), 14 + len(_TAGS) + len(_GROUP_NAMES)
    log = np.log1p
    depth, inside, groups, holds, named = {}, {}, {}, {}, {}
    for v in reversed(nodes):
        holds[id(v)] = v.main or any(holds[id(c)] for c in v.children)
    for v in nodes:
        for i, c in enumerate(v.children):
            place[id(c)] = i
    for r, v in enumerate(nodes):
        u, me = v.parent, id(v)
        depth[me] = depth[id(u)] + 1 if u else 0
        inside[me] = v.main or (u is not None and inside[id(u)])
        groups[me] = (groups[id(u)] if u else frozenset()) | ({v.group} if v.group else set())
        named[me] = v.mentions or (u is not None and named[id(u)])
        row = x[r]
        row[0], row[1], row[2], row[3] = v.pieces is not None, depth[me], v.chars, v.words
        row[4] = v.links / v.chars if v.chars else 0
        row[5] = v.chars / (v.tags + 1)
        row[6] = len(v.children)
        if u is not None:
            row[7] = place[me] / len(u.children)
            row[8] = len(u.children)
            row[9] = u.chars / len(u.children)
            row[13] = v.chars / u.chars if u.chars else 0
        row[10] = v.chars / total if total else 0
        row[11] = v.start / total if total else 0
        row[12] = v.points / v.words if v.words else 0
        element = u if v.pieces is not None else v
        if element.tag in _TAG_NO:
            row[tags + _TAG_NO[element.tag]] = 1
        if element.group:
            row[own + _GROUP_NAMES.index(element.group)] = 1
        for g in groups[me]:
            row[above + _GROUP_NAMES.index(g)] = 1
        row[-5], row[-4] = element.mentions, named[me]
        row[-3], row[-2] = inside[me], holds[me]
        row[-1] = v.paragraph / v.chars if v.chars else 0
    for c in (2, 3, 5, 6, 8, 9):
        x[:, c] = log(x[:, c])
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a kept node's parent is kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = yes.tolist(), no.tolist()  # best of the subtree, given the node's label
    number = {id(v): i for i, v in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        u = number[id(nodes[i].parent)]
        keep[u] += max(keep[i], drop[i])
        drop[u] += drop[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[number[id(nodes[i].parent)]] and keep[i] > drop[i]
    return kept


class Trees:
    """The fitted trees as flat arrays: feature (-1: leaf), threshold, left, right, value."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            flat: list = []

            def walk(node, flat=flat, weight=weight):
                at = len(flat)
                flat.append(None)
                if node.subtreeDepth() == 0:
                    flat[at] = (-1, 0.0, at, at, weight * node.prediction())
                else:
                    split = node.split()
                    left, right = walk(node.leftChild()), walk(node.rightChild())
                    flat[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
                return at

            walk(tree._java_obj.rootNode())
            f, t, left, right, v = zip(*flat)
            self.trees.append((np.array(f), np.array(t), np.array(left), np.array(right), np.array(v)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, left, right, v in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = np.where((f[at] < 0) | (x[rows, f[at]] <= t[at]), left[at], right[at])
            out += v[at]
        return 2 * out


def labels_of(nodes: list[Node]) -> list[int] | None:
    """1 for nodes that hold main text, by the page's own marks; None if it has none."""
    good, label = {}, {}
    marked = any(v.keep is not None for v in nodes)
    for v in nodes:
        u = good[id(v.parent)] if v.parent else (False, False)
        if marked:
            good[id(v)] = (v.keep if v.keep is not None else u[0], False)
        else:
            good[id(v)] = (u[0] or v.main, u[1] or bool(v.group))
    for v in reversed(nodes):
        own = v.pieces is not None and good[id(v)][0] and not good[id(v)][1]
        label[id(v)] = int(own or any(label[id(c)] for c in v.children))
    return [label[id(v)] for v in nodes] if label[id(nodes[0])] else None


def retold(nodes: list[Node], seed: int) -> str:
    """The page's main text in a template of its own, with what surrounds and interrupts it."""
    rng = random.Random(seed)
    label = labels_of(nodes)
    say = lambda v: html.escape(run_text(v))
    main = [(v.parent.tag, say(v)) for v, y in zip(nodes, label) if v.pieces is not None and y]
    other = [say(v) for v, y in zip(nodes, label) if v.pieces is not None and not y] or ["..."]
    words = " ".join(s for _, s in main).split()
    if rng.random() < 0.3:  # a short page
        main = [(t, " ".join(s.split()[:rng.randint(1, 15)])) for t, s in main[:rng.randint(1, 3)]]

    def some(low, high):
        n = rng.randint(low, high)
        i = rng.randrange(max(1, len(words) - n))
        return " ".join(words[i:i + n])

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def mark(group):
        token = rng.choice(GROUPS[group].split())
        if rng.random() < 0.2:
            return f'class="{token}-{rng.choice(["wrapper", "box", "list", "content", "text", "inner", "stories", "policy"])}"'
        return f'{rng.choice(["class", "class", "id"])}="{rng.choice(["", "site-", "page-"])}{token}"'

    def box(group, body, tag="div"):
        return f'<{tag} data-keep="0" {mark(group)}>{body}</{tag}>'

    def comments():
        each = "".join(f"<{t}><b>{some(1, 2)}</b> <p>{some(5, 60)}</p></{t}>" for t in [rng.choice(["li", "div", "article"])] * rng.randint(1, 5))
        return box("comment", f"<h3>{some(1, 2)}</h3>{each}", rng.choice(["div", "section", "ol"]))

    extras = {
        "ad": lambda: box("ad", rng.choice([some(4, 25), f"<p>{some(4, 30)}</p>", rng.choice(other)])),
        "notice": lambda: box("notice", f"<p>{some(6, 30)}</p><button>{some(1, 1)}</button>"),
        "side": lambda: rng.choice([box("side", f"<h3>{some(1, 3)}</h3>{links(4)}<p>{some(5, 40)}</p>"),
                                    f'<aside data-keep="0"><h4>{some(1, 3)}</h4><p>{some(5, 40)}</p></aside>']),
        "form": lambda: rng.choice([f'<form data-keep="0"><label>{some(1, 4)}</label><p>{some(4, 20)}</p><input name="q"></form>',
                                    box("form", f"<p>{some(4, 20)}</p><input>")]),
        "more": lambda: box("more", links(rng.randint(2, 6))),
        "nav": lambda: rng.choice([f'<nav data-keep="0">{links(rng.randint(1, 8))}</nav>', box("nav", links(rng.randint(1, 8))),
                                   f'<div data-keep="0">{links(rng.randint(1, 8))}</div>']),
    }
    def chunks(s, most):
        """The words of ``s`` in runs of 1 to ``most`` words."""
        left, out = s.split(), []
        while left:
            n = rng.randint(1, most)
            out.append(" ".join(left[:n]))
            left = left[n:]
        return out

    def odd():
        """A class that mentions a group's word without being of the group."""
        word = rng.choice(rng.choice([*GROUPS.values()]).split())
        return f'class="{word}-{rng.choice(["history", "enabled", "story", "study", "guide", "open"])}"'

    def block(tag, s):
        """One block of the article: mostly as it was, else in another of HTML's shapes."""
        tag = tag if tag in BLOCKS and tag not in ("body", "html") else "p"
        shape = rng.choice(["p"] * 9 + ["list", "table", "quote", "pre", "figure", "dl", "heading", "letter", "bare", "odd", "short"])
        if shape == "list":
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{c}</li>" for c in chunks(s, 8)) + f"</{t}>"
        if shape == "table":
            cells = chunks(s, 3)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells[i:i + 3]) + "</tr>" for i in range(0, len(cells), 3)) + "</table>"
        if shape == "quote":
            return f"<blockquote>{rng.choice([s, f'<p>{s}</p>'])}</blockquote>"
        if shape == "figure":
            return f'<figure><img src="a.png"><figcaption>{" ".join(s.split()[:12])}</figcaption></figure><p>{s}</p>'
        if shape == "dl":
            return "<dl>" + "".join(f"<{'dd' if i % 2 else 'dt'}>{c}</{'dd' if i % 2 else 'dt'}>" for i, c in enumerate(chunks(s, 6))) + "</dl>"
        if shape in ("heading", "letter"):
            h = rng.choice(["h1", "h2", "h3"])
            return f"<{h}>{s[:1] if shape == 'letter' else ' '.join(s.split()[:3])}</{h}><p>{s}</p>"
        if shape == "short":
            return "".join(f"<p>{c}</p>" for c in chunks(s, 6))
        return {"pre": f"<pre>{s}</pre>", "bare": f"<div>{s}</div>", "odd": f"<div {odd()}><p>{s}</p></div>"}.get(shape, f"<{tag}>{s}</{tag}>")

    body = []
    for tag, s in main:
        body.append(block(tag, s))
        if rng.random() < 0.12:
            body.append(extras[rng.choice(["ad", "ad", "side", "form", "more", "notice"])]())
    if rng.random() < 0.3:
        body.append(comments())
    open_, close = rng.choice([("article", "article"), ("main", "main"), ('div class="content"', "div"), ('div id="main-content"', "div"),
                               ('section class="post"', "section"), ("div", "div"), (f"article {odd()}", "article"), ('div class="story-body"', "div")])
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    top = [rng.choice([f'<header data-keep="0"><h2>{some(1, 4)}</h2><p>{some(2, 10)}</p></header>', box("head", some(1, 6))])]
    top += [extras[k]() for k in ("nav", "notice", "ad") if rng.random() < 0.7]
    end = [comments()] if rng.random() < 0.5 else []
    end += [extras[k]() for k in ("side", "more", "form", "ad") if rng.random() < 0.5]
    end.append(rng.choice([f'<footer data-keep="0">{rng.choice(other)}</footer>', box("foot", f"<p>{some(3, 20)}</p>")]))
    rng.shuffle(end)
    whole = rng.choice(["body", "body", f"body {odd()}"])
    return f'<html><{whole}>{"".join(top)}<{open_} data-keep="1">{inner}</{close}>{"".join(end)}</body></html>'


def training_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                   sample: int = SAMPLE_PAGES, templates: int = TEMPLATES) -> DataFrame:
    """features, label of the nodes of at most ``sample`` pages and their retold versions; ids of any type."""
    ship_code(pages.sparkSession)
    page = F.col(f"`{html_col}`")
    ids = (pages.where(F.length(page).between(1, SAMPLE_CHARS)).select(F.col(f"`{id_col}`").cast("string").alias("id")).distinct()
           .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = (pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), page.alias("page")).where(F.length("page").between(1, SAMPLE_CHARS))
            .join(F.broadcast(ids), "id", "left_semi").orderBy(F.xxhash64("id"), "id", F.xxhash64("page")).limit(sample))

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, source in zip(frame["id"], frame["page"]):
                tree = parse(source)
                if labels_of(tree) is None:
                    continue
                pages = [tree] + [parse(retold(tree, zlib.crc32(f"{i}|{k}".encode()))) for k in range(templates)]
                for p in pages:
                    y = labels_of(p)
                    if y is not None:
                        yield pd.DataFrame({"x": list(describe(p)), "label": np.array(y, dtype=np.float64)})

    return rows.repartition(8).mapInPandas(nodes, "x array<double>, label double")


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees | None:
    """Fit the trees; None where no page marks a main text (every run is kept then)."""
    rows = written(training_nodes(pages, id_col, html_col), "nodes")
    if len(rows.select("label").distinct().limit(2).collect()) < 2:
        return None
    vectors = rows.select(array_to_vector("x").alias("features"), "label").cache()
    try:
        return Trees(GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=7).fit(vectors))
    finally:
        vectors.unpersist()


def main_text(pages: list[str | None], trees: Trees | None) -> list[str]:
    """The main text of each page; an empty string for null, empty or text-free pages."""
    parsed = [parse(p) for p in pages]
    x = [describe(p) for p in parsed]
    odds = trees.odds(np.concatenate(x)) if trees and x else np.ones(sum(map(len, x)))
    out, at = [], 0
    for nodes, features in zip(parsed, x):
        kept = decode(nodes, odds[at:at + len(features)])
        at += len(features)
        out.append("\n".join(s for v, k in zip(nodes, kept) if k and v.pieces is not None and (s := run_text(v))))
    return out


def text_column(trees: Trees | None, page: Column, spark) -> Column:
    ship_code(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([t for i in range(0, len(pages), BATCH)
                             for t in main_text(pages.iloc[i:i + BATCH].tolist(), shared.value)], dtype=object)

    return texts(page)


def extract(pages: DataFrame, trees: Trees | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give an empty text, repeated rows a row each, an empty table
    none; ids and urls may be of any type and null; other columns are left out. A page is read
    whole, however long, in one task. Without trees every run of text is kept.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        text_column(trees, F.col(f"`{html_col}`"), pages.sparkSession).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
