"""Main text of web pages: wrappers induced from pages of the same host by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Pages of a host that its wrappers are learned from at most, and how many different ones it takes to call a text constant.
SAMPLE, SUPPORT = 16, 4
#: Pages of one layout have this share of their elements in common. The search for the content goes on in an element that
#: has the share MOST of the varying text, and leaves out others with less than the share SMALL of what it has.
ALIKE, MOST, SMALL = 0.4, 0.6, 0.2
#: Ids and wrappers are sent to every task up to these sizes, and joined by shuffle beyond.
BROADCAST_IDS, BROADCAST_CHARS = 500_000, 32_000_000
#: Cells of the largest alignment table; longer lists are halved first.
TABLE = 1_000_000
# Kinds of elements, and names that class, id and role give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article aside body center dd div fieldset figure footer form header html main nav section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noframes noscript object script select style svg template textarea title video".split())
DROPPED_NAMES = frozenset(
    "ad ads adslot adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog "
    "discussion disqus footer gdpr masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification pagination pager popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element: its label (tag and class), names of class, id and role, children (elements and texts)."""

    __slots__ = ("bare", "children", "constant", "label", "names", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.names, self.children = tag, tag, frozenset(), []
        self.constant = self.bare = False  # no content, and: its own text is none, only what its children have
        if attributes and "=" in attributes:
            found = [(k.lower(), a or b or c) for k, a, b, c in NAMES.findall(attributes)]
            if found:
                self.label = tag + "".join(f".{v.strip()}" for k, v in found if k == "class")
                self.names = frozenset(n for _, v in found for n in re.split(r"[^a-z0-9]+", v.lower()))

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


def parse(source: str) -> Node:
    """A tree for any string: unknown, unclosed and stray tags are mended as browsers do for the common cases."""
    root = Node("html")
    stack, at, n = [root], 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].children.append(html.unescape(source[at:lt]))
        if lt == n:
            break
        m = TOKEN.match(source, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCKS or tag in CLOSES:
            ends = ("p",) if tag in BLOCKS and tag not in ("html", "body") else ()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends or stack[k].tag in CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS and stack[k].tag not in ("p",):
                    break
        if tag in ("html", "body") and tag in (x.tag for x in stack):
            continue
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(source[at : end.start() if end else n]))
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/") and len(stack) < 200:
            stack.append(node)
    return root


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """The child elements as runs of one label; what may hold the content is a run of its own."""
    out: list[tuple[str, list[Node]]] = []
    for c in node.children:
        if isinstance(c, Node) and c.tag not in VOID:
            if out and out[-1][0] == c.label and c.tag not in CONTAINERS:
                out[-1][1].append(c)
            else:
                out.append((c.label, [c]))
    return out


def totals(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The highest total score of an order-preserving pairing of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:  # what lies above, or a pair more, or what lies to the left
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + scores[x][b]))
    return row


def align(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
    """Simple tree matching's step: the order-preserving pairing of two lists with the highest total score.

    a and b number rows and columns of scores. Long lists are halved where the best pairing crosses, so memory grows
    with their length alone.
    """
    n, m = len(a), len(b)
    if n > 1 and n * m > TABLE:
        half = n // 2
        cut = int(np.argmax(totals(a[:half], b, scores) + totals(a[half:][::-1], b[::-1], scores)[::-1]))
        return align(a[:half], b[:cut], scores) + [(i + half, j + cut) for i, j in align(a[half:], b[cut:], scores)]
    w = np.zeros((n + 1, m + 1), np.int64)
    s = scores[a][:, b] if n and m else w
    for i in range(n):
        np.maximum.accumulate(np.maximum(w[i, 1:], w[i, :-1] + s[i]), out=w[i + 1, 1:])
    out, i, j = [], n, m
    while i and j:
        if s[i - 1, j - 1] and w[i, j] == w[i - 1, j - 1] + s[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif w[i, j] == w[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class Shapes:
    """Simple tree matching over shapes: elements alike in all their structure are one shape, and two shapes are matched once.

    So the work for two trees is at most that of each shape of one with each of the other on its level, however deep they are.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.known: list[tuple[str, int, tuple[int, ...]]] = []
        self.of_node: dict[int, tuple[Node, int]] = {}
        self.matched: dict[tuple[int, int], int] = {}

    def shape(self, run: tuple[str, list[Node]]) -> int:
        """The number of a run's shape: its label, how many elements it has, and if one, the shapes of its children."""
        label, own = run
        if len(own) > 1:
            return self.number((label, len(own), ()))
        found = self.of_node.get(id(own[0]))
        if found is None:
            found = self.of_node[id(own[0])] = own[0], self.number((label, 1, tuple(self.shape(r) for r in runs(own[0]))))  # the element too, so that its id stays its own
        return found[1]

    def number(self, key: tuple[str, int, tuple[int, ...]]) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.known)
            self.known.append(key)
        return self.numbers[key]

    def likeness(self, x: int, y: int) -> int:
        """How many elements two shapes have in common; runs of several count their lengths."""
        if (x, y) not in self.matched:
            (a, n, own), (b, m, other) = self.known[x], self.known[y]
            if a != b:
                found = 0
            elif n > 1 or m > 1:
                found = min(n, m)
            else:
                found = 1 + (int(totals(*self.scores(own, other))[-1]) if own and other else 0)
            self.matched[x, y] = found
        return self.matched[x, y]

    def scores(self, a: Sequence[int], b: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which row and column each of a and b is in a table of the likeness of their different shapes, and that table."""
        (one, i), (other, j) = (np.unique(np.asarray(x, np.int64), return_inverse=True) for x in (a, b))
        return i, j, np.array([[self.likeness(x, y) for y in other.tolist()] for x in one.tolist()], np.int64).reshape(len(one), len(other))

    def pairs(self, a: list[tuple[str, list[Node]]], b: list[tuple[str, list[Node]]]) -> list[tuple[int, int]]:
        return align(*self.scores([self.shape(r) for r in a], [self.shape(r) for r in b]))

    def similar(self, a: Node, b: Node) -> float:
        return 2 * self.likeness(self.shape(("", [a])), self.shape(("", [b]))) / (size(a) + size(b))


def size(node: Node) -> int:
    """The elements of a tree as likeness() counts them."""
    return 1 + sum(len(own) if len(own) > 1 else size(own[0]) for _, own in runs(node))


def similar(a: Node, b: Node) -> float:
    return Shapes().similar(a, b)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def digest(text: str) -> str:
    return xxhash.xxh64_hexdigest(text)


def prose(node: Node) -> str:
    """The text of an element without its links and what is never part of an article."""
    return "".join(c if isinstance(c, str) else prose(c) for c in node.children if isinstance(c, str) or c.tag != "a" and c.tag not in DROPPED)


def shape(own: list[Node]) -> set[str]:
    """The labels of an element's children."""
    return {label for label, _ in runs(own[0])}


class Column:
    """A run of children as matched pages have it: by page its elements, and what they show."""

    def __init__(self, label: str):
        self.label, self.tag, self.own = label, label.split(".")[0], {}

    def weighed(self, support: int) -> Column:
        texts = [[squeezed(n.text()) for n in own] for own in self.own.values()]
        pages = Counter(digest(t) for own in texts for t in set(own) if t)
        often = max(support, 0.8 * len(texts))
        self.constant = sorted(d for d, n in pages.items() if n >= often)
        whole = {" ".join(own) for own in texts}
        first = [t.split()[:2] for own in texts for t in own[:1]]
        # What begins alike on all pages and goes on differently, like a footer that names the site.
        self.headed = len(texts) >= support and len(whole) > 1 and len(first[0]) == 2 and all(x == first[0] for x in first)
        self.mass = 0 if self.tag in DROPPED else sum(len(squeezed(prose(n))) for own in self.own.values() for n in own if digest(squeezed(n.text())) not in self.constant)
        total = sum(len(t) for own in texts for t in own)
        shapes = Counter(x for own in self.own.values() for x in shape(own))
        self.shape = sorted(x for x, n in shapes.items() if 2 * n >= len(texts))
        self.linked = total > 0 and sum(len(squeezed(prose(n))) for own in self.own.values() for n in own) < 0.4 * total
        return self


def columns(nodes: dict[int, Node], support: int, shapes: Shapes) -> list[Column]:
    """The children of matching elements of several pages, aligned page by page: those of all pages, in order."""
    found: list[Column] = []
    for page, node in nodes.items():
        now = runs(node)
        pairs = dict(shapes.pairs([(c.label, next(iter(c.own.values()))) for c in found], now))
        for i, j in pairs.items():
            found[i].own[page] = now[j][1]
        at = {j: i for i, j in pairs.items()}
        out, i = [], 0
        for j, (label, own) in enumerate(now):
            if j in at:
                out += found[i : at[j] + 1]
                i = at[j] + 1
            else:
                new = Column(label)
                new.own[page] = own
                out.append(new)
        found = out + found[i:]
    return [c.weighed(support) for c in found]


def induce(nodes: dict[int, Node], support: int = SUPPORT, shapes: Shapes | None = None) -> dict | None:
    """The wrapper of matching elements, one of each page: {"r": whether the content is here, "k": [[label, what, labels], ...]}.

    Of the runs of children, with the labels of their own children that most pages have, `what` is 0 for those that are not content, a list of digests of the texts that are
    constant for those that are, and a wrapper for the one that the search goes on in. That is the element that most
    of the varying text outside links lies in. If there is none, the content is here: what varies and is not mostly
    links, nor small beside the rest. None: no text varies.
    """
    shapes = shapes or Shapes()
    found = columns(nodes, support, shapes)
    bare = sum(len(squeezed("".join(c for c in n.children if isinstance(c, str)))) for n in nodes.values())
    total = bare + sum(c.mass for c in found)
    if not total:
        return None
    inner = [c for c in found if c.tag in CONTAINERS and 2 * len(c.own) > len(nodes) and all(len(own) == 1 for own in c.own.values())]
    best = max(inner, key=lambda c: c.mass, default=None)
    if best is not None and best.mass < MOST * total:
        best = None
    deeper = induce({p: own[0] for p, own in best.own.items()}, support, shapes) if best is not None else None
    rest = best.mass if deeper else total
    kids = []
    for c in found:
        if c is best and deeper:
            kids.append([c.label, deeper, c.shape])
        elif c.linked or not c.mass or c.tag in CONTAINERS and c.mass < SMALL * rest or deeper and c.headed:
            kids.append([c.label, 0 if c.linked or c.tag in CONTAINERS or deeper else c.constant, c.shape])
        else:
            kids.append([c.label, c.constant, c.shape])
    return {"r": deeper is None, "k": kids}


def layouts(trees: list[Node], support: int) -> list[dict]:
    """A wrapper for each layout among a host's pages: pages like enough to the layout's first page, most pages first."""
    groups: list[list[Node]] = []
    shapes = Shapes()
    for t in trees:
        own = next((g for g in groups if shapes.similar(g[0], t) >= ALIKE), None)
        own.append(t) if own else groups.append([t])
    out = []
    for g in sorted(groups, key=len, reverse=True):
        if len(g) > 1 and (w := induce(dict(enumerate(g)), support, shapes)):
            out.append(w)
    return out


def mark(wrapper: dict, node: Node) -> bool:
    """Marks what a wrapper takes for no content on a page; whether the page has the place of the content."""
    own = runs(node)
    inner = [shape(nodes) for _, nodes in own]
    likely = np.array([[1 + 2 * len(s.intersection(k[2])) if k[0] == r[0] else 0 for r, s in zip(own, inner, strict=True)] for k in wrapper["k"]], np.int64).reshape(len(wrapper["k"]), len(own))
    pairs = {j: wrapper["k"][i][1] for i, j in align(np.arange(len(wrapper["k"])), np.arange(len(own)), likely)}
    here = bool(wrapper["r"])
    if not here:
        node.bare = True
        here = any(isinstance(w, dict) and len(own[j][1]) == 1 and mark(w, own[j][1][0]) for j, w in pairs.items())
    for j, (_, nodes) in enumerate(own):
        what = pairs.get(j, [] if wrapper["r"] else 0)
        if not isinstance(what, dict):
            for c in nodes:
                c.constant = what == 0 or c.tag in BLOCKS and bool(what) and digest(squeezed(c.text())) in what
    return here


def elements(node: Node) -> Iterator[Node]:
    """The elements below, without those inside an element that is never part of an article."""
    for c in node.children:
        if isinstance(c, Node) and c.tag not in DROPPED and not c.names & DROPPED_NAMES:
            yield c
            yield from elements(c)


def articles_of(root: Node) -> list[Node]:
    """The longest article and those beside it, in page order, else the longest main element, if any."""
    for wanted in (lambda c: c.tag == "article", lambda c: c.tag == "main" or "main" in c.names or "articlebody" in c.names):
        found = [c for c in elements(root) if wanted(c)] or [c for c in every(root) if wanted(c) and c.tag in ("article", "main") and not c.names & DROPPED_NAMES]
        if found:
            best = max(found, key=lambda c: len(c.text()))
            within = next((c for c in (root, *every(root)) if any(x is best for x in c.children)), root)
            return [c for c in within.children if c is best or c.__class__ is Node and best.tag == "article" and c.tag == "article" and any(c is x for x in found)]
    return []


def every(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node):
            yield c
            yield from every(c)


def blocks(root: Node, inside: bool) -> list[str]:
    """The text of each block in page order; inside: root is the article, so a header there may hold its heading."""
    out, now, total = [], [], max(1, len(root.text()))

    def flush() -> None:
        if text := squeezed("".join(now)):
            out.append(text)
        now.clear()

    def walk(node: Node, heading_only: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if not heading_only and not node.bare:
                    now.append(c)
                continue
            if c.constant or c.tag in DROPPED:
                continue
            if c.tag == "br" or c.tag in ("td", "th"):
                now.append(" ")
            header = c.tag == "header" or "header" in c.names
            if header and not inside or c.names & DROPPED_NAMES and len(c.text()) <= 0.6 * total:
                continue
            if not inside and c.tag in ("ul", "ol", "div", "p", "table") and linked(c):
                continue
            block = c.tag in BLOCKS
            if block:
                flush()
            walk(c, (heading_only or header) and c.tag not in HEADINGS)
            if block:
                flush()

    walk(root, False)
    flush()
    return out


def linked(node: Node) -> bool:
    """Whether most of a text is the text of links."""
    text = len(squeezed(node.text()))
    return text > 0 and sum(len(squeezed(c.text())) for c in every(node) if c.tag == "a") > 0.6 * text


def extract(source: str | None, wrappers: list[dict] | None = None) -> str:
    """The main text of a page.

    With the wrappers of its host's layouts: what the first that fits takes for content. Without, or where none fits,
    its article, or else its body without lists of links and the like.
    """
    for wrapper in wrappers or ():
        root = parse(source or "")
        if mark(wrapper, root):
            return "\n".join(blocks(root, True))
    root = parse(source or "")
    own = articles_of(root)
    return "\n".join(line for x in own or [root] for line in blocks(x, bool(own)))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame, sample: int = SAMPLE, support: int = SUPPORT) -> DataFrame:
    """(host, wrapper), the wrappers of its layouts as JSON, for each host with two different pages of one layout in its sample.

    A host's sample is the page of the smallest hash in each of `sample` slots that ids are dealt into, so it is found
    by partial aggregates however large the host is, and one group holds `sample` pages.
    """
    ids = pages.select("host", F.xxhash64("page_id").alias("h"), "page_id")
    chosen = ids.groupBy("host", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min(F.struct("h", "page_id")).alias("m")).select(F.col("m.page_id").alias("page_id"))
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [parse(x) for x in sorted(set(pdf["html"].dropna()))[:sample]]
        found = layouts(trees, support)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(found) if found else None]})

    some = pages.select("host", "page_id", "html").join(chosen, "page_id", "left_semi").groupBy("host", "page_id").agg(F.max("html").alias("html"))
    return some.groupBy("host").applyInPandas(learn, "host string, wrapper string").filter("wrapper IS NOT NULL")


def main_texts(pages: DataFrame, sample: int = SAMPLE, support: int = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html).

    A null or empty html gives an empty text. Pages without a host, or of a layout that no other page of the host's
    sample has, have no wrapper and are read by their elements' kinds and names alone. Very long pages are read whole.
    Repeated rows give equal rows; an empty table gives none; further columns, whatever their names, are not looked
    at. Elements nest 200 deep at most, beyond that they lie side by side.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    known = saved(wrappers(pages, sample, support))
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        known = F.broadcast(known)
    both = pages.join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, dict | None] = {None: None}
        for b in batches:
            for lo in range(0, len(b), 512):
                part, texts = b.slice(lo, 512), []
                for source, wrapper in zip(part.column(2), part.column(3), strict=True):
                    w = wrapper.as_py()
                    if w not in seen:
                        if len(seen) > 500:
                            seen = {None: None}
                        seen[w] = json.loads(w)
                    texts.append(extract(source.as_py(), seen[w]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(each, "page_id long, url string, text string, n_chars long")
