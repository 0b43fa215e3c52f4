"""Main text of web pages by a graphical model over the DOM.

A page becomes a tree of elements and of runs, that is, stretches of text between the borders of
blocks. Every node has one of three states: outside (it may still hold the article), article,
and boilerplate, which never holds an article. Potentials connect a node with its parent,
depending on what the node's tag and names say (nothing, main text, boilerplate); a run has a further one, depending on its number of words, its
share of linked text and whether it ends like a sentence. Messages go up from the leaves and down
again from the root, so that each node gets its marginals from the whole page; text under nodes that are
more likely article than not is kept.

Potentials are smoothed counts over labelled pages, taken in one aggregation. Pages may be labelled by
a table of their known main text, or label themselves: a page with one ``article`` (or, without
any, one ``main``) element says where its text is. At most about ``SAMPLE`` pages are
counted, chosen by a hash of the identifier; every page is extracted, whole.

Messages of all pages of a batch are computed together, a level of the trees at a time.

Defined cases: null html is empty and gives an empty text; broken markup is read as browsers do (open elements are closed
where their parent ends or a new block begins, an unclosed comment or script runs to the end, a cut
tag at the end goes); pages of any size or depth are read whole; without labelled pages only the
smoothing speaks, that is, names and long sentences; repeated rows get equal texts; other columns are carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.llm.common import fresh

#: Labelled pages that are counted, about.
SAMPLE = 5_000
#: Characters of pages whose trees a task holds at once.
CHUNK = 4_000_000

OUTSIDE, ARTICLE, BOILERPLATE = range(3)
#: What a node's tag and names say; a run has neither, but is always text of one side or the other.
NOTHING, MAIN, OTHER, RUN = range(4)

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em embed font i img input ins kbd label map mark meter nobr object output picture progress q ruby rb rp rt s samp select small span strike strong sub sup svg time tt u var video audio canvas wbr".split()
)
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
#: Which open elements a new one ends, and within which elements they are sought.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select", "datalist"})}
ENDS |= {"tr": ("tr td th", {"table"}), "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"})} | {x: ("thead tbody tfoot tr td th", {"table"}) for x in ("thead", "tbody", "tfoot")}
BARRIERS = {"table", "td", "th", "caption", "template", "object"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}

# Tags, roles and words of names that say what a node is.
OTHER_TAGS = set("nav aside footer form head menu dialog button select option textarea fieldset label input script style noscript template iframe object svg canvas datalist".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer footers sidebar sidebars aside rail widget widgets notice notices cookie cookies consent gdpr banner banners "
    "popup modal overlay alert disclaimer newsletter subscribe subscription signup login ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos "
    "promoted promotion promotions share sharing social related recommended recommendations comment comments commentlist reply replies respond responses disqus discussion form search toolbar "
    "pagination pager copyright".split()
)
MAIN_WORDS = set("article articles content contents main post entry story maincontent articlebody".split())
#: With these a header is that of an article.
OWN_HEADER = {"article", "post", "entry", "story", "content"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>|</?[a-zA-Z][^>]*+\Z", re.DOTALL
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@lru_cache(maxsize=100_000)
def says(tag: str, attributes: str) -> int:
    """What a tag with its attributes says of the text inside."""
    if tag in ("html", "body"):
        return NOTHING
    if tag in OTHER_TAGS:
        return OTHER
    names: list[str] = []
    role = ""
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return OTHER
        if key == "role":
            role = value.strip().lower()
        elif key != "style":
            names += value.split()
    if role in OTHER_ROLES:
        return OTHER
    if tag in ("article", "main") or role in ("article", "main"):
        return MAIN
    words: set[str] = set()
    for name in names:
        parts = [x.lower() for x in PART.findall(name)]
        words.update(parts, (a + b for a, b in zip(parts, parts[1:])))
    other = words & OTHER_WORDS
    if other == {"header"} and words & OWN_HEADER:
        return NOTHING
    return OTHER if other or tag == "header" else MAIN if words & MAIN_WORDS else NOTHING


class Page:
    """A page's tree. Nodes are numbered so that parents come first; node 0 is the page itself."""

    __slots__ = ("parents", "depths", "saying", "runs", "texts", "marks")

    def __init__(self):
        self.parents, self.depths, self.saying = [-1], [0], [NOTHING]
        self.runs: list[int] = []  # nodes that are runs
        self.texts: list[tuple[int, int, bool, str]] = []  # (run's place in runs, node, within a link, raw text)
        self.marks: list[tuple[str, int]] = []  # article and main elements

    def add(self, parent: int, says: int) -> int:
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.saying.append(says)
        return len(self.parents) - 1


def parse(source: str | None) -> Page:
    page, text = Page(), source or ""
    tags, nodes, opened = [""], [0], {}  # the open elements, and how many of each tag
    run = -1  # the node of the open run

    def pop(to: int) -> None:
        while len(tags) > to:
            opened[tags.pop()] -= 1
            nodes.pop()

    def seek(wanted: tuple[str, ...], barriers: set[str]) -> int:
        """The place of the innermost of these elements, or 0 if a barrier comes first."""
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in wanted:
                return k
            if tags[k] in barriers:
                return 0
        return 0

    def parent() -> int:
        return nodes[-1] if nodes[-1] > run else run

    def write(raw: str) -> None:
        nonlocal run
        if run < 0:
            if raw.isspace():
                return
            run = page.add(nodes[-1], RUN)
            page.runs.append(run)
        page.texts.append((len(page.runs) - 1, parent(), opened.get("a", 0) > 0, raw))

    at = 0
    while m := TOKEN.search(text, at):
        if m.start() > at:
            write(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:  # an end tag
            if tag == "br":
                write(" ")
            elif tag in ("html", "body") or not opened.get(tag):
                run = run if inline else -1
            elif inline:
                k = len(tags) - 1
                while k and tags[k] != tag and tags[k] in INLINE:
                    k -= 1
                if k and tags[k] == tag:
                    pop(k)
                elif k and tag not in FORMATTING and (k := seek((tag,), BARRIERS)):
                    pop(k)
                    run = -1
            else:
                run = -1
                if k := seek((tag,), set() if tag in TABLE else BARRIERS):
                    pop(k)
            continue
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag == "br":
            if run >= 0:
                write(" ")
            continue
        if not inline:
            run = -1
            if opened.get("p") and (k := seek(("p",), BARRIERS | {"button"})):
                pop(k)
            if tag in ENDS:
                wanted, within = ENDS[tag]
                wanted = tuple(wanted.split())
                while any(opened.get(x) for x in wanted) and (k := seek(wanted, within)):
                    pop(k)
            if tag == "body" and opened.get("head") and (k := seek(("head",), set())):
                pop(k)
        if tag == "option":
            run = -1
        if inline and run < 0 and tag not in VOID:
            run = page.add(nodes[-1], RUN)
            page.runs.append(run)
        saying = NOTHING if tag == "header" and (opened.get("article") or opened.get("main")) else says(tag, m[3])
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g"):
            continue
        node = page.add(parent() if inline else nodes[-1], saying)
        if tag in ("article", "main"):
            page.marks.append((tag, node))
        tags.append(tag)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(text):
        write(text[at:])
    return page


#: Kinds of runs: by words, by share of linked text, by the way they end; the last kind is an empty run.
WORDS = (3, 6, 15, 40)
KINDS = (len(WORDS) + 1) * 3 * 2
#: Numbers that are counted: edges by what the node says, its parent's state and its own, runs by kind and state.
CELLS = 4 * 3 * 3 + (KINDS + 1) * 3


def kinds(page: Page) -> list[int]:
    """The kind of every run."""
    count = [[0, 0, ""] for _ in page.runs]
    for r, _, linked, raw in page.texts:
        n = len(raw.split())
        count[r][0] += n
        count[r][1] += n if linked else 0
        count[r][2] = raw.rstrip() or count[r][2]
    out = []
    for n, links, last in count:
        share = 0 if links == 0 else 1 if 2 * links < n else 2
        out.append((sum(n >= w for w in WORDS) * 3 + share) * 2 + (last[-1:] in ".!?…:;\"”»。！？") if n else KINDS)
    return out


class Forest(NamedTuple):
    """The trees of several pages: parents, depths and what nodes say; kind of each node, KINDS where it has no text; where pages start."""

    parents: np.ndarray
    depths: np.ndarray
    saying: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.parents) for p in pages]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    joined = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    parents = joined("parents") + np.repeat(starts[:-1], sizes)
    parents[starts[:-1]] = -1
    kind = np.full(starts[-1], KINDS, np.int64)
    for p, s in zip(pages, starts):
        kind[np.array(p.runs, np.int64) + s] = kinds(p)
    return Forest(parents, joined("depths"), joined("saying"), kind, starts)


def _levels(f: Forest) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(f.depths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(f.depths[order])) + 1)


class Model(NamedTuple):
    """Logarithms: edges by what the node says, its parent's state and its own; runs by kind and state."""

    edges: np.ndarray
    runs: np.ndarray


#: What no edge may be: outside within an article, anything but boilerplate within boilerplate, a run outside.
ALLOWED = np.array([[[1, 1, 1], [0, 1, 1], [0, 0, 1]]] * 3 + [[[0, 1, 1], [0, 1, 1], [0, 0, 1]]], bool)
#: Shares of an even distribution mixed into the counts: edges of nodes that say nothing, main text, boilerplate, of runs; kinds of runs.
MIXED = (0.1, 0.05, 1e-9, 0.02)
MIXED_RUNS = 0.1


def model_of(edges: np.ndarray, runs: np.ndarray) -> Model:
    """Potentials from counts [says, parent, own] and [kind, state]."""
    # before any page: nodes go on as their parent, main text is article, boilerplate is boilerplate, a lone run rather that too
    expected = np.array([np.eye(3), [[0, 1, 0], [0, 1, 0], [0, 0, 1]], [[0, 0, 1]] * 3, [[0, 1 / 3, 2 / 3], [0, 1, 0], [0, 0, 1]]])
    p = (edges + expected) / (edges + expected).sum(2, keepdims=True)
    mixed = np.array(MIXED)[:, None, None]
    p = np.where(ALLOWED, (1 - mixed) * p + mixed / 3, 0.0)
    p /= p.sum(2, keepdims=True)
    long = np.array([[0.5, 1.0, 0.5] if k // 6 < 3 else [0.25, 2.0, 0.25] for k in range(KINDS)])
    of = runs + long
    # text outside is read as boilerplate is
    rest = of[:, OUTSIDE] + of[:, BOILERPLATE]
    of = np.column_stack([rest, of[:, ARTICLE], rest])
    e = (1 - MIXED_RUNS) * of / of.sum(0) + MIXED_RUNS / KINDS
    with np.errstate(divide="ignore"):
        return Model(np.log(p), np.vstack([np.log(e), np.zeros(3)]))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def marginals(f: Forest, model: Model) -> np.ndarray:
    """The probability of each state of each node, by one pass of messages up the trees and one down."""
    n = len(f.parents)
    own = model.runs[f.kinds]  # what a node and those below it say of its state
    own[f.parents < 0] = (0.0, -np.inf, -np.inf)
    up, levels = np.zeros((n, 3)), _levels(f)
    for at in reversed(levels[1:]):
        up[at] = _log_sum(model.edges[f.saying[at]] + own[at][:, None, :], 2)
        above, place = np.unique(f.parents[at], return_inverse=True)
        for s in range(3):
            own[above, s] += np.bincount(place, up[at, s])
    down = np.zeros((n, 3))
    for at in levels[1:]:
        above = f.parents[at]
        with np.errstate(invalid="ignore"):
            rest = down[above] + own[above] - up[at]  # all that the parent knows but from this node
        rest = np.where(np.isnan(rest), -np.inf, rest)
        down[at] = _log_sum(rest[:, :, None] + model.edges[f.saying[at]], 1)
    both = down + own
    return np.exp(both - _log_sum(both, 1)[:, None])


# -- learning ------------------------------------------------------------------------------------


def _squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def states(page: Page, known: str | None = None) -> list[int] | None:
    """The state of every node of a labelled page, None if it is not labelled. known: its main text; without it the page must mark one."""
    n = len(page.parents)
    texts = [""] * len(page.runs)
    for r, _, _, raw in page.texts:
        texts[r] += raw
    texts = [_squeezed(t) for t in texts]
    good = [False] * n
    if known is not None:
        whole = " ".join(known.split())
        for node, t in zip(page.runs, texts):
            good[node] = bool(t) and t in whole
    else:
        marks = [x for x in page.marks if x[0] == "article"] or page.marks
        if len(marks) != 1:
            return None
        inside = [False] * n
        for v in range(1, n):
            inside[v] = v == marks[0][1] or inside[page.parents[v]] and page.saying[v] != OTHER
        for node, t in zip(page.runs, texts):
            good[node] = bool(t) and inside[node]
    total = sum(good)
    if not total:
        return None
    filled = [False] * n
    for node, t in zip(page.runs, texts):
        filled[node] = bool(t)
    count = [int(x) for x in good]
    for v in range(n - 1, 0, -1):
        count[page.parents[v]] += count[v]
        filled[page.parents[v]] |= filled[v]
    out = [OUTSIDE] * n
    top = max(v for v in range(n) if count[v] == total)  # the innermost node with all of it: numbers grow inwards
    for v in range(1, n):
        above = out[page.parents[v]]
        if v == top:
            out[v] = ARTICLE
        elif above == BOILERPLATE:
            out[v] = BOILERPLATE
        elif above == ARTICLE:
            out[v] = ARTICLE if count[v] or not filled[v] and page.saying[v] != OTHER else BOILERPLATE
        else:
            out[v] = OUTSIDE if count[v] else BOILERPLATE
    return out


def fit(pages: DataFrame, known: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """The potentials, from pages (page_id, html) that are in known (page_id, text) or, without it, label themselves."""
    labelled = pages.select("page_id", "html")
    labelled = labelled.withColumn("known", F.lit(None).cast("string")) if known is None else labelled.join(known.select("page_id", F.col("text").alias("known")), "page_id")
    total = labelled.count()
    if total > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < -(-1_000_003 * sample // total))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, runs = np.zeros((4, 3, 3), np.int64), np.zeros((KINDS + 1, 3), np.int64)
        for b in batches:
            for source, text in zip(b["html"], b["known"]):
                page = parse(source)
                of = states(page, text if isinstance(text, str) else None)
                if of is None:
                    continue
                y = np.array(of)
                np.add.at(edges, (np.array(page.saying)[1:], y[np.array(page.parents)[1:]], y[1:]), 1)
                np.add.at(runs, (np.array(kinds(page), np.int64), y[np.array(page.runs, np.int64)]), 1)
        yield pd.DataFrame({"cell": np.arange(CELLS), "n": np.concatenate([edges.ravel(), runs.ravel()])})

    found = np.zeros(CELLS)
    for r in labelled.mapInPandas(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a hundred and a half numbers
        found[r.cell] = r.n
    return model_of(found[:36].reshape(4, 3, 3), found[36:].reshape(KINDS + 1, 3)[:KINDS])


# -- extraction ----------------------------------------------------------------------------------


def texts_of(sources: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    f = forest(pages)
    kept = marginals(f, model)[:, ARTICLE] >= 0.5
    out = []
    for p, start in zip(pages, f.starts):
        blocks: dict[int, list[str]] = {}
        for r, node, _, raw in p.texts:
            if kept[start + node]:
                blocks.setdefault(r, []).append(raw)
        found = (_squeezed("".join(b)) for b in blocks.values())
        out.append("\n\n".join(b for b in found if b))
    return out


def extracted(model: Model, source: Column) -> Column:
    """The main text of a column of html."""

    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list[str] = []
            held: list[str | None] = []
            size = 0
            for s in b:
                held.append(s)
                size += len(s or "")
                if size > CHUNK:
                    out += texts_of(held, model)
                    held, size = [], 0
            out += texts_of(held, model) if held else []
            yield pd.Series(out, dtype=object)

    return extract(source)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """pages without html, with their main text and its number of code points."""
    text, size = fresh(pages.drop("html"), "text", "n_chars")
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, extracted(model, F.col("html")).alias(text)).withColumn(size, F.char_length(text).cast("long"))
