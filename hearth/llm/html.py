"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of block elements. Each block is main text or not; a node's
features (tag, class and id words, length, links, sentence ends) give its potential,
parent-child potentials tie a block to its parent, and sum-product messages passed
upward and downward give each block's exact marginal. All potentials are trained from
the labelled pages of :mod:`hearth.llm.layouts`. The text of the blocks whose marginal
reaches one half is the page's main text.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.layouts import labelled_pages

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr img input select option button".split())
NEVER = set("script style textarea xmp iframe noembed noframes template head title noscript select option button svg math "
            "object canvas".split())  # never text of the article
CLOSES = {  # a start tag that ends an open element of these
    **{t: {"p"} for t in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form "
       "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "option": {"option"},
}
SCOPE = set("ul ol dl table div article section body main aside".split())  # an implied end doesn't cross these

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_WORD = re.compile(r"[a-z]+")
_WORDS_OF = ("class", "id", "role")  # attributes whose words are features
OUTER = ("#page", "html", "body", "form")  # elements that may hold a whole page
PLAIN = set("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table".split())
GROUPS = set("div section td blockquote".split())
LABEL = "y"  # of training pages
_NAMED = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def attributes(raw: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; the first of a name counts. A
    name is read whole: ``data-id`` is no ``id``."""
    given: dict[str, str] = {}
    for name, value in _NAMED.findall(raw):
        given.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return given


def hidden(given: dict[str, str]) -> bool:
    """Whether the attributes hide their element: ``hidden`` with any value, ``aria-hidden``
    true, or a style that ends at display none or visibility hidden."""
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true":
        return True
    style: dict[str, str] = {}
    firm = set()
    for declared in _COMMENT.sub("", given.get("style", "")).split(";"):
        name, _, value = (x.strip().lower() for x in declared.partition(":"))
        value, mark, _ = value.partition("!")
        if mark or name not in firm:  # the last counts, but for an important one
            style[name] = value.strip()
            firm |= {name} if mark else set()
    return style.get("display") == "none" or style.get("visibility") == "hidden"


class Page:
    """Block elements of a page and its text in page order."""

    __slots__ = ("tag", "parent", "given", "label", "own", "chars", "linked", "ends", "text")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.given: list[dict[str, str]] = []
        self.label: list[int] = []
        self.own: list[int] = []  # text right in the block
        self.chars: list[int] = []  # text of the whole subtree, after parsing
        self.linked: list[int] = []
        self.ends: list[int] = []
        self.text: list[tuple[int, str]] = []  # block and text; block -1: a boundary

    def add(self, tag: str, parent: int, given: dict[str, str], label: int | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.given.append(given)
        self.label.append(label if label is not None else self.label[parent] if parent >= 0 else 0)
        self.own.append(0)
        self.linked.append(0)
        self.ends.append(0)
        self.text.append((-1, ""))
        return len(self.tag) - 1


class Open:
    """The open elements of a page. Where the last of a name stands is known without a walk, so
    broken markup of any kind takes linear time."""

    def __init__(self, root: int) -> None:
        self.stack: list[tuple[str, int]] = [("#page", root)]  # each with the block it stands in
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]  # places of elements that aren't inline
        self.scopes: list[int] = [0]

    def push(self, name: str, block: int) -> None:
        k = len(self.stack)
        self.stack.append((name, block))
        self.at.setdefault(name, []).append(k)
        if name not in INLINE:
            self.blocks.append(k)
        if name in SCOPE:
            self.scopes.append(k)

    def pop(self) -> tuple[str, int]:
        name, block = self.stack.pop()
        k = len(self.stack)
        self.at[name].pop()
        for places in (self.blocks, self.scopes):
            if places[-1] == k:
                places.pop()
        return name, block

    def last(self, name: str) -> int:
        """Place of the last open element of a name; 0 if there is none."""
        places = self.at.get(name)
        return places[-1] if places else 0

    def ended_by(self, shut: set[str]) -> int:
        """The first of the neighbouring open elements that a start tag ends; 0 if none is."""
        k = max(map(self.last, shut))
        if not k or k < self.scopes[-1]:
            return 0
        while k > 1 and self.stack[k - 1][0] in shut:
            k -= 1
        return k


def parse(source: str, labelled: bool = False) -> Page:
    """The block tree of a page; broken markup ends somehow, nothing is dropped but comments.
    Labels are read from training pages only."""
    page = Page()
    open_ = Open(page.add("#page", -1, {}))
    stack = open_.stack
    links = 0
    at = 0

    def put(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            block = stack[-1][1]
            page.text.append((block, text))
            size = len(text) - text.count(" ")
            page.own[block] += size
            if links:
                page.linked[block] += size
            page.ends[block] += text.count(". ") + text.rstrip().endswith((".", "!", "?", ":"))

    def pop() -> None:
        nonlocal links
        name, block = open_.pop()
        links -= name == "a"
        if stack[-1][1] != block:
            page.text.append((-1, ""))

    while m := _TAG.search(source, at):
        put(source[at:m.start()])
        at = m.end()
        slash, name, attr = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            depth = open_.last(name)
            if depth and not (name in INLINE and open_.blocks[-1] > depth):
                while len(stack) > depth:
                    pop()
            elif name == "p":
                page.text.append((-1, ""))
            continue
        if name in VOID:
            if name in ("br", "hr"):
                page.text.append((-1, ""))
            continue
        if (shut := CLOSES.get(name)) and (low := open_.ended_by(shut)):
            while len(stack) > low:
                pop()
        if name in INLINE and name not in NEVER:
            open_.push(name, stack[-1][1])
            links += name == "a"
        else:
            given = attributes(attr) if attr else {}
            label = int(given.pop(LABEL)) if labelled and LABEL in given else None
            open_.push(name, page.add(name, stack[-1][1], given, label))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            put(source[at:stop])
            at = stop
        elif attr.endswith("/") and name in ("svg", "path"):
            pop()
    put(source[at:])
    page.chars = page.own.copy()
    for k in range(len(page.tag) - 1, 0, -1):
        p = page.parent[k]
        page.chars[p] += page.chars[k]
        page.linked[p] += page.linked[k]
        page.ends[p] += page.ends[k]
    return page


def features(page: Page) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for tag, parent, given, own, chars, linked, ends in zip(page.tag, page.parent, page.given, page.own, page.chars, page.linked, page.ends):
        f, words = [f"tag:{tag}"], {w for k in _WORDS_OF if k in given for w in _WORD.findall(given[k].lower())}
        f += [f"word:{w}" for w in words]
        if tag in OUTER and own:
            f.append("outer text")
        elif tag in PLAIN and parent >= 0 and page.tag[parent] in OUTER:
            f.append(f"outer:{tag}")
        if tag in GROUPS and not words:
            f.append("no name")
        f.append(f"own:{min(4, int(math.log(own + 1, 5)))}")
        f.append(f"chars:{min(4, int(math.log(chars + 1, 5)))}")
        f.append(f"links:{0 if not linked else 1 + (linked * 2 > chars) + (linked * 10 > chars * 9)}")
        f.append(f"ends:{min(3, ends)}")
        out.append(f)
    return out


class Trees:
    """The blocks of many pages as one forest: parents, levels by depth, feature lists."""

    def __init__(self, pages: list[Page]):
        parent, depth, self.features, self.never, self.bounds = [], [], [], [], [0]
        for page in pages:
            base = self.bounds[-1]
            for k, p in enumerate(page.parent):
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
            self.features += features(page)
            self.never += [t in NEVER or bool(g and hidden(g)) for t, g in zip(page.tag, page.given)]
            self.bounds.append(len(parent))
        self.parent, depth = np.array(parent, np.int64), np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def sum_product(self, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact marginals: P(main text) of each block and, for each block but the roots,
        P(parent's state, own state). ``own``: log odds of each block, ``pair``: log
        potentials [parent's state, own state]. Messages run up the trees, then down.
        """
        up = np.zeros((len(own), 2))
        up[:, 1] = own
        message = np.zeros_like(up)  # of each block to its parent
        for rows in reversed(self.levels[1:]):
            message[rows] = np.logaddexp(pair[None, :, 0] + up[rows, 0, None], pair[None, :, 1] + up[rows, 1, None])
            np.add.at(up, self.parent[rows], message[rows])
        full = up.copy()
        both = np.zeros((len(own), 2, 2))
        for rows in self.levels[1:]:
            rest = full[self.parent[rows]] - message[rows]  # all but the child's own message
            joint = rest[:, :, None] + pair[None] + up[rows, None, :]
            full[rows] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[rows] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700))), both


class Model:
    """Log odds of each feature and log potentials of parent and child."""

    def __init__(self, odds: dict[str, float], pair: np.ndarray):
        self.odds, self.pair = odds, pair

    @classmethod
    def train(cls, sources: list[str], steps: int = 150, rate: float = 0.5, decay: float = 0.002) -> Model:
        """Maximum likelihood by gradient: what the labels have of each feature and pair of
        states, less what the marginals expect. Starts at zero; the same on every machine."""
        pages = [parse(s, labelled=True) for s in sources]
        trees = Trees(pages)
        y = np.array([v for p in pages for v in p.label])
        names = {f: k for k, f in enumerate(sorted({f for fs in trees.features for f in fs}))}
        node = np.repeat(np.arange(len(y)), [len(fs) for fs in trees.features])
        feat = np.array([names[f] for fs in trees.features for f in fs])
        child = trees.parent >= 0
        want = np.zeros((2, 2))
        np.add.at(want, (y[trees.parent[child]], y[child]), 1)
        w, pair = np.zeros(len(names)), np.zeros((2, 2))
        square_w, square_p = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(steps):
            own = np.bincount(node, w[feat], len(y))
            p, both = trees.sum_product(own, pair)
            g = np.bincount(feat, (y - p)[node], len(names)) / len(pages) - decay * w
            h = (want - both[child].sum(axis=0)) / len(pages) - decay * pair
            square_w += g * g
            square_p += h * h
            w += rate * g / np.sqrt(square_w)
            pair = pair + rate * h / np.sqrt(square_p)
        return cls({f: float(w[k]) for f, k in names.items()}, pair)

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(main text) of every block of every page."""
        trees = Trees(pages)
        own = [-50.0 if never else sum([self.odds.get(f, 0.0) for f in fs])
               for never, fs in zip(trees.never, trees.features)]
        one, _ = trees.sum_product(np.array(own, np.float64), self.pair)
        return [one[a:b] for a, b in zip(trees.bounds, trees.bounds[1:])]


@functools.lru_cache(1)
def model() -> Model:
    return Model.train(labelled_pages())


def assemble(page: Page, content: np.ndarray) -> str:
    """Text of the content blocks in page order, white space turned into single spaces."""
    keep = content.tolist()
    return " ".join("".join(" " if b < 0 else t for b, t in page.text if b < 0 or keep[b]).split())


def extract_many(sources: list[str | None], trained: Model) -> list[str]:
    pages = [parse(s or "") for s in sources]
    return [assemble(p, m >= 0.5) for p, m in zip(pages, trained.marginals(pages))]


def extract(df: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), batch: int = 64) -> DataFrame:
    """``keep`` plus text and n_chars (code points) of every row.

    Null and empty pages, and pages without a content block, give an empty text; attributes of
    any name and value and markup that is broken or very deep are read in linear time;
    repeated rows each give their row; an empty table gives none.
    """
    src = df.select(*[F.col(c) for c in keep], F.col(source).cast("string").alias("_html"))
    trained = model()  # once on the driver: a few hundred numbers
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes[:-1]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                b = whole.slice(k, batch)
                texts = extract_many(b.column(len(keep)).to_pylist(), trained)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, schema)
