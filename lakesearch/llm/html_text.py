"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier's costs of calling a block content or boilerplate are the capacities of its
edges to the two terminals; neighbours in page order and blocks under one parent are tied by smoothness edges. The minimum
cut labels all blocks of a page at once, so a short line inside an article goes with it and a long advert beside it doesn't.
The classifier is trained on the pages' own semantic elements; half of the examples have these hidden, so that it also
learns from links, lengths and punctuation, and a few prior examples stand for kinds of boilerplate not met in the sample.
"""

from collections import deque
from dataclasses import dataclass
import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.mixing import id_hash
from lakesearch.llm.rows import small_batches

#: Bounds of the training sample: so many pages (those with the smallest id hash), none longer than so many characters.
TRAIN_PAGES, TRAIN_CHARACTERS = 1500, 200_000
#: Strength of the edges between neighbours and between blocks of one parent.
NEIGHBOUR, SIBLING = 1.5, 1.0

# Fixed values of the format.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe template select button head".split())
SPACED = frozenset("annotation br desc mi mn mo ms mtext text".split())
TO_END = frozenset("script style title textarea".split())
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
CLOSED_BY = {tag: [t for t, by in CLOSES.items() if tag in by] for tag in BLOCKS}
FENCE = frozenset("article aside div section table ul ol body html nav header footer main form td th blockquote".split())
#: Elements whose blocks are tied to each other: cells of one table belong together.
GROUPS = FENCE - {"td", "th"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that can be a part of the page by their id; other ids are anchors.
PARTS = frozenset("aside details div dl fieldset footer form header menu nav ol section table ul".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?+""")
NO_STYLE = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'""", re.S)
SENTENCE = re.compile(r"[.!?…:;,]")

#: Signs that an element and what stands in it belong to one kind; the first is content.
KINDS = ("content", "menu", "header", "footer", "aside", "advert", "comment", "form", "notice")
TAGS = {"article": "content", "main": "content", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "notice"}
NAMES = {
    "content": "article content entry main post story maincontent articlebody",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "header": "header masthead topbar banner",
    "footer": "footer copyright colophon contentinfo",
    "aside": "aside sidebar widget related recommended complementary",
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion",
    "comment": "comment comments discussion disqus replies reply",
    "form": "form login signup search subscribe newsletter",
    "notice": "notice cookie cookies consent modal popup alert share social",
}
NAME_KIND = {name: k for k, names in NAMES.items() for name in names.split()}
#: Parts of a name that say where in a part of the page an element stands, and parts before a part of the page that is had elsewhere.
PLACES = frozenset("area block body bottom box column container content inner item items left link links list main outer panel primary right secondary section slot text top unit wrap wrapper".split())
STATES = frozenset("has hide is no not show with without".split())
#: Tags that are boilerplate whatever share of the page stands in them, unless the article does.
FIXED = frozenset(t for t, k in TAGS.items() if k not in ("content", "form"))
#: Kinds that an id tells of although it is also the slug of the element's own heading.
TITLED = frozenset(["aside", "comment"])
HIDDEN = 1 << len(KINDS)
NOISE = HIDDEN - 2
WIDTH = len(KINDS) + 8


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    kinds: int
    depth: int
    parent: int
    common: int


def attributes_of(raw: str) -> dict[str, str]:
    """Values by lower-case name, character references decoded; empty without a value. The first of a name holds."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        if value[:1] in ('"', "'") and value[-1] == value[0] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def _not_displayed(style: str) -> bool:
    """Whether the display in force is none: the last declaration, an important one before others."""
    shown, important = "", False
    for declaration in NO_STYLE.sub(" ", style.lower()).split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        if name.strip() == "display" and (mark or not important):
            shown, important = value.strip(), bool(mark)
    return shown == "none"


def unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or "style" in attributes and _not_displayed(attributes["style"])


def kind_of_name(token: str) -> str | None:
    """Kind of a class, id or role: of the whole name or its last part, without modifiers, numbers and places."""
    parts = [x for x in re.split(r"[^a-z0-9]+", token.lower().partition("--")[0]) if x]
    kind = None
    while parts:
        if not (len(parts) > 1 and parts[-2] in STATES):
            kind = NAME_KIND.get(parts[-1]) or kind
        if parts[-1] not in PLACES and not parts[-1].isdigit():
            break
        parts.pop()
    return kind


@dataclass(slots=True)
class Mark:
    """An element with kinds of its own; ``above`` is the next one around it. ``by_id`` are kinds that only its id tells of."""
    above: int
    kinds: int
    tag: str
    main: bool
    by_id: int
    slug: str


def slug_of(text: str) -> str:
    """Words of a heading or an id, as an id is made of them."""
    return "-".join(re.findall(r"[^\W_]+", text.lower()))


def _kinds_of(tag: str, raw: str, above: int) -> tuple[int, bool, int, str]:
    """Kinds of an element itself, whether it is the page's main element, kinds that only its id tells of, and the id's slug.

    Inside content an id is a part of the page's only on an element that can be one, and is taken back when the element's own
    heading has the same slug (``settle_headings``): then it is an anchor."""
    kinds, main, by_id, slug = 0, tag == "main", 0, ""
    if (k := TAGS.get(tag)) and not (k in ("header", "footer") and above & 1):
        kinds |= 1 << KINDS.index(k)
    if raw and not raw.isspace():
        attributes = attributes_of(raw)
        if tag not in ("html", "body"):  # their names tell of the whole page
            for name in ("class", "role"):
                for token in attributes.get(name, "").split():
                    if k := kind_of_name(token):
                        kinds |= 1 << KINDS.index(k)
            if (k := kind_of_name(attributes.get("id", ""))) and (tag in PARTS or not above & 1):
                by_id = 1 << KINDS.index(k) & ~kinds
                kinds |= by_id
                if k not in TITLED and above & 1:
                    slug = slug_of(attributes["id"])
            main = main or "main" in attributes.get("role", "").lower().split()
        if unseen(attributes):
            kinds |= HIDDEN
    return kinds, main, by_id & NOISE, slug


def settle_headings(text: str, mark: int, marks: list[Mark]) -> None:
    """Takes back what ids tell of the elements around a heading that has the same slug."""
    slug = slug_of(text)
    while mark >= 0:
        if slug and marks[mark].slug == slug:
            marks[mark].kinds &= ~marks[mark].by_id
        mark = marks[mark].above


def settle(blocks: list[Block], places: list[int], marks: list[Mark]) -> None:
    """Sets the blocks' kinds: those of all elements around them, but no boilerplate kind of an element that wraps the page's own text.

    That is the main element and what is around it. As long as no content stands outside of boilerplate, it is also what is around an
    article and holds more text than is outside of boilerplate, then what holds more than half of the page's text.
    """
    n, total = len(marks), sum(len(b.text) for b in blocks)
    own = [0] * n
    for b, i in zip(blocks, places):
        if i >= 0:
            own[i] += len(b.text)
    sizes = list(own)
    for i in range(n - 1, -1, -1):
        if marks[i].above >= 0:
            sizes[marks[i].above] += sizes[i]

    def free(i: int) -> None:
        while i >= 0:
            marks[i].kinds &= ~NOISE
            i = marks[i].above

    def around() -> tuple[list[int], list[int], bool]:
        """Outermost boilerplate element of each mark, how many are on the way, and whether any content is outside."""
        outer, count, inside = [], [], []
        for i, m in enumerate(marks):
            first, above, within = (outer[m.above], count[m.above], inside[m.above]) if m.above >= 0 else (-1, 0, False)
            noise = bool(m.kinds & NOISE)
            outer.append(i if noise and first < 0 else first)
            count.append(above + noise)
            inside.append(within or bool(m.kinds & 1))
        return outer, count, any(inside[i] and not count[i] and own[i] for i in range(n))

    if any(m.kinds & NOISE for m in marks):
        free(max((i for i in range(n) if marks[i].main and sizes[i]), key=lambda i: sizes[i], default=-1))
        outer, count, clean = around()
        if not clean:
            rest = total - sum(sizes[i] for i in range(n) if outer[i] == i)
            nearest: dict[int, int] = {}
            for i, m in enumerate(marks):
                if m.tag == "article" and not m.kinds & NOISE and sizes[i] and (o := outer[i]) >= 0 and sizes[o] > rest:
                    if o not in nearest or (count[i], -sizes[i]) < (count[nearest[o]], -sizes[nearest[o]]):
                        nearest[o] = i
            for i in nearest.values():
                free(i)
            outer, count, clean = around()
        if not clean:
            level, inside, wraps = [], [], []  # boilerplate elements on the way, if each of them holds the most text
            for i, m in enumerate(marks):
                above = level[m.above] if m.above >= 0 else 0
                if m.kinds & NOISE:
                    above = above + 1 if 2 * sizes[i] > total and m.tag not in FIXED and above == len(wraps) else n + 1
                    if above <= n:
                        wraps.append(i)
                level.append(above)
                inside.append(bool(m.kinds & 1) or m.above >= 0 and inside[m.above])
            for i in wraps[: min((level[i] for i in range(n) if inside[i] and own[i]), default=n)]:
                marks[i].kinds &= ~NOISE
    kinds: list[int] = []
    for m in marks:
        kinds.append(m.kinds | (kinds[m.above] if m.above >= 0 else 0))
    for b, i in zip(blocks, places):
        b.kinds = kinds[i] if i >= 0 else 0


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: character references decoded, white space single, trimmed, none empty. Hidden elements, scripts,
    styles, frames, templates and form controls are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, kinds of it and all above, number, mark
    at_tag: dict[str, list[int]] = {}  # positions in the stack by tag, of blocks and of fences
    at_block: list[int] = []
    at_fence: list[int] = []
    at_group: list[int] = []
    marks: list[Mark] = []
    places: list[int] = []
    parts: list[str] = []
    linked, links, number, common, at = 0, 0, 0, 0, 0

    def flush():
        nonlocal linked, common
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            kinds = stack[-1][1] if stack else 0
            if text and not kinds & HIDDEN:
                home = stack[at_block[-1]][0] if at_block else ""
                parent = stack[at_group[-1]][2] if at_group else -1
                if home in HEADINGS and stack[-1][3] >= 0:
                    settle_headings(text, stack[-1][3], marks)
                out.append(Block(text, min(linked, len(text)), home, kinds, len(stack), parent, min(common, len(stack))))
                places.append(stack[-1][3] if stack else -1)
                common = len(stack)
        linked = 0

    def shorten(to: int):
        nonlocal common, links
        for tag, *_ in stack[to:]:
            links -= tag == "a"
            at_tag[tag].pop()
            if tag in BLOCKS:
                at_block.pop()
            if tag in FENCE:
                at_fence.pop()
            if tag in GROUPS:
                at_group.pop()
        del stack[to:]
        common = min(common, to)

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    done = 0
    while (opening := page.find("<", at)) >= 0 and page.find(">", opening) >= 0:
        if not (m := TOKEN.match(page, opening)):  # a sign, not a tag
            at = opening + 1
            continue
        add(page[done:opening])
        at = done = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            if at_tag.get(tag):
                shorten(at_tag[tag][-1])
            continue
        if tag in SPACED:
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            k = max((at_tag[t][-1] for t in CLOSED_BY[tag] if at_tag.get(t)), default=-1)  # an open element that this one ends
            if k >= (at_fence[-1] if at_fence else 0):
                shorten(k)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
            if end or tag in TO_END:
                at = done = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        above, mark = (stack[-1][1], stack[-1][3]) if stack else (0, -1)
        number += 1
        kinds, main, by_id, slug = _kinds_of(tag, m[3], above)
        if kinds:
            marks.append(Mark(mark, kinds, tag, main, by_id, slug))
            mark = len(marks) - 1
        at_tag.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            at_block.append(len(stack))
        if tag in FENCE:
            at_fence.append(len(stack))
        if tag in GROUPS:
            at_group.append(len(stack))
        stack.append((tag, above | kinds, number, mark))
        links += tag == "a"
    add(page[done:])
    flush()
    settle(out, places, marks)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH))
    for row, b in zip(x, blocks):
        for k in range(len(KINDS)):
            row[k] = b.kinds >> k & 1
        size, marks = len(b.text), len(SENTENCE.findall(b.text))
        row[len(KINDS) :] = (1, b.linked / size, min(math.log1p(size) / 6, 1.5), min(marks / size * 20, 2), b.tag == "p", b.tag in HEADINGS, b.tag in ("li", "td", "th", "dt", "dd"), size < 40 and marks == 0)
    return x


#: A block with one of these kinds is boilerplate, also inside an article; one with content alone is content. Each stands for
#: so many examples.
PRIOR_WEIGHT = 30.0


#: Prior examples without any sign but their text: how often, (1, share of links, length, punctuation, p, heading, item, bare
#: line), and how likely they are content.
BARE = (
    (8, (1, 0.0, 1.0, 0.6, 1, 0, 0, 0), 1.0), (4, (1, 0.0, 1.0, 0.6, 0, 0, 0, 0), 0.95), (2, (1, 0.0, 0.6, 0.5, 1, 0, 0, 0), 0.9), (2, (1, 0.0, 0.4, 0.0, 0, 1, 0, 1), 0.7),
    (2, (1, 0.0, 0.7, 0.5, 0, 0, 1, 0), 0.8), (4, (1, 1.0, 0.5, 0.0, 0, 0, 1, 1), 0.0), (4, (1, 1.0, 0.4, 0.0, 0, 0, 0, 1), 0.0), (2, (1, 0.0, 0.4, 0.0, 0, 0, 0, 1), 0.3),
)


#: Texts that are content inside content though they look like menus: cells, lists of links, definitions, code, bare lines.
INSIDE = (
    (1, 0.0, 0.2, 0.0, 0, 0, 1, 1), (1, 1.0, 0.4, 0.0, 0, 0, 1, 1), (1, 1.0, 0.5, 0.0, 0, 0, 1, 0), (1, 0.0, 0.4, 0.0, 0, 0, 1, 1),
    (1, 0.0, 0.6, 0.3, 0, 0, 0, 0), (1, 0.0, 0.3, 0.0, 0, 0, 0, 1), (1, 1.0, 0.4, 0.0, 0, 0, 0, 1), (1, 1.0, 0.5, 0.0, 1, 0, 0, 1), (1, 1.0, 0.4, 0.0, 0, 1, 0, 1),
)


def _priors() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for text in ((1, 0.0, 0.8, 0.6, 1, 0, 0, 0), (1, 0.5, 0.5, 0.1, 0, 0, 0, 1), (1, 0.0, 0.7, 0.5, 0, 0, 1, 0), (1, 0.0, 0.5, 0.0, 0, 1, 0, 1)):
        for k in range(len(KINDS)):
            for inside in (0, 1) if k else (0,):
                kinds = np.zeros(len(KINDS))
                kinds[k] = 1
                kinds[0] = max(kinds[0], inside)
                rows.append(np.concatenate((kinds, text)))
                labels.append(float(k == 0))
    for text in INSIDE:
        rows.append(np.concatenate(([1.0], np.zeros(len(KINDS) - 1), text)))
        labels.append(1.0)
    for times, text, label in BARE:
        rows += [np.concatenate((np.zeros(len(KINDS)), text))] * times
        labels += [label] * times
    return np.array(rows), np.array(labels)


def train(pages: list[str], rounds: int = 40, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps. Blocks under content elements alone are content, blocks with another kind boilerplate."""
    rows, labels, weights = [*_priors()[:1]], [_priors()[1]], [np.full(len(_priors()[1]), PRIOR_WEIGHT)]
    for page in pages:
        x = features(blocks_of(page))
        if not len(x):
            continue
        noise = x[:, 1 : len(KINDS)].any(1)
        known = noise | (x[:, 0] > 0)
        x, y = x[known], (~noise[known]).astype(float)
        bare = x.copy()
        bare[:, : len(KINDS)] = 0
        rows += [x, bare]
        labels += [y, y]
        weights += [np.full(len(y), 1 / max(len(y), 1)), np.full(len(y), 0.5 / max(len(y), 1))]
    x, y, c = np.concatenate(rows), np.concatenate(labels), np.concatenate(weights)
    w = np.zeros(WIDTH)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + penalty * np.eye(WIDTH), x.T @ (c * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: True for the nodes that stay with the content terminal.

    ``content[i]`` is the cost of calling i boilerplate, ``boilerplate[i]`` of calling it content; an edge costs its weight if its
    ends differ. A node whose terminals differ by more than all its edges is decided at once, and its edges become terminal
    capacity of its neighbours; what is left is solved by augmenting paths.
    """
    n = len(content)
    s, t = list(content), list(boilerplate)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(s[i] - t[i]) > sum(near[i].values()):
            label[i] = s[i] > t[i]
            for j, w in near[i].items():
                (s if label[i] else t)[j] += w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i in left:
            both = min(s[i], t[i])
            s[i] -= both
            t[i] -= both
        residual = {i: dict(near[i]) for i in left}
        while True:  # shortest augmenting path
            before: dict[int, int] = {i: -1 for i in left if s[i] > 1e-12}
            queue, end = deque(before), None
            while queue:
                i = queue.popleft()
                if t[i] > 1e-12:
                    end = i
                    break
                for j, w in residual[i].items():
                    if w > 1e-12 and j not in before:
                        before[j] = i
                        queue.append(j)
            if end is None:
                break
            path = [end]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            flow = min(t[end], s[path[-1]], *(residual[b][a] for a, b in zip(path, path[1:])))
            t[end] -= flow
            s[path[-1]] -= flow
            for a, b in zip(path, path[1:]):
                residual[b][a] -= flow
                residual[a][b] = residual[a].get(b, 0.0) + flow
        for i in left:
            label[i] = i in before
    return [bool(x) for x in label]


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    z = np.clip(features(blocks) @ weights, -12, 12)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            way = blocks[i - 1].depth + b.depth - 2 * b.common  # steps between the two in the tree
            edges.append((i - 1, i, NEIGHBOUR / (1 + way)))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        elif b.parent in last:
            edges[-1] = (i - 1, i, edges[-1][2] + SIBLING)
        last[b.parent] = i
    return cut(np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist(), edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    """Content blocks of a page, one a line; empty if there is none."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, content in zip(blocks, label_blocks(blocks, weights)) if content) if blocks else ""


def fit(pages: DataFrame, id_column: str = "page_id", html: str = "html", most: int = TRAIN_PAGES, characters: int = TRAIN_CHARACTERS) -> np.ndarray:
    """Weights from a bounded sample of pages; without any, from the prior examples."""
    known = pages.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{html}`").alias("__html")).where(F.col("__id").isNotNull() & (F.length("__html") <= characters))
    chosen = known.select("__id").distinct().orderBy(id_hash(F.col("__id")), "__id").limit(most)  # ids first: only their pages are sent to the driver
    sample = known.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__html").alias("html"))
    return train([r.html for r in sorted(sample.collect(), key=lambda r: str(r["__id"]))])


def extract(pages: DataFrame, weights: np.ndarray, html: str = "html") -> DataFrame:
    """``pages`` with ``text``. Whole pages are read; a null page counts as empty and gives an empty text; markup that isn't
    closed ends with its parent or the page. Rows are handled one by one; an input column named text is replaced."""
    small_batches(pages.sparkSession)
    rows = pages.select([F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"])
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, shared.value) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, rows.withColumn("text", F.lit("")).schema)
