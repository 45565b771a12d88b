"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier gives each block its cost of being
content and of being boilerplate, which become capacities to the two terminals; edges between
neighbouring blocks and between blocks of one parent element make unlike labels costly. A
minimum cut then labels the whole page at once.

The classifier is fitted on a bounded sample of pages, with the semantic elements that some blocks
stand in (article and main; nav, footer, aside, form) as labels, by maximum a posteriori around prior
weights that carry over to signs the sample lacks.

Nulls and odd input: a null or empty html has the empty text; broken, unclosed or cut markup is read
as far as it goes; a tag that the page's end cuts is dropped. Rows with a null page_id or
repeated rows are extracted like any other; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_pieces
from foretally.llm.fitting import bounded_sample, sigmoid

#: Pages that the classifier is fitted on at most: those with the smallest hashes of their id and html, of at most FIT_BYTES.
FIT_PAGES = 300
FIT_BYTES = 64 << 10
NEIGHBOUR = 0.6
SAME_PARENT = 0.6

# How elements and the words of their class and id are read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script style noscript template iframe textarea title"
#: Elements that no drawing holds: their tags end an unclosed svg.
BREAKOUT_TAGS = (
    "b big blockquote body br center code dd div dl dt em embed h[1-6] head hr i img li menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var"
)
#: Open elements that the beginning of another one ends, if they are innermost.
IMPLIED_ENDS = {
    "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
} | dict.fromkeys(("thead", "tbody", "tfoot"), ("td", "th", "tr", "thead", "tbody", "tfoot"))
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form header dialog menu button select search".split())
CONTENT_WORDS = frozenset("article body content entry main post story text prose".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus foot footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)

_ROLES = {
    "navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1,
    "main": 1, "article": 1,
}
_RAW, _BREAKOUT = ("|".join(tags.split()) for tags in (RAW_TAGS, BREAKOUT_TAGS))
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?![^>]*/>)[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<svg(?=[\s/>])(?![^>]*/>)[^>]*+>.*?(?:</svg\s*+>|(?=</?(?:{_BREAKOUT})[\s/>])|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?|[\"'=/]")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

N_FEATURES = 14
#: Prior weights: bias, nearest mark content, boilerplate, any boilerplate above, share of link text, log of length,
#: ends like a sentence, heading, list item, paragraph, few words, header mark, copyright sign, label-like bars.
PRIOR = np.array([-1.2, 3.5, -4.0, -1.5, -3.5, 0.45, 0.5, 0.8, -0.5, 0.8, -0.2, 1.5, -1.5, 0.0])


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    mark: int  # nearest marked element: 1 content, -1 boilerplate, 0 none
    below_boiler: bool
    semantic: int  # the same for semantic elements alone, the label of the fit
    parent: int
    in_header: bool


def attributes_of(text: str) -> Iterator[tuple[str, str]]:
    """(lower-case name, value) of a tag's attributes; what stands inside a value is no name."""
    for match in _ATTRIBUTE.finditer(text):
        if match[1]:
            yield match[1].lower(), match[2] or match[3] or match[4] or ""


def _named(value: str) -> int:
    """What the names in a class or id say. One that is a content word as a whole and another one with a boilerplate word say nothing."""
    content = boiler = whole = False
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        boiler |= bool(words & BOILER_WORDS)
        content |= bool(words & CONTENT_WORDS)
        whole |= bool(words) and words <= CONTENT_WORDS
    return 0 if boiler and whole else -1 if boiler else 1 if content else 0


def mark_of(tag: str, attributes: str, above: int = 0) -> int:
    """What an element's tag, role, class and id say below a mark: 1 content, -1 boilerplate, 0 nothing."""
    own = 1 if tag in CONTENT_TAGS else -1 if tag in BOILER_TAGS else 0
    if tag == "header" and above > 0:  # an article's own heading
        own = 0
    if len(attributes) > 4:
        for name, value in attributes_of(attributes):
            if name == "role":
                own = _ROLES.get(value.lower(), own)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return -1
            elif name in ("class", "id"):
                said = _named(value)
                if said < 0 and not own > 0:
                    own = -1
                elif said > 0 and own == 0:
                    own = 1
    return own


class _Links:
    """How many links are open: one with an end tag before the next link lasts through blocks, another ends with its block."""

    def __init__(self, page: str):
        self.page, self.open, self.loose = page, 0, 0
        self.tags, self.next = _LINK.finditer(page), None
        self.seen = -1

    def begin(self, at: int) -> None:
        while self.seen < at:  # to the first link tag after this one
            self.next = next(self.tags, None)
            self.seen = self.next.start() if self.next else len(self.page)
        if self.next and self.next[1]:
            self.open += 1
        else:
            self.loose += 1

    def end(self) -> None:
        if self.open:
            self.open -= 1
        else:
            self.loose = max(0, self.loose - 1)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    # open elements: tag, mark, below boilerplate, semantic, number, in a header
    stack: list[tuple[str, int, bool, int, int, bool]] = [("", 0, False, 0, 0, False)]
    depths: dict[str, list[int]] = {}  # of the open elements of each tag
    number = linked = 0
    links = _Links(page)
    parts: list[str] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] not in BLOCK_TAGS:
                    depth -= 1
                tag, mark, below, semantic, own, header = stack[depth]
                parent = stack[depth - 1][4] if depth > 0 and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else own
                found.append(Block(text, min(linked, len(text)), tag, mark, below, semantic, parent, header))
            parts, linked = [], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()

    at = 0
    for token in _TOKEN.finditer(page):
        begin = token.start()
        if begin > at:
            parts.append(page[at:begin])
            if links.open or links.loose:
                linked += begin - at
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                links.end()
            if depths.get(tag):
                close(depths[tag][-1])
            continue
        if tag in BLOCK_TAGS:
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            while stack[-1][0] in IMPLIED_ENDS.get(tag, ()):
                close(len(stack) - 1)
            links.loose = 0
        if tag == "br" or tag == "hr":
            parts.append(" ")
        elif tag == "a":
            links.begin(at)
        if tag in VOID_TAGS or token[4].endswith("/>"):
            continue
        _, mark, below, semantic, _, header = stack[-1]
        own = mark_of(tag, token[4], mark)
        number += 1
        label = 1 if tag in CONTENT_TAGS else -1 if tag in BOILER_TAGS and tag != "header" else semantic
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, own or mark, below or own < 0, label, number, header or tag == "header"))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


def block_features(block: Block) -> tuple[float, ...]:
    text, n = block.text, len(block.text)
    return (
        1.0,
        float(block.mark > 0),
        float(block.mark < 0),
        float(block.below_boiler),
        block.linked / n,
        math.log1p(n) / 2,
        float(text[-1] in ".!?:;…\"'”»"),
        float(block.tag[:1] == "h" and block.tag[1:].isdigit()),
        float(block.tag == "li"),
        float(block.tag == "p"),
        float(n < 25),
        float(block.in_header and block.tag == "h1"),
        float("©" in text),
        float(" | " in text),
    )


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes fall on the content side of a minimum cut.

    ``gain`` is what a node gains by being content: its capacity to one terminal, or if negative to the
    other. Nodes that no set of neighbours can outvote are decided first and folded into the gains
    of their neighbours; the rest go through augmenting paths of shortest length.
    """
    n = len(gain)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, weight in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0.0) + weight
            around[b][a] = around[b].get(a, 0.0) + weight
    gain, label = list(gain), [None] * n
    ties = [sum(near.values()) for near in around]
    ready = [i for i in range(n) if abs(gain[i]) > ties[i]]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = gain[i] > 0
        for j, weight in around[i].items():
            if label[j] is None:
                gain[j] += weight if label[i] else -weight
                ties[j] -= weight
                if abs(gain[j]) > ties[j] + 1e-12:
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    room = {i: {j: w for j, w in around[i].items() if label[j] is None} for i in rest}
    supply = {i: max(gain[i], 0.0) for i in rest}
    demand = {i: max(-gain[i], 0.0) for i in rest}
    tiny = 1e-9
    while True:
        # distances from the supplying nodes
        level = {i: 0 for i in rest if supply[i] > tiny}
        queue = list(level)
        for i in queue:
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not any(demand[i] > tiny for i in level):
            return [i in level if label[i] is None else label[i] for i in range(n)]
        pending = {i: list(room[i]) for i in level}
        for source in [i for i in level if level[i] == 0]:
            path = [source]
            while path and supply[source] > tiny:
                i = path[-1]
                if demand[i] > tiny:
                    flow = min([supply[source], demand[i], *(room[a][b] for a, b in zip(path, path[1:]))])
                    supply[source] -= flow
                    demand[i] -= flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = [source]
                    continue
                while pending[i]:
                    j = pending[i][-1]
                    if room[i][j] > tiny and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                    pending[i].pop()
                else:
                    path.pop()
                    if path and pending[path[-1]]:
                        pending[path[-1]].pop()


def page_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and from each block to the one before it under the same parent."""
    edges, latest = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR))
        if block.parent in latest:
            edges.append((latest[block.parent], i, SAME_PARENT))
        latest[block.parent] = i
    return edges


def extract(pages: list[str], weights: np.ndarray) -> list[tuple[str, int]]:
    """(main text, content blocks) of each page."""
    parsed = [blocks_of(page) for page in pages]
    rows = [block_features(block) for blocks in parsed for block in blocks]
    gains = (np.array(rows, float).reshape(-1, N_FEATURES) @ weights).tolist()
    out, at = [], 0
    for blocks in parsed:
        kept = minimum_cut(gains[at : at + len(blocks)], page_edges(blocks))
        at += len(blocks)
        out.append((" ".join(b.text for b, content in zip(blocks, kept) if content), sum(kept)))
    return out


def fit_weights(rows: np.ndarray, labels: np.ndarray, ridge: float = 5.0, steps: int = 30) -> np.ndarray:
    """Logistic weights around the prior ones."""
    weights = PRIOR.copy()
    for _ in range(steps):
        p = sigmoid(rows @ weights)
        slope = rows.T @ (labels - p) - ridge * (weights - PRIOR)
        curve = (rows * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ rows + ridge * np.eye(len(PRIOR))
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def fit(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> np.ndarray:
    """The classifier's weights, from a bounded sample of pages."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(html_column).alias("html"))
    small = F.octet_length("html") <= FIT_BYTES
    sample = bounded_sample(rows, FIT_PAGES, "page_id", "html", keep=small).select("html").collect()
    blocks = [b for row in sample for b in blocks_of(row.html) if b.semantic]
    if not blocks:
        return PRIOR
    return fit_weights(np.array([block_features(b) for b in blocks]), np.array([float(b.semantic > 0) for b in blocks]))


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page."""
    weights = fit(pages, id_column, html_column)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = extract(filled(piece.column(2)).to_pylist(), weights)
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                piece.column(1),
                pa.array([t for t, _ in found], pa.string()),
                pa.array([len(t) for t, _ in found], pa.int64()),
                pa.array([k for _, k in found], pa.int32()),
            ],
            ["page_id", "url", "text", "n_chars", "n_blocks"],
        )

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_pieces(rows, run, f"page_id {kind}, url string, text string, n_chars long, n_blocks int", "html")
