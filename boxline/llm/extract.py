"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text with their place in the document tree. A logistic classifier over
measures of the text (length, links, punctuation) and of the place (names of the elements around it) gives
every block a log odds of being content. It is trained on blocks of a sample of pages whose place alone
tells what they are; each counts a second time without the measures of its place, so that pages with
nameless elements are judged by their text. Log odds become capacities to the two terminals, neighbours
and blocks of one parent are joined by edges that get weaker with their distance in the tree, and a maximum
flow separates content from the rest at least cost.

The text of a page is that of its content blocks in page order, one line each, with character references
decoded and white space made one space. Null, empty and textless pages give an empty text. Broken markup is
read as far as it goes: unclosed elements end with their parent. Page ids may be null or repeat.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Most pages that the classifier is trained on, chosen by a hash of their content.
TRAIN_PAGES = 2_000
# Largest log odds of one block, and the strength of edges between neighbours and within a parent.
MOST_ODDS, NEAR, PARENT = 8.0, 1.0, 0.5

#: Element names by the part they play in HTML.
RAW = frozenset("script style textarea title".split())
# What is inside isn't text of the page, from the start tag to its own end tag.
INNER = frozenset("noscript template select iframe svg object canvas math audio video".split())
BLOCKS = frozenset(
    "html body div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot "
    "tr td th caption h1 h2 h3 h4 h5 h6 p blockquote pre form fieldset legend figure figcaption address hr "
    "details summary dialog center button menu".split()
)
CONTAINERS = BLOCKS - frozenset("h1 h2 h3 h4 h5 h6 p hr".split())
CONTENT_NAMES = frozenset("article main".split())
OTHER_NAMES = frozenset("nav header footer aside form dialog menu button fieldset head".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
    "cookies consent notice notices gdpr privacy popup modal overlay newsletter subscribe subscription "
    "signup sidebar side rail widget widgets related recommended recommendations share sharing social menu "
    "menubar nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar comment "
    "comments commentlist reply replies respond disqus login search pager pagination copyright legal "
    "toolbar skip alert disclaimer complementary contentinfo dialog form feedback".split()
)
CONTENT_WORDS = frozenset(
    "article articlebody post posts entry content story main maincontent body text prose".split()
)
# Words of a class that tell what state or layout something is in, not what it is: has-sidebar, comments-open.
STATE_WORDS = frozenset("has no with without open opened closed layout enabled disabled".split())
# Words that leave it open whether a part is named or the layout around it: page-header-fixed.
LAYOUT_WORDS = frozenset("fixed sticky static page left right".split())
# Comments, adverts and forms: nothing inside is content.
SHUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
    "commentlist reply replies respond disqus form dialog login search feedback".split()
)
# Lists of other pages, whose items may be articles, and boxes around the page's own text.
LIST_WORDS = frozenset(
    "related recommended recommendations widget widgets share sharing social newsletter subscribe "
    "subscription signup cookie cookies consent gdpr popup modal complementary contentinfo".split()
)
# Whole names, without signs, of what holds an article's text.
STRONG_NAMES = frozenset(
    "main mainbody maincontent contentmain article articlebody articlecontent articletext post postbody "
    "postcontent posttext entry entrybody entrycontent entrytext hentry story storybody storycontent "
    "storytext singlepost blogpost prose".split()
)
# How firmly a word marks an element as other: what is inside becomes content again by any content word, by
# a strong name, only as the main element, or never.
LOOSE, NAMED, LISTED, SHUT = range(4)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*+>",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_NAMED = re.compile(
    r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden",
    re.I,
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
FEATURES = [
    "one", "log_chars", "log_words", "links", "signs", "ended", "heading", "paragraph", "item", "short",
    "capitals", "mark", "parent_chars", "content_place", "other_place", "other_name", "other_word",
]
PLACE = FEATURES.index("content_place")
#: Log odds before anything is learned, in the order of ``FEATURES``.
PRIOR = np.array(
    [-1.5, 0.3, 0.3, -3.0, 1.0, 0.8, 0.3, 0.6, -0.5, -0.5, -0.5, -2.0, 0.2, 4.0, -6.0, -1.0, -1.0]
)


@dataclass
class Element:
    """An open element: the verdict of its place (1 content, -1 other, 0 none) and where it came from."""

    name: str
    number: int
    depth: int
    place: int = 0
    by_name: bool = False
    by_word: bool = False
    hidden: bool = False
    chars: int = 0
    firm: int = LOOSE


@dataclass
class Block:
    text: str
    name: str
    links: int
    parent: Element
    path: tuple[int, ...]
    features: np.ndarray = field(default=None)


def _names(attributes: str) -> tuple[set[str], set[str], int | None]:
    """(words, whole names without signs, how firmly they mark an element as other) of its attributes."""
    words, names, firm = set(), set(), None
    for found in _NAMED.findall(attributes):
        for name in "".join(found).split():
            own = {w.lower() for w in _WORD.findall(name)}
            words |= own
            names.add(re.sub(r"[^a-z0-9]", "", name.lower()))
            if own & OTHER_WORDS and not own & STATE_WORDS:
                level = (
                    SHUT if own & SHUT_WORDS else LISTED if own & LIST_WORDS
                    else LOOSE if own & LAYOUT_WORDS else NAMED
                )
                firm = level if firm is None else max(firm, level)
    return words, names, firm


def _open(name: str, attributes: str, parent: Element, number: int) -> Element:
    words, names, firm = _names(attributes) if attributes else (set(), set(), None)
    found = Element(
        name, number, parent.depth + 1, parent.place, parent.by_name, parent.by_word,
        parent.hidden or bool(attributes and _HIDDEN.search(attributes)), firm=parent.firm,
    )
    if name in ("html", "body"):
        # Their names tell of the whole page.
        return found
    # The head of an article is part of it.
    other_name = name in OTHER_NAMES and not (name == "header" and parent.place > 0)
    if name in CONTENT_NAMES and firm in (LOOSE, NAMED):
        firm = None
    if other_name or firm is not None:
        found.place = -1
        found.by_name, found.by_word = other_name, firm is not None
        own = SHUT if other_name else firm
        found.firm = max(own, parent.firm) if parent.place < 0 else own
    elif name in CONTENT_NAMES or words & CONTENT_WORDS:
        if parent.place >= 0 or parent.firm == LOOSE:
            again = True
        elif parent.firm == NAMED:
            again = name in CONTENT_NAMES or bool(names & STRONG_NAMES)
        else:
            again = parent.firm == LISTED and (name == "main" or bool(names & {"main", "articlebody"}))
        if again:
            found.place, found.by_name, found.by_word, found.firm = 1, False, False, LOOSE
    return found


def _tags(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, name, "/" of an end tag, attributes) of what isn't text; comments and such have no name.

    Scripts, styles and titles reach to their end tag or else to the end of the page. Pictures and players
    reach to their end tag within the element around them; without one only the tag itself isn't text.
    """
    found: list[tuple[int, int, str, str, str]] = []
    at, drawing = 0, 0
    while (match := TOKEN.search(page, at)) is not None:
        closing, name, attributes = match.group(1) or "", (match.group(2) or "").lower(), match.group(3) or ""
        at = match.end()
        alone = attributes.rstrip().endswith("/")
        if name in ("svg", "math") and not (alone and not closing):
            drawing = max(0, drawing - 1) if closing else drawing + 1
        elif name in CONTAINERS:
            drawing = 0
        # Within a drawing these may be empty elements.
        if name in RAW and not closing and not (alone and drawing):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            name = ""
        found.append((match.start(), at, name, closing, attributes))
    # The tag that ends each picture or player.
    ends: dict[int, int] = {}
    stack: list[int] = []
    open_names: Counter = Counter()
    for k, (_, _, name, closing, attributes) in enumerate(found):
        if name not in CONTAINERS and name not in INNER:
            continue
        if not closing:
            if not attributes.rstrip().endswith("/"):
                stack.append(k)
                open_names[name] += 1
        elif open_names[name]:
            while True:
                top = stack.pop()
                open_names[found[top][2]] -= 1
                if found[top][2] == name:
                    break
            if name in INNER:
                ends[top] = k
    out, k = [], 0
    while k < len(found):
        start, end, name, closing, attributes = found[k]
        if k in ends:
            k = ends[k]
            out.append((start, found[k][1], "", "", ""))
        else:
            out.append((start, end, name, closing, attributes))
        k += 1
    return out


def page_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order, without those that are hidden."""
    root = Element("", 0, 0)
    stack, number, out = [root], 0, []
    pieces: list[str] = []
    links, link, name = 0, 0, ""
    last = 0

    def close():
        nonlocal links, name
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            parent = stack[-1]
            if text and not parent.hidden:
                parent.chars += len(text)
                out.append(Block(text, name or parent.name, links, parent,
                                 tuple(e.number for e in stack)))
        links, name = 0, ""

    for start, end, tag, closing, attributes in _tags(page):
        if start > last:
            piece = page[last:start]
            pieces.append(piece)
            if link:
                links += len(piece.strip())
        last = end
        if not tag:
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS or tag == "head":
            close()
            if tag in CONTAINERS or tag == "head":
                if closing:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name == tag:
                            del stack[k:]
                            break
                else:
                    if tag == "body":
                        del stack[1:]
                    elif tag == "li" or tag in ("td", "th", "tr", "dt", "dd"):
                        # These end when the next one begins.
                        if stack[-1].name == tag:
                            stack.pop()
                    number += 1
                    if not attributes.rstrip().endswith("/"):
                        stack.append(_open(tag, attributes, stack[-1], number))
                        if tag == "head":
                            stack[-1].hidden = True
            elif not closing:
                name = tag
    if last < len(page):
        pieces.append(page[last:])
        if link:
            links += len(page[last:].strip())
    close()
    for b in out:
        b.features = features(b)
    return out


def features(block: Block) -> np.ndarray:
    text, parent = block.text, block.parent
    n, words = len(text), text.count(" ") + 1
    signs = sum(text.count(c) for c in ".,;:!?")
    upper = sum(map(str.isupper, text))
    return np.array([
        1.0, np.log1p(n), np.log1p(words), min(1.0, block.links / n), min(1.0, signs / words),
        text[-1] in ".!?:\"'”»", block.name in ("h1", "h2", "h3", "h4", "h5", "h6"), block.name == "p",
        block.name in ("li", "td", "th", "dt", "dd", "button"), n < 25, upper / n,
        "©" in text or "copyright" in text.lower(), np.log1p(parent.chars),
        parent.place > 0, parent.place < 0, parent.by_name, parent.by_word,
    ], float)


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression drawn towards ``PRIOR``, by Newton steps."""
    weights = PRIOR.copy()
    if not len(rows):
        return weights
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        g = rows.T @ (p - labels) + ridge * (weights - PRIOR)
        h = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(weights))
        step = np.linalg.solve(h, g)
        weights = weights - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: odds left on the wrong side plus edges between the sides.

    Augmenting paths run from blocks with odds to spare to blocks that lack some; what can still be reached
    at the end is content.
    """
    n, left = len(odds), list(odds)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    room: list[float] = []
    for i, j, w in edges:
        near[i].append((j, len(room)))
        near[j].append((i, len(room) + 1))
        room += [w, w]
    while True:
        came: list = [None] * n
        queue = deque(i for i in range(n) if left[i] > 1e-9)
        for i in queue:
            came[i] = (-1, -1)
        sink = -1
        while queue and sink < 0:
            i = queue.popleft()
            for j, e in near[i]:
                if room[e] > 1e-9 and came[j] is None:
                    came[j] = (i, e)
                    if left[j] < -1e-9:
                        sink = j
                        break
                    queue.append(j)
        if sink < 0:
            return [c is not None for c in came]
        path, at, amount = [], sink, -left[sink]
        while came[at][0] >= 0:
            path.append(came[at][1])
            amount = min(amount, room[came[at][1]])
            at = came[at][0]
        amount = min(amount, left[at])
        left[at] -= amount
        left[sink] += amount
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker the more elements part them, and along each parent."""
    edges, seen = [], {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1].path
            common = 0
            for x, y in zip(before, b.path):
                if x != y:
                    break
                common += 1
            apart = len(before) + len(b.path) - 2 * common
            edges.append((i - 1, i, NEAR * 0.5**apart))
        k = seen.get(b.parent.number)
        if k is not None and k != i - 1:
            edges.append((k, i, PARENT))
        seen[b.parent.number] = i
    return edges


def main_text(page: str, weights: np.ndarray) -> str:
    found = page_blocks(page)
    if not found:
        return ""
    odds = np.clip(np.array([b.features for b in found]) @ weights, -MOST_ODDS, MOST_ODDS)
    content = min_cut(odds.tolist(), smoothness(found))
    return "\n".join(b.text for b, keep in zip(found, content) if keep)


def train(pages: DataFrame, column: str = "html", limit: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from the blocks of at most ``limit`` pages whose place tells what they are."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    chosen = pages.select(F.xxhash64(text).alias("_hash")).distinct().orderBy(
        F.xxhash64("_hash"), "_hash"
    ).limit(limit)
    sample = pages.select(text.alias("_html"), F.xxhash64(text).alias("_hash")).join(
        F.broadcast(chosen), "_hash"
    ).select("_hash", "_html")

    def extract(batches):
        width = len(FEATURES)
        for batch in batches:
            rows = []
            for page in batch.column(1):
                marked = [b for b in page_blocks(page.as_py()) if b.parent.place]
                values = np.array([b.features for b in marked]).reshape(-1, width)
                label = np.array([b.parent.place > 0 for b in marked], float)
                rows.append(np.column_stack([label, values]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary())], ["_hash", "rows"]
            )

    got = sample.mapInArrow(extract, "_hash bigint, rows binary").groupBy("_hash").agg(
        F.first("rows").alias("rows")
    ).orderBy("_hash").collect()
    blob = b"".join(bytes(r["rows"]) for r in got)
    table = np.frombuffer(blob, np.float32).astype(float).reshape(-1, len(FEATURES) + 1)
    labels, rows = table[:, 0], table[:, 1:]
    plain = rows.copy()
    plain[:, PLACE:] = 0
    return fit(np.vstack([rows, plain]), np.concatenate([labels, labels]))


def extract_text(
    pages: DataFrame, weights: np.ndarray, column: str = "html", output: str = "text"
) -> DataFrame:
    """``pages`` without ``column`` but with ``output`` and n_chars (code points); such columns are replaced."""
    carried = [c for c in pages.columns if c not in (column, output, "n_chars")]

    def apply(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(0)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), sizes],
                [*carried, output, "n_chars"],
            )

    schema = StructType([
        *(pages.schema[c] for c in carried), StructField(output, StringType()),
        StructField("n_chars", LongType()),
    ])
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return pages.select(text.alias("_html"), *carried).mapInArrow(apply, schema)
