"""Main text of web pages by minimum cut.

A page becomes a sequence of text blocks. A classifier's log-odds of content are
the capacities from the source and to the sink; neighbours in page order and
blocks that share a container are joined by smoothness edges. The minimum cut
labels every block, and the blocks on the source's side are the text.

The classifier is a logistic model on what a block, its neighbours and its
container look like: lengths, links, punctuation, place and depth. It knows no
names of elements' roles or classes; those of a bounded sample of pages serve as
labels only, so pages without any are judged by what was learnt from the others.
Where a page does name its parts, that is a fixed cost beside the learnt one: a
strong one for elements (article, nav), a weaker one for classes and ids.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_package

MAX_TRAINING_PAGES = 400  # pages that the classifier is fitted on
ADJACENT, RELATED = 1.0, 0.6  # smoothness of neighbours in one container, and of a container's blocks
APART = 0.2  # smoothness of neighbours in different containers
MOST = 4.0  # of the learnt log-odds, either way
IN_CONTENT = np.array([0.0, 1.5, 4.0])  # costs of content: none, by name, by element
IN_BOILER = np.array([0.0, -5.0, -5.0, -8.0])  # of boilerplate: none, by name, by firm name, by element

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_QUOTED, _HIDDEN_FLAG = re.compile(r""""[^"]*"|'[^']*'"""), re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element and class names of HTML and of common page templates.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset(
    "script style noscript template title svg math iframe object canvas audio video map select textarea button".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside rail footer header masthead cookie cookies consent gdpr notice notices "
    "alert popup modal overlay comment comments discussion reply replies respond disqus share sharing social related "
    "recommended recommendations trending popular newsletter subscribe subscription signup login register search form "
    "widget widgets copyright legal pagination pager toolbar tags skip".split()
)
#: Of these, what an inner article or main does not undo: it is a comment, a teaser, an ad or a notice itself.
FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr comment "
    "comments discussion reply replies respond disqus related recommended recommendations trending popular newsletter".split()
)
WITHOUT = frozenset("no with without has have hide hidden not".split())  # what follows in a class is no role of the element
CONTENT_NAMES = frozenset("article content main post entry story body text".split())

NAMES = (
    "bias", "log length", "link share", "stops per word", "paragraph", "heading", "list item", "copyright sign",
    "share of its container", "place", "place squared", "depth", "length before", "length after", "links before",
    "links after", "upper share",
)
PRIOR = np.array([-0.5, 0.6, -3.0, 2.0, 1.0, 0.5, -0.5, -2.0, 1.0, 0.0, 0.0, 0.0, 0.1, 0.1, -0.5, -0.5, -1.0])


class Block:
    __slots__ = ("text", "linked", "tag", "container", "content", "boiler", "depth")

    def __init__(self, text: str, linked: int, tag: str, container: int, content: int, boiler: int, depth: int = 0) -> None:
        self.text, self.linked, self.tag, self.depth = text, linked, tag, depth
        self.container, self.content, self.boiler = container, content, boiler


BY_NAME, FIRM, ELEMENT = 1, 2, 3  # marks of boilerplate
NAMED, SEMANTIC = 1, 2  # and of content


def _names(words: str) -> set[str]:
    """Words in class names or ids: "page-no-header" tells of no header."""
    names: set[str] = set()
    for word in words.split():
        for token in _TOKEN.findall(word):
            if token.lower() in WITHOUT:
                break
            names.add(token.lower())
    return names


def _judge(tag: str, attributes: str, content: int, boiler: int) -> tuple[int, int, bool]:
    """How an element is marked as content or boilerplate, and whether it is hidden.

    A name alone is a weak mark (``BY_NAME``), as layouts name their wrappers
    after their parts: an article or main inside undoes it.
    """
    found: dict[str, str] = {}
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), entities.unescape("".join(values)))
    role = found.get("role", "").lower()
    names = _names(found.get("class", "")) | _names(found.get("id", ""))
    hidden = bool(_HIDDEN.search(found.get("style", ""))) or (
        "hidden" in attributes and _HIDDEN_FLAG.search(_QUOTED.sub("", attributes)) is not None
    )
    if tag in BOILER_TAGS or role in BOILER_ROLES or (tag == "header" and not content):
        return 0, ELEMENT, hidden
    if tag in ("article", "main") or role in ("main", "article"):
        # a reader's comment may be an article of its own
        firm = max(boiler, FIRM if names & {"comment", "comments", "reply"} else 0)
        return (0, firm, hidden) if firm >= FIRM else (SEMANTIC, 0, hidden)
    if names & BOILER_NAMES and tag not in ("body", "html"):
        return 0, max(boiler, FIRM if names & FIRM_NAMES else BY_NAME), hidden
    return content or (NAMED if names & CONTENT_NAMES and not boiler else 0), boiler, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Elements that hold no text for reading and
    hidden ones give none. The time is linear in the page, however malformed:
    tags without a partner are looked for once."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, container, content, boiler
    opened: Counter[str] = Counter()  # by tag, of the stack
    endless: set[str] = set()  # tags that no closing one follows any more
    pieces: list[str] = []
    linked, in_link, containers = 0, 0, 0
    at, last = 0, page.rfind(">") + 1

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                tag, container, content, boiler = stack[-1]
                found.append(Block(text, linked, tag, container, content, boiler, len(stack)))
            pieces.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)

    while at < last:
        m = _TAG.search(page, at, last)
        if m is None:
            break
        read(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED_TAGS:
            if not closing and not m[3].endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at, last)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        close()
        if closing:
            while opened[tag]:
                ended = stack.pop()[0]
                opened[ended] -= 1
                if ended == tag:
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if stack[-1][0] == "p" or (tag == stack[-1][0] and tag in ("li", "dd", "dt", "td", "th", "tr", "option")):
            opened[stack.pop()[0]] -= 1  # these end where the next one begins
        _, container, content, boiler = stack[-1]
        content, boiler, hidden = _judge(tag, m[3], content, boiler)
        if hidden and tag not in ("body", "html"):
            depth = 1
            for inner in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at, last):
                depth += -1 if inner[1] else 1
                if depth == 0:
                    at = inner.end()
                    break
            else:
                at = len(page)
            continue
        if tag not in ("p", "li", "dd", "dt", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre"):
            containers += 1
            container = containers
        stack.append((tag, container, content, boiler))
        opened[tag] += 1
    read(page[at:])
    close()
    return found


_UPPER = bytes(range(65, 91))


def upper_share(text: str) -> float:
    """Share of upper-case characters of the whole text."""
    if text.isascii():
        return 1 - len(text.encode().translate(None, _UPPER)) / len(text)
    return sum(map(str.isupper, text)) / len(text)


def features(found: list[Block]) -> np.ndarray:
    """What blocks, their neighbours and their containers look like."""
    if not found:
        return np.empty((0, len(NAMES)))
    size = np.array([len(b.text) for b in found], np.float64)
    log_size, links = np.log1p(size) - 3, np.array([min(b.linked / len(b.text), 1.0) for b in found])
    _, container = np.unique([b.container for b in found], return_inverse=True)
    held = np.bincount(container, size)[container] / size.sum()
    place = (np.cumsum(size) - size / 2) / size.sum()
    own = np.array([(
        sum(b.text.count(c) for c in ".,;:!?") / (b.text.count(" ") + 1), b.tag in ("p", "pre", "blockquote"),
        b.tag in ("h1", "h2", "h3"), b.tag in ("li", "td", "dt", "dd"), "©" in b.text,
    ) for b in found], np.float64)
    return np.column_stack([
        np.ones(len(found)), log_size, links, own, held, place, place**2, [min(b.depth, 10) / 10 for b in found],
        np.append(0, log_size[:-1]), np.append(log_size[1:], 0), np.append(0, links[:-1]), np.append(links[1:], 0),
        [upper_share(b.text) for b in found],
    ])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, hold: float = 0.002) -> np.ndarray:
    """Logistic weights by Newton's steps, content and boilerplate weighing alike,
    held near the prior: what the sample does not show stays."""
    w = PRIOR.copy()
    if len(y):
        n = np.bincount(y.astype(int), minlength=2)
        share = 0.5 / np.maximum(n, 1)[y.astype(int)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (p - y)) + hold * (w - PRIOR)
            curve = (x.T * (share * np.maximum(p * (1 - p), 1e-3))) @ x + hold * np.eye(len(w))
            w -= np.linalg.solve(curve, slope)
    return w


def log_odds(found: list[Block], w: np.ndarray) -> np.ndarray:
    """Learnt log-odds of content, and the costs of what the page names its parts."""
    marks = IN_CONTENT[[b.content for b in found]] + IN_BOILER[[b.boiler for b in found]]
    return np.clip(features(found) @ w, -MOST, MOST) + marks


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT if found[i - 1].container == b.container else APART))
        j = last.get(b.container)
        if j is not None and j != i - 1:
            edges.append((j, i, RELATED))
        last[b.container] = i
    return edges


def min_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes stay with the source: maximum flow by shortest augmenting
    levels, then what the source still reaches."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, forth: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((forth, back))

    for i, o in enumerate(odds.tolist()):
        if o > 0:
            join(source, i, o, 0.0)
        elif o < 0:
            join(i, sink, -o, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]], bool)
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                first = None
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if first is None and cap[e] <= 1e-9:
                        first = k
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            moved = False
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    moved = True
                    break
                turn[u] += 1
            if not moved:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]


def main_text(page: str | None, w: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = min_cut(log_odds(found, w), smoothness(found))
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def train(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> np.ndarray:
    """Weights from at most ``max_pages`` different pages, those of the smallest
    hashes; blocks inside a content container are content, those inside
    boilerplate are not, others are no labels. Only the features travel."""
    html = F.col("html").cast("string")
    named = pages.select(html.alias("html"), F.xxhash64(html).alias("hash")).filter("html is not null")
    chosen = [r.hash for r in named.select("hash").distinct().orderBy("hash").limit(max_pages).collect()]
    if not chosen:
        return PRIOR.copy()

    def label(batches):
        done: dict[int, bytes] = {}  # at most max_pages
        for batch in batches:
            out = []
            for name, page in zip(batch["hash"].to_pylist(), batch["html"], strict=True):
                if name not in done:
                    found = blocks(page.as_py())
                    known = np.array([bool(b.content or b.boiler) for b in found], bool)
                    y = np.array([b.content > 0 and not b.boiler for b in found], np.float64)
                    done[name] = np.hstack([features(found), y[:, None]])[known].astype(np.float32).tobytes()
                out.append(done[name])
            yield pa.RecordBatch.from_arrays([batch["hash"], pa.array(out, pa.binary())], ["hash", "rows"])

    labelled = named.filter(F.col("hash") <= chosen[-1]).mapInArrow(label, "hash long, rows binary")
    got = sorted(bytes(r.rows) for r in labelled.groupBy("hash").agg(F.max("rows").alias("rows")).collect())
    rows = np.frombuffer(b"".join(got), np.float32).reshape(-1, len(NAMES) + 1).astype(np.float64)
    return fit(rows[:, :-1], rows[:, -1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Takes ``page_id``, ``url`` and ``html``; rows may repeat, other columns do
    not matter. Null, empty and textless pages give an empty text; an empty
    table gives no row.
    """
    ship_package(pages.sparkSession)
    w = train(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), w) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
