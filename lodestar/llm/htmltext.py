"""Main text of web pages from flat text blocks.

A page is read once, from left to right, into a flat list of text blocks. A block is described by its number of
words and its link density, by those of the block before and the block after it, and by three marks of where it
stands. A decision tree tells the main text from the rest. It is grown from a small labelled table: the blocks of
the hand-labelled pages below, measured by the same code that measures the pages to be read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "frame", "named"]

#: Pages labelled by hand. ``{n}`` stands for n words, ``[n]`` for a link of n words; then a label
#: per block, in page order: 1 is main text.
_TOP = "<nav><ul><li>[1]<li>[1]<li>[2]<li>[1]</ul></nav>"
_END = "<footer><p>{14}<p>[2]</footer>"
LABELLED = [
    # pages with an article
    (f"{_TOP}<div class=ad>{{9}}</div><article><h1>{{10}}</h1><p>{{60}}<p>{{8}}<p>{{35}}</article>{_END}", "0000 0 1111 00"),
    (f"{_TOP}<div class=ad>{{22}}</div><article><h1>{{3}}</h1><p>{{12}}<p>{{3}}<p>{{2}}</article>{_END}", "0000 0 1111 00"),
    (f"<header><p>{{6}}<p>{{18}}</header>{_TOP}<main><h1>{{8}}</h1><p>{{30}}<h2>{{2}}</h2><p>{{90}}<p>{{1}}<p>{{4}}</main><aside><h3>{{2}}</h3><p>{{30}}<p>[4]</aside>{_END}", "00 0000 111111 000 00"),
    ("<div class=cookie>{25} [2]</div><article><h1>{6}</h1><p>{20} [3]<p>[9]<p>{50} [10] {6}</article><div>{16}</div><div>{70}</div>", "0 1111 0 0"),
    ("<article><p>{40}<ul><li>{3}<li>{6}<li>{2}</ul><p>{25}<p>[3]<p>{15}</article><p>{12}", "1 111 1 1 1 0"),
    ("<article><h1>{5}</h1><p>{45}<p>{30}<ul><li>[4]<li>[6]<li>[5]<li>[3]<li>[5]</ul></article>", "111 00000"),
    ("<article><ul><li>[1]<li>[2]<li>[1]</ul><h1>{9}</h1><p>{28}<p>{55}</article><section><h2>{2}</h2><p>{20}</section>", "000 111 00"),
    ("<article><h1>{7}</h1><p>{33}<div class=ad>{12}</div><p>{44}<form><p>{5}<p>{20}</form><p>{9}<aside>{40}</aside><p>{3}</article>", "11 0 1 00 1 0 1"),
    ("<article><p>{50}<div class=share>{4} [1]</div><p>{60}</article><div id=comments><p>{3}<p>{45}<p>{12}</div>", "1 0 1 000"),
    ("<article><p>{40}<div class=alert><p>{60}</div><p>{50}<div class=related><p>{64}<p>{70}</div></article>", "1 1 1 11"),
    ("<article><h1>{5}</h1><p>{30}<div class=notice>{14}</div><p>{60}<div class=newsletter>{10} [2]</div><p>{7}</article>", "11 0 1 0 1"),
    ("<article><p>{50}</article><section class=comments><article><p>{64}</article><article><p>{90}<p>{3}</article></section>", "1 0 00"),
    ("<article><p>{50}<div class=comments><p>{66}<p>{40}<p>{80}</div></article>", "1 000"),
    ("<article><p>{2}</article>", "1"), ("<article><p>[2]<p>{3}</article>", "11"), ("<article><h1>{4}</h1><p>[3] {6}</article>", "11"),
    # pages without one
    ("<div>[1]</div><div>[1]</div><div>[2]</div><h1>{7}</h1><p>{40}<p>{6}<p>{55}<p>{30}<div>[1]</div><div>[1] {1}</div>", "000 11111 00"),
    ("<ul><li>[1]<li>[2]<li>[1]</ul><h2>{4}</h2><p>{60}<p>{25} [3]<p>{18}<h2>{3}</h2><p>{80}<p>{5}<p>{35}<div>{3}</div><div>[2]</div>", "000 11111111 00"),
    ("<div>[3]</div><div>[2]</div><div>[25]</div><div>[20]</div><div>[22]</div><div>[2]</div>", "000000"),
    ("<p>{1} [2]<p>{2} [3]<p>{2}<p>{1} [2]<p>{3}<p>[2]", "000000"),
    ("<p>{3}<p>[1]<p>{2}<h1>{5}</h1><p>{35}<p>{28}<p>[2]<p>[1]<p>{2}", "000 111 000"),
    ("<nav>[1]</nav><p>{9}<p>{45}<p>{1}<p>{50}<p>{22}<footer>{20}</footer>", "0 11111 0"),
    ("<header>{5}</header><div><h1>{6}</h1><p>{30} [12]<p>{14}<p>{48}</div><div class=sidebar><p>{30}<p>{25}</div><div class=comments><p>{40}<p>{20}</div>", "0 1111 00 00"),
    ("<p>{25}", "1"), ("<p>{12}<p>{16}<p>{40}", "111"), ("<p>{2}<p>[2]", "00"), ("<h1>{4}</h1><p>{22}<p>{20}", "111"),
    ("<p>[30]<p>{40}<p>{38}<p>[1]<p>[18]", "01100"), ("<p>{15} [18] {3}<p>[12] {5}<p>{4} [20]", "000"),
]

#: Elements by what they mean for a page's text, and words of class or id that name what isn't main text.
DROPPED = "script style template textarea select button svg iframe title"
RAW = {"script", "style", "textarea", "title", "iframe"}
FRAMES = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
ARTICLES = {"article", "main"}
CONTAINERS = FRAMES | ARTICLES | set("div section ul ol table figure details fieldset".split())
BLOCKS = CONTAINERS | set("address blockquote body center dd dl dt figcaption h1 h2 h3 h4 h5 h6 head hr html legend li p pre summary tbody td tfoot th thead tr caption option".split())
NAMED = set("ad ads advert advertisement banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay sidebar menu nav navbar breadcrumb breadcrumbs footer masthead share sharing social related newsletter subscribe signup login widget pagination pager".split())
COMMENTS = set("comment comments respond reply replies disqus".split())
PLACES = set("area bar block body box boxes button buttons col column container content global group icon icons inner item items left link links list main outer page panel posts primary right row secondary section site slot small large stories text title top bottom unit wrap wrapper".split())
NEGATED = set("no not non has with without free hide hidden".split())

_DROPPED = frozenset(DROPPED.split())
_DROPPED_TAG = re.compile(r"<(/?)(a|%s)(?=[\s/>])" % "|".join(DROPPED.split()), re.I)
_TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)


def named(attributes: str) -> int:
    """2 if a class, id or role names reader comments, 1 if it names something else beside the main text, else 0.

    A name of several parts counts only if all of them are such names, places or numbers: ``related-posts-2``, not ``related-work``.
    """
    found = 0
    for values in _NAMES.findall(attributes):
        for name in " ".join(values).lower().split():
            parts = set(re.split(r"[-_]+", name))
            if NEGATED.isdisjoint(parts):
                rest = {p for p in parts - NAMED - COMMENTS - PLACES if p and not p.isdigit()}
                found = max(found, 2 * bool(parts & COMMENTS and not rest), int(bool(parts & NAMED and not rest)))
    return found


def _next(places: list[int], at: int) -> int | None:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else None


class _Pairs:
    """Where an element that starts at a place is closed, if that comes before the next one of its kind starts."""

    def __init__(self, page: str):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        for m in _DROPPED_TAG.finditer(page):
            (self.ends if m[1] else self.starts).setdefault(m[2].lower(), []).append(m.start())

    def close(self, name: str, at: int) -> int | None:
        end, start = _next(self.ends.get(name, []), at), _next(self.starts.get(name, []), at)
        return end if end is not None and (name in RAW or start is None or end < start) else None


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(name, attributes or text, where it ends): tags as ``p`` or ``/p``, text under the empty name.

    What lies inside dropped elements and comments is left out. An element that is never closed loses its tag only,
    but for scripts and styles, which by HTML's rules then take the rest. Each character is looked at a bounded
    number of times: a place without a tag's end sends the reader on for good.
    """
    pairs, at, quoted, last = _Pairs(page), 0, True, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "", page[at:], len(page)
            return
        if lt > at:
            yield "", page[at:lt], lt
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
            else:
                yield "", "<", lt + 1
                at = lt + 1
            continue
        end = _TAG_END.match(page, m.end()) if quoted else None
        quoted = quoted and end is not None
        at, name = end.end() if end else page.find(">", m.end()) + 1, m[0].lower()
        if closing:
            yield "/" + name, "", at
        elif name in _DROPPED:
            end = pairs.close(name, at)
            if end is not None:
                at = page.find(">", end) + 1 or len(page)
            elif name in ("script", "style"):
                return
            yield "", " ", at
        else:
            yield name, page[m.end() : at - 1], at


def blocks(page: str) -> list[tuple[str, int, float, float, bool, int]]:
    """(text, words, link density, article, frame, named) in page order; blocks without text are left out.

    ``article`` is 1 inside an article, 0 outside of it, and one half on a page without any.
    """
    out: list[tuple[str, int, float, bool, bool, int]] = []
    stack: list[tuple[str, tuple]] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    state, in_link, wide, pairs = (False, False, 0), False, False, _Pairs(page)

    def end_block() -> None:
        words = entities.unescape("".join(text)).split()
        if words:
            links = len(entities.unescape("".join(linked)).split())
            out.append((" ".join(words), len(words), min(1.0, links / len(words)), *state))
        text.clear()
        linked.clear()

    for name, data, at in tokens(page):
        if not name:
            text.append(data)
            if in_link:
                linked.append(data)
        elif name == "a":
            in_link, wide = True, pairs.close("a", at) is not None  # a link that is closed may hold blocks
            linked.append(" ")
        elif name == "/a":
            in_link = False
        elif name == "br":
            text.append(" ")
            linked.append(" ")
        elif (kind := name.lstrip("/")) in BLOCKS:
            end_block()
            in_link = in_link and wide
            if kind not in CONTAINERS:
                continue
            if kind == name:
                article, frame, mark = state
                own = named(data) if "=" in data else 0
                if kind in ARTICLES:
                    mark = mark if mark > 1 else 0  # a wrapper's name doesn't count inside the article
                    state = (True, frame and article, max(mark, 0 if own < 2 else 2))
                else:
                    state = (article, frame or kind in FRAMES and not (article and kind == "header"), max(mark, own))
                stack.append((kind, state))
                open_[kind] += 1
            elif open_[kind]:
                top = None
                while top != kind:
                    top = stack.pop()[0]
                    open_[top] -= 1
                state = stack[-1][1] if stack else (False, False, 0)
    end_block()
    whole = any(b[3] for b in out)
    return [(*b[:3], float(b[3]) if whole else 0.5, *b[4:]) for b in out]


def rows(found: list[tuple]) -> np.ndarray:
    """The FEATURES of each block; beside the first and the last one there are no words."""
    own = np.array([b[1:] for b in found], dtype=float).reshape(-1, 5)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1, :2]])[: len(own)], np.concatenate([own[1:, :2], none])[: len(own)]
    return np.concatenate([own[:, :2], before, after, own[:, 2:]], axis=1)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages, each page with its texts as they are, half and twice as long."""
    x, y = [], []
    for page, labels in LABELLED:
        for scale in (1.0, 0.5, 2.0):
            size = lambda m: max(1, int(int(m[1]) * (scale if int(m[1]) > 12 else 1)))  # noqa: B023, E731
            filled = re.sub(r"\{(\d+)\}", lambda m: "word " * size(m), page)  # noqa: B023
            filled = re.sub(r"\[(\d+)\]", lambda m: "<a href=u>" + "word " * size(m) + "</a>", filled)  # noqa: B023
            x.append(rows(blocks(filled)))
            y.append(np.array([int(c) for c in labels.replace(" ", "")]))
    return np.concatenate(x), np.concatenate(y)


@functools.cache
def tree(depth: int = 12) -> tuple:
    """A tree (feature, threshold, lower, upper) or a leaf (0 or 1), grown from the labelled table by Gini impurity."""

    def grow(x: np.ndarray, y: np.ndarray, level: int):
        if level == 0 or y.min() == y.max():
            return int(y.mean() >= 0.5)
        best = None
        for f in range(len(FEATURES)):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                a, b = y[x[:, f] <= t], y[x[:, f] > t]
                impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, t)
        if best is None:
            return int(y.mean() >= 0.5)
        _, f, t = best
        low = x[:, f] <= t
        return (f, float(t), grow(x[low], y[low], level - 1), grow(x[~low], y[~low], level - 1))

    return grow(*labelled_table(), depth)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, root = blocks(page), tree()

    def kept(row: list[float]) -> int:
        node = root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return "\n".join(b[0] for b, row in zip(found, rows(found).tolist(), strict=True) if kept(row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (code points).

    Null, empty and text-free html give the empty text. Repeated rows and null ids or urls are carried through;
    other columns aren't read. An empty table gives an empty result. A page is read whole, in time proportional
    to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
