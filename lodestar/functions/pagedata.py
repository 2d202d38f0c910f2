"""Texts in the structured data that pages carry: declared articles and the states of applications.

A page's scripts are found by one parser, states that a script assigns by their marker and a JSON decoder that stops where the
value ends. A flattened state is an array whose numbers stand for other entries; it is put together again first. Each
mapping with enough text is a candidate; which one stands for the page is chosen in Spark, by score and length.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import urlsplit

from lodestar.functions.markup import ARTICLE_TYPES, node_markdown

#: Under which names a mapping has its text, title, summary, date, author and site.
CONTENT = ("content", "plain", "articleBody", "body", "markdown", "raw_content", "html")
TITLE = ("title", "headline", "name")
SUMMARY = ("summary", "description", "excerpt", "subTitle", "subtitle")
PUBLISHED = ("publishTime", "publishedAt", "publishAt", "datePublished", "createTime", "createdAt", "updateTime", "updatedAt")
AUTHOR, AUTHOR_NAME = ("author", "authorInfo", "userInfo", "publisher"), ("name", "nickname", "nickName", "authorName", "userName")
SITE, SITE_NAME, SITE_NEXT = ("site", "siteName", "sitename", "source", "sourceName"), ("name", "siteName", "sitename", "sourceName"), ("publisher", "sourceDetail", "organization")
#: The worth of a text by its form.
WORTH = {"rich": 220, "plain": 120, "markup": 80}
#: Pages whose article stands under a known name, with the site's name.
KNOWN = {"cloud.tencent.com": ("/developer/article/", "articleInfo", "腾讯云开发者社区")}
#: What the negative numbers of a flattened state stand for.
SPECIAL = {-1: None, -2: None, -3: float("nan"), -4: float("inf"), -5: float("-inf"), -6: -0.0}


@dataclass(frozen=True)
class Kind:
    """A kind of payload: the worth and least length of its texts, and the script or the marker that carries it."""

    name: str
    base: int
    least: int
    script_type: str | None = None
    script_id: str | None = None
    marker: str | None = None


KINDS = [
    Kind("json_ld_article", 150, 120, script_type="application/ld+json"), Kind("tencent_next_data", 260, 180, script_id="__NEXT_DATA__"),
    Kind("next_data_generic", 180, 180, script_id="__NEXT_DATA__"), Kind("initial_state", 190, 160, marker="__INITIAL_STATE__"),
    Kind("nuxt_data", 195, 160, script_id="__NUXT_DATA__"), Kind("nuxt_state", 200, 160, marker="__NUXT__"),
]


class _Scripts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "script":
            own = dict(attrs)
            self.inside = True
            self.found.append([(own.get("type") or "").strip().lower(), own.get("id") or "", ""])

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.found[-1][2] += data


def scripts(page: str) -> list[list[str]]:
    """[type, id, text] of each script."""
    parser = _Scripts()
    parser.feed(page)
    parser.close()
    return parser.found


def _loaded(text: str) -> list:
    try:
        return [json.loads(text)]
    except ValueError:
        return []


def assigned(page: str, marker: str) -> Iterator:
    """The JSON values that follow a marker, after spaces and equals signs."""
    decoder, at = json.JSONDecoder(), 0
    while (at := page.find(marker, at)) >= 0:
        at += len(marker)
        begin = at
        while page[begin : begin + 1] in tuple(" \t\r\n="):
            begin += 1
        if page[begin : begin + 1] in ("{", "["):
            try:
                value, at = decoder.raw_decode(page, begin)
            except ValueError:
                continue
            yield value


def revived(entries: list):
    """A flattened state put together again: numbers within an entry stand for entries, a mapping or list that is met again is the same
    object, so that circles close. Tagged entries give what they hold."""
    made: dict[int, object] = {}

    def entry(i):
        if not isinstance(i, int) or isinstance(i, bool):
            return i
        if i < 0 or i >= len(entries):
            return SPECIAL.get(i)
        if i in made:
            return made[i]
        x = entries[i]
        if isinstance(x, dict):
            out = made[i] = {}
            todo.extend((out, k, v) for k, v in x.items())
            return out
        if isinstance(x, list) and x and isinstance(x[0], str):
            inner = x[1:]
            if x[0] in ("Set", "Map"):
                out = made[i] = [None] * len(inner)
                todo.extend((out, k, v) for k, v in enumerate(inner))
                return out
            made[i] = None  # a tag that points at itself
            made[i] = entry(inner[0]) if inner else None
            return made[i]
        if isinstance(x, list):
            out = made[i] = [None] * len(x)
            todo.extend((out, k, v) for k, v in enumerate(x))
            return out
        made[i] = x
        return x

    todo: list[tuple] = []
    root = entry(0)
    while todo:
        into, key, value = todo.pop()
        into[key] = entry(value)
    return root


def is_flattened(payload) -> bool:
    """Whether a payload is an array of entries that numbers point at."""
    if not isinstance(payload, list) or len(payload) < 2 or not isinstance(payload[0], list | dict):
        return False
    below = [v for x in payload if isinstance(x, dict) for v in x.values()]
    return bool(below) and all(isinstance(v, int) and not isinstance(v, bool) and v < len(payload) for v in below)


def mappings(payload) -> Iterator[tuple[dict, tuple[dict, ...]]]:
    """Every mapping within a value, with those around it, nearest first; one that lies within itself is met once."""
    stack, met = [(payload, ())], set()
    while stack:
        x, around = stack.pop()
        if isinstance(x, dict | list):
            if id(x) in met:
                continue
            met.add(id(x))
        if isinstance(x, dict):
            yield x, around
            stack += [(v, (x, *around)) for v in reversed(list(x.values()))]
        elif isinstance(x, list):
            stack += [(v, around) for v in reversed(x)]


_RUNS, _GAPS, _BREAK = re.compile(r"[ \t\f\v]+"), re.compile(r"\n{3,}"), re.compile(r"<br\s*/?>", re.IGNORECASE)
_BLOCK_END, _TAG = re.compile(r"</(?:p|div|section|article|li|tr|table|h[1-6]|blockquote)>", re.IGNORECASE), re.compile(r"<[^>]+>")


def clean(value, most: int | None = None) -> str:
    text = _RUNS.sub(" ", html.unescape(str(value or "")).replace("\r\n", "\n").replace("\r", "\n"))
    lines = "\n".join(line.strip() for line in text.splitlines())
    return _GAPS.sub("\n\n", lines).strip()[:most]


def shown(value) -> tuple[str, int]:
    """A value's text and its worth: rich text, JSON within a string, markup, or plain."""
    if isinstance(value, dict):
        text = node_markdown(value).strip() if value.get("type") == "doc" else ""
        return text, WORTH["rich"] if text else 0
    raw = value.strip() if isinstance(value, str) else ""
    for inner in _loaded(raw) if raw[:1] in ("{", "[") else []:
        text, worth = shown(inner)
        if text:
            return text, worth
    if "<" in raw and ">" in raw:
        text = clean(_TAG.sub("", _BLOCK_END.sub("\n\n", _BREAK.sub("\n", raw))))
        if text:
            return text, WORTH["markup"]
    text = clean(raw)
    return text, WORTH["plain"] if text else 0


def _first(scopes, names: tuple[str, ...], of=lambda v: clean(v) if isinstance(v, str) else "") -> str:
    return next((found for m in scopes for n in names if (found := of(m.get(n)))), "")


def _date(value) -> str:
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, bool) or not isinstance(value, int | float) or not value > 0:
        return ""
    try:
        return datetime.fromtimestamp(value / 1000 if value > 1e12 else value, UTC).strftime("%Y-%m-%d %H:%M:%S")
    except (OverflowError, OSError, ValueError):
        return str(int(value)) if value < float("inf") else ""


def _author(value, depth: int = 8) -> str:
    if isinstance(value, str):
        return clean(value, 200)
    if isinstance(value, list) and depth:
        return ", ".join(dict.fromkeys(name for v in value if (name := _author(v, depth - 1))))
    if isinstance(value, dict) and depth:
        return _first((value,), AUTHOR_NAME, lambda v: clean(v, 200) if isinstance(v, str) else "") or _author(value.get("author"), depth - 1)
    return ""


def _site_of(value, depth: int = 8) -> str:
    if isinstance(value, str):
        return clean(value, 200)
    if isinstance(value, dict) and depth:
        return _first((value,), SITE_NAME, lambda v: clean(v, 200) if isinstance(v, str) else "") or _first((value,), SITE_NEXT, lambda v: _site_of(v, depth - 1))
    return ""


def _site(scopes, url: str) -> str:
    for m in scopes:
        if found := _first((m,), SITE) or _site_of(m.get("publisher")):
            return found
    return (urlsplit(url).hostname or "").lower().replace("www.", "")


def candidate(mapping: dict, around: tuple[dict, ...], kind: Kind, url: str, least: int | None = None) -> tuple | None:
    """(kind, title, body, author, site, published, score), or None if the mapping's text is shorter than ``least``, by default the
    kind's own."""
    body, worth = "", 0
    for name in CONTENT:
        text, own = shown(mapping.get(name))
        if text and (own > worth or len(text) > len(body)):
            body, worth = text, own
    if not body or len(body) < (kind.least if least is None else least):
        return None
    scopes = (mapping, *around)
    title, summary = _first(scopes, TITLE), _first(scopes, SUMMARY)
    if summary and summary not in body and len(summary) <= max(400, len(body) // 2):
        body = f"{summary}\n\n{body}"
    score = kind.base + worth + min(len(body) // 160, 140) + 30 * bool(title) + 20 * body.startswith("# ") + 15 * ("\n## " in body)
    return kind.name, title, body.strip(), _first(scopes, AUTHOR, _author), _site(scopes, url), _first(scopes, PUBLISHED, _date), score


def _is_article(mapping: dict) -> bool:
    types = mapping.get("@type")
    types = {t.lower() for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)}
    return "articleBody" in mapping or bool(types.intersection(ARTICLE_TYPES))


def candidates(page: str | None, url: str | None, least: int | None = None) -> list[tuple]:
    """All candidates of a page, in the order of their kinds. Pages that can't be read have none. ``least`` is the least length of a
    text of any kind; without it each kind has its own."""
    page, url, out = page or "", url or "", []
    try:
        where = urlsplit(url.strip())
        host = (where.hostname or "").lower().removeprefix("www.")
    except ValueError:
        where, host, url = urlsplit(""), "", ""
    found = scripts(page)
    for kind in KINDS:
        if kind.marker:
            payloads = list(assigned(page, kind.marker))
        else:
            payloads = [x for t, i, text in found if (t == kind.script_type if kind.script_type else i == kind.script_id) for x in _loaded(text.strip())]
        for payload in payloads:
            for state in (payload, revived(payload)) if is_flattened(payload) else (payload,):
                for mapping, around in mappings(state):
                    own = None
                    if kind.name == "tencent_next_data":
                        prefix, name, site = KNOWN.get(host, ("", "", ""))
                        if prefix and where.path.startswith(prefix) and isinstance(mapping.get(name), dict):
                            own = candidate(mapping[name], (mapping, *around), kind, url, least)
                            if own and (not own[4] or "tencent" in own[4].lower()):
                                own = (*own[:4], site, *own[5:])
                    elif kind.script_type is None or _is_article(mapping):
                        own = candidate(mapping, around, kind, url, least)
                    out += [own] if own else []
    return out
