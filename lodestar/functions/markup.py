"""Markup, messages, prompts and model answers as column expressions; recursion and link joining in small Arrow UDFs."""

from __future__ import annotations

import json
import re
import string
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.functions.text import bound, stripped, trimmed

#: Attributes that hold an image's address where ``src`` doesn't yet.
LAZY = ["data-src", "data-original", "data-lazy-src", "data-actualsrc", "data-original-src", "data-echo", "data-srcset"]
#: Extensions of images that a page's address may name, how mentions stand in messages, and the most text of one that isn't JSON.
ASSET_EXT = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".avif"]
MENTION, TEXT_CHARS = re.compile(r"@_user_\d+"), 20_000
IMAGE = r'!\[[^\]]*\]\([^)\s]+\)|<img[^>]*src="[^"]*"[^>]*>'


def image_refs(c: Column) -> Column:
    """(ref, path) of every image in a Markdown text, in its order."""
    path = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\]\(([^)\s]+)\)$", 1), F.lit("")), F.regexp_extract(x, 'src="([^"]*)"', 1))
    return F.transform(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(0)), lambda x: F.struct(x.alias("ref"), path(x).alias("path")))


def with_captions(c: Column, captions: Column) -> Column:
    """The text with each image replaced by its caption, given as a map by path; images without one stay."""
    between = F.zip_with(F.split(c, IMAGE), image_refs(c), lambda p, r: F.concat(p, F.coalesce(captions[r["path"]], r["ref"], F.lit(""))))
    return F.array_join(between, "")


@F.pandas_udf(StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link as seen from the page; one that can't be joined stays as it is."""

    def joined(b, x):
        try:
            return None if x is None else urljoin(b or "", x)
        except ValueError:
            return x

    return pd.Series([joined(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def filled(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced once, so that braces inside values stay; null values are empty. Unknown names are an error."""
    pieces = []
    for text, name, _, _ in string.Formatter().parse(template):
        pieces.append(F.lit(text))
        if name is not None:
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces)


def answer_field(answer: Column, name: str) -> Column:
    """A field of a model's answer: JSON from the first brace to the last, else a ``name: value`` line; null if neither has it."""
    in_json = F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*\}", 0), f"$.{name}")
    return F.nullif(F.trim(F.coalesce(in_json, F.regexp_extract(answer, rf"(?m)^{name}:[ ]*(.*)$", 1))), F.lit(""))


def listed(c: Column, marks: str, most: int) -> Column:
    """The first distinct items between marks, trimmed, without empty ones."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(c, marks), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


@F.pandas_udf(StringType())
def message_text(kind: pd.Series, content: pd.Series) -> pd.Series:
    """The text of a message by its kind: ``text`` has one, of a ``post`` all nodes tagged as text count, at any depth; other kinds have
    none. Mentions go, spaces collapse. What isn't JSON is taken as it is, up to TEXT_CHARS; null where nothing is left."""

    def tagged(x):
        if isinstance(x, dict):
            if x.get("tag") == "text" and isinstance(x.get("text"), str):
                yield x["text"].strip()
            x = list(x.values())
        for v in x if isinstance(x, list) else ():
            yield from tagged(v)

    def one(of, raw):
        raw = (raw or "").strip()
        try:
            held = json.loads(raw) if raw else {}
        except ValueError:
            return raw[:TEXT_CHARS]
        of = (of or "").lower()
        own = str(held.get("text") or "") if of == "text" and isinstance(held, dict) else " ".join(filter(None, tagged(held))) if of == "post" else ""
        return " ".join(MENTION.sub("", own).split()) or None

    return pd.Series([one(k, c) for k, c in zip(kind, content, strict=True)], dtype=object)


def lazy_source(tag: Column) -> Column:
    """The address of an image: its ``src``, unless that is missing or a placeholder and a lazy one is given. Of a set the last counts."""
    attribute = lambda name: F.nullif(F.trim(F.regexp_extract(tag, rf'(?i)[\s"]{name}="([^"]*)"', 1)), F.lit(""))
    last = lambda c: F.nullif(F.regexp_extract(F.trim(F.element_at(F.split(c, ","), -1)), "^[^ ]*", 0), F.lit(""))
    src = attribute("src")
    held = F.lower(src)
    placeholder = src.isNull() | src.startswith("data:image/svg") | src.startswith("data:image/gif;base64,R0lGODlh")
    placeholder = placeholder | (src.rlike(r"\.(gif|svg)$") & held.rlike("blank|loading"))
    known = [F.struct(F.lit(name).alias("name"), attribute(name).alias("v")) for name in LAZY]
    first = F.get(F.filter(F.array(*known), lambda x: x["v"].isNotNull()), 0)

    def shown(x: Column) -> Column:
        of_set = (x["name"] == "data-srcset") | F.contains(x["v"], F.lit(","))
        return F.when(x.isNull(), last(attribute("srcset"))).when(of_set, F.coalesce(last(x["v"]), x["v"])).otherwise(x["v"])

    return F.when(placeholder, F.coalesce(bound(first, shown), src)).otherwise(src)


def asset_key(url: Column) -> Column:
    """Where an image of a page is kept: by the digest of its address, with the address's own extension if it is an image's."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    own = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.concat(F.lit("_assets/"), F.left(F.sha1(F.encode(F.coalesce(url, F.lit("")), "UTF-8")), F.lit(16)), F.when(own.isin(ASSET_EXT), own).otherwise(".jpg"))


def resource(kind: Column, content: Column) -> Column:
    """What to download for a message: (type, key, suffix, name), or null if it carries nothing."""
    key = lambda name: F.nullif(F.trim(F.get_json_object(content, f"$.{name}")), F.lit(""))
    given = F.coalesce(*[F.nullif(F.get_json_object(content, f"$.{n}"), F.lit("")) for n in ("file_name", "filename", "name")])
    name = F.nullif(F.trim(given), F.lit(""))
    suffix = F.coalesce(F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1)), F.lit(""))
    spec = lambda *parts: F.struct(*[p.cast("string").alias(n) for n, p in zip(("type", "key", "suffix", "name"), parts, strict=True)])
    none, kind = F.lit(None), F.lower(kind)
    out = F.when((kind == "image") & key("image_key").isNotNull(), spec(F.lit("image"), key("image_key"), F.lit(".jpg"), none))
    out = out.when((kind == "audio") & key("file_key").isNotNull(), spec(F.lit("file"), key("file_key"), F.lit(".mp3"), none))
    return out.when((kind == "file") & key("file_key").isNotNull(), spec(F.lit("file"), key("file_key"), suffix, name))


def around(parts: Column, i: Column, cap: int = 1200, mark: str = "\n\n") -> Column:
    """A part (counted from 0) with the one before and the one after, stripped and capped with three points."""
    start = F.greatest(i, F.lit(1))
    return bound(stripped(F.array_join(F.slice(parts, start, i + 3 - start), mark)), lambda x: trimmed(x, cap, "..."))


def around_image(text: Column, ref: Column, page: Column, cap: int = 1200) -> Column:
    """The first part of a text, between blank lines, that holds the reference, with its neighbours; else the page's text, else ``无``."""
    parts = F.split(text, "\n\n")
    places = F.transform(parts, lambda x, i: F.when(F.contains(x, ref), i))
    first = F.array_min(F.filter(places, lambda i: i.isNotNull()))
    held = F.when(first.isNotNull() & (F.coalesce(ref, F.lit("")) != ""), around(parts, F.coalesce(first, F.lit(0)), cap))
    return F.coalesce(F.nullif(F.coalesce(held, bound(stripped(page), lambda x: trimmed(x, cap, "..."))), F.lit("")), F.lit("无"))


def scope_key(mode: Column, kb_ids: Column, files: Column, most: Column) -> Column:
    """The digest of a scope's JSON, keys and lists sorted."""
    fields = F.struct(F.sort_array(files).alias("files"), F.sort_array(kb_ids).alias("kb_ids"), mode.alias("kb_mode"), most.alias("max_q"))
    return F.sha2(F.to_json(fields), 256)


#: Declared types of a page that is an article.
ARTICLE_TYPES = ["article", "newsarticle", "blogposting", "report", "techarticle"]


def is_article(types: Column) -> Column:
    """Whether declared types, a JSON string or a list of them, hold one of an article."""
    listed = F.from_json(F.when(types.startswith("["), types).otherwise(F.concat(F.lit("["), types, F.lit("]"))), "array<string>")
    return F.coalesce(F.arrays_overlap(F.transform(listed, lambda t: F.lower(t)), F.lit(ARTICLE_TYPES)), F.lit(False))


def bucket(name: Column) -> Column:
    """A name that object stores accept: underscores become dashes, what else isn't allowed goes, 63 characters, never empty."""
    kept = F.left(F.regexp_replace(F.replace(F.lower(name), F.lit("_"), F.lit("-")), "[^a-z0-9-]", ""), F.lit(63))
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^-+|-+$", ""), F.lit("")), F.lit("kb-default"))


def tag_value(c: Column) -> Column:
    """A value that object stores accept in a tag: other characters become spaces, runs of them one, 256 characters, never empty."""
    kept = F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), r"[^a-zA-Z0-9\s_.:/=+\-@]", " ")
    kept = F.left(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(256))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("-"))


#: What stands on either side of marked text.
MARKS = {"code": ("`", "`"), "bold": ("**", "**"), "italic": ("*", "*"), "strike": ("~~", "~~"), "underline": ("<u>", "</u>")}


def _marked(node: dict) -> str:
    """A text within its marks from the inside out; a link, the last one if there are several, goes around all of them."""
    text, marks = str(node.get("text") or ""), [m for m in node.get("marks") or [] if isinstance(m, dict)]
    links = [href for m in marks if m.get("type") == "link" and (href := str((m.get("attrs") or {}).get("href") or "").strip())]
    for mark in marks if text else ():
        before, after = MARKS.get((mark.get("type") or "").strip(), ("", ""))
        text = before + text + after
    return f"[{text}]({links[-1]})" if text and links else text


def node_markdown(node) -> str:
    """Markdown of one node of a rich text."""
    if not isinstance(node, dict):
        return ""
    kind, attrs, below = node.get("type"), node.get("attrs") or {}, node.get("content") or []
    if kind == "text":
        return _marked(node)
    if kind == "hardBreak":
        return "  \n"
    if kind == "image":
        return f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
    if kind in ("paragraph", "heading", "tableCell", "tableHeader"):
        text = "".join(map(node_markdown, below))
        return "#" * int(attrs.get("level") or 1) + " " + text if kind == "heading" else text
    if kind == "codeBlock":
        return "```" + (attrs.get("language") or "") + "\n" + "".join(map(node_markdown, below)) + "\n```"
    if kind in ("bulletList", "orderedList"):
        sign = (lambda i: f"{i}. ") if kind == "orderedList" else lambda i: "- "
        return "\n".join(sign(i) + node_markdown(x).replace("\n", "\n  ") for i, x in enumerate(below, 1))
    if kind == "blockquote":
        return "\n".join("> " + line for line in "\n\n".join(map(node_markdown, below)).split("\n"))
    if kind == "table":
        rows = ["| " + " | ".join(node_markdown(c).replace("|", "\\|") for c in row.get("content") or []) + " |" for row in below]
        return "\n".join([*rows[:1], "|" + " --- |" * len(below[0].get("content") or []), *rows[1:]]) if rows else ""
    mark = "\n" if kind == "listItem" else "\n\n"
    return mark.join(filter(None, map(node_markdown, below)))


@F.pandas_udf(StringType())
def rich_text(document: pd.Series) -> pd.Series:
    """Markdown of rich-text JSON; null where the JSON can't be read."""

    def one(x):
        try:
            return node_markdown(json.loads(x))
        except (TypeError, ValueError):
            return None

    return document.map(one).astype(object)
