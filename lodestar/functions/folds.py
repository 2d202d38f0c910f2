"""Sequential folds over one document's parts, which no frame of a window expresses; small helpers for use inside tasks."""

from __future__ import annotations

import json
import re
from itertools import groupby

MAX_CHUNK, OVERLAP, MERGE = 900, 150, 500
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def pack_parts(parts: list[str], limit: int, mark: str = "\n", overlap: int = 0) -> list[str]:
    """Join neighbours greedily while they fit. With ``overlap`` a new one begins with the end of the one before, of that many characters
    or as many as leave room for the part itself, if the one before is longer than that."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(mark) + len(part) <= limit:
            out[-1] += mark + part
            continue
        shared = min(overlap, limit - len(mark) - len(part))
        out.append(out[-1][-shared:] + mark + part if out and shared > 0 and len(out[-1]) > overlap else part)
    return out


def recursive_split(text: str, limit: int = MAX_CHUNK, marks: tuple[str, ...] = ("\n\n", "\n"), overlap: int = 0) -> list[str]:
    """Paragraphs packed to the limit, longer ones split at sentences, longer sentences cut. Nothing is lost. Packed parts may
    overlap, where there is room."""
    if len(text) <= limit:
        return [text] if text.strip() else []
    parts = [p for p in (text.split(marks[0]) if marks else _SENTENCE.split(text)) if p.strip()]
    if len(parts) <= 1 and not marks:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    fine = [q for p in parts for q in ([p] if len(p) <= limit else recursive_split(p, limit, marks[1:]) if marks else [p[i : i + limit] for i in range(0, len(p), limit)])]
    return pack_parts(fine, limit, marks[0] if marks else " ", overlap)


def markdown_parts(text: str) -> list[str]:
    """A line that begins with ``#`` opens a part and takes the text below it, over blank lines until there is some; a fenced block is a
    part. Two blank lines, or one before the next header or at the end, close a part; in a text without any ``#`` line each one does."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    headed = any(x.startswith("#") for x in lines)
    parts: list[list[str]] = [[]]
    fenced, skip = False, False
    for line, below in zip(lines, [*lines[1:], None], strict=True):
        mark, own = line.lstrip().startswith("```"), parts[-1]
        if skip:
            skip = False
        elif mark or fenced:
            if mark and not fenced:
                parts.append([line])
            else:
                own.append(line)
                if mark:
                    parts.append([])
            fenced ^= mark
        elif line.startswith("#"):
            parts.append([line])
        elif line.strip():
            own.append(line)
        else:
            held = [x for x in own if x.strip()]
            waiting = len(held) == 1 and held[0].startswith("#")
            if not headed or below is None or below.startswith("#"):
                parts.append([])
            elif waiting or below.strip():
                own.append(line)
            else:
                parts.append([])
                skip = True
    return [whole for p in parts if (whole := "\n".join(p).strip())]


def row_blocks(header: list[str], rows: list[list[str]], limit: int = MAX_CHUNK) -> list[tuple[int, int, str]]:
    """(first row, last row, Markdown table) with the header repeated; rows are numbered from 1."""
    cell = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ")
    line = lambda xs: "| " + " | ".join(cell(x) for x in [*xs, *[""] * len(header)][: len(header)]) + " |"
    head = line(header) + "\n|" + " --- |" * len(header)
    budget, out, held, used = max(200, limit - len(head)), [], [], 0
    for i, row in enumerate(rows, 1):
        text = line(row)
        if held and used + len(text) > budget:
            out.append((i - len(held), i - 1, "\n".join([head, *held])))
            held, used = [], 0
        held.append(text)
        used += len(text) + 1
    if held:
        out.append((len(rows) - len(held) + 1, len(rows), "\n".join([head, *held])))
    return out


def merge_scenes(scenes: list[tuple[float, float, str]], overlap: float = 10.0) -> list[tuple[float, float, str]]:
    """Neighbours closer than the overlap with the same summary (80 characters), or the same first 20 of a longer one, become one."""
    out: list[tuple[float, float, str]] = []
    for start, end, summary in sorted(scenes):
        if out and start - out[-1][1] < overlap:
            before, now = out[-1][2][:80], summary[:80]
            if before == now or len(before) > 20 and before[:20] == now[:20]:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] or summary)
                continue
        out.append((start, end, summary))
    return out


def _fences(lines: list[str]) -> list[bool]:
    """For each line whether it belongs to a fenced block, its marks included."""
    out, inside = [], False
    for line in lines:
        mark = line.strip().startswith("```")
        out.append(inside or mark)
        inside ^= mark
    return out


def _post_line(line: str) -> list[str]:
    """A line outside fences as chats show it: a rule stands alone between empty lines, a header's text is bold."""
    bare = line.strip()
    if bare in ("---", "***", "___"):
        return ["", " --- ", ""]
    level = len(bare) - len(bare.lstrip("#"))
    title = bare[level:]
    if 1 <= level <= 6 and title[:1].isspace():
        return [line[: len(line) - len(line.lstrip())] + f"**{title.strip()}**"]
    return [line]


def _linked_images(text: str) -> str:
    """Images become links to their address on the web, or a note of what they show."""
    out, at = [], 0
    while (begin := text.find("![", at)) >= 0:
        close = text.find("](", begin)
        end = text.find(")", close) if 0 <= close == text.find("]", begin) else -1
        address = text[close + 2 : end].strip()
        if end <= close + 2:
            out.append(text[at : begin + 2])
            at = begin + 2
            continue
        label = text[begin + 2 : close]
        shown = f"[{label}]({address})" if address.startswith(("http://", "https://")) else f"（图：{label or '配图'}）"
        out += [text[at:begin], shown]
        at = end + 1
    return "".join(out) + text[at:]


def post_markdown(text: str) -> str:
    """Markdown as chat posts show it. What stands in fences stays, but for images in a fence that is indented or never closed."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    shown = [x for line, fenced in zip(lines, _fences(lines), strict=True) for x in ([line] if fenced else _post_line(line))]
    marks = [i for i, line in enumerate(shown) if line.startswith("```")]
    kept = {i for a, b in zip(marks[::2], marks[1::2], strict=False) for i in range(a, b + 1)}
    blocks = [(keep, "\n".join(shown[i] for i in run)) for keep, run in groupby(range(len(shown)), kept.__contains__)]
    return "\n".join(block if keep else _linked_images(block) for keep, block in blocks)


def post_parts(text: str, limit: int = 5200) -> list[str]:
    """Paragraphs packed up to the limit; one that is longer is cut, and its pieces stand alone."""
    out: list[str] = []
    for long, run in groupby(text.strip().split("\n\n"), lambda p: len(p) > limit):
        out += [p[i : i + limit] for p in run for i in range(0, len(p), limit)] if long else [x.removeprefix("\n\n") for x in pack_parts(list(run), limit, "\n\n")]
    return [x for x in out if x]


def first_json(text: str, wanted=lambda x: True):
    """The first balanced JSON value in a text that is ``wanted``, fences and trailing commas tolerated; None if there is none."""
    decoder, clean = json.JSONDecoder(), re.sub(r",\s*([}\]])", r"\1", text or "")
    for m in re.finditer(r"[{\[]", clean):
        try:
            value = decoder.raw_decode(clean, m.start())[0]
        except ValueError:
            continue
        if wanted(value):
            return value
    return None


def scenes(answer: str | None) -> list[tuple[float, str]]:
    """(start, summary) of the scenes that a model's answer lists, alone or under ``scenes``."""
    found = first_json(answer or "", lambda x: isinstance(x, list) or isinstance(x, dict) and isinstance(x.get("scenes"), list))
    listed = found["scenes"] if isinstance(found, dict) else found or []
    return [(float(x.get("start_time") or 0), str(x.get("scene_summary") or "")) for x in listed if isinstance(x, dict)]
