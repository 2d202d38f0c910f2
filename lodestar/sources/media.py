"""What the headers of images, sounds and films say, read by walking their chunks and boxes.

Only headers are looked at, so a walker gets by with a file-like object and never reads what it skips. Files that are
cut short or damaged give the feature's defaults and the reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

#: What is told of a file whose header can't be read.
NO_SOUND = {"duration": 0.0, "sample_rate": 44100, "channels": 2, "bitrate": 0}
NO_FILM = {"duration": 0.0, "fps": 30.0, "width": 1920, "height": 1080, "frame_count": 0, "codec": "unknown"}
NO_IMAGE = {"width": None, "height": None, "format": None}


class Short(ValueError):
    pass


def _take(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Short("the file ends inside a header")
    return data


def _size(f: BinaryIO) -> int:
    at = f.tell()
    end = f.seek(0, 2)
    f.seek(at)
    return end


def _jpeg(f: BinaryIO) -> tuple[int, int]:
    f.seek(2)
    while True:
        mark = _take(f, 2)
        if mark[0] != 0xFF:
            raise ValueError("no marker where one must be")
        while mark[1] == 0xFF:
            mark = bytes((0xFF, _take(f, 1)[0]))
        if 0xD0 <= mark[1] <= 0xD9 or mark[1] == 1:
            continue
        (length,) = struct.unpack(">H", _take(f, 2))
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">xHH", _take(f, 5))
            return width, height
        f.seek(length - 2, 1)


def _webp(f: BinaryIO) -> tuple[int, int]:
    f.seek(12)
    kind = _take(f, 8)[:4]
    if kind == b"VP8X":
        data = _take(f, 10)
        return 1 + int.from_bytes(data[4:7], "little"), 1 + int.from_bytes(data[7:10], "little")
    if kind == b"VP8L":
        data = _take(f, 5)
        bits = int.from_bytes(data[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        width, height = struct.unpack("<6xHH", _take(f, 10))
        return width & 0x3FFF, height & 0x3FFF
    raise ValueError("a chunk that isn't an image's")


def _tiff(f: BinaryIO, order: str) -> tuple[int, int]:
    f.seek(4)
    f.seek(struct.unpack(order + "I", _take(f, 4))[0])
    found = {}
    for _ in range(struct.unpack(order + "H", _take(f, 2))[0]):
        tag, kind, _, raw = struct.unpack(order + "HHI4s", _take(f, 12))
        found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
    return found[256], found[257]


def _image(f: BinaryIO) -> tuple[str, int, int]:
    start = f.read(30)
    if start.startswith(b"\x89PNG\r\n\x1a\n"):
        if len(start) < 24:
            raise Short("the file ends inside a header")
        return ("PNG", *struct.unpack(">II", start[16:24]))
    if start[:6] in (b"GIF87a", b"GIF89a") and len(start) >= 10:
        return ("GIF", *struct.unpack("<HH", start[6:10]))
    if start.startswith(b"BM") and len(start) >= 26:
        if struct.unpack("<I", start[14:18])[0] == 12:
            return ("BMP", *struct.unpack("<HH", start[18:22]))
        width, height = struct.unpack("<ii", start[18:26])
        return "BMP", width, abs(height)
    if start.startswith(b"\xff\xd8\xff"):
        return ("JPEG", *_jpeg(f))
    if start[:4] == b"RIFF" and start[8:12] == b"WEBP":
        return ("WEBP", *_webp(f))
    if start[:4] in (b"II*\0", b"MM\0*"):
        return ("TIFF", *_tiff(f, "<" if start[:1] == b"I" else ">"))
    raise ValueError("no image header")


def image_info(f: BinaryIO) -> dict:
    """width, height, format, aspect_ratio; null, with the reason, where the header can't be read."""
    try:
        kind, width, height = _image(f)
    except (ValueError, KeyError, struct.error) as e:
        return NO_IMAGE | {"aspect_ratio": None, "parse_error": str(e)}
    return {"width": width, "height": height, "format": kind, "aspect_ratio": round(width / height, 2) if height > 0 else 0.0}


def _wav(f: BinaryIO) -> dict:
    f.seek(12)
    rate = channels = per_second = None
    while True:
        name, size = struct.unpack("<4sI", _take(f, 8))
        if name == b"fmt ":
            channels, rate, per_second = struct.unpack("<2xHII", _take(f, 12))
            f.seek(size - 12 + size % 2, 1)
        elif name == b"data":
            if not per_second:
                raise ValueError("sound before its format")
            left = _size(f) - f.tell()
            return {"duration": min(size, left) / per_second, "sample_rate": rate, "channels": channels, "format": "WAV"}
        else:
            f.seek(size + size % 2, 1)


def boxes(f: BinaryIO, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    """(type, first byte, end) of the boxes between two places."""
    while lo + 8 <= hi:
        f.seek(lo)
        size, kind = struct.unpack(">I4s", _take(f, 8))
        begin = lo + 8
        if size == 1:
            (size,) = struct.unpack(">Q", _take(f, 8))
            begin += 8
        end = hi if size == 0 else lo + size
        if end < begin or end > hi:
            raise Short("a box that ends outside its own")
        yield kind.decode("latin-1"), begin, end
        lo = end


def _inside(f: BinaryIO, lo: int, hi: int, *path: str) -> Iterator[tuple[int, int]]:
    for kind, begin, end in boxes(f, lo, hi):
        if kind == path[0]:
            if len(path) == 1:
                yield begin, end
            else:
                yield from _inside(f, begin, end, *path[1:])


def _timed(f: BinaryIO, begin: int) -> float:
    """Seconds of a header that has a scale and a length, in either of its versions."""
    f.seek(begin)
    version = _take(f, 4)[0]
    scale, length = struct.unpack(">16xIQ" if version else ">8xII", _take(f, 28 if version else 16))
    return length / scale if scale else 0.0


def _mp4(f: BinaryIO) -> dict:
    end = _size(f)
    movie = next(_inside(f, 0, end, "moov"), None)
    if movie is None:
        raise Short("no film header")
    out = {"duration": 0.0, "fps": 0.0, "width": 0, "height": 0, "frame_count": 0, "codec": "unknown", "has_audio": False, "sample_rate": None, "channels": None}
    for begin, _ in _inside(f, *movie, "mvhd"):
        out["duration"] = _timed(f, begin)
    for track in list(_inside(f, *movie, "trak")):
        handler = next(_inside(f, *track, "mdia", "hdlr"), None)
        if handler is None:
            continue
        f.seek(handler[0] + 8)
        kind = _take(f, 4)
        described = next(_inside(f, *track, "mdia", "minf", "stbl", "stsd"), None)
        if kind == b"soun":
            out["has_audio"] = True
            if described:
                f.seek(described[0] + 8)
                channels, rate = struct.unpack(">4x4x8x8xH2x4xI", _take(f, 36))
                out |= {"channels": channels, "sample_rate": rate >> 16}
        elif kind == b"vide":
            if described:
                f.seek(described[0] + 8)
                name, width, height = struct.unpack(">4x4s8x16xHH", _take(f, 36))
                out |= {"codec": name.decode("latin-1").strip() or "unknown", "width": width, "height": height}
            for begin, _ in _inside(f, *track, "mdia", "minf", "stbl", "stsz"):
                f.seek(begin + 8)
                (out["frame_count"],) = struct.unpack(">I", _take(f, 4))
            for begin, _ in _inside(f, *track, "mdia", "mdhd"):
                seconds = _timed(f, begin)
                out["fps"] = out["frame_count"] / seconds if seconds else 0.0
    return out


def audio_info(f: BinaryIO, extension: str = "") -> dict:
    """duration, sample_rate, channels, format, bitrate (thousands a second of the whole file), file_size; defaults with the reason."""
    size = _size(f)
    try:
        start = f.read(12)
        if start[:4] == b"RIFF" and start[8:12] == b"WAVE":
            found = _wav(f)
        elif start[4:8] == b"ftyp":
            film = _mp4(f)
            found = {"duration": film["duration"], "sample_rate": film["sample_rate"] or NO_SOUND["sample_rate"], "channels": film["channels"] or NO_SOUND["channels"], "format": extension}
        else:
            raise ValueError("no sound header that is known")
    except (ValueError, struct.error) as e:
        return NO_SOUND | {"format": extension, "file_size": size, "parse_error": str(e)}
    seconds = found["duration"]
    return found | {"bitrate": int(size * 8 / seconds) // 1000 if seconds > 0 else 0, "file_size": size}


def video_info(f: BinaryIO, extension: str = "") -> dict:
    """duration, fps, resolution, width, height, frame_count, codec, has_audio, format, file_size; defaults with the reason."""
    size = _size(f)
    try:
        if f.read(8)[4:8] != b"ftyp":
            raise ValueError("no film header that is known")
        found, why = _mp4(f), {}
    except (ValueError, struct.error) as e:
        found, why = NO_FILM | {"has_audio": False}, {"parse_error": str(e)}
    kept = {k: v for k, v in found.items() if k not in ("sample_rate", "channels")}
    return kept | {"resolution": f"{found['width']}x{found['height']}", "format": extension, "file_size": size} | why
