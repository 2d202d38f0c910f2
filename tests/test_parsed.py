import io
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.sources import media, office, parsed

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def relations(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def workbook():
    return zipped({
        "xl/workbook.xml": f'<workbook {MAIN}><workbookPr/><sheets><sheet name="Zahlen &amp; Text" sheetId="1" r:id="r0"/><sheet name="leer" sheetId="2" r:id="r1"/><sheet name="zwei" sheetId="3" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations("worksheets/sheet1.xml", "/xl/worksheets/sheet2.xml", "worksheets/sheet3.xml"),
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>reading</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>inline</t></is></c></row>'
        '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>3</v></c><c r="C4"><v>2.50</v></c><c r="D4" t="b"><v>1</v></c></row>'
        '<row r="5"><c r="A5" s="1"><v>45292</v></c><c r="B5" s="2"><v>45292.5</v></c><c r="C5" s="3"><v>7</v></c><c r="D5" t="e"><v>#DIV/0!</v></c><c r="E5" t="str"><v>formula</v></c></row><row r="6"/></sheetData>'
        '<mergeCells><mergeCell ref="A2:B2"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {MAIN}><sheetData/></worksheet>",
        "xl/worksheets/sheet3.xml": f'<worksheet {MAIN}><sheetData><row><c><v>1</v></c><c><v>1</v></c></row><row><c r="AB2"><v>1e3</v></c></row></sheetData></worksheet>',
    })


def document():
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    return zipped({
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve"> a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c </w:t></w:r></w:p><w:p/>'
        f'<w:tbl><w:tr>{cell("x", "<w:gridSpan w:val=\"2\"/>")}{cell("top", "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{cell("1")}{cell("2")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl></w:body></w:document>',
    })


def slides():
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r0"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations("slides/slide1.xml", "slides/slide2.xml"),
        "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('last')}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('first')}<p:sp/>{shape(' ')}</p:spTree></p:cSld></p:sld>",
    })


def test_workbook_rows():
    rows = list(office.workbook_rows(workbook()))
    assert rows == [
        (0, "Zahlen & Text", 2, ["name", "", "inline"]), (0, "Zahlen & Text", 4, ["rich text", "3", "2.5", "True"]),
        (0, "Zahlen & Text", 5, ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "7", "", "formula"]),
        (2, "zwei", 1, ["1", "1"]), (2, "zwei", 2, [""] * 27 + ["1000"]),
    ]
    assert office.header_names(["a", "", "a", "a"], 5) == ["a", "Unnamed: 1", "a.1", "a.2", "Unnamed: 4"]
    for bad in (b"no zip", workbook()[:-40], zipped({"x.xml": "<a/>"}), zipped({"xl/workbook.xml": "<workbook"})):
        with pytest.raises(ValueError):
            list(office.workbook_rows(bad))


def test_documents_and_slides():
    assert list(office.document_parts(document())) == [
        ("paragraph", "heading 1", "Title"), ("paragraph", "Normal", "a\tb\nc"), ("table", None, [["x", "x", "top"], ["1", "2", "top"]]),
    ]
    assert list(office.slide_texts(slides())) == [(1, "first\nmore"), (1, "more"), (2, "last\nmore")]


def png(width, height):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + bytes(10) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes(3)


def tiff(order, width, height):
    entries = struct.pack(order + "HHIHxx", 256, 3, 1, width) + struct.pack(order + "HHII", 257, 4, 1, height)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 2) + entries + bytes(4)


def webp(kind, data):
    body = b"WEBP" + kind + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


IMAGES = {
    "PNG": png(640, 480), "GIF": b"GIF89a" + struct.pack("<HH", 640, 480) + bytes(20), "JPEG": jpeg(640, 480),
    "BMP": b"BM" + bytes(12) + struct.pack("<Iii", 40, 640, -480) + bytes(30), "TIFF": tiff(">", 640, 480),
}


def test_image_headers():
    more = [("TIFF", tiff("<", 640, 480)), ("WEBP", webp(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"))), ("WEBP", webp(b"VP8L", b"\x2f" + (639 | 479 << 14).to_bytes(4, "little"))), ("WEBP", webp(b"VP8 ", bytes(6) + struct.pack("<HH", 640, 480)))]
    for kind, data in [*IMAGES.items(), *more]:
        assert media.image_info(io.BytesIO(data)) == {"width": 640, "height": 480, "format": kind, "aspect_ratio": 1.33}, kind
        for cut in range(0, min(len(data), 22)):
            short = media.image_info(io.BytesIO(data[:cut]))
            assert short["width"] in (None, 640) and ("parse_error" in short) == (short["width"] is None)


def wav(seconds=2, rate=8000, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(bytes(2 * channels * rate * seconds))
    return out.getvalue()


def box(kind, *inside):
    data = b"".join(inside)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def mp4():
    header = box(b"mvhd", bytes(12), struct.pack(">II", 1000, 4000))
    entry = lambda kind, data: box(b"stsd", bytes(8), box(kind, data))
    film = box(b"trak", box(b"mdia", box(b"mdhd", b"\1" + bytes(19), struct.pack(">IQ", 600, 2400)), box(b"hdlr", bytes(8), b"vide"), box(b"minf", box(b"stbl", entry(b"avc1", bytes(24) + struct.pack(">HH", 320, 240) + bytes(50)), box(b"stsz", bytes(8), struct.pack(">I", 100))))))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun"), box(b"minf", box(b"stbl", entry(b"mp4a", bytes(16) + struct.pack(">HHxxxxI", 2, 16, 48000 << 16) + bytes(20))))))
    return box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 1000) + bytes(1000) + box(b"moov", header, film, sound)


def test_sound_and_film_headers():
    got = media.audio_info(io.BytesIO(wav()), "wav")
    assert got == {"duration": 2.0, "sample_rate": 8000, "channels": 2, "format": "WAV", "bitrate": len(wav()) * 4 // 1000, "file_size": len(wav())}
    film = media.video_info(io.BytesIO(mp4()), "mp4")
    assert film == {"duration": 4.0, "fps": 25.0, "width": 320, "height": 240, "frame_count": 100, "codec": "avc1", "has_audio": True, "resolution": "320x240", "format": "mp4", "file_size": len(mp4())}
    assert {k: v for k, v in media.audio_info(io.BytesIO(mp4()), "m4a").items() if k in ("sample_rate", "channels", "duration")} == {"sample_rate": 48000, "channels": 2, "duration": 4.0}
    for cut in (0, 5, 30, 200, len(mp4()) - 3):
        short = media.video_info(io.BytesIO(mp4()[:cut]), "mp4")
        assert (short["resolution"], short["fps"], short["duration"]) == ("1920x1080", 30.0, 0.0) and short["parse_error"]
    bad = media.audio_info(io.BytesIO(wav()[:30]), "wav")
    assert (bad["sample_rate"], bad["channels"], bad["bitrate"], bad["file_size"]) == (44100, 2, 0, 30) and bad["parse_error"]
    assert media.audio_info(io.BytesIO(wav()[:-4000]), "wav")["duration"] == 2.0 - 4000 / 32000  # what is there


def test_one_read_over_a_folder(spark, tmp_path):
    content = {
        "a.txt": b"one\r\n\r\ntwo\n\n \n", "b.md": b"# H\ntext\n```\ncode\n```\n", "c.xlsx": workbook(), "d.csv": "名称,值\n甲,1\n".encode("gbk"), "e.docx": document(), "deep/f.pptx": slides(),
        "g.png": png(2, 1), "h.wav": wav(), "i.mp4": mp4(), "noname": IMAGES["GIF"], "j.zip": b"PK", "k.xlsx": b"broken", "l.pdf": b"%PDF", "empty.txt": b"", "m.xls": b"\xd0\xcf",
    }
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    df = parsed.read(spark, str(tmp_path), partition_bytes=2000)
    assert df.rdd.getNumPartitions() > 3
    rows = {}
    for r in df.collect():
        rows.setdefault(r["path"].removeprefix(f"{tmp_path}/"), []).append(r)
    assert set(rows) == set(content) - {"empty.txt"}
    assert [r["text"] for r in rows["a.txt"]] == ["one", "two"] and [r["part"] for r in rows["a.txt"]] == [0, 1]
    assert [(r["kind"], r["name"], r["text"]) for r in rows["b.md"]] == [("content", None, content["b.md"].decode()), ("header", "1", "H"), ("code", None, "code")]
    assert [(r["kind"], r["name"], r["number"]) for r in rows["c.xlsx"]] == [("headers", "Zahlen & Text", 2), ("row", "Zahlen & Text", 4), ("row", "Zahlen & Text", 5), ("headers", "zwei", 1), ("row", "zwei", 2)]
    assert [r["cells"] for r in rows["d.csv"]] == [["名称", "值"], ["甲", "1"]]
    assert [r["kind"] for r in rows["e.docx"]] == ["paragraph", "paragraph", "table_row", "table_row"] and rows["deep/f.pptx"][0]["name"] == "slide 1"
    assert rows["g.png"][0]["info"]["width"] == "2" and rows["noname"][0]["file_type"] == "image" and rows["i.mp4"][0]["info"]["fps"] == "25.0"
    assert {n: r[-1]["error"].split(":")[0] for n, r in rows.items() if r[-1]["error"]} == {"j.zip": "ValueError", "k.xlsx": "ValueError", "l.pdf": "ValueError", "m.xls": "ValueError"}
    assert rows["j.zip"][0]["error"] == "ValueError: unsupported type unknown"
    assert all(r["file_size"] == len(content[n]) for n, rs in rows.items() for r in rs)


def test_conditions_choose_files_before_they_are_opened(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
        (tmp_path / f"{i}.md").write_text(f"# {i}")

    def refuse(content, path):
        raise AssertionError("opened")

    monkeypatch.setitem(parsed.PARSERS, "md", refuse)
    df = parsed.read(spark, str(tmp_path))
    assert df.filter("file_type = 'txt'").filter("error IS NOT NULL").count() == 0
    assert sorted(r["text"] for r in df.filter(F.col("file_type") == "txt").collect()) == [f"text {i}" for i in range(5)]
    assert [r["text"] for r in df.filter(F.col("path") == f"{tmp_path}/3.txt").collect()] == ["text 3"]
    assert df.filter(F.col("path").isin(f"{tmp_path}/1.txt", f"{tmp_path}/2.txt")).count() == 2
    reader = parsed.Reader({"path": str(tmp_path)}, parsed.PARSERS, parsed.EXTENSIONS)
    list(reader.pushFilters([parsed.EqualTo(("file_type",), "txt"), parsed.StringStartsWith(("path",), f"{tmp_path}/4")]))
    assert [[p for p, _ in part.files] for part in reader.partitions()] == [[f"{tmp_path}/4.txt"]]


def test_parsers_can_be_registered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parsed, "PARSERS", dict(parsed.PARSERS))
    monkeypatch.setattr(parsed, "EXTENSIONS", dict(parsed.EXTENSIONS))

    def lines(content, path):
        yield {"kind": "first", "text": content.decode().split("\n")[0]}
        raise RuntimeError("no more")

    parsed.register_parser("log", lines, [".LOG"])
    assert "log" in parsed.supported_types() and parsed.get_parser("log") is lines and parsed.get_parser("none") is None
    (tmp_path / "x.log").write_text("a\nb")
    got = parsed.read(spark, str(tmp_path)).orderBy("part").collect()
    assert [(r["kind"], r["text"], r["error"]) for r in got] == [("first", "a", None), ("error", None, "RuntimeError: no more")]
