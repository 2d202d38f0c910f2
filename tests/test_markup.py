import json

from pyspark.sql import functions as F

from lodestar.functions import markup as M
from lodestar.functions import text as T
from lodestar.sources import ingest


def text(x, *marks):
    return {"type": "text", "text": x, "marks": [{"type": m} for m in marks]}


def node(kind, *content, **attrs):
    return {"type": kind, "content": list(content), "attrs": attrs}


def test_rich_text():
    items = [node("listItem", node("paragraph", text(x))) for x in "ab"]
    table = node("table", node("tableRow", node("tableHeader", text("h|"))), node("tableRow", node("tableCell", text("c"))))
    doc = node("doc", node("heading", text("T"), level=2), node("orderedList", *items), node("blockquote", node("paragraph", text("q", "italic"))), node("codeBlock", text("x = 1"), language="python"), table)
    assert M.node_markdown(doc) == "## T\n\n1. a\n2. b\n\n> *q*\n\n```python\nx = 1\n```\n\n| h\\| |\n| --- |\n| c |"
    assert M.node_markdown({"type": "text", "text": "t", "marks": [{"type": "link", "attrs": {"href": "u"}}]}) == "[t](u)"
    assert M.node_markdown(None) == M.node_markdown(node("table")) == ""


def test_links_images_messages_prompts(spark):
    rows = [("http://h.x/a/b?q#f", "../c", "![i](p) and <img alt='' src=\"r\">!"), ("http://h.x/a", "//o.y/z", ""), (None, None, None), ("http://h.x", "http://[", "no image")]
    df = spark.createDataFrame(rows, "base string, link string, md string")
    out = df.select(M.absolute("base", "link").alias("u"), M.image_refs(F.col("md")).alias("r"), M.with_captions(F.col("md"), F.create_map(F.lit("r"), F.lit("R"))).alias("c")).collect()
    assert [x.u for x in out] == ["http://h.x/c", "http://o.y/z", None, "http://["]
    assert [[y.path for y in x.r or []] for x in out] == [["p", "r"], [], [], []]
    assert [x.c for x in out] == ["![i](p) and R!", "", None, "no image"]
    message = json.dumps({"zh_cn": {"title": "t", "content": [[[{"tag": "text", "text": " 段落A "}, {"tag": "a", "text": "no"}], [{"tag": "text", "text": "@_user_1段落B"}]]]}})
    cases = [("post", message, "段落A 段落B"), ("text", '{"text": "  hello   world "}', "hello world"), ("TEXT", '{"text": "@_user_1 你好 @_all_2"}', "你好 @_all_2"), ("text", "not json", "not json")]
    cases += [("image", '{"image_key": "k"}', None), ("text", " ", None), ("post", None, None), ("text", '{"text": "@_user_12"}', None), (None, "x" * 30_000, "x" * 20_000), ("text", "[1]", None)]
    m = spark.createDataFrame([c[:2] for c in cases], "k string, c string").coalesce(1)
    assert [x[0] for x in m.select(M.message_text("k", "c")).collect()] == [c[2] for c in cases]
    assert df.limit(1).select(M.filled("{a}{{a}}", a=F.lit("{a}"))).first()[0] == "{a}{a}"


def test_upload_twice(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "points")
    source.mkdir()
    (source / "a.txt").write_text("one\r\n\r\ntwo")
    (source / "b.md").write_text("x" * 2000)
    (source / "c.pdf").write_bytes(b"%PDF")
    for _ in range(2):
        ingest.upload(spark, str(source), path, "kb1")
    rows = spark.read.parquet(path).collect()
    assert sorted(len(r.text_content) for r in rows) == [8, 150 + 2 + 200, 900, 900]
    assert {r.kb_id for r in rows} == {"kb1"} and len({r.id for r in rows}) == 4
    ingest.upload(spark, str(source), path, "kb2", extensions=["md"])
    ingest.upload(spark, str(source), path, "kb1", extensions=["none"])
    assert {r.kb_id for r in spark.read.parquet(path).collect()} == {"kb2"}


def test_marks_and_breaks():
    assert M.node_markdown(node("paragraph", text("a", "underline"), {"type": "hardBreak"}, text("b"))) == "<u>a</u>  \nb"
    link = lambda href: {"type": "link", "attrs": {"href": href}}
    both = {"type": "text", "text": "t", "marks": [link("u"), {"type": "bold"}, link(" v "), {"type": "italic"}, link("")]}
    assert M.node_markdown(both) == "[***t***](v)" and M.node_markdown({"type": "text", "text": "", "marks": [link("u")]}) == ""


def test_questions_names_and_values(spark):
    asked = {" - 1) What is X? ": "What is X?", "1、第一个问题。": "、第一个问题？", "什么是检索；": "什么是检索？", "  ": "", None: "", "x" * 120: "x" * 95 + "…？", "a\t\n b": "a b？", "3.14": ""}
    df = spark.createDataFrame([(k,) for k in asked], "q string")
    got = {r["q"]: (r["a"], r["k"]) for r in df.select("q", T.question(F.col("q")).alias("a"), T.canonical_key(F.col("q")).alias("k")).collect()}
    assert {k: v[0] for k, v in got.items()} == asked
    assert got["什么是检索；"][1] == "什么是检索" and got[" - 1) What is X? "][1] == "what is x" and got["1、第一个问题。"][1] == "、第一个问题"
    names = [("Hello World", "http://h.x/a", "Hello World.md"), ("..", "https://u@Ex.am:80/p/q.html?x#y", "ex_am_p_q.html-20240110.md"), (None, "http://h.x", "h_x-20240110.md"), ("a//b:__c_. ", "", "a_b_c.md"), ("", "", "page-20240110.md")]
    df = spark.createDataFrame(names, "t string, u string, want string")
    assert all(r[0] == r[1] for r in df.select(T.file_name(F.col("t"), F.col("u"), F.lit("20240110")), "want").collect())
    buckets = {"My_KB 1": ("my-kb1", "My_KB 1"), "知识": ("kb-default", "-"), "-": ("kb-default", "-"), "a" * 70: ("a" * 63, "a" * 70), "__x!!y": ("x" "y", "__x y")}
    df = spark.createDataFrame([(k,) for k in buckets], "n string").select("n", M.bucket(F.col("n")).alias("b"), M.tag_value(F.col("n")).alias("v"))
    assert {r["n"]: (r["b"], r["v"]) for r in df.collect()} == buckets
    pages = {"<b>a</b><br/>b &nbsp;&lt;&#233;&amp;amp;<p> c </p><li>d</li>": "a\nb \xa0<é&amp; c\n\nd", "<section>x</section>\n\n\n\ny<script>1</script>": "x\n\ny"}
    df = spark.createDataFrame([(k,) for k in pages], "p string")
    assert {r["p"]: r["t"] for r in df.select("p", T.html_text(F.col("p")).alias("t")).collect()} == pages


def test_upload_by_type(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "points")
    source.mkdir()
    (source / "a.txt").write_text("one\r\n\r\ntwo")
    (source / "b.md").write_text("# H\ntext\n\n# I\nmore")
    (source / "c.csv").write_text("k,v\n1,x\n2,y\n")
    (source / "d.zip").write_bytes(b"PK")
    (source / "e.gif").write_bytes(b"GIF89a" + bytes([2, 0, 1, 0]) + bytes(20))
    for _ in range(2):
        report = {r["path"].rsplit("/", 1)[1]: r for r in ingest.upload_folder(spark, str(source), path, "kb1").collect()}
        assert {n: r["chunks"] for n, r in report.items()} == {"a.txt": 1, "b.md": 2, "c.csv": 1, "d.zip": 0, "e.gif": 0}
        assert report["d.zip"]["error"] and report["e.gif"]["info"]["width"] == "2"
    held = spark.read.parquet(path).collect()
    assert sorted(r["text_content"] for r in held) == ["# H\ntext", "# I\nmore", "# Sheet1\n| k | v |\n| --- | --- |\n| 1 | x |\n| 2 | y |", "one\ntwo"]
