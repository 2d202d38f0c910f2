import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import folds
from lodestar.operators import chunks, portraits
from lodestar.operators import search as S
from lodestar.sources import files
from lodestar.streaming import state


def test_recursive_split_loses_nothing():
    for text in ("a b. " * 900, "x" * 2500, "p1\n\n" + "long sentence here. " * 100, "no end " * 300, ""):
        got = folds.recursive_split(text, 900)
        assert all(len(c) <= 900 for c in got)
        assert "".join("".join(got).split()) == "".join(text.split())


def test_packed_parts_overlap():
    words = lambda a, b, mark="": "".join(f"w{i}{mark} " for i in range(a, b))
    for text in (words(0, 900, "."), words(0, 900).replace(" ", ""), "p1\n\n" + words(0, 400, "."), words(0, 120, ".") + "\n\n" + words(120, 300, "."), "\n\n".join(f"paragraph {i} " + words(1000 * i, 1000 * i + i * 7 % 120) for i in range(40))):
        plain, got = folds.recursive_split(text, 900), folds.recursive_split(text, 900, overlap=150)
        assert all(len(c) <= 900 for c in got) and "".join("".join(plain).split()) == "".join(text.split())
        rest = [got[0]]
        for before, chunk in zip(got, got[1:], strict=False):
            shared = next((n for n in range(150, 0, -1) if chunk.startswith(before[-n:]) and chunk[n : n + 1].isspace()), 0)
            rest.append(chunk[shared:])
        assert "".join("".join(rest).split()) == "".join(text.split())
    assert folds.pack_parts(["a" * 8, "b" * 3, "c" * 9], 10, "\n", 4) == ["a" * 8, "aaaa\nbbb", "c" * 9]


def test_markdown_parts():
    assert len(folds.markdown_parts("title\n\nA\n\nB")) == 3
    assert folds.markdown_parts("# H\none\ntwo\n\n```\n# x\n\ny\n```\nend") == ["# H\none\ntwo", "```\n# x\n\ny\n```", "end"]


def test_merge_to_limit():
    got = folds.pack_parts(["x" * 100] * 15, 350)
    assert len(got) == 5 and all(len(x) <= 350 for x in got)


def test_row_blocks_and_scenes_and_json():
    blocks = folds.row_blocks(["a", "b"], [["1|", "x\ny"], ["2"]] * 40, 400)
    assert blocks[0][0] == 1 and blocks[-1][1] == 80 and all(b[1] + 1 == c[0] for b, c in zip(blocks, blocks[1:], strict=False)) and "1\\|" in blocks[0][2]
    assert folds.merge_scenes([(0, 50, "same"), (45, 90, "same"), (89, 120, "other")]) == [(0, 90, "same"), (89, 120, "other")]
    assert folds.first_json('say ```json\n{"a": [1, 2,],}``` end') == {"a": [1, 2]}
    assert folds.merge_scenes([(0, 5, "short a"), (4, 9, "short b"), (8, 12, "y" * 21), (11, 15, "y" * 20 + "z")]) == [(0, 5, "short a"), (4, 9, "short b"), (8, 15, "y" * 21)]


def test_routing_cases(spark):
    cases = [("one", "a", 0.5), ("unequal", "a", 0.5), ("unequal", "b", 0.2), ("equal", "a", 0.4), ("equal", "b", 0.4), ("low", "a", 0.05), ("low", "b", 0.01), ("close", "a", 0.5), ("close", "b", 0.49), ("close", "c", 0.1)]
    got = S.route_decision(S.route_scores(spark.createDataFrame(cases, "query_id string, kb_id string, sim double"))).collect()
    found = {q: (sorted(r["kb_id"] for r in got if r["query_id"] == q), next(r["method"] for r in got if r["query_id"] == q)) for q in {c[0] for c in cases}}
    assert found == {"one": (["a"], "single_kb_dominant"), "unequal": (["a"], "single_kb_dominant"), "equal": (["a", "b"], "dual_kb"), "low": (["a", "b"], "low_confidence"), "close": (["a", "b"], "dual_kb")}


def test_fusion_and_cut(spark):
    hits = spark.createDataFrame([(1, "dense", "x", 0), (1, "video", "x", 1), (1, "dense", "y", 1)], "query_id int, route string, id string, rank int")
    got = {r["id"]: r["score"] for r in S.weighted_rrf(hits).collect()}
    assert abs(got["x"] - (1 / 60 + 1.1 / 61)) < 1e-12 and abs(got["y"] - 1 / 61) < 1e-12
    ranked = spark.createDataFrame([(1, f"i{k:02}", 1.0 - k / 100, True) for k in range(12)] + [(1, "t", 2.0, False)], "query_id int, id string, final double, is_image boolean")
    assert {r["is_image"] for r in S.final_cut(ranked).collect()} == {True}


def test_portraits_and_chunk_links(spark):
    pts = spark.range(60).select("id", F.lit(1).alias("kb_id"), F.array((F.col("id") % 2).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    few = spark.range(9).select((F.col("id") + 100).alias("id"), F.lit(2).alias("kb_id"), F.lit([1.0, 2.0]).cast("array<float>").alias("vec"))
    found = portraits.portraits(pts.unionByName(few).withColumn("modality", F.lit("doc"))).collect()
    assert {r["kb_id"] for r in found} == {1} and sum(r["cluster_size"] for r in found) == 60 and len(found) == portraits.clusters_for(60)
    assert all(r["inertia"] < 1e-6 for r in found)
    two = np.array([[0.0, 0], [0, 1], [9, 0], [9, 1]])
    labels, _, inertia = portraits._cluster(two, 2)
    a, b = 1.0, (9 + np.sqrt(82)) / 2
    assert labels[0] == labels[1] != labels[2] and abs(inertia - 1) < 1e-9 and abs(portraits.silhouette(two, labels) - (b - a) / b) < 1e-9
    stored = spark.createDataFrame([(1, "old"), (3, "kept")], "kb_id int, note string")
    new = spark.createDataFrame([(1, "new")], "kb_id int, note string")
    assert sorted(portraits.replaced(stored, new, spark.createDataFrame([(1,), (2,)], "kb_id int")).collect()) == [(1, "new"), (3, "kept")]
    docs = spark.createDataFrame([(1, "a\n\nb\n\nc"), (2, None), (3, "")], "doc_id int, text string")
    rows = chunks.records(chunks.parts(docs)).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["a", "b", "c"] and rows[0]["next_id"] == rows[1]["id"] and rows[1]["prev_id"] == rows[0]["id"]


def test_write_replace_delete(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [("1", "k1", "f1", None, 0, "t", [1.0]), ("2", "k2", "f2", "f1", 0, "t", [1.0]), ("3", "k2", "f3", "x", 0, "t", [1.0])]
    pts = spark.createDataFrame(rows, files.POINT)
    files.append(pts, path)
    files.replace_kbs(pts.filter("id = '1'").withColumn("text_content", F.lit("new")), path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.filter("kb_id = 'k1'").first()["text_content"] == "new"
    assert [r["id"] for r in files.without(pts, spark.createDataFrame([("f1",)], "file_id string")).collect()] == ["3"]


def test_folder_and_types(spark, tmp_path):
    for name, data in (("a.txt", b"x"), ("skip/b.txt", b"y"), ("c.bin", b"%PDF-1.4"), ("d.JPG", b"zz")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.folder(spark, str(tmp_path), exclude=["skip"]).select("path", files.file_type(F.col("path"), F.col("content")).alias("t")).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["t"]) for r in got) == [("a.txt", "txt"), ("c.bin", "pdf"), ("d.JPG", "image")]


def test_counters_in_order(spark):
    rows = [("a", 3, 30), ("a", 1, 30), ("a", 2, 19), ("a", 4, 1), ("b", 1, 50), ("b", 2, None), ("c", 1, 49)]
    got = state.counter_triggers(spark.createDataFrame(rows, "kb string, n int, d int"), "kb", "d", ["n"]).collect()
    assert sorted(map(tuple, got)) == [("a", 3, 79), ("b", 1, 50)]


def test_dedup_stream_and_windows(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 5).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.deduplicated(stream, "k", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 5
    assert state.windows(rows, "ts", "10 seconds").agg(F.sum("n")).first()[0] == 20
    assert state.pending(rows, "k", "ts", "ts").agg(F.max("taken")).first()[0] == 3


def test_encodings_parsers_and_texts(spark, tmp_path):
    for name, data in (("a.csv", "k,v\n1,é\n2,\n".encode()), ("b.csv", "k,v\n1,中文\n".encode("gbk")), ("c.csv", b"\xef\xbb\xbfk,v\n1,x\n"), ("d.txt", "x\r\ny".encode())):
        (tmp_path / name).write_bytes(data)
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "é"), ("2", "")]
    assert files.csv(spark, str(tmp_path / "b.csv")).first()["v"] == "中文" and files.csv(spark, str(tmp_path / "c.csv")).columns == ["k", "v"]
    assert files.whole_texts(spark, str(tmp_path / "d.txt")).first()["text"] == "x\ny"
    files.register_parser("sheet", lambda found: found.select("path"))
    try:
        parsed = files.parse_files(files.folder(spark, str(tmp_path)))
        assert set(parsed) == {"sheet"} and parsed["sheet"].count() == 3
    finally:
        files.PARSERS.clear()
    capped = files.folder(spark, str(tmp_path), max_files=2).select("path").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in capped) == ["a.csv", "b.csv"]
    assert files.progress(spark.createDataFrame([("one", 1)], "stage string, percent int"), "stage", "percent").first()["value"] == '{"stage":"one","percent":1}'
    heads = [(b"II*\x00rest", "image"), (b"BMxx", "image"), (b"RIFF0000WEBP", "image"), (b"%PDF-1", "pdf"), (b"zz", "unknown")]
    got = spark.createDataFrame([(bytearray(b), "f") for b, _ in heads], "content binary, path string").select(files.file_type(F.col("path"), F.col("content"))).collect()
    assert [r[0] for r in got] == [kind for _, kind in heads]


def test_pending_items_in_batch_and_as_a_stream(spark, tmp_path):
    events = [(1, k, 1000 + k * 10, k in (4, 7)) for k in range(8)] + [(2, 0, 1000, False), (2, 1, 1500, True)]
    made = spark.createDataFrame(events, "s int, id int, sec int, takes boolean").withColumn("ts", F.timestamp_seconds("sec"))
    want = [(1, 4, "0,1,2"), (1, 7, "5,6"), (2, 1, "")]
    assert sorted(map(tuple, state.taken(made, "s", "id", "ts", "takes").collect())) == want
    made.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "events"))
    rows = []
    q = state.taken(stream, "s", "id", "ts", "takes").writeStream.foreachBatch(lambda b, _: rows.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(rows) == [(s, str(at), items) for s, at, items in want]


def test_posts(spark):
    assert folds.post_markdown("## 小节\n\n---\n\n正文") == "**小节**\n\n\n --- \n\n\n正文"
    assert folds.post_markdown("![x](https://a.com/z.png) ![y](rel/path.jpg) ![](p) ![a] (b) ![c]() ![") == "[x](https://a.com/z.png) （图：y） （图：配图） ![a] (b) ![c]() !["
    fenced = "```py\n# no ![i](j)\n---\n```\n# yes ![i](j)\n####### seven\n  #\tin"
    assert folds.post_markdown(fenced) == "```py\n# no ![i](j)\n---\n```\n**yes （图：i）**\n####### seven\n  **in**"
    assert folds.post_markdown("```\n# open ![i](j)") == "```\n# open （图：i）"
    assert folds.post_parts("p1\n\n" + "x" * 100, 80) == ["p1", "x" * 80, "x" * 20]
    assert folds.post_parts("", 80) == [] and folds.post_parts(" a\n\nb ", 80) == ["a\n\nb"] and folds.post_parts("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]


def test_markdown_parts_wait_for_text():
    assert folds.markdown_parts("# H\n\n行1\n行2\n\n行3") == ["# H\n\n行1\n行2\n\n行3"]
    assert folds.markdown_parts("# H\n\n\n\ntext\n\n\nnext\n\n## I\nx\n") == ["# H\n\n\n\ntext", "next", "## I\nx"]
    assert folds.markdown_parts("a\n\nb\n#tag\nc") == ["a\n\nb", "#tag\nc"]  # any line that begins with the sign counts
    assert folds.markdown_parts("标题\r\n\r\n段落甲\r\n\r\n段落乙") == ["标题", "段落甲", "段落乙"]


def test_overlap_leaves_marked_chunks_alone(spark):
    rows = [(1, k, c * 5, c == "c") for k, c in enumerate("abcde")] + [(2, 0, "xy", False)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, text string, alone boolean")
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunks.overlapped(df, 3, alone="alone").collect()}
    assert got == {(1, 0): "aaaaa\n\nbbb", (1, 1): "aaa\n\nbbbbb", (1, 2): "ccccc", (1, 3): "ddddd\n\neee", (1, 4): "ddd\n\neeeee", (2, 0): "xy"}


def test_csv_of_several_encodings(spark, tmp_path):
    for name, data in (("a.csv", "k,v\n1,é\n".encode()), ("b.csv", "k,v\n2,中文\n".encode("gbk")), ("c.csv", "k,v,w\n3,x,\n".encode("utf-8-sig"))):
        (tmp_path / name).write_bytes(data)
    assert sorted(tuple(r) for r in files.csv(spark, str(tmp_path)).select("k", "v", "w").collect()) == [("1", "é", ""), ("2", "中文", ""), ("3", "x", "")]
