from lodestar.plans import catalog


def test_titles_keep_their_references(spark, tmp_path):
    titles = ["A &quot;b&quot; &lt;c", 'x "y" \\z', "p &amp; q", "r &amp;quot; s", "t & u", "v w x y", "no state"]
    pages = [(k, "http://www.h.x/a", f"<title>{t}</title>") for k, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in catalog.QUERIES["structured_pages"](spark, str(tmp_path)).collect()}
    assert got == {k: t.replace("&amp;", "&") for k, t in enumerate(titles[:6])}


def test_titles_of_a_few_letters_make_texts(spark, tmp_path):
    titles = ["a", "ab", "É", "to."]
    pages = [(10 * 7 * n + k, None if n == 2 else "http://www.h.x/a", f"<title>\u3000{t}\xa0</title>") for n, t in enumerate(titles) for k in range(7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in catalog.QUERIES["structured_pages"](spark, str(tmp_path)).collect()}
    assert {i: r["title"] for i, r in got.items()} == {70 * n + k: t for n, t in enumerate(titles) for k in range(6)}
    base = [300, 290, 340, 345, 350, 340]
    assert all(got[k]["score"] == base[k] and got[70 + k]["score"] == base[k] + 1 for k in range(6))
    assert [got[k]["site"] for k in range(6)] == ["The Site"] + ["h.x"] * 5 and [got[140 + k]["site"] for k in range(6)] == ["The Site"] + [None] * 5


def test_pages_that_share_an_id_all_stay(spark, tmp_path):
    pages = [(k % 7, "http://www.h.x/a", f"<title>title {k // 14}</title>") for k in range(28)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["title"]) for r in catalog.QUERIES["structured_pages"](spark, str(tmp_path)).collect())
    assert got == sorted((k % 7, f"title {k // 14}") for k in range(28) if k % 7 < 6)
