import random

from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.op2_query import RULES
from tallyloom.llm.url_filter import judge_urls, plain_text, resolve


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    return {r.page_id: r for r in judge_urls(df, RULES, **more).collect()}


def test_rules_and_odd_urls(spark):
    got = judged(spark, [
        (1, "http://A.Example.NET/en/1", None, "x"), (2, "http://example.net/de/", "", "x"), (3, "https://badnet/x", "", "x"), (4, None, None, None),
        (5, "no scheme.net/", "", ""), (6, "http://example.com/de/a?b=/c", "", ""), (7, "http://x.org/fr/", "", ""), (8, "http://example.net", "", ""), (9, "http://notexample.com/de/", "", ""), (9, "http://notexample.com/de/", "", ""),
    ])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("badnet", "/x", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("example.com", "/de/a", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("example.net", "", None, "allow"), ("notexample.com", "/de/", None, "allow"),
    ]


def test_aliases_spread_blocks_but_not_over_allows(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    got = judged(spark, [
        (1, "http://a.com/1", link.format("http://bad.net/x"), ""),
        (2, "http://a.com/2#frag", '<META http-equiv="Refresh" content="0; URL=/1">', ""),
        (3, "http://ok.org/fr/3", link.format("http://a.com/2"), ""),
        (4, "http://a.com/4", link.format("http://a.com/5"), ""), (5, "http://a.com/5", "<link rel=stylesheet href=http://bad.net/x>", ""),
    ])
    assert {k: v.verdict for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert len({got[i].alias_of for i in (1, 2, 3)}) == 1


def test_empty(spark):
    assert judged(spark, []) == {}


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def test_relative_references(spark):
    base = "http://example.com/a/b/c?q=1#f"
    want = {  # with RFC 3986, 5.4
        "g": "/a/b/g", "./g": "/a/b/g", "g/": "/a/b/g/", "/g": "/g", "?y": "/a/b/c?y", "g?y#s": "/a/b/g?y#s", ".": "/a/b/", "..": "/a/", "../g": "/a/g", "../..": "/", "../../../g": "/g", "/./g": "/g",
        "g/./h": "/a/b/g/h", "g/../h": "/a/b/h", "login.html": "/a/b/login.html", "in?next=http://x.org/": "/a/b/in?next=http://x.org/",
    }
    df = spark.createDataFrame([(base, x) for x in [*want, "//x.org/1", "https://y.org/../2", "mailto:a@b", "#s"]], "url string, to string")
    got = {r.to: r.full for r in df.select("to", resolve(F.col("url"), F.col("to")).alias("full")).collect()}
    assert got == {k: "http://example.com" + v for k, v in want.items()} | {"//x.org/1": "http://x.org/1", "https://y.org/../2": "https://y.org/../2", "mailto:a@b": None, "#s": base}
    tag = '<meta http-equiv="refresh" content="0; url={}">'
    pages = judged(spark, [(1, "http://example.com/fr/x", tag.format("../de/y"), ""), (2, "http://example.com", tag.format("de/y"), ""), (3, "http://example.com/en/z", tag.format("?id=2"), "")])
    assert {k: v.verdict for k, v in pages.items()} == {1: "block", 2: "block", 3: "allow"} and pages[3].alias_of


def test_bases_and_character_references(spark):
    tag = '<meta http-equiv="refresh" content="0; url={}">'
    got = judged(spark, [
        (1, "http://a.com/1", '<base target="_top" href="http://bad.net/q/">' + tag.format("x"), ""), (2, "http://a.com/2", tag.format("http:&#47;&#x2F;bad&#46;net/"), ""),
        (3, "http://a.com/3", "<base href='/de/'>" + tag.format("x"), ""), (4, "http://example.com/4", "<base href='/de/'>" + tag.format("x"), ""), (5, "http://a.com/5", tag.format("&#x110000;&#0;&#xD800;y&amp;lt;"), ""),
    ])
    assert {k: v.verdict for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow"}
    text = spark.createDataFrame([("&#233;&#x1F600;&amp;quot;&quot;&#0;",)], "t string").select(plain_text(F.col("t"))).first()[0]
    assert text == 'é\U0001f600&quot;"&#0;'
