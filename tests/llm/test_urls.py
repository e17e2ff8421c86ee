"""URL filters against a plain union-find version; connected components on odd graphs."""

import random
import re

from carrisk.llm import urls
from carrisk.llm.components import connected_components
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001

PAGES = [
    (1, "http://a.example.org/es/1", ""),  # blocked by rule
    (2, "https://b.example.net/x", '<html><link href="http://a.example.org/es/1" rel="canonical">'),  # alias: block
    (3, "http://b.example.net/x/#top", None),  # normal form of 2
    (4, "https://c.example.com/fr/9", "<LINK REL='canonical' HREF='https://b.example.net/x'>"),  # own allow
    (5, "http://d.example.net/old/a", '<meta http-equiv="refresh" content="0; URL=/new">'),
    (6, "http://d.example.net/new?utm_source=feed", ""),
    (7, "http://d.example.net/new", '<link rel=canonical href=http://e.example.com/de/4>'),  # 5, 6, 7 blocked by target
    (8, "http://f.example.net/1", "<link rel='stylesheet' href='http://a.example.org/es/1'>"),
    (9, None, "<link rel=canonical href='http://a.example.org/es/1'>"), (10, "", None), (11, "no scheme/es/", ""),
    (12, "HTTP://A.EXAMPLE.ORG/en/1#x?y", ""), (13, "http://example.org/en/2?x#y", ""), (14, "http://x.org", ""),
    (15, "ftp://badexample.org/es/", ""), (16, "http://g.net?ref=x", ""), (16, "http://g.net?ref=x", ""),
]


def plain_rule(host, path):
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def test_judged_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("verdict", urls.F.lit(1))
    rows = urls.judge(pages, urls.RULES).collect()
    assert sorted(r.page_id for r in rows) == sorted(p[0] for p in PAGES)
    blocked = {r.page_id for r in rows if r.verdict == "block"}
    assert blocked == {1, 2, 3, 5, 6, 7, 12}
    for r in rows:
        url = next(u for i, u, _ in PAGES if i == r.page_id)
        assert (r.host, r.path) == plain_parts(url)
        assert r.rule == plain_rule(r.host, r.path)[0]
    redirects = spark.createDataFrame([("http://g.net?ref=x", "http://a.example.org/es/1"), (None, "x")], "from_url string, to_url string")
    again = {r.page_id: r.verdict for r in urls.judge(pages, urls.RULES, redirects).collect()}
    assert again[16] == "block" and again[4] == "allow"
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_query_against_union_find(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def normal(url):
        host, path = plain_parts(url)
        q = re.match(r"[^?#]*\??([^#]*)", url.split("://", 1)[1]).group(1)
        kept = [p for p in q.split("&") if p and not re.fullmatch(urls.TRACKING + "(=.*)?", p)]
        return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    for p in pages:
        parent[find(p.url)] = find("normal " + normal(p.url))
    bad = {find(p.url) for p in pages if plain_rule(*plain_parts(p.url))[1] == "block"}
    rows = {r.page_id: r for r in QUERIES["op9_url_filter"](spark, SF001).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        rule, verdict = plain_rule(*plain_parts(p.url))
        want = verdict or ("block" if find(p.url) in bad else "allow")
        assert (rows[p.page_id].rule, rows[p.page_id].verdict) == (rule, want)
    assert not re.search("Python|Arrow|Pandas", QUERIES["op9_url_filter"](spark, SF001)._jdf.queryExecution().executedPlan().toString())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500), (None, 3)]
    edges += [(1000, 1000 + k) for k in range(1, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_table_of_rules_judges_like_rules_in_the_row(spark, monkeypatch):
    """20,000 rules, and the same few rules by both ways."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = [*urls.RULES, ("block", "x.org", ""), ("allow", "example.org", "/es/1"), ("block", "a.example.org", "/es/1"), ("block", "net", "/x"), ("allow", "net", "/x")]
    columns = ["page_id", "host", "path", "rule", "verdict"]
    few = sorted(map(str, urls.judge(pages, rules).select(columns).collect()))
    monkeypatch.setattr(urls, "MAX_RULES", 3)
    assert sorted(map(str, urls.judge(pages, rules).select(columns).collect())) == few
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(str, urls.judge(pages, table).select(columns).collect())) == few
    monkeypatch.undo()
    many = rules + [("block", f"h{i}.test", f"/{i % 7}") for i in range(20_000)]
    more = pages.unionByName(spark.createDataFrame([(100, "http://www.h777.test/0/x", ""), (101, "http://h777.test/1", "")], pages.schema))
    got = {r.page_id: r for r in urls.judge(more, many).collect()}
    assert got[100].rule == "h777.test/0" and got[100].verdict == "block" and got[101].rule is None
    assert sorted(str(r) for r in urls.judge(pages, many).select(columns).collect()) == few
