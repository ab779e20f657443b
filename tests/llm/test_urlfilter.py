import duckdb

from arborlake.llm.urlfilter import ORACLE, judge_urls


def both(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/{name}/*.parquet'")
    sql = sorted(con.sql(ORACLE).fetchall(), key=str)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.read.parquet(f"{tmp_path}/{name}")).collect()), key=str)
    assert got == sql
    return {r[0]: r for r in got}


def test_real_rows(spark, tmp_path):
    got = both(spark, spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), tmp_path, "real")
    assert {"block", "allow"} == {r[4] for r in got.values()} and len({r[3] for r in got.values()}) >= 4


def test_links_and_odd_rows(spark, tmp_path):
    canon = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://a.com/de/1", ""),
        (2, "http://x.net/p", canon("https://A.com/de/1?utm_source=q#top")),  # alias of a blocked url
        (3, "https://X.net/p?utm_medium=z", None),
        (4, "http://y.net/q", "<META HTTP-EQUIV='refresh' CONTENT='0; URL=http://x.net/p'>"),
        (5, "http://z.net/q", canon("//y.net/q") + canon("http://never.net")),
        (6, "http://allowed.org/x", canon("http://w.net/")),
        (7, "http://w.net/", canon("http://b.com/de/")),  # allow comes before block
        (8, "http://w.net/v", "<link href=/u rel=canonical>"),
        (9, "http://w.net/u", ""),
        (10, "http://r.net/", canon("http://gone.com/de/2")),  # a blocked url that is no page
        (11, None, canon("http://a.com/de/1")), (12, "", ""), (13, "no scheme/de/", ""), (None, "http://EXAMPLE.ORG?x#y", None),
        (14, "http://example.org/es/", ""), (15, "http://sub.example.org/en/12", ""), (16, "http://notexample.org/es/", ""), (17, "http://org", ""), (18, "http://c.com/fr/de/", ""),
        (18, "http://c.com/fr/de/", ""), (19, "ftp://q.com/de/://w.net/", ""), (20, "http://h.net/" + "a/" * 100_000, "<p>" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "k", "n") for r in rows], "page_id long, url string, html string, key string, rule string")
    got = both(spark, df, tmp_path, "odd")
    assert [got[i][4] for i in (2, 3, 4, 5)] == ["block"] * 4 and got[2][3] is None
    assert [got[i][4] for i in (6, 7, 8, 9, 10, 11)] == ["allow", "allow", "allow", "allow", "block", "allow"]
    assert got[14][3] == "example.org/es/" and got[15][3] == "example.org/en/1" and got[16][3] == "org/" and got[17][3] is None
    assert judge_urls(df.limit(0)).count() == 0
    extra = spark.createDataFrame([("http://w.net/u", "http://a.com/de/9"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in judge_urls(df, redirects=extra).collect()}[8] == "block"


def test_relative_links_and_all_canonical_ones(spark, tmp_path):
    canon = lambda *us: "".join(f'<link rel="canonical" href="{u}">' for u in us)
    rows = [
        (1, "http://a.com/de/x/", ""), (2, "http://a.com/de/x/p.html", ""), (3, "http://n.net/f/g?x=1", canon("h")), (4, "http://n.net/f/h", canon("http://a.com/de/x/")),
        (5, "http://m.net/", canon("http://other.net/", "http://a.com/de/x/p.html")), (6, "http://m.net", canon("q")), (7, "http://m.net/q", canon("mailto:x@y.z", "#top", "?y=2")), (8, "http://m.net/q?y=2", canon("http://a.com/de/9")),
    ]
    got = both(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path, "relative")
    assert [got[i][4] for i in (3, 4, 5, 6, 7, 8)] == ["block"] * 6


def test_links_as_pages_write_them(spark, tmp_path):
    bad = "http://a.com/de/?x=1&y=2"
    rows = [
        (1, bad, ""),
        (2, "http://n.net/amp", "<link rel=canonical href='http://a.com/de/?x=1&amp;y=2'>"),
        (3, "http://n.net/words", f'<link rel="alternate  Canonical" href="{bad}">'),
        (4, "http://n.net/base", '<base href="http://a.com/de/"><link rel="canonical" href="?x=1&#38;y=2">'),
        (5, "http://n.net/gt", f'<link title="a > b" rel="canonical" href="{bad}">'),
        (6, "http://n.net/space", f'<link rel="canonical" href=" {bad}\n">'),
        (7, "http://n.net/port", '<link rel="canonical" href="https://a.com:443/de/?x=1&y=2">'),
        (8, "http://a.com:80/q", ""), (9, "http://n.net/to-port", '<link rel="canonical" href="http://a.com/q">'), (10, "http://n.net/f/g", '<link rel="canonical" href="http://n.net/to-port">'),
        (11, "http://a.com/x/y/z", '<link rel="canonical" href="../../de/./?x=1&y=2">'),
        (12, "http://n.net/comment", f'<!-- <link rel="canonical" href="{bad}"> --><p>'),
        (13, "http://n.net/script", f"""<script>x = '<link rel="canonical" href="{bad}">'</script>"""),
        (14, "http://n.net/title", f"""<link title="rel=canonical" href="{bad}"><link rel="stylesheet" title='x rel="canonical"' href="{bad}">"""),
        (15, "http://n.net/close", f'<link rel="canonical"href="{bad}"/>'),
        (16, "http://n.net/refresh", f"<meta content='3;URL={bad} ' http-equiv=Refresh>"),
        (17, "http://n.net/a/../dots", '<link rel=canonical href="http://n.net/b">'), (18, "http://n.net/dots", f'<link rel=canonical href="{bad}">'), (19, "http://n.net/b", ""),
        (20, "http://n.net/two", f'<base target=x><base href="http://a.com/de/"><base href="http://z.net/"><link rel=canonical href="?x=1&y=2">'),
        (21, "http://n.net/mail", '<base href="mailto:x"><link rel=canonical href="words">'),
        (22, "http://n.net/long", "<link " + "x='1' " * 100 + f'rel=canonical href="{bad}">' + "<link rel=canonical " + "y " * 100_000),
    ]
    got = both(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path, "written")
    verdicts = {i: got[i][4] for i in range(1, 23)}
    assert [i for i, v in verdicts.items() if v == "block"] == [1, 2, 3, 4, 5, 6, 7, 11, 15, 16, 17, 18, 19, 20, 21], verdicts


def test_a_large_link_table(spark, tmp_path):
    """Chains, a hub and rings of redirects against a union-find."""
    chain = [(f"http://c{k}.net/{i}", f"http://c{k}.net/{i + 1}") for k in range(40) for i in range(200)]
    hub = [(f"http://h.net/{i}", "http://hub.net/") for i in range(20_000)]
    rings = [(f"http://r{k}.net/{i}", f"http://r{k}.net/{(i + 1) % 10}") for k in range(500) for i in range(10)]
    links = chain + hub + rings + [(f"http://c{k}.net/200", "http://a.com/de/") for k in range(0, 40, 3)] + [("http://h.net/7", "http://b.com/de/x"), ("http://r3.net/4", "http://q.org/"), ("http://r3.net/5", "http://a.com/de/r")]
    pages = sorted({u for pair in links for u in pair})
    top = {u: u for u in pages}

    def find(u):
        while top[u] != u:
            top[u] = top[top[u]]
            u = top[u]
        return u

    for a, b in links:
        top[find(a)] = find(b)
    rule = lambda u: "allow" if u.split("/")[2].endswith("org") else "block" if "com/de/" in u else None
    says = {}
    for u in pages:
        says.setdefault(find(u), set()).add(rule(u))
    want = {u: rule(u) or ("allow" if "allow" in says[find(u)] else "block" if "block" in says[find(u)] else "allow") for u in pages}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(pages)], "page_id long, url string, html string")
    got = judge_urls(df, redirects=spark.createDataFrame(links, "src string, dst string"))
    assert {pages[r.page_id]: r.verdict for r in got.collect()} == want
    assert sum(v == "block" for v in want.values()) > 20_000
