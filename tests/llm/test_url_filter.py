from twinweave.llm.url_filter import url_filter

ROWS = [
    (1, "http://a.example.net/en/x?q#f", None), (2, "https://example.net/de/x", ""), (3, "HTTP://Example.ORG/fr/1", None), (4, "http://b.org/en/", '<link rel="canonical" href="http://c.net/z">'),
    (5, "http://shop.example.com/de/1", None), (6, "http://shop.example.com/en/1", None), (7, None, None), (8, "no scheme", "<p>"), (9, "http://net", None), (9, "http://net", None), (10, "ftp://xnet/", None),
    (11, "http://d.org/q", "<META http-equiv='refresh' content='0; URL=/r'>"), (12, "http://d.org/r?x=1", "<link href=//e.example.com/de/k rel=canonical>"), (13, "http://d.org/far", None),
    (14, "http://f.org/m", '<link rel="canonical" href="http://g.net/b">'), (15, "http://f.org/m2", '<link rel="canonical" href="http://f.org/m"><meta http-equiv="refresh" content="3;url=http://h.org/fr/ok">'),
    (16, "http://i.org:80/p#x", None), (17, "http://net/", None),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(*r, "h", "p") for r in ROWS], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/x", "net/", "block")
    assert got[3] == ("example.org", "/fr/1", "org/fr/", "allow")
    assert got[4] == ("b.org", "/en/", None, "block")  # its canonical target is blocked
    assert got[5][2:] == ("example.com/de/", "block")
    assert got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow")
    assert got[8] == ("", "", None, "allow")
    assert got[9] == ("net", "", None, "allow")  # no path, so the rule's path doesn't start it
    assert got[17] == ("net", "/", "net/", "block")
    assert got[10] == ("xnet", "/", None, "allow")
    assert got[11][3] == got[12][3] == "block"  # over two edges
    assert got[13][3] == "allow"
    assert got[14][3] == got[15][3] == "allow"  # an explicit allow in the class comes first
    assert got[16][:2] == ("i.org:80", "/p")


def test_links_that_are_no_markup_tie_nothing(spark):
    link = '<link rel="canonical" href="http://c.net/z">'
    texts = [f"<!-- {link} -->", f"<script>var x = '{link}'</script>", f"<STYLE>{link}</style >", f"<p><!-- open {link}", f"<textarea>{link}</textarea>", f"<template>{link}</template>", "<!-- a -->" + link, "<script></script>" + link, f"<scripted>{link}"]
    pages = spark.createDataFrame([(k, f"http://a{k}.org/", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter(pages).collect()} == {k: "allow" if k < 6 else "block" for k in range(len(texts))}


def test_very_long_html(spark):
    filler = "<p>some text</p><!-- note --><script>var a = 1 < 2;</script>" * 40_000
    pages = spark.createDataFrame([(1, "http://a.org/1", filler + '<link rel="canonical" href="http://c.net/z">'), (2, "http://a.org/2", "<script>" + "x" * 2_000_000), (3, "http://a.org/3", "canonical " + "<" * 1_000_000)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter(pages).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_given_redirects_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", None)], "page_id long, url string, html string")
    ties = spark.createDataFrame([("http://a.org/1", "http://b.org/2"), ("http://b.org/2", "http://c.net/3"), (None, "http://c.net/3")], "from_url string, to_url string")
    assert url_filter(pages, redirects=ties).first().verdict == "block"
    assert url_filter(pages.limit(0)).collect() == []
