import json
import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from twinweave.llm import html_extraction
from twinweave.llm.html_extraction import MARKED, SAME_MARKED, SAME_PAGES, SAME_SHARE, align, blocks_of, content, extract, infer_wrappers, main_text, structure
from twinweave.llm.url_filter import host_of


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body><header><p>site head</p></header><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class=\"ad\">buy</div>{body}<aside>side</aside><form><p>mail</p></form>{extra}<footer>&copy; foot</footer></body></html>"


def test_article_without_its_surroundings():
    html = page("<!-- c --><article><h1>Title &amp; more</h1><p><b>First  line\n of <i>text</i><br>goes on.<p>Second &eacute;&#8211;x &lt; y.</p><div class='share'>share me</div><ul><li>one<li>two</ul></article>", "<section id='comments'><p>a reader says</p></section>")
    assert main_text(html, frozenset()) == "Title & more\n\nFirst line of text goes on.\n\nSecond é–x < y.\n\none\n\ntwo"


def test_cut_off_and_stray_markup():
    assert main_text("<article><p>a</b></p><p>b < c</p><p>d", frozenset()) == "a\n\nb < c\n\nd"
    assert main_text("<head><title>x<body><article>lost", frozenset()) == ""
    assert main_text("<head><article><p>kept", frozenset()) == "kept"
    assert main_text("<article><script>var x", frozenset()) == ""
    assert blocks_of("") == []
    assert main_text("<article>" * 3000 + "deep", frozenset()) == "deep"


def test_alignment_makes_optional_and_repeated_groups():
    a = structure(blocks_of("<div><h2>x</h2><p>1</p><p>2</p></div><div id=k><p>same</p></div>"))
    b = structure(blocks_of("<div><h2>y</h2><blockquote>q</blockquote><p>3</p></div><div id=k><p>same</p></div>"))
    w = align(a, b)
    flags = {x[0]: (x[2], x[3], x[6] is None) for x in w}
    assert flags["div>h2"] == (0, 0, True)  # a slot
    assert flags["div>p"] == (0, 1, True)  # repeated
    assert flags["div>blockquote"][0] == 1  # optional
    assert flags["div.k>p"][2] is False  # constant
    assert structure(blocks_of("<dl>" + "<dt>a<dd>b" * 5 + "</dl>"))[0][3] == 1


def test_wrappers_find_content_without_main_markup(spark):
    rows = [(i, f"http://h.org/{i}", f"<div class=top><p>Welcome to the site</p></div><div class=body><h2>T{i}</h2><p>{'story %d ' % i * 9}</p></div><div class=low><p>All rights</p></div>", 1, "h") for i in range(20)]
    rows += [(100, None, None, 1, "h"), (101, "http://one.org/", "", 1, "h"), (102, "http://h.org/z", page("<article><p>A</p></article>"), 1, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, host string")
    got = {r.page_id: r for r in extract(pages.repartition(4)).collect()}
    assert got[3].text == "T3\n\n" + ("story 3 " * 9).strip()
    assert got[3].n_chars == len(got[3].text)
    assert (got[100].text, got[100].n_chars, got[100].url) == ("", 0, None)
    assert got[101].text == ""
    assert got[102].text == "A"
    assert extract(pages.limit(0)).collect() == []
    assert content([]) == []


def extracted(spark, bodies, host="h.org"):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract(pages.repartition(4)).collect()}


def test_template_texts_inside_a_marked_region_go(spark):
    bodies = [page(f"<article><h1>T{i}</h1><div class='k9'><p>Only this week: all at half price</p></div><p>story {i}</p><p>more {i * i}</p>{'<ul><li>x</ul>' if i % 3 == 0 else ''}<p>Read the next one</p></article>") for i in range(12)]
    bodies += [page("<article><h2>Twin</h2><p>the same text</p></article>")] * 6
    got = extracted(spark, bodies)
    assert got[3] == "T3\n\nstory 3\n\nmore 9\n\nx"
    assert got[4] == "T4\n\nstory 4\n\nmore 16"
    assert got[13] == "Twin\n\nthe same text"  # one page six times is no template
    # Few pages prove nothing, and a region of nothing but such a text keeps it.
    assert extracted(spark, bodies[:3])[1] == "T1\n\nOnly this week: all at half price\n\nstory 1\n\nmore 1\n\nRead the next one"
    assert extracted(spark, [page(f"<div class=x>{i}</div><article><p>closed</p></article>") for i in range(8)])[2] == "closed"


def test_pages_without_main_markup_have_their_own_region(spark):
    top, low = "<div class=top><p>Welcome to the site</p></div>", "<div class=low><p>All rights</p></div>"
    some = lambda name, i: f"{name} {i} " * 30
    # Two templates on one host, one of them with a list of links that differ.
    posts = [f"{top}<div class=post><h2>P{i}</h2><p>{some('post', i)}</p></div><div class=latest><p>see {i}</p></div>{low}" for i in range(12)]
    stories = [f"{top}<div class=story><p>{some('story', i)}</p></div>{low}" for i in range(4)]
    got = extracted(spark, posts + stories)
    assert got[2] == f"P2\n\n{some('post', 2).strip()}"
    assert got[14] == some("story", 2).strip()
    # Sections beside each other.
    got = extracted(spark, [f"{top}<div class=wrap><section class=intro><p>{some('a', i)}</p></section><section class=body><p>{some('b', i)}</p></section><section class=end><p>{some('c', i)}</p></section></div>{low}" for i in range(6)])
    assert got[5] == "\n\n".join(some(x, 5).strip() for x in "abc")
    # A container of its own on every page.
    got = extracted(spark, [f"{top}<div id='title-{'abcdefgh'[i]}'><p>{some('own', i)}</p></div>{low}" for i in range(8)])
    assert got == {i: some("own", i).strip() for i in range(8)}
    # One page again and again is no template.
    assert extracted(spark, [f"<div class=body><p>{some('x', 1)}</p></div>"] * 5 + [page("<article><p>A</p></article>")])[3] == some("x", 1).strip()
    # A short page keeps to the region of its class.
    assert extracted(spark, [*posts, f"{top}<div class=post><p>Brief</p></div><div class=latest><p>{'see this ' * 9}</p></div>{low}"])[12] == "Brief"


def test_names_are_evidence_only_as_a_whole():
    text = lambda body: main_text(body, frozenset())
    assert text('<body class="single has-sidebar"><article><p>a story</p></article>') == "a story"
    assert text('<article class="post share-enabled"><p>a story</p></article>') == "a story"
    assert text('<article><h2 id="related-work">Related work</h2><p>as before</p><section id="notice"><p>to note</p></section></article>') == "Related work\n\nas before\n\nto note"
    assert text('<article><p>a story</p><div class="ad-box">buy</div><div id="cookie-banner">ok</div><ul class="comment-list"><li>hm</ul></article>') == "a story"
    assert text("<div class=post><p>a story</p></div><section id='comments'><p>a reader</p></section>") == "a story"


def test_inline_parts_that_are_out():
    text = lambda body: main_text(body, frozenset())
    assert text("<article><p>Story <button>Buy now</button> goes on</p></article>") == "Story goes on"
    assert text("<article><p>Story <span class='ad'>Buy <b>now</b></span> goes on <label>Mail</label>here</p></article>") == "Story goes on here"
    assert text("<article><p>As <math><mi>x</mi>=2</math> says</p></article>") == "As x=2 says"


def test_quotes_in_and_out_of_attributes():
    text = lambda body: main_text(body, frozenset())
    assert text("<article><p title=it's>one</p><p>isn't two</p></article>") == "one\n\nisn't two"
    assert text("<article><p title=\"a > b\" data-x='<p>'>one</p></article>") == "one"
    assert text("<article><p title=\"open>one</p><p>two") in ("one\n\ntwo", "")


def test_deep_nesting_keeps_its_kinds():
    deep = "<div>" * 5000
    assert main_text(f"<article>{deep}<nav><p>menu</p></nav><p>story</p>", frozenset()) == "story"
    assert len(blocks_of("<div><p>x</p>" * 3000)) == 3000


def random_pages(rng):
    """Pages of a few hosts and templates; some blocks come and go, some repeat, some are constant."""
    rows = []
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randint(0, 99)) for _ in range(n))
    for i in range(140):
        host, kind = rng.choice(["one.org", "one.org", "two.org", "solo%d.org" % i]), rng.randint(0, 2)
        story = "".join(f"<p>{words(rng.randint(3, 30))}</p>" + "<blockquote>%s</blockquote>" % words(4) * rng.randint(0, 1) for _ in range(rng.randint(1, 6)))
        inner = [f"<article><h1>{words(3)}</h1>{story}<p>Read on below</p></article>", f"<div class=body><h2>{words(2)}</h2>{story}</div>", f"<div id=x{i}>{story}</div>"][kind]
        rows.append((i, f"http://{host}/{i}", f"<html><body><div class=top><p>Welcome to {host}</p></div>{inner}<div class=low><p>All rights</p></div><ul>{'<li>link' * rng.randint(0, 4)}</ul></body>"))
    return rows + [rows[3], rows[4], (900, "http://one.org/e", ""), (901, None, None)]


def brute_pages(rows):
    """The same by plain loops over all pages of a host at once."""
    out = []
    hosts = {r[0]: (r[1] or "").partition("://")[2].partition("/")[0] for r in rows}
    for page_id, _, html in rows:
        pages = [r[2] or "" for r in rows if hosts[r[0]] == hosts[page_id]]
        distinct = {tuple(b for b in blocks_of(p) if b[1] != "out") for p in pages}
        have, around = defaultdict(int), defaultdict(int)
        for blocks in distinct:
            for b in set(blocks):
                have[b] += 1
            for container in {b[:2] for b in blocks}:
                around[container] += 1
        same = {b for b, n in have.items() if n >= (SAME_MARKED if b[1] == "main" else SAME_PAGES) and n >= SAME_SHARE * around[b[:2]]}
        chars, seen = defaultdict(float), defaultdict(set)
        for k, p in enumerate(pages):
            items = defaultdict(list)
            for b in blocks_of(p):
                if b[1] != "out":
                    items[b[:2]].append(b[2])
                    seen[b[0]].add(k)
            for (s, kind), texts in items.items():
                chars[s, kind] += sum(map(len, texts))
        out.append((page_id, same, {c: n / len(seen[c[0]]) for c, n in chars.items()}, html or ""))
    return out


def test_against_plain_loops_however_rows_are_dealt(spark, monkeypatch):
    rows = random_pages(random.Random(4))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for parts, fan in ((1, 64), (7, 3)):
        monkeypatch.setattr(html_extraction, "FAN", fan)
        results.append(sorted(tuple(r) for r in extract(pages.repartition(parts)).select("page_id", "text").collect()))
    assert results[0] == results[1]
    got = dict(results[0])
    for page_id, same, weights, html in brute_pages(rows):
        blocks = [b for b in blocks_of(html) if b[1] != "out"]
        own = [b for b in blocks if b not in same]
        # Content is made of the page's own blocks, in order; whatever the template repeats is gone.
        assert got[page_id] == "\n\n".join(t for _, _, t in own if t in got[page_id].split("\n\n"))
        assert all(b[2] not in got[page_id].split("\n\n") for b in same)
        # The region holds most of the weight of its host's slots.
        sizes = {b[:2]: weights[b[:2]] * (MARKED if b[1] == "main" else 1) for b in own}
        kept = sum(w for c, w in sizes.items() if any(b[:2] == c and b[2] in got[page_id].split("\n\n") for b in own))
        assert not own or kept >= 0.5 * sum(sizes.values()), page_id


def test_every_page_goes_through_its_wrapper(spark):
    """Wrappers hold a slot or constant for every block, and their weights alone choose the region."""
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = random_pages(random.Random(7))
    pages = spark.read.parquet(path).select("page_id", "url", "html") if os.path.exists(path) else spark.createDataFrame(rows, "page_id long, url string, html string")
    given = pages.withColumn("host", host_of(F.col("url")))
    wrappers = {r.host: {(x[0], x[1]) for x in json.loads(r.wrapper)} for r in infer_wrappers(given).collect()}
    through = [all(b[:2] in wrappers[r.host or ""] for b in blocks_of(r.html or "")) for r in given.collect()]
    assert sum(through) == len(through)
    # Without a main region in the markup the same text comes out.
    got = {r.page_id: r.text for r in extract(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    bare = {r.page_id: r.text for r in extract(plain).collect()}
    assert sum(got[k] == bare[k] for k in got) >= 0.8 * len(got)


def test_common_subsequence_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        found = html_extraction._common(a, b)
        assert len(found) == best[0][0]
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_repeated_rows_ties_and_a_very_long_page(spark):
    long = page("<article>" + "".join(f"<p>sentence {i} of it</p>" for i in range(20_000)) + "</article>")
    got = extracted(spark, [long, long, page("<article><p>a</p></article>"), "<p>only</p><p>two</p>"])
    assert got[0] == got[1] == "\n\n".join(f"sentence {i} of it" for i in range(20_000))
    assert got[3] == "only\n\ntwo"
