"""The operators on pages and vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import lineblock, pq, urls
from parley.llm.components import connected_components
from parley.llm.gather import HashSet
from parley.llm.queries_web import RULES

PAGES = [
    ("<article><p>One &amp; two&nbsp;three</p><p>four<br>five</p></article>", "One & two three\nfour five"),
    ("<body><nav><ul><li><a href=x>Menu</a></ul></nav><main><h1>Title</h1><div>Text <b>bo</b>ld</div></main><footer>foot</footer>", "Title\nText bold"),
    ("<div class='site-header'>Head</div><div class=content><p>" + "word " * 40 + "</p><p>Short.</p></div><div id=comments><p>" + "reply " * 40 + "</p></div>", ("word " * 40).strip() + "\nShort."),
    ("<article>a<aside>side</aside>b<div class='ad'>buy</div><form>in</form><script>var t='</article>';</script>c<!-- x --><section class='comments'>no</section></article>tail", "a\nb\nc"),
    ("<nav><a href=/>home</a><article><p>kept although the menu never ends</article>", "kept although the menu never ends"),
    ("<article><p>story</p></article><section class=comments><article class=comment>one</article></section><aside><article>teaser</article></aside>", "story"),
    ("<main><article class='post'>a</article><article class='user-comment'>b</article></main><div role='banner'>x</div>", "a"),
    ("<p>Only a few words.</p>", "Only a few words."),
    ("plain text", "plain text"),
    ("<div class=\"cookie-notice\">We use cookies</div><article><header><h1>T</h1></header><p>a &lt;b&gt; c</p><p title='x > y'>d</p></article>", "T\na <b> c\nd"),
    ("", ""),
    (None, ""),
    ("<<<>>><p", "<<<>>><p"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert lineblock.main_text(html) == want


LONG = ("word " * 40).strip()


def test_a_marked_teaser_does_not_replace_the_body():
    body = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    for teaser in ("<article>", "<article class='teaser'>", "<article class='card'>"):
        got = lineblock.main_text(f"{body}<ul><li><a href=/x>more of it</a></li></ul>{teaser}<p>A few words.</p></article>")
        assert got.startswith(f"{LONG}\n{LONG}")


def test_wrappers_and_figures_lose_no_short_lines():
    html = f"<div><h1>Title</h1></div><div><p>{LONG}</p></div><div><div><p>Short one.</p></div></div><p></p><figure><img src=x></figure><p>- Yes.</p><ul><li>item</li></ul><nav>menu</nav><p>Middle.</p><div class=ad>buy</div><p>{LONG}</p><div><p>The end.</p></div><footer>foot</footer>"
    assert lineblock.main_text(html).split("\n") == ["Title", LONG, "Short one.", "- Yes.", "item", "Middle.", LONG, "The end."]


def test_headings_and_sections_may_be_called_anything():
    html = "<article><h2 id='search'>Search</h2><p>a</p><section id=discussion><h2>Discussion</h2><p>b</p></section><section id='pagination'><p>c</p></section><section class=comments>no</section></article>"
    assert lineblock.main_text(html) == "Search\na\nDiscussion\nb\nc"


def test_menus_of_links_never_surge():
    html = "<ul>" + "".join(f"<li><a href=/{k}>a link with a rather long name {k}</a></li>" for k in range(20)) + "</ul><hr><div><p>" + "text " * 50 + "</p></div>"
    assert lineblock.main_text(html) == ("text " * 50).strip()


def test_extract_rows(spark):
    rows = [(k, f"http://x/{k}", h, "clash") for k, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = lineblock.extract(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id) == sorted((k, w, len(w)) for k, (_, w) in enumerate(PAGES) if k)
    assert len(got) == len(rows) and lineblock.extract(df.limit(0)).count() == 0


def test_aliases_of_blocked_pages(spark):
    edges = spark.createDataFrame([("a.net/1", "b.net/2"), ("b.net/2", "x.com/de/"), ("c.com/fr/", "x.com/de/"), (None, "a.net/1"), ("z.net/", "z.net/")], "src string, dst string")
    pages = [(1, "http://a.net/1#top"), (2, "https://B.NET/2"), (3, "http://c.com/fr/"), (4, "http://d.net/"), (5, None), (6, "no host"), (7, "http://"), (8, "http://sub.example.org/en/19"), (9, "http://example.org/"), (1, "http://a.net/1#top")]
    df = spark.createDataFrame([(i, u, "", "h") for i, u in pages], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df, RULES, edges).collect())
    assert got == [
        (1, "a.net", "/1", None, "block"), (1, "a.net", "/1", None, "block"), (2, "b.net", "/2", None, "block"), (3, "c.com", "/fr/", "com/fr/", "allow"), (4, "d.net", "/", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "sub.example.org", "/en/19", "example.org/en/1", "block"), (9, "example.org", "/", "org/", "allow"),
    ]
    assert urls.url_verdicts(df.limit(0), RULES).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (120, 2))] + [(5, 5), (None, 3)]
    label = {x: x for e in edges for x in e if x is not None and e[0] is not None}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and set(label) - set(got) <= {a for a, b in edges if a == b}


@pytest.mark.parametrize("kind,chunk", [("long", 1 << 19), ("long", 7), ("string", 7)])
def test_components_of_paths_and_hubs(spark, kind, chunk):
    """A shuffled path, hubs with larger and with smaller neighbours, edges between them and repeated ones."""
    rng = np.random.default_rng(8)
    name = rng.permutation(900) - 100
    edges = [(k, k + 1) for k in range(150)] + [(200, k) for k in range(201, 400)] + [(k, 400 + k % 3) for k in range(410, 600)] + [(401, 402), (210, 410), (700, 701), (701, 700)]
    edges = [(int(name[a]), int(name[b])) for a, b in edges]
    edges += [(a, b) for a, b in edges[::5]] + [(1000, min(name[:150])), (1000, 5000)] + [(5000, 6000 + k) for k in range(50)] + [(k - 900, 5000) for k in range(50)]
    edges = [edges[k] for k in rng.permutation(len(edges))]
    edges = [tuple(f"{x + 1000:05}" for x in e) for e in edges] if kind == "string" else [tuple(map(int, e)) for e in edges]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame([*edges, (None, None)], f"a {kind}, b {kind}").repartition(3), chunk=chunk).collect()
    assert {r.id: r.component for r in got} == label and len(got) == len(label)


def test_components_take_few_rounds(spark):
    """Jobs of a search in near copies that meet in many regions: those of many small tasks last long."""
    rng = np.random.default_rng(11)
    ids = rng.integers(-(2**62), 2**62, 4000)
    edges = [(int(ids[a]), int(ids[b])) for a, b in zip(rng.integers(0, 200, 6000), rng.integers(200, 4000, 6000))]
    df = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        found = connected_components(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 20
    assert found.select("component").distinct().count() == 1 and connected_components(df.limit(0)).count() == 0


def test_hash_set_loses_nothing(spark):
    ids = spark.range(5000).selectExpr("xxhash64(id) AS h")
    held = HashSet.of(ids, "h", bits=1 << 16)
    known = np.array([r.h for r in ids.collect()])
    assert held.may_hold(known).all()
    assert HashSet.of(ids.limit(0), "h", bits=1 << 16).array.sum() == 0


def test_vectors_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]),
        (10, [1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, []),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(df).collect()), key=str)
    want = [(0, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (11, 3, 1, False), (11, 3, 1, False)] + [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 12)]
    assert got == sorted(want, key=str)
    assert pq.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in pq.near_duplicates(df.where("vec_id IN (5, 6)")).collect()} == {0}


def test_vector_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    near = base[rng.integers(0, 1500, 1500)] + 0.25 * rng.standard_normal((1500, 32))
    rows = np.concatenate([base, near]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.95).sum() - len(rows)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in pq.near_duplicates(df).collect())
    assert truth > 1000 and 0.98 * truth <= found <= truth


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin, urlsplit

    rng = random.Random(3)
    parts = ["a", "b.html", ".", "..", "c d", "x.y"]
    pages = ["http://H.example/", "https://h.example", "http://h.example/a/b", "http://h.example/a/b/", "http://h.example/a/b/c.html?q=1#f"]
    refs = ["", "?q=2", "#top", "/", "//Other.example/x", "http://third.example/a/c?z=/../1", "/..", "..", ".", "../..", "./x"]
    refs += ["/" * rng.randrange(2) + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?a=b/../c"]) for _ in range(200)]
    rows = [(p, r) for p in pages for r in refs if r]
    df = spark.createDataFrame(rows, "url string, ref string")
    got = {(r.url, r.ref): r.node for r in df.withColumn("node", urls.node_of(urls.resolved(F.col("url"), F.col("ref")))).collect()}
    for page, ref in rows:
        whole = urlsplit(urljoin(page, ref))
        node = whole.netloc.lower() + whole.path + (f"?{whole.query}" if whole.query else "")
        assert got[page, ref] == node, (page, ref)


def test_links_that_count(spark):
    rows = [
        ('<link data-rel="canonical" href="/no">', []),
        ('<link rel="canonical" data-href="/no" href="/yes">', ["h.example/yes"]),
        ('<link rel="alternate canonical" href="/yes">', ["h.example/yes"]),
        ("<link rel='canonical nofollow' href='/yes'>", ["h.example/yes"]),
        ('<link rel="not-canonical" href="/no">', []),
        ("<link rel=canonical href=/yes?a=1&#38;b=2&amp;c=3>", ["h.example/yes?a=1&b=2&c=3"]),
        ('<base target="x"><base href="http://b.example/d/e"><link rel="canonical" href="f"><base href="/no">', ["b.example/d/f"]),
        ('<base href="/d/e/"><meta http-equiv="refresh" content="0; url=../f">', ["h.example/d/f"]),
        ('<meta data-http-equiv="refresh" content="0; url=/no">', []),
        ('<!-- <link rel="canonical" href="/no"> -->', []),
    ]
    for k, (html, expected) in enumerate(rows):
        df = spark.createDataFrame([(k, "http://h.example/a/b", html)], "page_id long, url string, html string")
        assert [r.dst for r in urls.alias_edges(df).collect()] == expected, html


def test_long_urls_and_repeated_links(spark):
    long = "http://h.example/" + "a/" * 50_000 + "end"
    links = '<link rel="canonical" href="http://b.com/de/1">' * 500
    df = spark.createDataFrame([(1, long, links), (1, long, links), (2, "http://x.net/" + "../" * 20_000, '<link rel="canonical" href="' + "../" * 5_000 + 'y">')], "page_id long, url string, html string")
    assert urls.alias_edges(df).count() == 2
    got = sorted((r.page_id, r.verdict) for r in urls.url_verdicts(df, RULES).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow")]


BODY = "<p>" + "A first paragraph that is long enough to be the text of a page, by itself. " * 3 + "</p><p>" + "A second one follows it and says some more of the same. " * 3 + "</p>"
PLAIN = "\n".join(" ".join(p.split()) for p in BODY.replace("</p>", "").split("<p>")[1:])
MENU = '<nav><a href="/">Home</a> <a href="/x">Other things</a></nav>'


@pytest.mark.parametrize(
    "html",
    [
        f'{MENU}<div class="container right-sidebar"><article>{BODY}</article></div>',
        f'{MENU}<div class="right-sidebar">{BODY}</div>',
        f'<form action="/page.aspx">{MENU}<div>{BODY}</div></form>',
        f'<form><div class="sidebar">{MENU}<main>{BODY}</main></div></form>',
        f'{MENU}<div><a name="top"><p></p>{BODY}</div>',
        f'{MENU}<div><h2><a href="#top">&nbsp;</h2>{BODY}</div>',
        f'{MENU}<div>{BODY}</div><div class="comments">{"<p>A reader says a great many words about all of this.</p>" * 40}</div>',
        f'{MENU}<div>{BODY}</div><aside>{"<p>See also some other page of ours.</p>" * 5}</aside>',
    ],
)
def test_no_body_is_lost_to_the_name_of_a_wrapper(html):
    assert lineblock.main_text(html) == PLAIN


def test_headers_inside_the_article_stay():
    for name in ("article-header", "post-header", "header"):
        page = f'{MENU}<article><div class="{name}"><h1>A title</h1></div>{BODY}</article><div class="{name}">Site</div>'
        assert lineblock.main_text(page) == "A title\n" + PLAIN


def test_given_pages_without_their_article_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"(?i)</?(?:article|main)\b[^>]*>", ""))
    want = {r.page_id: r.text for r in lineblock.extract(pages).collect()}
    got = {r.page_id: r.text for r in lineblock.extract(bare).collect()}
    assert all(got.values()) and sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_a_very_long_page():
    html = f"<article>{BODY * 3000}</article>"
    assert lineblock.main_text(html) == "\n".join([PLAIN] * 3000)
