import collections
import random
import time

import pytest

from ledgerloom.llm import html_text
from ledgerloom.llm.html_text import main_texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><header>Site</header><div class="ad">buy</div>
<article><h1>Head&amp;line %d</h1><p>%d One <b>bo</b>ld&nbsp;word<br>next<p>%d Two
 lines &lt;x&gt;<div class="promo-box">promo</div><div>Follow the site</div><ul><li>a<li>b %d</ul>
<div class="comments"><p>reader</p></div><form>f</form></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_article_without_template(spark):
    rows = [(i, f"https://h{i % 2}.example.org/{i}", PAGE % (i, i, i, i)) for i in range(12)]
    rows += [(100, "https://lone.example.org/", PAGE % (1, 1, 1, 1)), (101, None, None), (102, "", ""), (103, "x", "plain &amp; text"), (104, "https://a.example.org", "<div>" * 5000 + "deep"), (None, "https://b.example.org", "<p>x<!-- c -->y<p>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as host", "1 as text").repartition(3)
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert all(got[i] == f"Head&line {i} {i} One bold word next {i} Two lines <x> b {i}" for i in range(12))
    assert got[100] == "Head&line 1 1 One bold word next 1 Two lines <x> Follow the site a b 1"
    assert (got[101], got[102], got[103], got[104], got[None]) == ("", "", "plain & text", "deep", "xy z")
    assert all(r.n_chars == len(r.text) for r in main_texts(df).collect())
    assert main_texts(df.limit(0)).count() == 0


def test_copies_of_an_article_are_not_its_template(spark):
    page = "<body><article><h1>Title %s</h1><p>All of the news %s</p><ul><li>point %s</li></ul><div>Follow this site for more</div></article></body>"
    rows = [(i, f"https://h.example.org/?v={i}", page % (("x",) * 3)) for i in range(20)]
    rows += [(20 + i, f"https://h.example.org/{i}", page % ((i,) * 3)) for i in range(6)]
    rows += [(100 + i, None, page % (("y",) * 3)) for i in range(8)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == "Title x All of the news x point x" for i in range(20))
    assert all(got[20 + i] == f"Title {i} All of the news {i} point {i}" for i in range(6))
    assert all(got[100 + i] == "Title y All of the news y point y Follow this site for more" for i in range(8))


def test_template_of_one_section_of_a_large_host(spark):
    section = "<div>You are reading the sports pages</div><table><tr><td>1</td></tr></table>"
    rows = [(i, f"https://h.example.org/{i}", f"<article><p>story {i}</p>{section if i < 30 else ''}</article>") for i in range(200)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"story {i} 1" if i < 30 else f"story {i}") for i in range(200))


@pytest.mark.parametrize("html,text", [("a<![ if x]>text", "atext"), ("a<![foo[ x", "a"), ("a<!-- x", "a"), ("<!-->a", "a"), ("<!--->a", "a"), ("a<!x y>b", "ab"), ("a<? php ?>b", "ab"), ("a<?", "a"), ("a<!", "a"), ("a<", "a<"), ("a<b", "a"), ("<p", ""), ("&#xD800;x&#0;&nosuch;", "\ufffdx\ufffd&nosuch;"), ("</p></div>a<p></b>b", "a b"), ("<script>a<!-- </script>b", "b"), ("<table><tr><td>a<td>b</table>", "a b"), ("<p class='share-price'>a</p><p class='hidden-figures'>b</p><p class='left-side'>c</p><p class='ad-box'>d</p>", "a b c"), ("\x00a\x0cb", "\x00a b")])
def test_broken_markup(html, text):
    trees = html_text._article(html_text._parse(html))
    assert " ".join(trees[1].split()) == text


def test_counting_decides(spark):
    menu = "<div><a>Home</a> <a>News</a> of the day and more of it</div>"
    rows = [(i, f"https://h.example.org/{i}", f"<body>{menu}<p>story {i}</p><nav>menu {i % 2}</nav></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert all((r.text, r.n_template) == (f"story {r.page_id}", 2) for r in main_texts(df).collect())
    old = html_text.BROADCAST_TREES, html_text.LEAST_PAGES
    try:
        html_text.BROADCAST_TREES = 0
        assert all((r.text, r.n_template) == (f"story {r.page_id}", 2) for r in main_texts(df).collect())
        html_text.BROADCAST_TREES, html_text.LEAST_PAGES = old[0], 10**9
        assert all(r.text == f"Home News of the day and more of it story {r.page_id}" for r in main_texts(df).collect())
    finally:
        html_text.BROADCAST_TREES, html_text.LEAST_PAGES = old


def test_counts_by_brute_force(spark):
    """n_template of the standard pages: subtrees counted in plain Python over the articles of each host."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    parsed = {r.page_id: (html_text._host(r.url), html_text._article(html_text._parse(r.html))) for r in pages}
    articles, seen = collections.defaultdict(set), collections.defaultdict(set)
    for host, (article, _, trees, _, _, others) in parsed.values():
        articles[host].add(article)
        for t in {*trees, *others}:
            seen[host, t].add(article)
    want, total = {}, collections.Counter()
    for (_, t), a in seen.items():
        total[t] += len(a)
    for page, (host, (_, _, trees, _, _, others)) in parsed.items():
        n = [(len(seen[host, t]), t & 1, total[t]) for t in {*trees, *others}]
        want[page] = sum(k >= 5 and (2 * k >= len(articles[host]) or k >= 20 and long == 1 and 2 * k >= every) for k, long, every in n)
    got = {r.page_id: r.n_template for r in main_texts(spark.createDataFrame(pages)).collect()}
    assert got == want and sum(want.values()) > 0


def test_texts_by_construction(spark):
    """Pages put together from parts whose part is known: no telling names, so only counting can part them.

    A passage that pages of many hosts share stays everywhere, a block of one host's pages goes there.
    """
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "ba ce di fo gu la me no".split() for b in "lor mit nes pur tal".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "a passage that very many of the pages share"
    rows, want = [], {}
    for host in range(12):
        own = f"<div><a>Start {host}</a> <a>Themen {host}</a> and whatever this site says on all of its pages</div>"
        some = f"<section>Part {host} of the site has a box of its own here</section>"
        foot = f"<div>Imprint of site {host} <b>terms</b></div>"
        for k in range(60 if host else 200):
            parts = [prose(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 5))]
            parts += [shared] if rng.random() < 0.25 else []
            box = some if k % 3 == 0 else ""
            page = len(rows)
            rows.append((page, f"https://s{host}.example.org/{k}", f"<body>{own}<article><h2>t{page}</h2>{''.join(f'<p>{p}</p>' for p in parts)}{box}</article>{foot}</body>"))
            want[page] = " ".join([f"t{page}", *parts])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert got == want
    bare = [(i, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, h in rows]
    assert {r.page_id: r.text for r in main_texts(spark.createDataFrame(bare, "page_id long, url string, html string").repartition(4)).collect()} == want


def test_long_and_broken_pages_take_linear_time(spark):
    n = 60_000
    pages = ["<p>kept</p>" + "<a " * 350_000, "<p>kept</p>" + "<a x='" * 100_000, "kept" + "<a x='" * n + ">", "<i><div>" + "<b>" * n + "</i>" * n + "kept", "<p><b>" * n + "kept", "<!--" * n + "-->kept", "</" * n + ">kept", "<p>" + "kept " * 300_000]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "cast(null as string) as url", "html", "1 as raw", "'x' as trees")
    began = time.time()
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert time.time() - began < 60
    assert [got[k] for k in (0, 1, 3, 4, 5)] == ["kept"] * 5 and got[7] == " ".join(["kept"] * 300_000)
    began = time.time()
    html_text._article(html_text._parse("<a " * 350_000))
    assert time.time() - began < 2
