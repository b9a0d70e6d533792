import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cotejo.llm import trees, wrapper
from cotejo.llm.queries import ARTICLES_SQL, op10_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>"; if (1 < 2) b();</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies</div><header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="ad">Buy {0}</div>{1}<aside class="sidebar"><p>Side {0}</p></aside>
<section id="comments"><article class="comment"><p>I disagree, at great length, with all of this {0} and more of it still</p></article></section>
<form><p>Mail: <input name="q"></p><button>Go</button></form><footer>&copy; {0}</footer></body></html>"""


@pytest.mark.parametrize(
    "article, wanted",
    [
        ("<article><h1>A &amp; B</h1><p>One\n  <b>two</b> three<br>four</p></article>", "A & B\n\nOne two three four"),
        ("<article><p><b>open<p>next</article>", "open\n\nnext"),
        ("<article><header><h1>H</h1></header><p>x</p><div class='related'>More</div><p>y</p></article>", "H\n\nx\n\ny"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nb\n\n1 2\n\n3"),
        ("<main><p>only main</p><p hidden>not this</p></main>", "only main"),
        ("<div class='content'><p>a plain page</p><ul><li><a href='/x'>Link</a></li></ul></div>", "a plain page\n\nLink"),
        ("<article><p>a &lt;b&gt; &eacute;&#233; &am</p><!-- no --></article>", "a <b> éé &am"),
        ("<article></article>", ""),
    ],
)
def test_article(article, wanted):
    assert wrapper.main_text(PAGE.format("x", article)) == wanted


@pytest.mark.parametrize("source", ["", "<", "<<<", "</p></div>", "<p", "plain", "<script>x", "<!-- open", "<a href=\"x", "<article><p>cut of", "<" * 3000, "<p>" * 3000 + "deep"])
def test_odd_sources_do_not_fail(source):
    assert isinstance(wrapper.main_text(source), str)


def test_constants_of_a_host_go():
    r = random.Random(1)
    page = lambda: f"<body><div><p>Subscribe to our letter today</p></div><article><h1>{r.random()}</h1><p>{r.random()} text {r.random()}</p><blockquote>Read the rules first</blockquote></article></body>"
    pages = [page() for _ in range(6)]
    pattern = wrapper.template(pages)
    text = wrapper.main_text(page(), pattern)
    assert "Subscribe" not in text and text.count("\n\n") == 2 and text.endswith("Read the rules first")


def test_copies_of_an_article_are_no_template():
    body = "<body><nav>{}</nav><article><h1>Same title</h1><p>The same article everywhere, word for word.</p></article></body>"
    pattern = wrapper.template([body.format(i) for i in range(6)])
    assert wrapper.main_text(body.format("x"), pattern).startswith("Same title")


def test_constants_may_outweigh_the_article():
    page = lambda i: f"<body><section>{'Legal notice of the house. ' * 50}</section><div><p>Short text {i}</p></div></body>"
    pattern = wrapper.template([page(i) for i in range(6)])
    assert wrapper.main_text(page(7), pattern) == "Short text 7"


def test_constants_in_runs_of_siblings_go():
    page = lambda i: f"<body><div><p>Head {i}</p></div><div><p>article {i} <b>Text</b> of it</p><p>Subscribe to our letter</p><table><tr><td>{i}<td>Terms</table></div></body>"
    pattern = wrapper.template([page(i) for i in range(6)])
    assert wrapper.main_text(page(7), pattern) == "Head 7\n\narticle 7 Text of it\n\n7"


def test_hashes_of_texts_are_those_of_words():
    found = []
    for x in ("a b c", "a <b>b</b>\n c", "<i>a</i><b></b>b c", "a bc", "a b d"):
        tree, nodes = wrapper.shape(wrapper.parsed(f"<body><div>{x}</div></body>"))
        found.append(tree.texts[[n.tag for n in nodes].index("div")])
    assert len(set(found[:3])) == 1 and len(set(found)) == 3


def nested(r, depth=3):
    """A random tree as (kind, text, kids)."""
    return r.choice("ab"), r.choice("xyz"), [nested(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else []


def flat(node):
    parents, kinds, texts, todo = [], [], [], [(node, -1)]
    while todo:
        (kind, text, kids), parent = todo.pop()
        todo.extend((k, len(parents)) for k in reversed(kids))
        parents.append(parent)
        kinds.append(ord(kind))
        texts.append(ord(text))
    return trees.Tree(parents, kinds, texts, [True] * len(parents))


def best(a, b):
    """Simple tree matching as it is defined, without anything known before."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x, y))
    return m[-1][-1] + 1 + (a[1] == b[1])


def test_matching_is_as_large_as_can_be():
    r = random.Random(5)
    for _ in range(300):
        one, two = nested(r), nested(r)
        a, b = flat(one), flat(two)
        pairs = [(i, j) for i, j in enumerate(trees.Matching(a, b).pairs()) if j >= 0]
        assert sum(1 + (a.texts[i] == b.texts[j]) for i, j in pairs) == best(one, two)
        assert all(a.kinds[i] == b.kinds[j] for i, j in pairs) and len({j for _, j in pairs}) == len(pairs)
        partner = dict(pairs)
        assert all(i == 0 or partner[a.parents[i]] == b.parents[j] for i, j in pairs)
        assert all(j < partner[k] for i, j in pairs for k in partner if k > i and a.parents[k] == a.parents[i])
        again = trees.Tree.unpacked(a.packed())
        assert (again.same, again.size, again.free) == (a.same, a.size, a.free)


def test_long_lists_of_siblings_are_paired_by_equal_subtrees():
    a, b = (flat(("a", "x", [("b", chr(100 + (i * k) % 90), []) for i in range(400)])) for k in (1, 7))
    pairs = [(i, j) for i, j in enumerate(trees.Matching(a, b).pairs()) if j >= 0]
    assert len(pairs) > 40 and all(a.texts[i] == b.texts[j] for i, j in pairs)


def test_pairs_do_not_depend_on_the_length_of_lists(monkeypatch):
    """Long lists are paired as short ones are, whatever is below the siblings."""
    r = random.Random(8)
    for n in (101, 140):
        many = [("a", "x", [nested(r, 2) if k % 3 else (r.choice("ab"), chr(200 + r.randrange(900)), []) for k in range(n)]) for _ in range(2)]
        a, b = map(flat, many)
        found = trees.Matching(a, b, limited=False).pairs()
        with monkeypatch.context() as m:
            m.setattr(trees, "WIDE", n * n)
            assert found == trees.Matching(a, b, limited=False).pairs()
        pairs = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert sum(1 + (a.texts[i] == b.texts[j]) for i, j in pairs) == best(*many)
        assert trees.marks(a, [b]) == [[trees.mark(0, j, a.texts[i])] if j >= 0 else [] for i, j in enumerate(found)]


ARTICLES = {
    "two articles": ("<article><h1>One</h1><p>first {0}</p></article><div><p>between</p></div><article><p>second {0}</p></article>", "One\n\nfirst {0}\n\nsecond {0}"),
    "a by-line": ("<article><h1>T{0}</h1><p>By the staff of the paper</p><p>story {0}</p></article>", "T{0}\n\nBy the staff of the paper\n\nstory {0}"),
    "versions": ("<div><h1>Same title</h1><p>Same body of text.</p><p>v{0}</p></div>", "Same title\n\nSame body of text.\n\nv{0}"),
    "links": ("<div><p>Intro {0}</p><ul><li><a href='/a'>Further {0}</a></li><li><a href='/b'>Reading {0}</a></li></ul></div>", "Intro {0}\n\nFurther {0}\n\nReading {0}"),
    "formulas": ("<article><p>as <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> shows</p></article>", "as x={0} shows"),
    "teasers": ("<article><p>own {0}</p></article><div class='related'><article><p>other</p></article></div>", "own {0}"),
}


@pytest.mark.parametrize("name", ARTICLES)
def test_nothing_of_an_article_is_dropped(spark, name):
    page, wanted = ARTICLES[name]
    rows = [(i, f"http://h.org/{i}", f"<body>{page.format(i)}</body>") for i in range(8)]
    found = wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: wanted.format(i) for i in range(8)}


def test_pages_without_telling_names(spark):
    """Menus, notices and footers in plain containers around articles of any number of paragraphs, some with a box put in: only matching tells them."""
    r = random.Random(8)
    rows, wanted = [], {}
    for i in range(60):
        host = i % 3
        text = [f"Title {i}", *(" ".join(r.choice(["tree", "house", "river", "stone"]) + str(r.randrange(99)) for _ in range(9)) for _ in range(r.randint(1, 7)))]
        box = f"<div><p>Seen {i} times</p></div>" if i % 4 == 0 else ""
        menu = "".join(f"<div><a href='/{k}'>Part {k} of host {host}</a></div>" for k in range(6))
        body = "".join(f"<p>{p}</p>" for p in text)
        rows.append((i, f"http://h{host}.org/{i}", f"<body><div>{menu}</div>{box}<div><div>{body}</div></div><div><p>All rights are ours</p><p>Write to host {host}</p></div></body>"))
        wanted[i] = "\n\n".join(([f"Seen {i} times"] if box else []) + text)
    found = wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in found} == wanted
    assert all("Part 1" in wrapper.main_text(x[2]) for x in rows)


@pytest.mark.parametrize("big", ["<div><section>" * 3 + "notice " * 3000 + "</section></div>" * 3, "".join(f"<div>term {k}</div>" for k in range(9000))])
def test_large_templates_are_kept(big):
    page = lambda i: f"<body>{big}<p>Short text {i}</p></body>"
    pattern = wrapper.template([page(i) for i in range(6)])
    assert wrapper.main_text(page(7), pattern) == "Short text 7"


LAYOUTS = {
    "a": "<body><div class='one'><div><p>Terms of one</p></div><div><p>text {0}</p></div></div></body>",
    "b": "<body><div class='two'><section><p>text {0}</p><p>Terms of two</p></section></div></body>",
}


@pytest.mark.parametrize("bound", [8 << 20, -1])
def test_all_pages_count_and_each_layout_has_its_constants(spark, monkeypatch, bound):
    monkeypatch.setattr(wrapper, "BROADCAST", bound)
    rows = [(f"http://{h}/{i}", LAYOUTS["ab"[i % 2]].format(i)) for h in ("x.org", "y.org", "z.org") for i in range(20)]
    rows += [(f"http://few.org/{i}", LAYOUTS["a"].format(min(i, 2))) for i in range(9)] + [(f"http://two.org/{i}", LAYOUTS["a"].format(i % 2)) for i in range(9)]
    found = wrapper.extracted(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    for r in found:
        i = int(r.url.rsplit("/", 1)[1])
        assert r.text == ("Terms of one\n\n" * ("two.org" in r.url)) + f"text {min(i, 2) if 'few' in r.url else i % 2 if 'two' in r.url else i}"


def test_sections_of_the_article_stay():
    page = '<article><h1>T</h1><div class="related-work"><p>Section on related work</p></div><div class="login search"><p>How login works</p></div><div class="related share"><p>More</p></div><p>end</p></article>'
    assert wrapper.main_text(page) == "T\n\nSection on related work\n\nHow login works\n\nend"


def test_deep_and_wide_pages_take_linear_time():
    deep = "<div>" * 5000 + "<p>x y z</p>" + "</div>" * 5000
    articles = "<article>" * 3000 + "<p>x y z</p>" + "</article>" * 3000
    wide = "<body>" + "".join(f"<p>a {i}</p><div>c</div>" for i in range(5000)) + "</body>"
    began = time.monotonic()
    for source, n in ((deep, 1), (articles, 1), (wide, 10000)):
        page = wrapper.parsed(source)
        tree, nodes = wrapper.shape(page)
        other = wrapper.shape(wrapper.parsed(source.replace("x y", "q").replace("a 1", "b 1")))[0]
        assert len(nodes) > n and wrapper.layout(page) and sum(j >= 0 for j in trees.Matching(tree, other).pairs()) > n // 2
        assert len(wrapper.article(page, ()).split("\n\n")) == n
    assert time.monotonic() - began < 20


def test_templates_change_pages_of_a_table(spark):
    """Notices without telling markup, longer than the articles, on pages without an article element: only counting tells them."""
    notice = "<section><p>" + "All of this house's rules apply to you. " * 30 + "</p></section>"
    rows = [(i, f"http://h.org/{i}", f"<body>{notice}<div><p>Short text {i} of its own</p><p>Read our terms</p></div></body>") for i in range(40)]
    found = wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"Short text {i} of its own" for i in range(40)}
    alone = [wrapper.main_text(h) for _, _, h in rows]
    assert all("rules" in t and "terms" in t for t in alone)


def test_rows(spark):
    rows = [(1, "http://a.org/x", PAGE.format("q", "<article><p>é x</p></article>")), (2, None, None), (3, "no address", ""), (None, "http://A.org:80/y", "<p>z</p>"), (1, "http://a.org/x", PAGE.format("q", "<article><p>é x</p></article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = wrapper.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "z", 1), (1, "é x", 3), (1, "é x", 3), (2, "", 0), (3, "", 0)]
    assert wrapper.extracted(pages.limit(0)).count() == 0
    assert spark.range(1).select(wrapper.host(F.lit("https://U@WWW.a.org:8/x?y")).alias("h")).first().h == "www.a.org"


def test_same_without_broadcast(spark, small, monkeypatch):
    first = {r.page_id: r.text for r in op10_html(spark, small).collect()}
    monkeypatch.setattr(wrapper, "BROADCAST", -1)
    assert {r.page_id: r.text for r in op10_html(spark, small).collect()} == first


def test_query_equals_articles_cut_out_by_pattern(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op10_html(spark, small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_query_equals_sql(same):
    same(op10_html, ARTICLES_SQL)
