import random

import pytest

from pivotspark.llm import html_extract as H

PAGES = "page_id long, url string, html string, host string, seed string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(rows)], PAGES)


def texts(spark, rows):
    return {r.page_id: r for r in H.extract(frame(spark, rows)).collect()}


def blocks(html):
    dom = H.parse(html)
    tree, owners = H.fold(dom)
    return H.content(dom, owners, [-1] * len(tree), set())


@pytest.mark.parametrize("html, want", [
    ("<p>a &amp; b&nbsp;\n c<p><b>d</b>e<br>f", ["a & b c", "de f"]),
    ("<nav>n</nav><header>h</header><main><header><h1>t</h1></header><p>x</p><aside>s</aside></main><footer>f</footer>", ["t", "x"]),
    ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><div class='ad'>a</div><p>x</p><form>f</form>", ["x"]),
    ("<article><p>x</p><section id='comments'><p>first!</p></section></article><p>out</p>", ["x"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
    ("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes", ["yes"]),
    ("<p>a < b</p>< p>c<!x><?y>", ["a < b", "< p>c"]), ("plain", ["plain"]), ("", []), (None, []),
    ("<p>cut <a href=\"x", ["cut"]), ("<p>cut<!-- open", ["cut"]), ("</p></div>x</span>", ["x"]), ("<title>t</title>x", ["x"]),
    ("<div>a<p>b</p>c</div>", ["a", "b", "c"]), ("<p>a<script>x()</script>b <button>y</button>c<aside>d</aside>e", ["ab c", "e"]),
    ("<DIV CLASS='Menu'>m</DIV><P>x</P>", ["x"]),
    ("<div id='site-header'>h</div><div class='article-header'><h1>t</h1></div><p style='display: none'>n</p><p>x</p>", ["t", "x"]),
    ("<div class='content-sidebar-wrap'><main><p>x</p></main><div class='sidebar'>s</div></div>", ["x"]),
    ("<div class='layout has-sidebar'><article><p>x</p></article></div><div class='sidebar'>s</div>", ["x"]),
    ("<div class='layout has-sidebar'><p>a text without any article</p></div><div class='menu'>m</div>", ["a text without any article"]),
    ("<article><p>x</p><footer>f</footer></article>", ["x"]), ("<article><p>x</p><div class='comments'>%s</div></article>" % ("c " * 50), ["x"]),
    ("<article><p>the whole story is here</p></article><div class='related'><article>more</article></div>", ["the whole story is here"]),
    ("<article>tip</article><p>a long text that no article holds, whatever the page says</p>",
     ["tip", "a long text that no article holds, whatever the page says"]),
    ("<p>x and y and z</p><div class='comments'>a long comment of a reader who has time</div>", ["x and y and z"]),
    ("<body class='sidebar-left'><article class='widget'><div class='header'>t</div><div class='user-comments'>c</div>x", ["t", "x"]), ("<p hidden>h</p><p>x&#x41;&#66;", ["xAB"])])
def test_blocks(html, want):
    assert blocks(html) == want


def test_odd_markup_never_fails():
    rng = random.Random(3)
    parts = ["<p>", "</p>", '<div class="ad">', "<div>", "</div>", "<li>", "<ul>", "t", "<![foo[", "<!DOCTYPE [", "<!--", "-->",
             "<![CDATA[", "<script>", "</script>", "&amp;", "&#x41;", '<a href="x', '">', "<article>", "</article>", "<br>", "</br>",
             "<?php", "?>", "<", ">", "<!", "</", "<td>", "<tr>", "<table>", "<textarea>", "<title>", "é", "\x00", "<svg/>"]
    for _ in range(4000):
        dom = H.parse("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
        tree, _ = H.fold(dom)
        dom.release()
        assert H.align(tree, tree) == list(range(len(tree)))


@pytest.mark.parametrize("html", ["<div>" * 30000 + "x", "<p>x" * 30000, "<b>" * 30000 + "<p>x</p>" * 2000, "<li>x" * 30000, "<" * 90000,
                                  "<!--" * 40000, "<a " * 40000, '<a =">' * 40000, "&" * 90000,
                                  "".join(f'<div class="c{i}">x</div>' for i in range(10000))], ids=range(10))
def test_long_pages(html):
    tree, owners = H.fold(H.parse(html))
    assert len(H.align(tree, tree)) == len(tree)


def test_align_is_the_largest_matching():
    def brute(a, b, i=0, j=0):
        x, y = H._children(a)[i], H._children(b)[j]
        w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                same = brute(a, b, x[p], y[q]) if a[x[p]][0] == b[y[q]][0] else 0
                w[p + 1][q + 1] = max(w[p][q + 1], w[p + 1][q], w[p][q] + same)
        return 1 + w[-1][-1]

    rng = random.Random(6)
    for _ in range(300):
        trees = []
        for _ in range(2):
            html = "".join(rng.choice(["<div>", "<ul>", "<dl>", "<table>", "</div>", "</ul>", "</dl>", "</table>", "<p>t</p>"])
                           for _ in range(rng.randint(2, 24)))
            trees.append(H.fold(H.parse(html))[0])
        place = H.align(*trees)
        assert sum(x >= 0 for x in place) == brute(*trees)


def layout(i, body):
    return f"<div><b>Site name</b></div><div class=x><i>Read more on this site</i></div><div class=y>{body}</div><div class=z>(c) us</div>"


def test_template_of_a_host_goes(spark):
    rows = [(f"http://h.org/{i}", layout(i, f"<p>text {i}</p><p>Shared passage</p>" if i % 2 else f"<p>text {i}</p>")) for i in range(12)]
    rows += [(f"http://few.org/{i}", layout(i, f"<p>text {i}</p>")) for i in range(3)]
    rows += [("http://copies.org/", layout(0, "<p>copy</p>"))] * 20
    got = texts(spark, rows)
    assert [got[i].text for i in range(12)] == [f"text {i}\n\nShared passage" if i % 2 else f"text {i}" for i in range(12)]
    assert all(got[i].n_template_blocks == 3 for i in range(12))
    # Too few different pages say nothing, however often one is repeated.
    assert got[12].text == "Site name\n\nRead more on this site\n\ntext 0\n\n(c) us"
    assert all(got[i].text == "Site name\n\nRead more on this site\n\ncopy\n\n(c) us" for i in range(15, 35))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "<p>a</p>"), ("http://h.org/", None), ("bad", ""), ("http://h.org/", "<p>é😀</p>"), ("http://h.org/", "<p>é😀</p>")]
    got = texts(spark, rows)
    assert [(got[i].text, got[i].n_chars) for i in range(5)] == [("a", 1), ("", 0), ("", 0), ("é😀", 2), ("é😀", 2)]
    assert H.extract(frame(spark, rows).limit(0)).count() == 0


def test_template_of_a_host_of_few_pages_goes(spark):
    def page(host, body):
        return (f"<div><b>Site of {host}</b></div><div class=x><i>Home and away</i></div><div class=y>{body}</div>"
                f"<div class=z>(c) {host}</div>")

    def body(host, i):
        return f"<p>{' '.join(f'{host}{i}w{k}' for k in range(40))}</p>"

    rows = [(f"http://{h}.org/{i}", page(h, body(h, i))) for h, n in (("two", 2), ("three", 3), ("seven", 7), ("one", 1)) for i in range(n)]
    # Near copies: what they share is their content.
    rows += [(f"http://near.org/{i}", f"<div><p>{'the same long story ' * 20}</p><p>seen {i} times</p></div>") for i in range(3)]
    # An article's own words stay, whatever they share.
    rows += [(f"http://art.org/{i}", f"<div>top of art</div><article><p>A word before</p>{body('art', i)}</article>") for i in range(3)]
    got = texts(spark, rows)
    for at, (h, n) in zip((0, 2, 5), (("two", 2), ("three", 3), ("seven", 7))):
        for i in range(n):
            # "Home and away" is on other hosts too: no host's own block.
            assert got[at + i].text == "Home and away\n\n" + body(h, i)[3:-4], (h, i)
            assert got[at + i].n_template_blocks == 2
    assert got[12].text.startswith("Site of one") and got[12].n_template_blocks == 0
    assert all(got[13 + i].text == "the same long story " * 19 + f"the same long story\n\nseen {i} times" for i in range(3))
    assert all(got[16 + i].text.startswith("A word before\n\nart") for i in range(3))
