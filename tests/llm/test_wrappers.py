import html
import json
import random
import re

from tracelink.llm import wrappers as w


def shape(page):
    return w.fold(w.tree(page)[0])


def test_repetitions_and_options():
    a = shape("<ul><li>1<li>2<li>3</ul><p>x</p>")
    assert a == [["e", "ul", [["+", [["e", "li", [["t"]]]]]]], ["e", "p", [["t"]]]]
    b = shape("<ul><li>1</ul><h2>new</h2><p>x</p><p>y</p>")
    got = w.align(a, b)
    assert got == [["e", "ul", [["+", [["e", "li", [["t"]]]]]]], ["?", [["e", "h2", [["t"]]]]], ["+", [["e", "p", [["t"]]]]]]
    assert w.align(got, shape("<ul></ul>")) == [["e", "ul", [["?", [["+", [["e", "li", [["t"]]]]]]]]], ["?", [["e", "h2", [["t"]]]]], ["?", [["+", [["e", "p", [["t"]]]]]]]]
    pairs = shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert pairs == [["e", "dl", [["+", [["e", "dt", [["t"]]], ["e", "dd", [["t"]]]]]]]]
    assert w.align(pairs, shape("<dl><dt>a<dd>b</dl>")) == pairs


def test_text_of_blocks():
    for page, want in [
        ("<article><p>a<b>b</b> c\n\n d&amp;e &lt;p&gt;&#233;</p>tail<br>end</article>", "ab c d&e <p>é\ntail end"),
        ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<nav>menu</nav><main><h1>T</h1><aside>s</aside><p>x</p><div class='comments'>c</div></main><p>out</p>", "T\nx"),
        ("<div id=cookie-notice>c</div><div class=\"has-sidebar\">kept</div><span class='ad'>ad</span>", "kept"),
        ("<script>var a='<p>';</script><style>p{}</style><!-- x > y --><p title='a>b'>t", "t"),
        ("plain < text & more", "plain < text & more"),
        ("<article><p>Main</p></article><article class='comment'><p>Reader</p></article>", "Main"),
        ("<main><article class=story><p>Main</p></article><ul><li><article class='comment-body'>Reader</article></ul><article class='teaser-box'><p>Next</p></article></main>", "Main"),
        ("<article><p>a</p><section class='related-work'><p>b</p></section><div id='social-studies'>c</div><div class='related-posts'>d</div><div class='share-buttons'>e</div></article>", "a\nb\nc"),
        ("<p>A <span class='ad'>BUY <b>now</b></span> b</p><p>c <i class='ad-slot'>x</p><p>d</p>", "A b\nc\nd"),
        ("<p>a<!--> b</p><p>c<!---> d</p><!-- x --!><p>e</p><!-- open", "a b\nc d\ne"),
        ("", ""), (None, ""), ("<p></p>  ", ""), ("</p></div>x</article>", "x"), ("<p>a<ul><li>b</ul>c", "a\nb\nc"), ("<p>a</p\n>b<p", "a\nb"),
        ("<article><p>" + "long " * 60_000 + "</p></article>", ("long " * 60_000).strip()),
    ]:
        assert w.main_text(page, None) == want


def test_wrapper_accepts_its_pages():
    rng = random.Random(4)
    parts = ["<p>t</p>", "<h2>t</h2>", "<ul>%s</ul>", "<div>%s</div>", "<dl><dt>a<dd>b</dl>", "t", "<div class=x>%s</div>", "<table><tr><td>1<td>2<tr><td>3</table>"]

    def page(depth=0):
        return "".join((p.replace("%s", page(depth + 1)) if depth < 3 else p.replace("%s", "t")) for p in rng.choices(parts, k=rng.randrange(0, 5)))

    for _ in range(150):
        pages = [page() for _ in range(rng.randrange(1, 7))]
        own = w.infer(map(shape, pages))
        for p in pages:
            items, texts = w.tree(p)
            if w.walk(w.labelled(own), items, found := []):
                assert [i for i, _ in found] == list(range(len(texts)))
            assert w.main_text(p, own).split("\n") == (texts or [""])


def test_random_markup_never_fails():
    rng = random.Random(9)
    bits = ["<", ">", "</", "<p", "<div class='", '"', "'", "<!--", "-->", "<script>", "</script>", "&", "&amp;", "x", " ", "<li>", "</ul>", "<br/>", "<a href=\"", "\x00", "<!x"]
    own = w.infer([shape("<div><p>a</p></div>")])
    for _ in range(500):
        w.main_text("".join(rng.choices(bits, k=rng.randrange(0, 60))), own)


def plain(page):
    """Main text of the test pages by their one article element."""
    body = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", page, re.S).group(1), flags=re.S)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = w.op9_wrappers(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_table(spark):
    rows = [(1, "http://A.example/x", "<nav>m</nav><p>one</p>"), (2, "https://u@a.example:80/y", "<nav>m</nav><p>one</p><p>two</p>"), (3, None, None), (None, "no host", ""), (1, "http://a.example/x", "<nav>m</nav><p>one</p>"), (5, "http://b.example", "<article><p>only</p></article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    want = sorted([("1", "one"), ("2", "one\ntwo"), ("3", ""), ("None", ""), ("1", "one"), ("5", "only")])
    for size in (8 << 20, 0):
        assert sorted((str(r.page_id), r.text) for r in w.extract(df, broadcast_bytes=size).collect()) == want
    hosts = {r.host: json.loads(r.wrapper) for r in w.wrappers(w.structures(df.select("url", "html"))).collect()}
    assert set(hosts) == {"a.example", "b.example", ""} and hosts["a.example"][1] == ["+", [["e", "p", [["t"]]]]]
    assert w.extract(df.limit(0)).count() == 0


def test_two_templates_on_one_host(spark):
    """Whether only article slots count is the page's own matter."""
    kinds = [("<nav>m</nav><article><p>in {}</p></article><p>out</p>", "in {}"), ("<nav>m</nav><div class=content><p>text {}</p></div>", "text {}")]
    rows = [(10 * u + 2 * i + k, url, page.format(i), want.format(i)) for u, url in enumerate(["http://mixed.example/x", None, "no-host"]) for i in range(3) for k, (page, want) in enumerate(kinds)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in w.extract(df).collect()} == {i: want for i, _, _, want in rows}


def test_constant_strings_are_template(spark):
    """Neutral names all over: only the wrapper can tell the motto, the rights line and the links from the text."""
    page = "<div class=a1><p>All the news of the valley</p></div><div class=a2><ul><li>Start<li>About us</ul></div><div class=b><h2>{0}</h2><p>Body of {0}.</p>{1}</div><div class=z>All rights reserved 2024</div>"
    rows = [(i, "http://neutral.example/x", page.format(f"story {i}", "<p>more</p>" * (i % 3))) for i in range(6)]
    rows += [(10 + i, "http://copies.example/x", page.format("one story", "")) for i in range(8)]  # nothing to compare with
    rows += [(20 + i, "http://marked.example/x", f"<p>motto</p><article><p>Dear reader</p><p>text {i}</p></article>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.extract(df).collect()}
    for i in range(6):
        assert got[i] == "\n".join([f"story {i}", f"Body of story {i}."] + ["more"] * (i % 3))
        assert got[20 + i] == f"Dear reader\ntext {i}"  # marked text stays, constant or not
        alone = w.main_text(rows[i][2], None).split("\n")
        assert alone[0] == "All the news of the valley" and alone[-1] == "All rights reserved 2024"
    assert all(got[10 + i] == w.main_text(rows[6][2], None) for i in range(8))


def test_deep_pages():
    deep = "<div>" * 5000 + "text<nav>menu</nav><p>more" + "</div>" * 5000 + "<p>end"
    assert w.main_text(deep, None) == "text\nmore\nend"
    own = w.infer([shape(deep), shape("<div><p>x</p></div>")])
    assert w.main_text(deep, own) == "text\nmore\nend"
    assert w.main_text("<nav>" * 3000 + "a" + "</nav>" * 3000 + "b", None) == "b"
    assert w.main_text("x" + "<div><article>" * 2000 + "a" + "</article></div>" * 2000 + "b", None) == "a"
    assert w.main_text("<p>" + "<b>" * 5000 + "c", None) == "c"


def test_wide_pages_and_many_structures(spark):
    """Thousands of siblings of other names are aligned in time that grows with their number; a host's structures in a tree."""
    import time

    a, b = (shape("".join(f"<div class='{x}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>t</div>" for i in range(8000))) for x in "pq")
    began = time.time()
    own = w.align(a, b)
    assert time.time() - began < 5 and len(own) == 16_000
    pages = [f"<div><p>{{}}</p>{''.join(f'<h{1 + (i >> k & 1)}>x</h{1 + (i >> k & 1)}>' for k in range(6))}</div>" for i in range(64)]
    df = spark.createDataFrame([(i, "http://many.example/x", p.format(f"text {i}")) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = w.wrappers(w.structures(df.select("url", "html")), each=4).collect()
    assert len(got) == 1
    marked = w.labelled(json.loads(got[0].wrapper))
    assert all(w.walk(marked, w.tree(p)[0], []) for p in pages)


def test_keys_are_equal_where_items_are_alike():
    items = [["t"], ["e", "p", [["t"]]], ["e", "q", []], ["?", [["e", "p", []]]], ["+", [["e", "p", []]]], ["?", [["+", [["e", "q", []]]]]], ["+", [["e", "p", []], ["t"]]], ["+", [["e", "p", []], ["e", "q", []]]], ["?", [["t"]]]]
    for x in items:
        for y in items:
            assert w.alike(x, y) == (w.key_of(x) is not None and w.key_of(x) == w.key_of(y))
