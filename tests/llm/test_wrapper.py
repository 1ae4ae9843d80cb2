import html
import random
import re

from framesieve.llm import dom, queries, wrapper
from framesieve.llm.wrapper import Tree


def slow_article(source):
    """The text of the article element of the given tables' pages, by plain cuts."""
    body = re.search(r"<article>(.*?)(</article>|<footer|$)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article|div|li|ul)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op10_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == slow_article(pages[r.page_id]) and r.n_chars == len(r.text)


#: No element or class says what is what: a menu, a fixed notice, the story with a fixed line inside, another link list.
PLAIN = """<!doctype html><html><head><title>x</title></head><body>
<div><a href=/>Home {i}</a> <a href=/b>News {i}</a></div>{menu}<div>Fixed words that stand on all pages of this host</div>
<div><h2>{title}</h2><div>{a}</div><p>{b}<p>Read more on our site</div>
<div>More: <a>item {i}</a> <a>item {k}</a></div></body>"""


def _page(i, menu=""):
    return PLAIN.format(title=f"Title &amp; {i}", a=f"First <b>part</b> {i} " * 9, b=f"Second part {i * 7}", i=i, k=3 * i, menu=menu)


def _want(i):
    return f"Title & {i} " + (f"First part {i} " * 9).strip() + f" Second part {i * 7}"


def _rows(spark, sources, host="http://plain.org/"):
    return spark.createDataFrame([(i, f"{host}{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")


def test_induction_without_marks(spark):
    got = {r.page_id: r.text for r in wrapper.main_text(_rows(spark, [_page(i) for i in range(5)])).collect()}
    assert got == {i: _want(i) for i in range(5)}
    # Without other pages to align with, the fixed words are no template: the wrapper is what takes them out.
    alone = wrapper.main_text(_rows(spark, [_page(1)])).first().text
    assert alone != _want(1) and "Read more on our site" in alone
    # Before any wrapper, all blocks are text.
    assert "Home 1" in " ".join(Tree.of(_page(1)).texts)


def test_many_blocks_before_the_article(spark):
    menu = "".join(f"<div><a>entry {k}</a></div>" for k in range(300))
    got = {r.page_id: r.text for r in wrapper.main_text(_rows(spark, [_page(i, menu) for i in range(4)])).collect()}
    assert got == {i: _want(i) for i in range(4)}


def test_layouts_of_one_host(spark):
    other = [f"<table><tr><td><a>x{i}</a><td><h1>Other {i}</h1><p>{'words of its own ' * 5}{i}</table>" for i in range(4)]
    got = {r.page_id: r.text for r in wrapper.main_text(_rows(spark, [_page(i) for i in range(4)] + other)).collect()}
    assert all(got[i] == _want(i) for i in range(4))
    assert all(got[4 + i] == f"Other {i} {'words of its own ' * 5}{i}" for i in range(4))


def test_marks_count_only_where_pages_are_few(spark):
    """Three different pages show what varies, whatever a class is called; of one page marked pieces are no text."""
    source = "<body><div>Fixed {w}</div><div class=promo><h2>Title {i}</h2><p>{a}</p><p>End {i}</p></div></body>"
    sources = [source.format(w="words", i=i, a=f"Told {i} " * 9) for i in range(4)]
    got = {r.page_id: r.text for r in wrapper.main_text(_rows(spark, sources)).collect()}
    assert got == {i: f"Title {i} " + (f"Told {i} " * 9).strip() + f" End {i}" for i in range(4)}
    small = source.replace("<div>Fixed {w}</div>", "<div>Fixed {w} " + "and many more of them " * 30 + "</div>")
    one = wrapper.main_text(_rows(spark, [small.format(w="words", i=1, a="Told 1 " * 9)])).first().text
    assert one.startswith("Fixed words") and "Told" not in one


def test_alignment_is_what_cuts(spark, sf):
    """Of the given pages every text is shorter than the page's pieces: without a wrapper none would be right."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert all(" ".join(Tree.of(r.html).texts) != slow_article(r.html) for r in pages)


def test_copies_are_no_template(spark):
    """Copies of one page say nothing about what is fixed; more or fewer paragraphs than the reference are content."""
    sources = [_page(1)] * 6 + [_page(2).replace("<p>Second", "<p>One more 2<p>Second"), _page(3), _page(4)]
    got = [r.text for r in wrapper.main_text(_rows(spark, sources)).orderBy("page_id").collect()]
    assert got[:6] == [_want(1)] * 6 and got[7:] == [_want(3), _want(4)]
    assert got[6] == _want(2).replace("Second", "One more 2 Second")


def slow_match(a, b, x=0, y=0):
    """Size of the largest matching by the definition."""

    def lists(left, right):
        if not left or not right:
            return 0
        best = max(lists(left[1:], right), lists(left, right[1:]))
        if a.labels[left[0]] == b.labels[right[0]]:
            best = max(best, slow_match(a, b, left[0], right[0]) + lists(left[1:], right[1:]))
        return best

    return 1 + lists(a.children[x], b.children[y])


def test_tree_match():
    rng = random.Random(5)

    def tree(depth=0):
        return "".join(f"<{t}>{tree(depth + 1) if depth < 2 else ''}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randint(0, 3)))

    for _ in range(150):
        a, b = Tree.of(tree()), Tree.of(tree())
        found = wrapper.tree_match(a, b)
        assert len(found) == slow_match(a, b) and len(set(found.values())) == len(found)
        for y, x in found.items():
            assert a.labels[x] == b.labels[y]
            assert not y or found[b.parents[y]] == a.parents[x]
        order = sorted(found)
        assert [found[y] for y in order] == sorted(found.values())
    deep = "<div>" * 3000 + "<p>x" + "</div>" * 3000
    assert len(wrapper.tree_match(Tree.of(deep), Tree.of(deep + "<p>y"))) == 3002


def test_parse():
    texts = _unmarked
    assert texts("<p>a <b>b</b>c<br>d<p>e&nbsp;&lt;p&gt; f") == ["a bc d", "e <p> f"]
    assert texts('<a title="x > y">k</a><script>var t="</p>";</script><!-- z -->q') == ["kq"]
    assert texts("<nav>n<ul><li>m</nav>k<form>f</form><div class='ad x'>g</div>") == ["k"]
    assert texts("<p>cut <a hr") == ["cut"]
    assert texts(f'<p title="{"> " * 50_000}">long attribute') == ["long attribute"]
    assert texts('<p class="social-proof">a</p><p id="related-work">b</p><p class="social">c') == ["a", "b", "c"]
    assert texts("<div>" * 5000 + "deep") == ["deep"]
    assert texts("") == [] and texts("no markup") == ["no markup"]
    assert Tree.of("<p>one <a>two</a> three").links == [3]
    for bad in ("<a " * 20000, '<a b="' * 20000, "</p>" * 20000, "<!--" * 20000, "<p>" * 20000, "&" * 50000):
        dom.parse(bad)


def _unmarked(source):
    tree = Tree.of(source)
    return tree.unmarked(tree.texts)


def test_marked_wrappers_keep_their_content():
    """An element around the article is no part to leave out, whatever its class says; real parts inside it are."""
    for tag in ('div class="layout sidebar"', 'div class="nav"', 'section id="comments"', 'form id="aspnetForm"'):
        name = tag.split()[0]
        for kind in ("article", "main"):
            page = f"<body><{tag}><nav>menu</nav><div class=sidebar>side</div><{kind}><p>The text</{kind}></{name}><footer>f</footer>"
            assert _unmarked(page) == ["The text"], (tag, kind)
        page = f"<body><{tag}><nav>menu</nav><div class=sidebar>side</div><div><p>{'The text ' * 9}</div></{name}>"
        assert _unmarked(page) == [("The text " * 9).strip()]
    page = "<article>own</article><div class=comments><article>a comment</article></div><aside><main>m</main></aside>"
    assert _unmarked(page) == ["own"]


def test_odd_rows(spark):
    rows = [(1, "http://a.b/", _page(1), "q"), (1, "http://a.b/", _page(1), "q"), (2, None, None, None)]
    rows += [(None, "::bad url::", "<article>no id</article>", "q"), (4, "", "", "q")]
    rows += [(10 + i, "http://H.org/x", _page(i), "q") for i in range(6)]
    rows += [(30, "http://long.org", "<p>" + "long text " * 100_000, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r.text for r in wrapper.main_text(pages).collect()}
    assert wrapper.main_text(pages).count() == len(rows)
    assert got[None, "::bad url::"] == "no id" and got[2, None] == "" and got[4, ""] == ""
    assert got[30, "http://long.org"] == ("long text " * 100_000).strip()
    assert all(got[10 + i, "http://H.org/x"] == _want(i) for i in range(6))
    assert wrapper.main_text(pages.limit(0)).collect() == []
