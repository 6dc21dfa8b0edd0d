import itertools
import random
import time

import pytest

from shopgrain.llm import main_text as op

PAGE = (
    "<html><head><title>No</title><style>p{}</style></head><body><div id=header><a href=/>Home</a></div>"
    "<div class='cookie-notice'>We use cookies on this site, please accept.</div><div class=post><h1>A title</h1>"
    "<p>First &lt;b&gt; paragraph &amp; <b>more</b>\n  text here today.<br>Next line.</p><p>Short</p>"
    "<script>var a = '<p>x</p>';</script><ul><li>item one of the list</ul></div>"
    "<div class=sidebar><p>Side text that is long enough to look real.</p></div>"
    "<section id=comments><p>I liked this article a lot, thank you.</p></section><form><p>Sign up now.</p></form>"
    "<footer>(c) X"
)


def test_main_text_of_a_page():
    assert op.main_text(PAGE) == "A title\nFirst <b> paragraph & more text here today. Next line.\nShort\nitem one of the list"


@pytest.mark.parametrize("page", [None, "", "<p>", "<script>x", "<nav><a href=x>Menu</a></nav>", "</div></p>", "<<>><!-->"])
def test_pages_without_text(page):
    assert op.main_text(page) in ("", "<>") or page == "<<>><!-->"


def test_broken_and_deep_markup():
    assert op.main_text("only plain text, no markup.") == "only plain text, no markup."
    assert op.main_text("<article><p>one is here.<p>two is here.<div>three</article>") == "one is here.\ntwo is here.\nthree"
    deep = "This text lies deep inside the page, but it is text."
    assert op.main_text("<div>" * 3000 + deep) == deep


@pytest.mark.parametrize("page", [
    "<html><head><title>No</title><body><p>{}</html>", "<html><head><meta charset=x><link rel=y><title>No</title><p>{}</p>",
    "<head><script>var a = '<p>x';</script>\n{}", "<head><style>p{{}}</style><noscript><p>No scripts here.</p></noscript><body>{}",
    "<head><noscript><img src=x><body><p>{}", "<head><body><option>A<option>B<p>{}", "<body><select><option>A</select><p>{}",
    "<head><object><param></object></head><body><p>{}", "<head><title>No</title></head><body><p>{}",
])
def test_end_tags_left_out(page):
    body = "This text stands in the body of the page, and all of it is kept."
    assert op.main_text(page.format(body)) == body
    assert op.main_text("<head><title>A title that is no text.</title>\n <script>x</script>") == ""


def test_cut_is_minimal():
    """Against every labelling of small random graphs."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        ties = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i) if rng.random() < 0.5}
        graph = [{} for _ in range(n + 2)]
        for i, c in enumerate(costs):
            a, b = (n, i) if c > 0 else (i, n + 1)
            graph[a][b], graph[b][a] = abs(c), 0.0
        for (i, j), w in ties.items():
            graph[i][j] = graph[j][i] = w
        reached = op.max_flow(graph, n, n + 1)

        def total(label, costs=costs, ties=ties):
            cut = sum(abs(c) for c, good in zip(costs, label, strict=True) if (c > 0) != good)
            return cut + sum(w for (i, j), w in ties.items() if label[i] != label[j])

        best = min(map(total, itertools.product([True, False], repeat=n)))
        assert total([reached[i] >= 0 for i in range(n)]) == pytest.approx(best)


def test_frame_keeps_other_columns(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "long text. " * 50_000), (4, "u", PAGE), (4, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS part", "8 AS __page__", "9 AS text")
    out = op.extracted(pages)
    assert out.columns == ["page_id", "url", "part", "__page__", "text", "n_chars"]
    got = sorted([(r.page_id, r.text, r.n_chars, r.part) for r in out.collect()], key=str)
    assert got == sorted([(r[0], op.main_text(r[2]), len(op.main_text(r[2])), 7) for r in rows], key=str)
    assert out.filter("text IS NULL").count() == 0


def test_empty_table(spark):
    assert op.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TEXT = [
    f"This is paragraph number {i}, and it has quite some words in it. " + "It goes on and on with plain sentences, as texts do. " * 5
    for i in range(3)
]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>"
WANT = "\n".join(t.strip() for t in TEXT)


@pytest.mark.parametrize("page", [
    '<article class="post type-post tag-politics">{}</article>', '<div class="content with-sidebar">{}</div>',
    '<div id="wrap" class="no-sidebar">{}</div>', "<form action=x><input type=hidden><input type=submit>{}</form>",
    '<article><section id="discussion">{}</section></article>', '<section id="search-methods">{}</section>',
    '<section id="social-effects">{}</section>', '<div class="content-sidebar-wrap">{}</div>',
    '<article>{}</article><section id=comments><h3>Comments</h3><p>I liked this a lot, thank you. It was long.</p></section>',
    '<main><article>{}</article><div class="comment-list"><p>I liked this a lot, thank you. It was long.</p></div></main>',
    '<article>{}</article><div class="post-comments"><p>I liked this a lot, thank you. It was long.</p></div>',
    '<article>{}<span class="advert">Buy our shoes now!</span><span hidden>not shown</span></article>',
    '<article>{}<p style="display: none">This is not shown to anybody who reads the page, ever.</p></article>',
])
@pytest.mark.parametrize("before", ["", NAV])
def test_names_do_not_decide_over_the_text(page, before):
    assert op.main_text(f"<html><body>{before}{page.format(BODY)}<footer>(c) X</footer>") == WANT


def test_headings_and_heads_of_articles_stay():
    page = f'<div class="entry-header"><h1>A title of words</h1></div><h2 id="search-methods">Search methods</h2>{BODY}'
    assert op.main_text(page) == "A title of words\nSearch methods\n" + WANT


@pytest.mark.parametrize("name, bad", [
    ("comments", True), ("comment-list", True), ("site-header", True), ("cookie-banner", True), ("ad-slot", True), ("ad2", True),
    ("related-posts", True), ("post-comments", True), ("sidebar", True), ("tag-politics", False), ("with-sidebar", False),
    ("entry-header", False), ("shadow", False), ("header-image-credit", False), ("adwords", False), ("", False), ("42", False),
])
def test_names_of_boilerplate(name, bad):
    assert op.marks_boilerplate(name) == bad


@pytest.mark.parametrize("odd", [
    "<![foo[ x ]]>", "<![CDATA[ x > y ]]>", "<![if !IE]>", "<![endif]-->", "<!foo>", "<!>", "<![", "<?xml x?>", "<!-->", "<!--->",
    "<!-- x -- y --!>", "<!ELEMENT a>", "<![temp[", "</>", "<!ATTLIST x>",
])
def test_odd_markup_is_passed_over(odd):
    one, two = "One long sentence stands here, as it should.", "Two long sentences stand here, as they should."
    assert op.main_text(f"<p>{one}</p>{odd}<p>{two}") == f"{one}\n{two}"


@pytest.mark.parametrize("reference, char", [
    ("&#" + "9" * 5000 + ";", "�"), ("&#000000000065;", "A"), ("&#x" + "f" * 5000 + ";", "�"), ("&#X0000000041;", "A"),
    ("&#00000000;", "�"), ("&amp;#65;", "&#65;"),
])
def test_long_references(reference, char):
    assert op.main_text(f"<p>A sentence of words, {reference} and more of them.") == f"A sentence of words, {char} and more of them."


@pytest.mark.parametrize("page", [
    "<span>" * 30_000 + "</i>" * 30_000, "<i><div>" + "<span>" * 30_000 + "</i>" * 30_000, "<div>" * 30_000 + "</div>" * 30_000,
    "<!--" * 30_000, "<![" * 30_000, "<a x='" * 20_000, "</a" * 30_000, "<?" * 30_000, "<select>" + "<option>x" * 30_000,
    "<table><tr><td>" * 10_000 + "x", "<span hidden>" * 30_000 + "x", "<div><p>Some words are here, and more.</p></div>" * 10_000,
])
def test_time_grows_with_the_page(page):
    start = time.monotonic()
    op.main_text(page)
    assert time.monotonic() - start < 10


def test_labels_of_whole_small_pages_against_all_labellings():
    """Costs, ties and cut of pages of few blocks, each tried in every labelling."""
    rng = random.Random(5)
    parts = [
        "<p>Some words of a text, which goes on here.</p>", "<p><a href=x>Link</a></p>", "<div class=ad><p>Buy it now, or be sad.</p></div>",
        "<article><p>One sentence is here, with a few words.</p></article>", "<li>item", "<h2>Heading</h2>", "<p>Short.</p>",
        "<div><p>Deep <b>text</b> in a part of its own, of many words and more.</p></div>",
    ]
    for _ in range(60):
        parser = op.Blocks()
        parser.feed("".join(rng.choice(parts) for _ in range(rng.randint(1, 7))))
        parser.close()
        blocks = parser.blocks()
        ties, last = [], {}
        for i, b in enumerate(blocks):
            if i:
                ties.append((i - 1, i, op.ADJACENT * 0.5 ** ((b.depth + blocks[i - 1].depth - 2 * b.common) / 2)))
            if b.parent in last:
                ties.append((last[b.parent], i, op.SIBLING))
            last[b.parent] = i

        def loss(labels, blocks=blocks, ties=ties):
            own = sum(max(c, 0) if not good else max(-c, 0) for c, good in zip(map(op.block_cost, blocks), labels, strict=True))
            return own + sum(w for a, b, w in ties if labels[a] != labels[b])

        best = min(loss(x) for x in itertools.product((False, True), repeat=len(blocks)))
        assert loss(op.content(blocks)) == pytest.approx(best)


def test_rows_of_pages(spark):
    rows = [(1, "u", BODY, 7), (1, "u", BODY, 7), (None, None, None, 8), (2, "v", "", 9), (3, "w", "<p>" + "Words of a text, and more. " * 40_000, 1)]
    got = op.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, `odd.name` int")).collect()
    assert [(r["page_id"], r["odd.name"], r["n_chars"]) for r in got[:4]] == [(1, 7, len(WANT)), (1, 7, len(WANT)), (None, 8, 0), (2, 9, 0)]
    assert got[4]["n_chars"] == 27 * 40_000 - 1
    clash = op.extracted(spark.createDataFrame([(1, "x", BODY, 5)], "page_id int, text string, html string, n_chars int")).first()
    assert clash["text"] == WANT and clash["n_chars"] == len(WANT)
    assert op.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0
