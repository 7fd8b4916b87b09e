import math
import random
import time

import pytest
from tidemark.llm import html_text
from tidemark.llm.html_text import main_text

LONG = "This paragraph is quite long and has more than enough words to count as text of the article."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a b"), ("<p>x<b>y</b>z<br>w</p>", "xyz w"), ("<div>" * 3000 + "deep", "deep"),
        ("<!-- <p>x</p> --><p>y", "y"), ("<script>if(a<b){x}</script><p>z 1 < 2 & 3 &eacute;&#x41;&nbsp;&amp;amp;", "z 1 < 2 & 3 éA &amp;"),
        ("<table><tr><td>one<td>two</table>", "one two"), ("<ul><li>one<li>two</ul>", "one two"), ("<p>a\n \t b</p>\n\n<p> c </p>", "a b c"),
        ("<title>t</title><style>p{}</style><article><h1>T</h1><p><b>T goes<br><p>on</article><footer>f</footer>", "T T goes on"),
        ("<article><header><h1>H</h1></header><p>Body</p><aside>no</aside><div class='share'>no</div><section id=comments>no</section></article>", "H Body"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"), ("<svg><text>no</text></svg><p>yes", "yes"), ("<script>never closed", ""), ("<p>a <![CDATA[b < c]]></p>", "a b < c"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_density_finds_unlabelled_main_text():
    menu = "".join(f"<li><a href='/{k}'>Menu entry {k}</a></li>" for k in range(30))
    page = f"<html><body><div id='x1'><ul>{menu}</ul></div><div id='x2'><div><p>{LONG}</p><p>{LONG} <a href='#'>link</a></p><p>{LONG}</p></div></div><div id='x3'><a href='/'>a</a> <a href='/'>b</a></div></body></html>"
    assert main_text(page) == f"{LONG} {LONG} link {LONG}"


def test_titles_stay_without_an_article():
    page = f"<body><nav>menu</nav><h1>Head line</h1><div id='x'><div class='story-text'><h2>Sub</h2><p>{LONG}</p><p>{LONG}</p></div></div><div id='y'><a href='/'>elsewhere</a></div></body>"
    assert main_text(page) == f"Head line Sub {LONG} {LONG}"


def test_boilerplate_goes_and_text_stays():
    page = f"""<body><header>site</header><nav>menu</nav><div class="cookie-banner">we use cookies</div><div class="ad">buy</div><main><div class="post-content"><h2>Title</h2><p>{LONG}</p>
    <blockquote>{LONG}</blockquote></div><div class="sidebar">side</div><form><label>mail</label></form><div class="comments"><p>{LONG} I think.</p></div></main><footer>foot</footer></body>"""
    assert main_text(page) == f"Title {LONG} {LONG}"


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>é𝒳"), (2, None, None), (2, "u", ""), (None, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "'x' AS text")
    got = sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, "u", "x", 1), (1, "u", "é𝒳", 2), (2, "", "", 0), (2, "u", "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0


ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
TEXT = f"Title {LONG} {LONG} {LONG}"


@pytest.mark.parametrize("raw", ['<script>x("<!--")</script>', '<script>x("<![CDATA[")</script>', "<style>/* <!-- */</style>", "<script>'</p><div class=\"ad\">'</script>", "<noscript><!-- </noscript>"])
def test_raw_elements_hold_anything(raw):
    assert main_text(f"<body>{raw}<article>{ARTICLE}</article><footer>f</footer></body>") == TEXT
    assert main_text(f"<body><div>{raw}{ARTICLE}</div><footer>f</footer></body>") == TEXT


@pytest.mark.parametrize("tag", ["article", "div", "section"])
@pytest.mark.parametrize(
    "wrapper",
    ["<form action='/' method='post'>{}</form>", "<div class='content with-sidebar'>{}</div>", "<div id='page-has-footer'>{}</div>", "<div class='widget Blog'>{}</div>", "<div role='form'>{}</div>", "<div class='ad'><div class='banner'>{}</div></div>"],
)
def test_a_cut_does_not_take_the_core(wrapper, tag):
    page = wrapper.format(f"<nav><a href='/'>home</a></nav><div class='ad'>Buy now!</div><{tag}>{ARTICLE}</{tag}><div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>")
    assert main_text(f"<html><body>{page}<footer>All rights</footer></body></html>") == TEXT


@pytest.mark.parametrize("opening", ["<div id='legal'>", "<article id='legal'>", "<div class='search notice'>"])
def test_an_article_named_like_boilerplate(opening):
    closing = opening[1:].split()[0]
    assert main_text(f"<body><nav><a href='/'>x</a></nav>{opening}{ARTICLE}</{closing}></body>") == TEXT


def test_a_short_article_beside_a_longer_advert():
    for kind in ("class='ad'", "class='q7'"):
        page = f"<body><nav><ul><li><a href='/'>x</a></li></ul></nav><div {kind}>{LONG}</div><article><h1>T</h1><p>One.</p></article><footer>f f f</footer></body>"
        assert main_text(page) == "T One."


def test_sibling_articles_that_reach_the_threshold():
    page = f"<body><article>{ARTICLE}</article><article><p>{LONG} {LONG}</p></article><article><a href='/'>{LONG}</a></article></body>"
    assert main_text(page) == f"{TEXT} {LONG} {LONG}"


@pytest.mark.parametrize("unit", ["<ul><li>", "<p><object><ul>", "<div class='ad'><span>", "<table><tr><td>", "<p title='>", "</b></p>", "<!--", "<a href=\"", "<form><p>x", "<h1>x"])
def test_time_is_linear_in_the_page(unit):
    def spent(n):
        began = time.perf_counter()
        main_text("<body>" + unit * n + "x")
        return time.perf_counter() - began

    spent(1000)
    assert spent(32_000) < 16 * spent(4_000) + 0.5


def direct(page, cut):
    """Counts, densities, sums and the core by their formulas, each node on its own."""
    n = len(page.tags)

    def above(k):
        while True:
            yield k
            if not k:
                return
            k = page.parents[k]

    below = [[j for j in range(n) if k in above(j) and not cut[j]] for k in range(n)]
    linked = [any(page.tags[j] == "a" for j in above(k) if j) for k in range(n)]
    own = [sum(len("".join(t.split())) for node, t in page.texts if node == k) for k in range(n)]
    c, lc = [sum(own[j] for j in b) for b in below], [sum(own[j] for j in b if linked[j]) for b in below]
    t, lt = [sum(j != k for j in b) for k, b in enumerate(below)], [sum(j != k and page.tags[j] == "a" for j in b) for k, b in enumerate(below)]
    body = page.tags.index("body")

    def dense(chars, links, tags, link_tags):
        if not chars:
            return 0.0
        one = lambda x: x or 1
        base = math.log(chars / one(chars - links) * links + lc[body] / c[body] * chars + math.e)
        return chars / one(tags) * max(0.0, math.log(chars / one(links) * one(tags) / one(link_tags))) / max(math.log(base), 0.05)

    each = [0.0 if cut[k] else dense(c[k], lc[k], t[k], lt[k]) for k in range(n)]
    sums = [0.0 if cut[k] else sum(each[j] for j in range(1, n) if page.parents[j] == k and not cut[j]) + dense(own[k], own[k] * linked[k], 1, 1) for k in range(n)]
    return each, sums, body


@pytest.mark.parametrize("seed", range(12))
def test_densities_sums_core_and_threshold_by_direct_formulas(seed):
    rng = random.Random(seed)

    def part(depth):
        tag = rng.choice(["div", "section", "p", "a", "span", "ul", "li", "nav"])
        inner = "".join(part(depth + 1) if rng.random() < 0.6 and depth < 5 else rng.choice(["word ", LONG, "", "x"]) for _ in range(rng.randrange(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    page = html_text.Page(f"<html><body>{''.join(part(0) for _ in range(5))}</body></html>")
    cut = page._cut(set())
    got = page.densities(cut)
    each, sums, body = direct(page, cut)
    assert got.dense == pytest.approx(each) and got.sums == pytest.approx(sums) and got.body == body
    core = got.core()
    best = max(range(body, len(sums)), key=lambda k: sums[k])
    assert sums[best] == pytest.approx(sums[core]) or page.tags[best] in html_text.SINGLE
    path, k = [each[core]], core
    while k != body:
        k = page.parents[k]
        path.append(each[k])
    assert got.threshold(core, body) == pytest.approx(min(path))


PARAGRAPHS = [f"Paragraph {k} tells at some length, and in whole sentences, what this page is about; it has no links in it." for k in range(4)]
STORY = "<h1>The headline</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TOLD = " ".join(["The headline", *PARAGRAPHS])
MENU = '<nav><a href="/">Home</a></nav><div class="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>'
TALK = '<div class="comments"><h3>Comments</h3>' + "".join(f"<p>Reader {k} disagrees with that, and says so in many words, as readers do.</p>" for k in range(9)) + "</div>"


@pytest.mark.parametrize("around", ['<div class="no-comments">', '<div class="post open-comments">', '<div id="respond">', '<div class="comments-enabled">', '<section class="content with-replies">', "<aside>", '<div role="complementary">', '<div role="dialog" class="page">'])
@pytest.mark.parametrize("inner", [STORY, f"<article>{STORY}</article>", f"<main><article>{STORY}</article></main>", STORY.replace("h1", "p")])
@pytest.mark.parametrize("talk", ["", TALK])
def test_a_wrapper_is_no_cut_whatever_its_name(around, inner, talk):
    if talk and "<h1>" not in inner:
        inner = f"<article>{inner}</article>"
    tag = around[1:].split(" ")[0].rstrip(">")
    assert html_text.main_text(f"<html><body>{MENU}{around}{inner}{talk}</{tag}><footer>Imprint</footer></body></html>") == TOLD
    assert html_text.main_text(f"<html><body>{MENU}<div>{around}{inner}</{tag}></div>{talk}<footer>Imprint</footer></body></html>") == TOLD


@pytest.mark.parametrize("word", sorted(html_text.CUT_WORDS | html_text.COMMENT_WORDS))
def test_no_word_in_a_wrappers_class_empties_the_page(word):
    assert html_text.main_text(f'<html><body>{MENU}<div class="has-{word}">{STORY}</div></body></html>') == TOLD


@pytest.mark.parametrize("times", [1, 5, 40])
@pytest.mark.parametrize("each", ["<p>{}</p>", '<article class="comment"><p>{}</p></article>', "<li>{}</li>"])
def test_comment_sections_are_cut_however_long(times, each):
    talk = "".join(each.format(f"Reader {k} disagrees with all of that, and says so in very many words, as readers always do.") for k in range(9 * times))
    for page in (f"{STORY}<div id='comments'>{talk}</div>", f"<article>{STORY}</article><section class='comment-list'>{talk}</section>", f"<div>{STORY}</div><div class='replies'>{talk}</div>"):
        assert html_text.main_text(f"<html><body>{MENU}{page}</body></html>") == TOLD
