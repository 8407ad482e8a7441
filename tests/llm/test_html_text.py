import html
import random
import re
import time

import pytest

from churnscope.llm import html_text as T

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, a lot. Accept?</div><div id=main>
<h2>Real title</h2><p>First paragraph, with some text &amp; more.<br>It is long&nbsp;enough, yes.</p>
<ul><li>one point, short<li>two <b>po</b>ints</ul><p>Second <a href=x>linked</a> paragraph; here too.</p>
<script>var t="</p>";</script><!-- hidden <p>x</p> --><form><label>Mail</label><input></form></div>
<div class="sidebar"><p>Side text, with punctuation. And more, more, more.</p></div>
<section id="comments"><p>Great post, thanks! I agree with it all, really.</p></section><footer>(c) 2020</footer></body></html>"""


def test_page_without_article():
    assert T.main_text(PAGE) == (
        "Real title First paragraph, with some text & more. It is long enough, yes. one point, short two points "
        "Second linked paragraph; here too.")


def test_article_with_inner_noise():
    page = ("<body><div class='menu'>Home, About</div><article><header>By A. Writer</header><h1>Head</h1><p>Text one, of two."
            "<p>x</p><aside>Related, of course.</aside><div class='ad'>Buy, now!</div><p>Text two.</p>"
            "<ul><li><a href='a'>More</a></li></ul><div id='comments'><p>First, I say!</p></div></article>"
            "<article class='comment'><p>A long comment, with a lot to say; more than most, I think.</p></article>")
    assert T.main_text(page) == "Head Text one, of two. x Text two."


def test_several_articles():
    one, two = "First text, of a page; long enough.", "Second text, of a page; long enough."
    assert T.main_text(f"<body><article><p>{one}</article><p>x</p><article><p>{two}</article>") == f"{one} {two}"
    assert T.main_text(f"<main><article><p>{one}</article><article><p>{two}</article><p>y</main>z") == f"{one} {two} y"


def test_names_of_noise_without_article():
    page = ("<body><div class='siteheader'><p>News, daily.</p></div><div class=cookiebar>We use cookies, please agree.</div>"
            "<div class=content><h1 class='header'>Head line</h1><p>Body text, first part; it goes on, and on.</p>"
            "<div class='advertisement'><p>Buy this, now!</p></div><p>Second, last part of the text, here.</p></div>"
            "<ol class='commentlist'><li>I agree, fully, with all of it.</li></ol><div id='sitefooter'>End, 2020.</div>")
    assert T.main_text(page) == ("Head line Body text, first part; it goes on, and on. "
                                 "Second, last part of the text, here.")


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("plain &lt;text&gt;\n only", "plain <text> only"), ("<script>x</script>", ""),
    ("<p>a<p>b", "a b"), ("<b>un<i>closed</b> x", "unclosed x"), ("<nav>all</nav>", ""), ("<", "<"), ("a < b", "a < b"),
    ("</div></p>t", "t"), ("<p title='a>b'>c", "c"), ("<td>a<td>b", "a b"), ("<!-- open", "")])
def test_small_inputs(source, want):
    assert T.main_text(source) == want


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = T.with_main_text(pages).collect()

    def article(h):
        a = h[h.index("<article>") + 9:]
        a = re.sub(r"</?(?:b|i|em)>", "", a[:a.index("</article>")] if "</article>" in a else a).replace("<br>", " ")
        return " ".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split(r"<[^>]*>", a)) if x)

    assert len(rows) == pages.count() and all(r.text == article(r.html) for r in rows)


def test_rows_columns_and_long_pages(spark):
    long = "<article>" + "<p>Word, word. </p>" * 30000 + "</article>"
    deep = "<div>" * 5000 + "deep, text." + "</div>" * 5000
    df = spark.createDataFrame([(1, None, "k"), (2, long, "k"), (3, deep, "k"), (3, deep, "k")],
                               "page_id long, html string, tag string")
    out = sorted(((r.page_id, r.text, r.tag) for r in T.with_main_text(df).collect()))
    assert [r[0] for r in out] == [1, 2, 3, 3] and out[0][1] == "" and out[2][1] == "deep, text."
    assert out[1][1] == " ".join(["Word, word."] * 30000) and {r[2] for r in out} == {"k"}
    assert T.with_main_text(df.limit(0)).collect() == []


COMMENTS = "".join(f"<p>Reader {i} says: I agree, fully, with all of it; thanks.</p>" for i in range(60))


@pytest.mark.parametrize("page", [
    "<article><h1>Head</h1><p>A short article, of two parts; it ends here.</p><p>So it does, in fact.</p></article>{c}",
    "<main><h1>Head</h1><p>A short article, of two parts; it ends here.</p><p>So it does, in fact.</p>{c}</main>",
    "<div><h1>Head</h1><p>A short article, of two parts; it ends here.</p><p>So it does, in fact.</p></div>{c}",
    "<div class='has-sidebar'><h1>Head</h1><p>A short article, of two parts; it ends here.</p><p>So it does, in fact.</p>"
    "{c}</div>"])
def test_comments_twenty_times_as_long_as_the_article(page):
    comments = f"<section id='comments'>{COMMENTS}</section>"
    assert len(COMMENTS) > 20 * len("Head A short article, of two parts; it ends here. So it does, in fact.")
    assert T.main_text("<body>" + page.format(c=comments) + "</body>") == (
        "Head A short article, of two parts; it ends here. So it does, in fact.")


def test_named_wrapper_of_the_whole_page_stays():
    page = "<body><div class='sidebar-layout'><h1>Head</h1><p>All the text, of the page.</p></div><div>x</div></body>"
    assert T.main_text(page).startswith("Head All the text, of the page.")


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>\"']*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>"
                   r"|<(/?)([A-Za-z][^\s/>\"']*)([^>]*)>", re.S)


def test_markup_against_one_pattern():
    rnd = random.Random(6)
    for _ in range(20000):
        s = "".join(rnd.choice(["<", ">", "a", "/", " ", '"', "'", "!", "-", "--", "<a ", "</b>", "<!--", "-->", "=", "<br/>",
                                "<![CDATA[", "]]>"]) for _ in range(rnd.randint(0, 14)))
        s = re.sub("(</?[a-z][^\\s/>\"']*)[\"']", r"\1 ", s)  # a quote inside a tag name is read as part of the name
        at = 0
        while True:
            m, got = TOKEN.search(s, at), T.next_token(s, at, s.rfind(">"))
            assert (m is None) == (got is None), s
            if m is None:
                break
            want = (m.start(), m.end(), m[1] or m[5] or "", m[2] or m[6] or "", (m[3] if m[2] else m[7]) or "", bool(m[4]))
            assert got == want, s
            at = m.end()


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"" * 250_000, "<!-- " * 200_000, "<script>" + "</script " * 120_000,
                                  "</" * 500_000, "<p>" + "x <b " * 200_000 + ">"])
def test_a_megabyte_of_odd_markup_takes_no_longer_than_text(page):
    begin = time.perf_counter()
    T.main_text(page)
    assert time.perf_counter() - begin < 2
