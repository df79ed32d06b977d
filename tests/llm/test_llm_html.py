import re
from html import unescape

import pytest

from touchflow.llm import html_text
from touchflow.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script>
</head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, a lot of them, and this is a long text about it.</div>
<div id="main-ad" class="ad">Buy now</div><article><header><h1>Head &amp;  line</h1></header>
<p>First&nbsp;<b>bold</b> &lt;tag&gt;
 text<p>Second <i>one</i></p><ul><li>item one<li>item two</ul><div>loose<p>x</p>tail</div>
<aside>side</aside><form><label>Mail</label><input value="a"></form>
<!-- note --><blockquote>Quote</blockquote><table><tr><td>a</td><td>b</td></tr></table>
<section class="comments"><p>Great article, I read it twice and shared it with all friends.</p></section>
</article><div class="sidebar"><p>More to read, more to read, more to read, more.</p></div>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE).split("\n") == [
        "Head & line", "First bold <tag> text", "Second one", "item one", "item two", "loose", "x",
        "tail", "Quote", "a", "b"]


def test_without_an_article_the_container_of_the_dense_lines_is_taken():
    long = "Many words stand here to make a dense line of running text, again and again. " * 3
    page = (f"<body><div><a href=1>One</a><br><a href=2>Two</a></div><div><h2>Title</h2><p>{long}</p>"
            f"<p>Short.</p><p>{long}</p></div><div><a href=3>Three</a> <a href=4>Four</a></div></body>")
    assert main_text(page).split("\n") == ["Title", long.strip(), "Short.", long.strip()]


@pytest.mark.parametrize("page", [None, "", "   ", "<html><body></body></html>", "<script>x</script>",
                                  "<!-- c", "<nav>a</nav>"])
def test_nothing_to_extract(page):
    assert main_text(page) == ""


@pytest.mark.parametrize("page, text", [
    ("plain text &eacute;", "plain text é"), ("<p>a<p>b", "a\nb"), ("<p>a</div></span>b", "ab"),
    ("<p>a<br>b", "a b"), ("<article><p>open <b>bold", "open bold"), ("a < b & c", "a < b & c")])
def test_broken_markup(page, text):
    assert main_text(page) == text


def test_long_pages_and_depth():
    page = "<article>" + "<div>" * 3000 + "<p>" + "word " * 100_000 + "</article>"
    assert len(main_text(page)) == 5 * 100_000 - 1


def test_smoothing_keeps_constants_and_clusters_split():
    assert html_text.smoothed([2.0] * 9) == pytest.approx([2.0] * 9)
    assert 3 < html_text.threshold([1, 2, 1, 10, 11]) < 10
    assert html_text.threshold([4.0]) == 4.0


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, None)]
    found = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in found[:2]] == \
        [(1, "u", len(main_text(PAGE)))] * 2
    assert found[2]["text"] == "" and found[2]["n_chars"] == 0
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


LONG = "Many words stand here to make a dense line of running text, again and again. " * 3


def test_generated_names_inside_an_article_are_no_marks():
    page = (f'<article><h1 id="share-prices">Share prices</h1><p class="ad-hoc">{LONG}</p>'
            f'<h2 id="related-work">Related work</h2><section id="social-history"><p>{LONG}</p></section>'
            f'<h2 id="notice">Notice</h2><section id="notice-period"><p>{LONG}</p></section>'
            f'<section id="related"><h3>Related</h3><p>{LONG}</p></section>'
            '<div class="related-posts"><p>More</p></div><div class="ad">Buy</div>'
            f'<div id="comments"><p>{LONG}</p></div><div class="share-buttons">Tell all</div></article>')
    assert main_text(page).split("\n") == [
        "Share prices", LONG.strip(), "Related work", LONG.strip(), "Notice", LONG.strip(), "Related",
        LONG.strip()]


def test_title_and_lead_beside_the_container_of_most_of_the_text():
    page = (f"<body><div><a href=1>One</a></div><div><h1>Title</h1><div>A lead of a few words.</div><div>"
            + f"<p>{LONG}</p>" * 9 + f"</div><div>{LONG}</div></div></body>")
    assert main_text(page).split("\n") == [
        "Title", "A lead of a few words.", *[LONG.strip()] * 10]


def test_an_article_does_not_displace_the_rest_of_main():
    page = (f"<main><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>"
            f"<section><h2>Part two</h2><p>{LONG}</p><p>{LONG}</p></section></main>")
    assert main_text(page).split("\n") == [
        "Title", *[LONG.strip()] * 3, "Part two", *[LONG.strip()] * 2]


@pytest.mark.parametrize("name", ["post tag-social category-ads", "content has-sidebar",
                                  "page-header-content", "article-header", "layout--with-menu"])
def test_names_of_the_container_of_all_text(name):
    page = (f'<body><nav><a href="/">Home</a></nav><div class="{name}"><h1>Title</h1><p>{LONG}</p>'
            f'<div class="ad">Buy</div><p>{LONG}</p></div><footer>End</footer></body>')
    assert main_text(page).split("\n") == ["Title", *[LONG.strip()] * 2]


def test_a_form_around_the_page_is_a_plain_box():
    page = (f'<body><form action="/"><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>'
            f'<div class="sidebar"><p>{LONG}</p></div></form></body>')
    assert main_text(page).split("\n") == ["Title", *[LONG.strip()] * 2]
    page = f'<body><article><p>{LONG}</p></article><form><p>Your mail</p></form></body>'
    assert main_text(page) == LONG.strip()


def test_sibling_articles_are_all_kept():
    one = f"<article><h2>Part</h2><p>{LONG}</p></article>"
    assert main_text(f"<body><nav><a href=1>x</a></nav>{one}{one}</body>").split("\n") == \
        ["Part", LONG.strip()] * 2
    short = "<article><h2>Part</h2><p>A few words.</p></article>"
    page = f"<body>{one}{short}</body>"
    assert main_text(page).split("\n") == ["Part", LONG.strip(), "Part", "A few words."]


@pytest.mark.parametrize("box", [
    '<section id="comments">%s</section>', '<div class="comment-body">%s</div>',
    '<div class="reader-comments">%s</div>', '<div class="user-comment">%s</div>',
    '<ol class="commentlist">%s</ol>'])
@pytest.mark.parametrize("page", ["<article><h1>Title</h1><p>%s</p>%%s</article>",
                                  "<body><div><h1>Title</h1><p>%s</p></div>%%s</body>"])
def test_comments_go_however_dense(page, box):
    page = page % LONG % (box % f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>")
    assert main_text(page).split("\n") == ["Title", LONG.strip()]


def slow_article(html):
    """The blocks of a given page's article, by cutting the markup with patterns."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.DOTALL)[1]
    inner = re.sub(r"<!--.*?-->", "", inner, flags=re.DOTALL)
    for name in ("script", "style", "nav", "aside", "form", 'div class="ad"'):
        inner = re.sub(rf"<{name}.*?</{name.split()[0]}>", "\0", inner, flags=re.DOTALL)
    inner = re.sub(r"</?(?:h[1-6]|p|div|ul|ol|li|blockquote|table|tr|td|th|section)\b[^>]*>", "\0", inner)
    inner = re.sub(r"<br[^>]*>", " ", inner)
    inner = re.sub(r"</?[a-zA-Z][^>]*>", "", inner)
    blocks = [" ".join(unescape(b).split()) for b in inner.split("\0")]
    return "\n".join(b for b in blocks if b)


def test_given_pages_equal_a_slow_extraction(spark):
    rows = html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"]
             for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    wrong = [r["page_id"] for r in rows if r["text"] != slow_article(pages[r["page_id"]] or "<article>")]
    assert len(rows) == len(pages) and not wrong
