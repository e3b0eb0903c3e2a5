import html as H
import re

from wardline.llm import html_text, queries


def plain(page):
    """Brute force for pages of the tables' shape: the article's blocks."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    if not m:
        return ""
    inner = re.sub(r"<[A-Za-z/!][^<>]*\Z", "", m[1])
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    return "\n\n".join(t for x in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(H.unescape(x).split())))


def test_pages(spark, docs, sf):
    rows = {r["page_id"]: r for r in queries.op10_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p["page_id"]]["text"] == plain(p["html"])
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


PAGE = """<html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=x>home</a></nav><div id="main-content"><h1>Title &amp; more</h1><p>Long text that is the content of the
article, with   many words, <b>bold</b><br>and <a href=y>a link</a>.</p><p>Short.</p><div class="advert">Buy now</div>
<p>Another long paragraph of content that goes on and on &eacute;&#x1F600;.</p><ul><li>first<li>second</ul>
<section class="comments"><p>First! a reader's comment that is long enough to look like an article.</p></section></div>
<div class="sidebar">x y z</div><div role="dialog">Accept cookies</div><form><p>Name</p></form><script>var x="<p>no</p>"</script>
<footer>&copy; someone</footer></body></html>"""


def test_what_goes_and_what_stays():
    assert html_text.main_text(PAGE) == "\n\n".join(["Title & more", "Long text that is the content of the article, with many words, bold and a link.", "Short.", "Another long paragraph of content that goes on and on \xe9\U0001f600.", "first", "second"])


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain text") == "plain text"
    assert html_text.main_text("<article><p>one</p><p>two <b") == "one\n\ntwo"
    assert html_text.main_text("<nav>only a menu</nav>") == ""
    assert html_text.main_text("<p>a < b &am &amp c</p>") == "a < b &am & c"
    long = "<article>" + "<p>paragraph of words</p>" * 20000 + "</article>"
    assert html_text.main_text(long).count("\n\n") == 19999
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


ARTICLE = "".join(f"<p>Paragraph {k} of an article that is long enough to be one.</p>" for k in range(12))
TEXT = "\n\n".join(f"Paragraph {k} of an article that is long enough to be one." for k in range(12))


def test_class_words_inside_other_names_drop_nothing():
    for name in ("layout has-sidebar", "no-ads", "with-comments", "share-buttons-off", "notice-board", "widget-free", "hasComments", "page no-banner", "adventure", "menuless"):
        for page in (f'<body><div class="{name}">{ARTICLE}</div></body>', f'<body><div id="{name}"><article>{ARTICLE}</article></div></body>', f'<article><div class="{name}">{ARTICLE}</div></article>'):
            assert html_text.main_text(page) == TEXT, (name, page[:60])


def test_whole_names_of_other_things_go():
    for name in ("ad", "site-footer", "commentList", "comments-area", "cookie-banner", "sidebar left", "sidebar-2", "nav-main", "relatedPosts", "x share-buttons", "ad-slot"):
        for page in (f'<body><div>{ARTICLE}</div><div class="{name}"><p>This is another thing than the article is.</p></div></body>', f'<article>{ARTICLE}<div id="{name}"><p>This is another thing than the article is.</p></div></article>'):
            assert html_text.main_text(page) == TEXT, (name, page[:60])


def test_a_named_container_that_is_the_content_stays():
    menu = '<div class="menu"><a href=x>one</a></div>'
    assert html_text.main_text(f'<body>{menu}<div class="widget"><article>{ARTICLE}</article><div class="ad">Buy</div></div><p>Beside.</p></body>') == TEXT
    assert html_text.main_text(f'<body>{menu}<div class="widget">{ARTICLE}</div></body>') == TEXT
    comments = f'<div class="comments"><article>{ARTICLE}</article></div>'
    assert html_text.main_text(f"<body>{menu}<div><p>Only this.</p></div>{comments}</body>") == "Only this."
    assert html_text.main_text(f"<body>{menu}{comments}</body>") == ""


def test_an_open_tag_of_any_length_goes():
    for size in (10, 5000, 200_000):
        assert html_text.main_text(f'<article>{ARTICLE}<p>End <a title="{"x " * size}') == TEXT + "\n\nEnd"
        assert html_text.main_text(f'<article>{ARTICLE}<p>End <a title="{"x < y " * size}') == TEXT + "\n\nEnd"
    assert html_text.main_text(f"<article>{ARTICLE}<p>5 < 6") == TEXT + "\n\n5 < 6"


def test_smoothing_keeps_the_mean_of_a_constant():
    assert all(abs(x - 3) < 1e-12 for x in html_text.smoothed([3.0] * 9))


def test_hard_rows(spark, docs):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", None, "t"), (1, "u", "", "t"), (1, "u", "<p>x", "t")], "page_id bigint, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("", 0), ("", 0), ("x", 1)]
    assert html_text.extract(df.limit(0)).collect() == []


def test_short_sections_and_articles_beside_long_ones_stay():
    say = lambda name, n: [f"{name} {k} is a paragraph of words, as long as paragraphs are." for k in range(n)]
    marked = lambda blocks: "".join(f"<p>{b}</p>" for b in blocks)
    menu = '<div class="menu"><a href=x>one</a><a href=y>two</a></div>'
    for many in (20, 200):
        long, short = say("Long", many), say("Short", 2)
        for tag in ("div", "section", "article"):
            page = f"<body>{menu}<div id=content><{tag}>{marked(long)}</{tag}><{tag}>{marked(short)}</{tag}></div></body>"
            assert html_text.main_text(page) == "\n\n".join(long + short)
