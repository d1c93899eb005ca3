import html
import re

from quadloom.llm import html_text as H
from quadloom.llm.html_text import html_text, lines_of, main_text, stretches


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", body)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = html_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice"><p>We use cookies</div><aside>Side</aside>
%s
<section id="comments"><h2>Comments</h2><p>First!</p></section><form><p>Name <input name=x></form><footer>&copy; us</footer>"""


def test_article():
    inside = "<article><h1>A  title</h1><p>One &amp; two&nbsp;three &#233;<p>Four <b>five<br>six</p><div class='ad banner'>Buy</div><ul><li>x<li>y</ul><!-- <p>no</p> --><section class=comments><p>me</section></article>"
    assert main_text(PAGE % inside) == "A title\nOne & two three é\nFour five\nsix\nx\ny"


def test_without_article():
    inside = "<div><h2>Head</h2><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div>"
    got = main_text(PAGE % inside)
    assert got == f"Head\n{('long text ' * 30).strip()}\n{('more text ' * 30).strip()}"


def test_odd_markup():
    assert main_text(None) == main_text("") == main_text("<script>never ends") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a</i></div></p>b < c <p>d") == "a\nb < c\nd"
    assert main_text("<article><p title='a > b'>x</p></article") == "x"
    assert main_text("<article>" + "<p>w</p>" * 20_000).count("\n") == 19_999


def test_windows():
    assert stretches([0, 5, 0, 5, 0, 0, 0, 5]) == [(1, 4), (7, 8)]
    assert stretches([]) == []
    assert stretches([4, 0, 0, 9, 9, 0, 1, 0, 0, 4], 10) == [(3, 7)]
    assert [(t, w) for t, w, _ in lines_of("<nav>a</nav><div>bb</div><p>bb</p><p><a href=x>linked only</a></p>")] == [("bb", 2), ("bb", 2 + H.DENSE), ("linked only", 0)]


def test_odd_table(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text(pages).collect()), key=str) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert html_text(pages.limit(0)).count() == 0


def test_attributes_are_whole():
    for attributes in ('title="a hidden valley"', 'data-hidden="false"', 'data-id="comments"', "data-role=navigation", 'title=\'style="display:none"\'', "data-x='class=ads'"):
        assert main_text(f"<article><p {attributes}>kept</p></article>") == "kept"
    assert main_text('<article><p>one <a href="/wiki/Hidden_costs">two</a> <a href=/wiki/hidden>three</a></article>') == "one two three"
    for attributes in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "role = navigation", 'style="color:red; display: none"', 'title="x"hidden'):
        assert main_text(f"<article><p {attributes}>gone</p><p>kept</article>") == "kept"


def test_names_in_an_article():
    inside = "<h2 id='social-impact'>a</h2><section id='related-work'><p>b</section><p class='share-price'>c</p><p class='notice'>d<h3 id='comments'>e</h3>"
    assert main_text(f"<article>{inside}</article>") == main_text(f"<body>{inside.replace('comments', 'remarks').replace('notice', 'x')}</body>") == "a\nb\nc\nd\ne"
    assert main_text("<article><p>a</p><div class='x ad'>b</div><ul class=menu><li>c</ul><section id=comments>d</section><p>e</article>") == "a\ne"
    assert main_text("<div class='site-header'>a</div><div id=cookie-notice-2>b</div><div class='main-nav'>c</div><p>d") == "d"


def test_short_stretches_without_article():
    page = "<div><p>" + "long text " * 50 + "</div>" + "<nav>x</nav>" + "<p><a href=x>links only</a></p>" * 4 + "<div><p>short end</div>"
    assert main_text(page) == ("long text " * 50).strip() + "\nshort end"


def lines(*texts):
    return "".join(f"<div class=x{i}>{t}</div>" for i, t in enumerate(texts))


def test_density_decides_without_an_article(monkeypatch):
    """Short lines that stand apart before and after all text go; those near it, and all in between, stay."""
    long = "a long line of text, as it stands in a story told at length "
    page = lines("Login", "Help", "7 May", "By me", long + "1", "*", "**", "***", "* *", "* * *", long + "2", "The end", "Up", "Top")
    whole = ["7 May", "By me", long + "1", "*", "**", "***", "* *", "* * *", long + "2", "The end", "Up"]
    assert main_text(page).split("\n") == [x.strip() for x in whole]
    monkeypatch.setattr(H, "WINDOW", 1)
    assert main_text(page).split("\n") == [x.strip() for x in whole[2:-2]]
    monkeypatch.setattr(H, "WINDOW", 50)
    assert main_text(page).split("\n") == ["Login", "Help", *[x.strip() for x in whole], "Top"]


def test_markup_adds_to_density():
    assert main_text(lines("Login", "Help", "About", "Jobs", "News") + "<h2>Yes</h2><p>No.</p>" + lines("a", "b", "c", "d")) == "Jobs\nNews\nYes\nNo.\na\nb"
    assert main_text(lines("Login", "Help") + "<article><div>Yes</div></article>" + lines("a")) == "Yes"
    assert main_text(lines("One", "Two")) == "One\nTwo"
