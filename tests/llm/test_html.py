from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import html as H

SITE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="page has-sidebar"><header><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav></header>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this</div>
{main}
<aside class="sidebar"><p>Popular posts and much more text in the sidebar, with many words.</p></aside>
<form action="/s"><label>Search</label><input name=q></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>Reader says hello, at length, again and again.</p></article></section>
<footer>&copy; 2024 Site</footer></body></html>"""


@pytest.mark.parametrize(
    ("main", "text"),
    [
        ("<article><h1>Head</h1><p>One  <b>two</b>\n three.<p>Four<br>five &lt;six&gt; &am &#233;</article>", "Head One two three. Four five <six> &am é"),
        ("<main><div class='post-body7'><p>Some text here, quite a lot of it.</p><div class='share'>Tweet</div><p>More.</p></div></main>", "Some text here, quite a lot of it. More."),
        ("<div class='content main-content has-sidebar'><div class='post-header'><h1>Title</h1></div><p>Body text of the page, long enough.</p><p>And an end of it.</p></div>", "Title Body text of the page, long enough. And an end of it."),
        ("<article class='post comments-open'><header><h1>Own</h1></header><p>Own text.</p><div hidden>x</div><!-- c <p>no</p> --></article>", "Own Own text."),
        ("<article><p>a<i>b</i>c&nbsp; d</p><table><tr><td>e<td>f<tr><td>g</table><ul><li>h<li>i</ul>j</article>", "abc d e f g h i j"),
    ],
)
def test_pages(main, text):
    page = SITE.format(main=main)
    paths = dict(H.vote(page))
    best = max(paths, key=paths.get)
    assert H.extract(page, best) == text
    assert H.extract(page, None) == text
    assert H.extract(page, "html/body/div.absent") == text


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<", "<"), ("<div", "<div"), ("a < b <i", "a < b <i"), ("<script>x", ""), ("<!-- x", ""), ("</p></div>a", "a"), ("<a href='x>y'>b</a>", "b")])
def test_odd_pages(page, text):
    assert H.extract(page, None) == text


def test_deep_pages():
    assert H.extract("<div>" * 5000 + "x" + "</div>" * 5000, None) == "x"


def test_paths_are_general():
    page = "<html><body><div class='b post-12 a'><p>text text text</div></body></html>"
    assert "html/body/div.a.b.post-#" in dict(H.vote(page))


def test_host_agrees(spark):
    good = "<html><body><div class='x'><p>%s</p></div><div class='y'><p>%s</p></div></body></html>"
    rows = [(i, "http://h.example/%d" % i, good % ("main words here " * 20, "other words"), 0) for i in range(5)]
    # on its own, this page's best container is the other one
    rows.append((9, "http://H.example/odd", good % ("short main", "a much longer text in the other place " * 5), 0))
    rows += [(10, "http://other.example/", good % ("few", "a much longer text " * 9), 0), (11, None, None, 0), (12, "::bad[", "", 0), (None, None, "<p>z", 0), (9, "http://h.example/odd", "<p>z", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    for most in (0, 1000):
        found = {(r.page_id, r.url): r for r in H.main_text(pages, broadcast_hosts=most).collect()}
        assert len(found) == len(rows)
        assert found[9, "http://H.example/odd"].text == "short main"
        assert found[10, "http://other.example/"].text == "a much longer text " * 8 + "a much longer text"
        assert [found[k].text for k in ((11, None), (12, "::bad["), (None, None), (9, "http://h.example/odd"))] == ["", "", "z", "z"]
        assert all(r.n_chars == len(r.text) for r in found.values())


def test_empty(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body><p>The text of the page.</p></body></html>",
        "<html><head><title>T</title><div><p>The text of the page.</p></div></html>",
        "<html><head><title>T</title></head><body><form action='/x'><input name=v><div><p>The text of the page.</p></div></form></body></html>",
        "<html><body><form><nav>Menu</nav><article>The text of the page.</article></form></body></html>",
        "<html><body><form><nav>Menu</nav><div><p>The text of the page.</p></div></form><p>End</p></body></html>".replace("<p>End</p>", ""),
    ],
)
def test_pages_without_an_end_of_the_head_or_in_a_form(page):
    assert H.extract(page, None) == "The text of the page."


def test_forms_beside_the_text_go():
    page = "<html><body><form><p>Search here</p></form><div><p>The text of the page, longer than the form.</p></div></body></html>"
    assert H.extract(page, None) == "The text of the page, longer than the form."


LONG = "This is a sentence of the article that goes on for a while, with some commas, and ends here. "


@pytest.mark.parametrize(
    "main",
    [
        "<main><h1>Head</h1><div class=lead><p>Lead of it. {x}</div><div class=body><p>{x}{x}{x}</div></main>",
        "<article><h1>Head</h1><p>Lead of it. {x}</p><div class=body><section><p>{x}{x}</section><section><p>{x}</section></div></article>",
        "<article><h1>Head</h1><div class=a><p>Lead of it. {x}</div><div class=a><p>{x}{x}</div><div class=b><p>{x}</div></article>",
        "<div class=wrap><h1>Head</h1><p>Lead of it. {x}</p><div class=text><p>{x}{x}{x}</div></div>",
        "<main><div><div><h1>Head</h1></div></div><div><p>Lead of it. {x}</div><div><div><p>{x}{x}<p>{x}</div></div></main>",
    ],
)
def test_text_beside_the_best_container_stays(main):
    page = SITE.format(main=main.replace("{x}", LONG))
    want = " ".join(f"Head Lead of it. {LONG * 4}".split())
    best = max(H.vote(page), key=lambda v: v[1])[0]
    assert H.extract(page, best) == want and H.extract(page, None) == want


@pytest.mark.parametrize("name", ["page-with-sidebar", "layout-sidebar-right", "widget-area main", "modal-open", "share-page", "theme-banner", "sidebar"])
def test_wrappers_with_marked_names_keep_the_text(name):
    page = f"<html><body><div class='{name}'><nav>Menu</nav><div><h1>Head</h1><p>{LONG}</p></div><div class=ad>Buy</div></div></body></html>"
    assert H.extract(page, None) == f"Head {LONG.strip()}"
    # a real sidebar beside the text still goes
    page = f"<html><body><div class=text><h1>Head</h1><p>{LONG * 3}</p></div><div class='{name}'><p>{LONG}</p></div></body></html>"
    if "with" not in name:
        assert H.extract(page, None) == f"Head {LONG * 3}".strip()


def test_names_inside_an_article():
    article = "<article><h1>Head</h1><h2 class=related-work>Related work</h2><p class=alert>Mind this.</p><p>{x}</p><p class=ad>Buy</p><div class=related><p>Other posts</div></article>"
    page = SITE.format(main=article.replace("{x}", LONG))
    assert H.extract(page, None) == f"Head Related work Mind this. {LONG.strip()}"


def test_lists_of_links_beside_the_text_stay_out():
    links = "".join(f"<li><a href='/{i}'>Another story number {i} of this site</a>" for i in range(9))
    page = f"<html><body><div class=all><ul>{links}</ul><div class=text><h1>Head</h1><p>{LONG * 2}</p></div></div></body></html>"
    assert H.extract(page, None) == f"Head {LONG * 2}".strip()


def texts_by_rule(page):
    """A slow reference on fixtures whose article is known: an independent parser, and names to leave out given by hand."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out, self.open = 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag not in H.VOID:
                gone = tag in ("nav", "aside", "footer", "script", "style", "form", "title") or dict(attrs).get("class") in GONE
                self.open.append((tag, gone))
                self.depth += gone
            self.out.append(" " if tag not in H.INLINE else "")

        def handle_endtag(self, tag):
            while self.open:
                name, gone = self.open.pop()
                self.depth -= gone
                if name == tag:
                    break
            self.out.append(" " if tag not in H.INLINE else "")

        def handle_data(self, data):
            if not self.depth:
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    return " ".join("".join(reader.out).split())


GONE = ("ad", "share", "cookie-notice", "comments", "related")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["p", "h2", "section", "ad", "share", "list", "table", "quote"]), min_size=1, max_size=9), st.sampled_from(["article", "main", "div"]), st.booleans())
def test_fixtures_with_known_text(parts, tag, wrapped):
    made = {
        "p": f"<p>{LONG} <b>bold</b>&amp; more</p>", "h2": "<h2>A heading</h2>", "section": f"<section><h3>Part</h3><p>{LONG}</p></section>",
        "ad": "<div class='ad'><p>Buy this</p></div>", "share": "<div class='share'>Tell others</div>", "list": "<ul><li>First point</li><li>Second point</li></ul>",
        "table": "<table><tr><td>one</td><td>two</td></tr></table>", "quote": f"<blockquote>{LONG}</blockquote>",
    }
    body = f"<h1>Head</h1><p>{LONG * 2}</p>" + "".join(made[p] for p in parts)
    body = f"<{tag}>{body}</{tag}>"
    body = f"<div class='outer'>{body}</div>" if wrapped else body
    page = f"<html><body><nav><a href='/'>Home</a></nav>{body}<aside>{LONG}</aside><footer>End</footer></body></html>"
    assert H.extract(page, None) == texts_by_rule(page)
