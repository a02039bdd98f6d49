"""Main text of made pages, whose article is known, and of markup broken in every way."""

import random
import time

import pytest
from conftest_llm import prose

from marginalia.llm import maintext

PROSE = [
    "The house was built for the keeper of the lock, and it is as old as the canal that it stands by. " * 3,
    "In the spring of that year a flood came to the town, which had not seen one for a long time, and took the bridge. " * 3,
    "Most of the stones are still on the bed of the river, but some were used for the walls of the mill that was built in its place. " * 3,
]
PROSE = [p.strip() for p in PROSE]
FURNITURE = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News of the day and of the week</a></li></ul></nav>',
    "<header><h2>The Site</h2><p>" + PROSE[0] + "</p></header>",
    "<footer><p>&copy; 2020 The Site</p><p>" + PROSE[1] + "</p></footer>",
    '<aside><h3>Also</h3><p>' + PROSE[2] + "</p></aside>",
    '<div class="sidebar left"><p>' + PROSE[0] + "</p></div>",
    '<div id="cookie-notice"><p>We use cookies. ' + PROSE[1] + "</p></div>",
    '<div class="ad">' + PROSE[2] + "</div>",
    '<section class="advert-box"><p>Buy it.</p></section>',
    "<form><label>Name</label><input><textarea>the text of a box</textarea><button>Send</button></form>",
    "<script>var x = '</p><p>the';</script><style>p { color: red }</style><noscript><p>No script</p></noscript>",
    "<!-- <p>" + PROSE[0] + "</p> -->",
    '<div class="commentList"><h3>Comments</h3><div><p>' + PROSE[1] + "</p></div></div>",
    '<section id="comments"><p>' + PROSE[2] + "</p></section>",
    '<div role="complementary">' + PROSE[0] + "</div>",
    '<div style="display: none">' + PROSE[0] + "</div><p hidden>" + PROSE[1] + "</p>",
]
HEAD = "<!DOCTYPE html><html><head><title>The title</title><meta charset=utf-8></head><body class='has-sidebar'>"


def page_of(rng, wrap, blocks):
    """A page with the blocks in the wrapping given and furniture around and between them."""
    inside = []
    for b in blocks:
        if rng.random() < 0.4:
            inside.append(rng.choice(FURNITURE[3:]))
        inside.append(b)
    around = [rng.choice(FURNITURE) for _ in range(6)]
    return HEAD + "".join(around[:3]) + wrap[0] + "".join(inside) + wrap[1] + "".join(around[3:]) + "</body></html>"


@pytest.mark.parametrize(
    "wrap",
    [("<article class='post has-comments'>", "</article>"), ("<main>", "</main>"), ('<div id="content"><div>', "</div></div>"), ("<div><div class='text'>", "</div></div>"),
     ("<main><div><article>", "</article></div></main>")],
)
def test_article_without_furniture(wrap):
    rng = random.Random(4)
    for _ in range(40):
        blocks = ["<h1>A short <i>title</i></h1>"] + [f"<p>{p}</p>" for p in rng.sample(PROSE, 3)]
        blocks.insert(2, "<p>So it&nbsp;was\n &amp; is.<br>Still</p>")
        want = "\n\n".join(["A short title", PROSE[0], "So it was & is. Still", *PROSE[1:]])
        got = maintext.main_text(page_of(rng, wrap, blocks))
        assert sorted(got.split("\n\n")) == sorted(want.split("\n\n")), got


def test_article_of_short_blocks_alone():
    for body in ("<h1>Xq</h1><p><b>Xq.<br>", "<p>One.</p><p>Two.</p>", "<ul><li>a<li>b</ul>", "plain"):
        got = maintext.main_text(HEAD + FURNITURE[0] + "<div class=ad>Bad ad</div><article>" + body + "</article>" + FURNITURE[2])
        assert got and "ad" not in got and "Home" not in got and "Site" not in got, body
    assert maintext.main_text("<p>Hello</p>") == "Hello"
    assert maintext.main_text("no markup at all") == "no markup at all"


def test_open_blocks_take_their_neighbours_label():
    links = '<ul><li><a href="a">One of the pages that are near</a></li><li><a href="b">Another of the pages</a></li></ul>'
    page = f"<body>{links}<p>See also</p>{links}<h1>Title</h1><p>{PROSE[0]}</p><p>Short.</p><p>{PROSE[1]}</p>{links}<p>Tail</p>{links}</body>"
    assert maintext.main_text(page) == "\n\n".join(["Title", PROSE[0], "Short.", PROSE[1]])


def test_links_within_an_article():
    page = f"<article><h1><a href=x>Title</a></h1><ul><li><a href=1>Part 1</a></li><li><a href=2>Part 2</a></li></ul><p>{PROSE[0]} <a href=y>there</a></p></article>"
    assert maintext.main_text(page) == f"Title\n\n{PROSE[0]} there"


def test_references_and_broken_markup():
    cases = {
        "<article><p>1 < 2 &lt; 3 &#8364; &euro; &nosuch; &amp;lt; &am": "1 < 2 < 3 € € &nosuch; &lt; &am",
        "<article><p>a<p>b<div>c</p>d": "a\n\nb\n\nc\n\nd",
        "<article><p>text <a href='never closed": "text",
        "<article><p>x</p><script>never closed": "x",
        "<article><p>x</p><!-- never closed": "x",
        "<ArTiClE><P CLASS=x>Up</P ></ARTICLE>": "Up",
        '<article><p title="a > b">y</p></article>': "y",
        "<form><article><p>In a form</p></article></form>": "In a form",
        "<nav><ul><li>Menu<article><p>Text</p></article>": "Text",
        "<article>a<b>b</b>c <i>d</i></article>": "abc d",
        "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\n\nb\n\nc",
        "": "", "<": "<", "</": "", "<>": "<>", "<p": "", "<!": "",
    }
    for page, want in cases.items():
        assert maintext.main_text(page) == want, page


def test_any_markup_is_read_in_time():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", '"', "'", ">", "<", "text the ", "<!--", "-->", "<script>", "</script>", "&amp", "<li>", "</ul>", "<article>", "="]
    for _ in range(2000):
        maintext.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))))
    for unit in ("<p>", "<li>", '<a href="', "<a =", "<div class=ad><p>x", "<!--", "<script>", "</p>", "<b", "<span class=ad>", "<article><nav>", "<form>", "<div></p>", "<form><li></li>"):
        took = []
        for n in (5_000, 20_000):
            began = time.perf_counter()
            maintext.main_text(unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5, (unit, took)


def test_rows_are_kept_as_they_are(spark):
    long = "<article>" + "".join(f"<p>{prose(k, 200)}</p>" for k in range(1500)) + "</article>"
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x</p>", None), (3, "v", "", 1), (4, "w", long, 2)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int")
    got = maintext.extract_main_text(df).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got[:4]] == ["", "", "x", ""]
    assert got[4].text == "\n\n".join(prose(k, 200) for k in range(1500)) and got[4].n_chars == len(got[4].text) > 2**20
    assert maintext.extract_main_text(df.limit(0)).count() == 0
