from __future__ import annotations

import html
import random
import tracemalloc

import pytest

from lorekeep.llm.html import extract, main_text

CHROME = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">'
    '<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a>B</a></ul></nav>'
    '<div class="cookie-notice">We use cookies to improve your visit to this site.</div><div class="ad">Buy now</div>'
)
END = (
    '<aside><p>About the author of this piece</p></aside><section id="comments"><p>First! A reader comment that is rather long for one.</p></section>'
    '<form><label>Mail</label><input name="m"><button>Go</button></form><footer>&copy; 2024 &middot; example</footer></body></html>'
)


def test_article_with_furniture():
    page = CHROME + "<article><h1>The  Title</h1><p><b>One &amp; two\n three<br>four<p>Short.</p><div class='ad'>Advert in text</div><ul><li>item <i>x</i><li>y</ul></article>" + END
    assert main_text(page) == "The Title\nOne & two three four\nShort.\nitem x\ny"


def test_without_article():
    body = "".join(f"<p>{'lorem ipsum dolor sit amet ' * 8}{i}</p>" for i in range(5))
    page = CHROME + f"<div id='content'><h2>Head</h2>{body}<p>End.</p></div>" + END
    got = main_text(page).split("\n")
    assert got[0] == "Head" and got[-1] == "End." and len(got) == 7


def test_generated_pages_are_returned_whole():
    rng = random.Random(13)
    for _ in range(40):
        paras = [" ".join(rng.choice(["alpha", "béta", "a<b", "c&d", "x"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))]
        tags = [rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<div>{}</div>"]) for _ in paras]
        page = CHROME + "<main><div>" + "".join(t.format(html.escape(p)) for t, p in zip(tags, paras)) + "</div></main>" + END
        assert main_text(page) == "\n".join(paras)


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<p", "plain", "<article></article>", "<" * 1000, "<div>" * 5000 + "deep"])
def test_odd_pages(page):
    assert main_text(page) == {"plain": "plain", "<div>" * 5000 + "deep": "deep", "<" * 1000: "<" * 1000}.get(page, "")


def test_query_shape(spark):
    df = spark.createDataFrame([(1, "u", "<p>hé</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(map(tuple, extract(df).collect()), key=str) == [(1, "u", "hé", 2), (None, None, "", 0)]
    assert extract(df.limit(0)).count() == 0


PARA = "<p>" + "lorem ipsum dolor sit amet " * 8 + "</p>"
SAID = ("lorem ipsum dolor sit amet " * 8).strip()


@pytest.mark.parametrize(
    "block, want",
    [
        ("<section id='discussion'><h2 id='discussion'>Discussion</h2><p>Short.</p></section>", "Discussion\nShort."),
        ("<h2 id='side-effects'>Side effects</h2><h2 class='banner'>Other</h2>", "Side effects\nOther"),
        ("<h2 id='related-work'>Related work</h2><div class='elementor-widget'>In a widget</div>", "Related work\nIn a widget"),
        ("<div class='alert alert-warning'>Mind the gap.</div><section id='consent'><p>All agreed.</p></section>", "Mind the gap.\nAll agreed."),
        (f"<div class='discussion'>{PARA}<p>End.</p></div>", f"{SAID}\nEnd."),
        ("<pre>x = 1 <span class='token comment'># one</span> y</pre>", "x = 1 # one y"),
        ("<p>Text</p><div class='related-posts'><a href='/a'>A</a></div><div class='share'>Share</div><div id='comments'>" + PARA + "</div><div class='cookie-notice'>We</div>", "Text"),
    ],
)
def test_names_of_furniture_on_content(block, want):
    for open_, close in (("<article>", "</article>"), ("<div class='sidebar'><main>", "</main></div>")):
        assert main_text(f"{CHROME}{open_}<h1>T</h1>{PARA}{block}{close}{END}") == f"T\n{SAID}\n{want}"


def test_wrappers_named_like_furniture():
    for name in ("content has-sidebar", "content sidebar", "page-widget"):
        assert main_text(f"<body><div class='{name}'><h1>T</h1>{PARA}<div class='ad'>Buy</div>{PARA}</div></body>") == f"T\n{SAID}\n{SAID}"
    assert main_text(f"<body><div id='content'>{PARA}{PARA}</div><div class='sidebar'>{PARA}</div></body>") == f"{SAID}\n{SAID}"
    assert main_text(f"<body><div class='sidebar content'><div class='widget'>{PARA}<div class='ad'>Buy</div>{PARA}</div></div></body>") == f"{SAID}\n{SAID}"
    assert main_text("<body><div class='ad'>Buy now</div></body>") == ""


MENU = "<nav><ul><li><a href='/a'>Aaa</a><li><a href='/b'>Bbb</a></ul></nav>"
FOUR = "<h1>T</h1>" + PARA * 4
WANT = "\n".join(["T", *[SAID] * 4])


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<form id='page'><div id='c'>{FOUR}</div><label>Mail</label><button>Go</button></form><footer>End</footer></body>",
        f"<body><div class='content has-sidebar'>{FOUR}</div></body>",
        f"<body><div class='post comments-open'>{FOUR}</div><div class='comments'>{PARA * 9}</div></body>",
        f"<body><div class='notice-of-award'>{FOUR}</div></body>",
        f"<body>{MENU.removesuffix('</nav>')}<article>{FOUR}</article></body>",
        f"<body>{MENU.removesuffix('</nav>')}<div id='c'>{FOUR}</div><aside>{PARA}</aside><footer>End</footer></body>",
        f"<head><title>T</title><body><div class='w'>{FOUR}</div><div class='x'><article><a href='/t'>Teaser</a></article></div></body>",
        f"<body><article>{FOUR}</article><footer>{PARA * 9}</footer><label>Never closed</body>",
    ],
)
def test_names_do_not_empty_a_page(page):
    assert main_text(page) == WANT


def test_region_grows_to_what_stands_beside_it():
    page = f"<body>{MENU}<div class='w'><div><p>Short start.</p></div><div>{PARA * 4}</div><div><p>End.</p></div><div><a>x</a> <a>y</a></div></div></body>"
    assert main_text(page) == "\n".join(["Short start.", *[SAID] * 4, "End."])
    two = f"<main><article><h1>A</h1><p>Hi.</p></article><article>{PARA}</article></main><section class='related'><article><p>No</p></article></section>"
    assert main_text(f"<body>{two}</body>") == f"A\nHi.\n{SAID}"


def test_deep_markup_takes_memory_in_proportion():
    tracemalloc.start()
    assert len(main_text("<b>x<div>w" * 4000)) > 4000
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_planted_pages_precision_and_recall():
    """Articles of invented words in pages of several layouts, with and without article tags."""
    rng = random.Random(29)
    kept = found = planted = 0
    for i in range(120):
        para = lambda: " ".join(f"a{rng.randrange(900)}" for _ in range(rng.randrange(2, 70)))  # noqa: B023, E731
        body = [para() for _ in range(rng.randrange(3, 12))]
        inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<p>{} </p>"]).format(p) for p in body)
        frame = ["<article>{}</article>", "<main><div>{}</div></main>", "<div id='content'>{}</div>", "<form><div class='post'>{}</div></form>", "<div class='content has-sidebar'>{}</div>"][i % 5]
        side = "<div class='sidebar'><ul><li><a href='/x'>side one</a><li><a href='/y'>side two</a></ul></div>"
        got = main_text(CHROME + side + frame.format(inner) + END).split()
        want = " ".join(body).split()
        planted, found, kept = planted + len(want), found + len(got), kept + len([w for w in got if w.startswith("a") and w[1:].isdigit()])
    assert kept / planted > 0.99 and kept / found > 0.99


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 7, "x")], "page_id long, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in extract(df).collect()] == [(1, "u", "a", 1)]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body>{MENU}<div class='lead'><p>Intro.</p></div><div class='body'>{FOUR}</div><div>Other line</div></body>", "Intro.\n" + WANT),
        (f"<body><article>{FOUR}<div class='ad-container'>Buy</div><div id='ad-slot'>Now</div><p>End.</p></article></body>", WANT + "\nEnd."),
        (f"<body><article>{FOUR}<div class='notice'>We have moved.</div><div class='notice-box'>Mind.</div></article></body>", WANT),
        (f"<body><article>{FOUR}<div style='display: none'>Unseen</div><p style='color:red'>Seen.</p></article></body>", WANT + "\nSeen."),
        ("<body><ul>" + "".join(f"<li><a href='/{i}'>A link of some length {i}</a></li>" for i in range(20)) + "</ul><article><h1>T</h1><ul><li>one<li>two</ul>Line.</article></body>", "T\none\ntwo\nLine."),
        (f"<body><article>{FOUR}</article><article class='teaser'>{PARA}</article></body>", WANT),
        (f"<body><article class='teaser'>{FOUR}</article></body>", WANT),
        (f"<body><div class='left-column'>{FOUR}</div><div class='right-col'>{PARA}</div></body>", WANT),
        (f"<body><article>{FOUR}<aside>{PARA}</aside></article></body>", WANT),
        (f"<body><div class='notice-of-award content-wrapper'>{FOUR}</div></body>", WANT),
    ],
)
def test_blocks_beside_and_inside(page, want):
    assert main_text(page) == want
