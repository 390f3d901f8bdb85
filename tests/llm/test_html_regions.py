"""Pages on which the main text isn't where the markup says first."""

import html
import math
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerflow.llm import html_text
from ledgerflow.llm.html_text import main_text

PARAS = [f"Paragraph {k} of the story goes on for quite a while and tells of what came of it in the end." for k in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in PARAS)
WHOLE = "\n".join(PARAS)


def test_article_that_is_a_teaser():
    teaser = "<article><p>Read this too</p></article>"
    assert main_text(f"<body><div>{STORY}</div>{teaser}</body>") == WHOLE


def test_article_marked_as_promotion():
    for mark in ("related", "promo", "ad"):
        assert main_text(f"<body><article>{STORY}</article><article class={mark}><p>{PARAS[0]}</p></article>") == WHOLE


def test_article_that_holds_the_text():
    assert main_text(f"<body><div>Site of all sites</div><main><article>{STORY}</article></main>") == WHOLE


def test_head_without_end_tag():
    assert main_text(f"<html><head><title>T</title><meta charset=x><body><div>{STORY}</div>") == WHOLE
    assert main_text(f"<html><head><title>T</title><div>{STORY}</div>") == WHOLE


def test_marked_wrapper_of_the_page():
    for mark in ("content right-sidebar", "layout-sidebar", "elementor-widget-text-editor"):
        assert main_text(f'<body><div class="{mark}"><div>{STORY}</div><div class=ad><p>Buy now</p></div></div>') == WHOLE
    assert main_text(f"<body><form id=aspnet><div>{STORY}</div></form>") == WHOLE
    assert main_text("<body><form class=login><p>Name and password, please</p></form>" + f"<div>{STORY}</div>") == WHOLE


def test_text_before_an_inline_advert():
    page = f"<body><div>{STORY}<p>Before <span class=ad><div>x</div></span></div>"
    assert main_text(page) == WHOLE + "\nBefore"
    assert main_text(f"<body><div>{STORY}<p>One <span class=share>Share</span> two</p></div>") == WHOLE + "\nOne two"


def test_advert_longer_than_the_article():
    assert main_text("<body><div class=ad>An advert with more words</div><article><h1>A few words of text</h1></article>") == "A few words of text"


def test_title_outside_the_body():
    assert main_text(f"<body><div><h1>Title</h1><div>{STORY}</div></div>") == "Title\n" + WHOLE
    assert main_text(f"<body><h1>Title</h1><article>{STORY}</article>") == "Title\n" + WHOLE


def test_article_in_two_sections():
    long, short = "".join(f"<p>{x}</p>" for x in PARAS * 2), f"<p>{PARAS[0]}</p><ul><li>one</ul>"
    assert main_text(f"<body><div><section>{long}</section><section>{short}</section></div>") == f"{WHOLE}\n{WHOLE}\n{PARAS[0]}\none"


def test_long_quotation():
    quote = "".join(f"<p>{x}</p>" for x in PARAS * 3)
    for tag in ("blockquote>", "td>"):
        got = main_text(f"<body><div><p>{PARAS[0]}</p><{tag}{quote}</{tag}<p>{PARAS[1]}</p></div>")
        assert got == "\n".join([PARAS[0], *PARAS * 3, PARAS[1]])


def test_ratio_step_by_plain_loops():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 40):
        size, tags = rnd.integers(1, 400, n).astype(float), rnd.integers(0, 6, n)
        own = [a / max(1, b) for a, b in zip(size, tags, strict=True)]
        for sigma, threshold in ((1.0, 0.5), (2.5, 1.0)):
            reach = max(1, int(3 * sigma))
            smooth = []
            for k in range(n):
                near = [(math.exp(-0.5 * ((j - k) / sigma) ** 2), own[j]) for j in range(max(0, k - reach), min(n, k + reach + 1))]
                smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            content, strong = html_text.clusters(size, tags, sigma, threshold)
            assert list(content) == [x >= threshold * sum(smooth) / n for x in smooth]
            assert list(strong) == [x >= threshold * sum(own) / n for x in own]


LINKS = "".join(f"<li><a href=/{k}>Link {k}</a>" for k in range(30))


PLAIN = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Title</h1>{STORY}<p>The end.</p></div><div>All rights kept 2024</div>"


@pytest.mark.parametrize("page", [f"<body><div><ul>{LINKS}</ul></div><div>{STORY}</div><div><ul>{LINKS}</ul></div>", f"<body><div>{STORY}</div><article><p>Read this too</p></article>"])
def test_ratio_decides(page, monkeypatch):
    """Without marks or telling elements only the ratio tells the story from links and teasers."""
    assert main_text(page) == WHOLE
    every = lambda size, *_: (np.ones(len(size), dtype=bool),) * 2
    monkeypatch.setattr(html_text, "clusters", every)
    assert main_text(page) != WHOLE


def test_plain_divs(monkeypatch):
    """No element and no name tells the article from menu and footer: the ratio of each line does."""
    want = f"Title\n{WHOLE}\nThe end."
    assert main_text(PLAIN) == want
    assert main_text(PLAIN.replace("All rights kept 2024", "© 2024 Company")) == want
    flat = PLAIN.replace("<div><h1>", "<h1>").replace("The end.</p></div>", "The end.</p>")
    assert main_text(flat) == want
    every = lambda size, *_: (np.ones(len(size), dtype=bool),) * 2
    monkeypatch.setattr(html_text, "clusters", every)
    assert main_text(PLAIN) != want and main_text(flat) != want


def test_header_of_an_article():
    assert main_text(f"<body><header>Site</header><article><header><h1>Title</h1></header>{STORY}<footer>Tags</footer></article>") == "Title\n" + WHOLE


def test_marks_are_whole_names():
    for name in ("ad-hoc", "search-engines", "social-policy", "menu-planning"):
        assert main_text(f"<body><article>{STORY}<section id={name}><p>{PARAS[0]}</p></section></article>") == f"{WHOLE}\n{PARAS[0]}", name
    for name in ("ad", "ad-slot-1", "cookieNotice", "user-feedback", "related-posts", "share_buttons", "site-footer", "widget-42", "comments-list"):
        assert main_text(f"<body><article>{STORY}<section id={name}><p>{PARAS[0]}</p></section></article>") == WHOLE, name


def test_pages_built_from_known_articles():
    """Random pages around an article that the test knows; every page must give exactly that article."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    for k in range(300):
        body, want = [], [say(rnd.randint(2, 7))]
        body.append(f"<h1>{want[0]}</h1>")
        for _ in range(rnd.randint(3, 12)):
            text = say(rnd.randint(25, 120))
            want.append(f"{text} & x")
            body.append(f"<p>{text} &amp; <b>x</b></p>" if rnd.random() < 0.8 else f"<p>{text}\n\t&amp;\u00a0x</p>")
        around = [
            "<ul>" + "".join(f"<li><a href=/{j}>{word()}</a></li>" for j in range(rnd.randint(2, 9))) + "</ul>",
            f"<form><input><label>{word()}</label></form>", f"<script>var x='{say(40)}'</script>", f"{say(2)}", f"<a href=/>{say(3)}</a>",
        ]
        marked = ['<div class="sidebar">', '<div id="cookie-banner">', '<div class="ad-box">', "<aside>", "<nav>", '<section class="comments">']
        top = [f"<div>{x}</div>" for x in rnd.sample(around, 2)]
        end = [f"<div>{x}</div>" for x in rnd.sample(around, 2)]
        boxes = [m + f"<p>{say(rnd.randint(3, 20))}</p></{m[1:].split()[0].rstrip('>')}>" for m in rnd.sample(marked, 2)]
        holder = rnd.choice(["article", "div", "main", "section"])
        page = "<html><head><title>T</title></head><body>" + "".join(top) + boxes[0] + f"<{holder}>{''.join(body)}</{holder}>" + boxes[1] + "".join(end) + "</body></html>"
        assert main_text(page) == "\n".join(want), (k, page)


def test_given_pages_by_a_plain_version():
    """All given pages hold one article: its text cut out by patterns, without the parser."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for row in pages:
        inner = re.search(r"<article[^>]*>(.*?)</article>", row["html"], re.S)
        if not inner:
            continue
        text = re.sub(r"<!--.*?-->|<(script|style|aside|nav|form)\b.*?</\1>", "", inner[1], flags=re.S)
        if re.search(r"class=|id=|role=", text):
            continue
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td|pre|section)\b[^>]*>", text)]
        assert main_text(row["html"]) == "\n".join(b for b in blocks if b), row["page_id"]


@pytest.mark.parametrize("parts", [("<div>a", ""), ("<b>a", "</i>"), ("<span class=ad><div>a", "</p>"), ("<b>", "<hr>a"), ("<article>a", "</section>")])
def test_deep_nesting_takes_linear_time(parts):
    start = time.perf_counter()
    main_text("<body>" + parts[0] * 100_000 + parts[1] * 100_000)
    assert time.perf_counter() - start < 30
