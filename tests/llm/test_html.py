import math
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import html

LONG = "This is a paragraph of the article, with some words; and it goes on, as they do."

CASES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a < b &amp; c<br>d&nbsp;e", "a < b & c d e"), ("<div><p>x <b>y</p><p>z</div>", "x y\nz"),
    (f"<article><h1>T</h1><p>{LONG}<p>Short.</article><footer>f</footer>", f"T\n{LONG}\nShort."),
    (f"<nav><a href=/>Home</a></nav><main><p>{LONG}</p></main><aside>s</aside>", LONG),
    (f"<header>Site</header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    (f"<body class='has-sidebar'><div id=content><p>{LONG}</p><div class='ad-box'>Buy, now, here!</div><p>End.</p></div><div class=comments><p>{LONG}</p></div>", f"{LONG}\nEnd."),
    (f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>{LONG}</p><ul><li>item a<li>item b</ul></div>", f"{LONG}\nitem a\nitem b"),
    (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div><p>{LONG}</p></div><form><p>{LONG}</p></form>", LONG),
    (f"<div><p>{LONG}</p><p>cut here <b>and <i", f"{LONG}\ncut here and"),
    (f"<div><p>{LONG}</p><p style='display: none'>hidden</p><p hidden>hidden</p></div>", LONG),
    (f"<div><table><tr><td>{LONG}<td>cell<tr><td>{LONG}</table></div>", f"{LONG}\ncell\n{LONG}"),
    ("<nav>only</nav><footer>menus</footer>", ""), (f"<div title=\"a>b\"><p>{LONG}</p></div>", LONG), ("<p>&lt;b&gt; &#233;&copy", "<b> é©"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_pages(page, want):
    assert html.main_text(page or "") == want


def test_generated_articles():
    """Articles of any shape come back whole, in order, without what surrounds them."""
    rng = random.Random(0)
    for _ in range(200):
        blocks = [" ".join(rng.choices(["alpha,", "beta", "gamma.", "Δ", "&amp;"], k=rng.choice([1, 3, 60]))) for _ in range(rng.randint(1, 12))]
        blocks[0] = "alpha, beta gamma. " * 20
        inner = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rng.choice(["p", "p", "p", "h2", "blockquote", "div"])])
        page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>m</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article>{inner}</article><aside>more</aside><footer>© x.</footer></body></html>"
        assert html.main_text(page) == "\n".join(b.replace("&amp;", "&").strip() for b in blocks)


@pytest.mark.parametrize("n", [1, 3, 30, 300])
def test_no_block_of_a_long_page_is_lost(n):
    """Title, lead and closing paragraph stand outside the body's element; nothing depends on the body's length."""
    body = "".join(f"<p>{LONG}</p>" for _ in range(n))
    want = "\n".join(["T", "A short lead.", *[LONG] * n, "The end."])
    assert html.main_text(f"<body><nav><a href=/>m</a></nav><div id=post><h1>T</h1><p>A short lead.</p><div class=entry>{body}</div><p>The end.</p></div><footer>f</footer></body>") == want
    nested = f"<div><h1>T</h1><div><p>A short lead.</p><div><div>{body}</div></div></div><p>The end.</p></div>"
    assert html.main_text(f"<body><div class=top><a href=1>a</a> <a href=2>b</a></div>{nested}<div class=cookies>Yes?</div></body>") == want


@pytest.mark.parametrize("n", [2, 40])
def test_words_alone_take_nothing_from_an_article(n):
    body = "".join(f"<p>{LONG}</p>" for _ in range(n))
    text = "\n".join([LONG] * n)
    for tag in ("article", "main"):
        page = lambda inner: html.main_text(f"<body><nav><a href=/>m</a></nav><div class=ad>Buy, now.</div><{tag}>{inner}</{tag}><div class=comments><p>{LONG}</p></div></body>")  # noqa: B023, E731
        assert page(f"<header class='entry-header'><h1>T</h1><p>A lead.</p></header>{body}") == f"T\nA lead.\n{text}"
        for name in ("section class=discussion", "div class='related-work'", "div id=widget-container"):
            part = f"<{name}><h2>Part</h2><p>{LONG}</p><p>Short.</p></{name.split()[0]}>"
            assert page(f"{body}{part * 3}<p>End.</p>") == "\n".join([text, *[f"Part\n{LONG}\nShort."] * 3, "End."])
        links = "<div class=share-box><a href=1>Share this now</a> <a href=2>Post it</a></div><div class=sidebar hidden><p>gone</p></div>"
        assert page(f"{body}{links}<p>End.</p><div class=ad>Buy now</div>") == f"{text}\nEnd."
    long = "word, " * 3000
    assert html.main_text(f"<article><p>{long}</p><section class=discussion><div>{LONG}</div></section><p>{LONG}</p><p>{LONG}</p></article>") == f"{long.strip()}\n{LONG}\n{LONG}\n{LONG}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ap div\"'=!-&;x\n", max_size=120))
def test_any_markup_is_read(page):
    text = html.main_text(page)
    assert "\n\n" not in text and text == text.strip()


def test_query(spark):
    rows = [(i, "u", page, 5) for i, (page, _) in enumerate(CASES)] + [(0, None, None, 5), (None, "u", f"<p>{LONG}" * 3000, 5)]
    got = html.op6(spark, spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text.count("\n") for r in got if r.page_id is None] == [2999]
    assert html.op6(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_what_an_article_holds_stays():
    body = f"<p>{LONG}</p>" * 4
    text = "\n".join([LONG] * 4)
    page = lambda inner: html.main_text(f"<body><nav><a href=/>m</a></nav><article>{inner}</article><footer>f</footer></body>")
    assert page(f'<div class="post-header"><h1>Title</h1></div>{body}') == f"Title\n{text}"
    assert page(f"{body}<h2>References</h2><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>") == f"{text}\nReferences\nOne\nTwo"
    assert page(f'<section class="search-results-discussion"><p>{LONG}</p></section>{body}') == f"{LONG}\n{text}"
    assert page(f'{body}<div class="notice-of-war">War was declared.</div>') == f"{text}\nWar was declared."
    assert page(f"{body}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>") == f"{text}\nSo x=1 holds."
    assert page(f'{body}<section id="comments"><div class="comment"><p>{LONG}</p></div></section>') == text
    apart = f"<body><main><article>{body}</article><section class=comments>{body * 3}</section></main></body>"
    assert html.main_text(apart) == text


def soup(rng):
    """A page of bare containers and what belongs to its article: nothing but the ratios tells them apart."""
    said = lambda n: " ".join(rng.choices(["alpha,", "beta", "gamma.", "delta"], k=n))
    parts = [said(rng.randint(30, 90)) for _ in range(rng.randint(2, 6))]
    frame = lambda: "".join(f"<span><div>{w}</div></span>" for w in rng.sample(["Home", "About us", "Shop now", "Archive", "Jobs", "Imprint"], 4))
    return f"<body><div><section>{frame()}</section></div><div><div>{'</div><div>'.join(parts)}</div></div><div><section>{frame()}</section></div></body>", "\n".join(parts)


def test_the_ratios_choose(monkeypatch):
    pages = [soup(random.Random(i)) for i in range(50)]
    assert all(html.main_text(p) == want for p, want in pages)
    for name, constant in (("fused_ratios", lambda length, *_: np.ones(len(length))), ("path_ratios", lambda paths, *_: (np.ones(len(paths)), np.ones(len(paths))))):
        with monkeypatch.context() as m:
            m.setattr(html, name, constant)
            assert all(html.main_text(p) != want for p, want in pages)
    table = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    with monkeypatch.context() as m:
        before = [html.main_text(p) for p, in table]
        m.setattr(html, "fused_ratios", lambda length, *_: np.ones(len(length)))
        assert sum(a != html.main_text(p) for a, (p,) in zip(before, table, strict=True)) > len(table) / 2
        m.undo()
        m.setattr(html, "WORDS", frozenset())
        assert sum(a != html.main_text(p) for a, (p,) in zip(before, table, strict=True)) <= len(table) / 50


class Tree(HTMLParser):
    """An independent reading of well-formed pages: blocks with their ancestors."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.found, self.links, self.n = [], [], 0, 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links += 1
        else:
            self.n += 1
            self.stack.append((tag, dict(attrs).get("class") or "", self.n))

    def handle_endtag(self, tag):
        if tag == "a":
            self.links -= 1
        else:
            self.stack.pop()

    def handle_data(self, data):
        self.found.append((tuple(self.stack), data, len(data) if self.links else 0))


def brute(page, share=0.25):
    """Definitions of the module's docstring, path by path and element by element, on pages whose text lies in leaves."""
    words = {"ad", "notice", "related", "sidebar"}
    blocks = [b for b in Tree(page).found if not any(t in ("nav", "footer", "aside") for t, *_ in b[0])]
    named = lambda e: e[1] in words and e[0] != "article"
    path = lambda b: [(e[0], e[1] if e[0] in html.NAMES else "", named(e)) for e in b[0]]
    under = lambda b, tags: any(t in tags for t, *_ in b[0])
    n = len(blocks)
    if all(k == len(t) for _, t, k in blocks):
        return ""
    ratio = []
    for b in blocks:
        own = [x for x in blocks if path(x) == path(b)]
        ratio.append((sum(len(t) - k for _, t, k in own) / len(own), sum(len(re.findall("[.,]", t)) for _, t, _ in own) / len(own)))
    score = []
    for i, b in enumerate(blocks):
        w = [math.exp(-0.5 * d * d) for d in range(-2, 3)]
        length, marks = (sum(w[d + 2] * ratio[min(max(i + d, 0), n - 1)][k] for d in range(-2, 3)) / sum(w) for k in (0, 1))
        inside = under(b, ("article", "main"))
        score.append((length + (40 if inside else 0)) * (1 + marks) * (4 if inside else 1) * (0.2 if any(map(named, b[0])) else 1) * (b[2] < len(b[1])))
    content = [any(score[j] >= share * max(score) for j in range(n) if path(blocks[j]) == path(b)) and b[2] < len(b[1]) for b in blocks]
    marked = [any(map(named, b[0])) for b in blocks]
    needed = [c or b[0][-1][0] in ("p", "h1", "h2") and not m and 2 * b[2] < len(b[1]) for b, c, m in zip(blocks, content, marked, strict=True)]
    holders = [e for b in blocks for e in b[0] if e[0] in ("article", "main") and all(e in x[0] for x, c in zip(blocks, content, strict=True) if c)]
    chains = [b[0] for b, k in zip(blocks, needed, strict=True) if k]
    common = []
    for column in zip(*chains):  # noqa: B905
        if len(set(column)) > 1 or common and common[-1][0] in ("article", "main") or column[0][0] in html.ENDS:
            break
        common.append(column[0])
    top = max(holders, key=lambda e: e[2]) if holders else common[-1] if common else None
    plain = [a * (1 + m) for a, m in ratio]
    least = min(100.0, share * max(plain))
    out = []
    for b in blocks:
        if top is not None and top not in b[0]:
            continue
        for e in b[0][b[0].index(top) + 1 if top is not None else 0 :]:
            if named(e):
                held = [j for j in range(n) if e in blocks[j][0]]
                if not any(blocks[j][0][-1][0] in ("h1", "h2") for j in held) and (
                        2 * sum(blocks[j][2] for j in held) >= sum(len(blocks[j][1]) for j in held) or not any(plain[j] >= least for j in held)):
                    break
        else:
            out.append(b[1])
    return "\n".join(out)


def test_against_brute_force():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices(["alpha,", "beta", "gamma.", "delta"], k=n))

    def leaf():
        tag = rng.choice(["p", "p", "p", "div", "h1", "h2", "blockquote"])
        text = say(rng.choice([1, 2, 5, 12, 40, 150]))
        return f"<{tag}>{text}</{tag}>" if rng.random() > 0.15 else f"<{tag}><a href=x>{text}</a></{tag}>"

    def part(depth):
        name = rng.choice(["", "", " class=ad", " class=related", " class=notice", " class=entry"])
        tag = rng.choice(["div", "div", "section", "article" if depth < 2 else "div"])
        return f"<{tag}{name}>{''.join(part(depth + 1) if rng.random() < 0.35 and depth < 4 else leaf() for _ in range(rng.randint(1, 5)))}</{tag}>"

    for _ in range(400):
        page = f"<body>{''.join(rng.choice([part(0), leaf(), '<nav><p>Menu</p></nav>', '<footer><p>Foot, end.</p></footer>']) for _ in range(rng.randint(1, 4)))}</body>"
        assert html.main_text(page) == brute(page), page


def test_time_and_memory_are_linear_in_depth():
    def seconds(page):
        at = time.process_time()
        html.main_text(page)
        return time.process_time() - at

    for make in (lambda n: "<div>" * n + LONG, lambda n: "<b>" * n + "<div></div>" * n + LONG, lambda n: "<div>" * n + "<li>x</li>" * n, lambda n: "<div><p>a" * n):
        seconds(make(1000))
        assert seconds(make(40_000)) < 12 * max(0.05, seconds(make(5_000)))
