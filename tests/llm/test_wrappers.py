"""Wrapper inference and main-text extraction."""

from __future__ import annotations

import html
import re

import pytest

from quarry.llm import wrappers as X

SHELL = """<!DOCTYPE html><html><head><title>T {t}</title><style>p{{x}}</style></head><body class="page">
<header class="site-header"><a href=/>Home</a> Site name</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="layout"><div class="story">{body}</div><aside>About</aside></div>
<form action=x><input name=q> Search</form><div class="comments"><p>Reader says {t}</p></div>
<script>var a = "</p><p>no";</script><!-- <p>hidden</p> --><footer>&copy; 2020</footer></body></html>"""


def page(i):
    paras = "".join(f"<p>Paragraph {k} of page {i} &amp; more&nbsp;text,   with <b>bold</b> words that make it long.</p>" for k in range(2 + i % 3))
    ad = '<div class="ad-box">Buy now</div>' if i % 2 else ""
    return SHELL.format(t=i, body=f"<h1>Title {i}</h1>{ad}{paras}")


def want(i):
    return "\n\n".join([f"Title {i}"] + [f"Paragraph {k} of page {i} & more text, with bold words that make it long." for k in range(2 + i % 3)])


def test_wrapper_groups():
    w = X.infer([page(i) for i in range(6)])
    path = X.main_path(w, 6)
    assert path[-1].startswith("div class=story")
    at = w
    for sig in path:
        at = next(k for k in at.kids if k.sig == sig)
    kinds = {k.sig: (k.repeated, k.optional, k.text) for k in at.kids}
    assert kinds["p"] == (True, False, None)
    assert kinds["div class=ad-box"][1] and not kinds["h1"][1] and kinds["h1"][2] is None


def test_extraction_without_article_element(spark):
    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(20)]
    rows += [(20, None, None, "x"), (21, "nonsense", "", "x"), (22, "http://b.example/1", "<p>Only &lt;this&gt; &am", "x"),
             (23, "http://a.example/zz", "<div class='story'><p>Odd one</p></div>", "x"), (24, "http://c.example/", "<!-- never closed <p>x", "x"),
             (25, "http://d.example/", "<article><h1>A</h1><p><b>B c<br>d<br><p>E\n f</p></article><footer>no</footer>", "x"),
             (25, "http://d.example/", "<article><h1>A</h1><p><b>B c<br>d<br><p>E\n f</p></article><footer>no</footer>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in X.main_text(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for i in range(20):
        assert got[i] == [want(i)]
    assert got[20] == [""] and got[21] == [""] and got[22] == ["Only <this> &am"] and got[24] == [""]
    assert got[25] == ["A\n\nB c d\n\nE f"] * 2
    assert len(got) == 26
    assert X.main_text(df.limit(0)).count() == 0


def plain(source):
    m = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    source = {(r["page_id"], r["url"]): r["html"] for r in df.collect()}
    rows = X.main_text(df).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == plain(source[(r["page_id"], r["url"])])


def test_broken_markup_is_linear():
    for source in ["<a \"" * 20000, "<" * 50000, "<p" * 20000 + ">", "<div>" * 3000 + "x", "<!--" * 5000, "<script>" * 2000, "</p>" * 20000]:
        X.extract(source, None)


@pytest.mark.parametrize("odd, want", [
    ('<svg viewBox="0 0 1 1"/>', "A\n\nB"), ("<svg><title>t</title><text>no</text></svg>", "A\n\nB"), ("<math/>", "A\n\nB"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "A\n\nso x=2 holds\n\nB"), ("<object data=x />", "A\n\nB"),
    ("<object data=x>", "A\n\nB"), ("<div><noscript>on</div>", "A\n\non\n\nB"), ("<noscript>no</noscript>", "A\n\nB"),
    ("<select><option>no", "A\n\nB"), ("<textarea>", "A\n\nB"), ("<div><script>no</div>", "A\n\nB")])
def test_unclosed_and_self_closed_elements_cut_nothing_else(odd, want):
    assert X.extract(f"<body><article><p>A</p>{odd}<p>B</p></article><footer>F</footer></body>", None) == want


@pytest.mark.parametrize("source, want", [
    ("<main><article><p>" + "a" * 60 + "</p></article><section><p>" + "b" * 40 + "</p></section></main>", ["a" * 60, "b" * 40]),
    ("<main><header><h1>T</h1></header><article><p>a</p></article></main>", ["T", "a"]),
    ("<article class=x><header class=header><h1>T</h1></header><p>a</p></article>", ["T", "a"]),
    ("<div class=intro><p>" + "i" * 35 + "</p></div><div class=rest><p>" + "r" * 65 + "</p></div><footer>no</footer>", ["i" * 35, "r" * 65]),
    ("<article class=a><p>one</p></article><article class=b><p>two</p></article><nav>no</nav>", ["one", "two"]),
    ("<main><article><p>a</p></article><article><p>b</p></article></main>", ["a", "b"]),
    ("<header>Site</header><div class=intro><p>i</p></div><div class=rest><p>r</p></div>", ["i", "r"]),
    ("<article><p>a</p><p class=ad-box>no</p><p class=site-footer>no</p></article><div class=comments>no</div>", ["a"]),
    *(f"<article><p>a</p><div class={c}><p>b</p></div></article>|a b".split("|") for c in
      "related-work search-method notice-period social-history ad-hoc form-factor header".split())])
def test_all_of_the_main_text(source, want):
    assert X.extract(f"<body>{source}</body>", None) == "\n\n".join(want if isinstance(want, list) else want.split())


FRAMES = ['<div id="wrap"><div class="lead">{s}</div><div class="body-{t}">{b}</div></div>',
          '<section class="top"><p>{s}</p></section><section class="s{t}"><div class="text">{b}</div></section>',
          '<div class="grid"><div class="cell"><div class="copy{t}">{b}</div></div><div class="cell side">{s}</div></div>',
          '<center>{s}</center><div class="text{t}">{b}</div>',
          '<div class="only{t}"><div class="teaser">{s}</div><div class="long">{b}</div></div>']


def framed(t, i):
    body = "".join(f"<p>Sentence {k} number {i} of template {t} goes on for a while &amp; ends.</p>" for k in range(2 + i % 4))
    return f"<html><body><nav>Menu</nav>{FRAMES[t].format(s='Same slogan on every page', t=t, b=body)}<footer>End</footer></body></html>"


@pytest.mark.parametrize("joined", [False, True])
def test_five_templates_of_one_host_without_article_elements(spark, monkeypatch, joined):
    """One of them on 1 % of the pages; each page is cut by its own template."""
    if joined:
        monkeypatch.setattr(X, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(X, "HELD_WRAPPERS", 3)
    which = [4 if i % 100 == 7 else i % 4 for i in range(400)]
    rows = [(i, f"http://one.example/{i}", framed(t, i)) for i, t in enumerate(which)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = X.wrappers(df).collect()
    assert sorted(r["n_pages"] for r in found) == sorted(which.count(t) for t in range(5))
    got = {r["page_id"]: r["text"] for r in X.main_text(df).collect()}
    for i, t in enumerate(which):
        assert got[i] == "\n\n".join(f"Sentence {k} number {i} of template {t} goes on for a while & ends." for k in range(2 + i % 4))


def test_merged_wrappers_equal_one_alignment_of_all_pages():
    sources = [page(i) for i in range(12)]
    left, right = X.infer(sources[:5]), X.infer(sources[5:])
    both = X._align(X.unpack(X.pack(left)), X.unpack(X.pack(right)))
    assert X.pack(both) == X.pack(X.infer(sources))
    assert X.main_path(both, 12) == X.main_path(X.infer(sources), 12)
