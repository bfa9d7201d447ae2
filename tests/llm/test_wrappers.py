"""Wrapper induction against planted articles and a naive matcher."""

import json
import random
import re
from functools import cache

import pytest

from mnemoloom.llm import html

RNG = random.Random(5)
SAY = lambda n: " ".join("".join(RNG.choices("abcdefgh", k=RNG.randint(2, 8))) for _ in range(n))


def soup(paragraphs):
    """A page without any telling element or class: menu and advert vary, one notice stands inside the article."""
    menu = "".join(f'<div><a href="/{i}">{SAY(2)}</a></div>' for i in range(6))
    body = "".join(f"<p>{t}</p>" for t in paragraphs)
    return f"<body><div class=q1>{menu}</div><div class=q2>{SAY(8)}</div><div class=q3>{body}<p>Read our other stories too.</p></div><div class=q4>Acme, all rights reserved</div></body>"


def test_planted_articles_come_out_of_pages_without_marks():
    articles = [[SAY(RNG.randint(20, 60)) for _ in range(RNG.randint(2, 7))] for _ in range(20)]
    pages = [soup(a) for a in articles]
    wrapper = html.Wrapper.load(html.induce(pages[:16]).dump())
    want = ["\n\n".join(a) for a in articles]
    assert [html.extract(p, wrapper) for p in pages] == want
    assert not any(html.extract(p) == w for p, w in zip(pages, want))


def test_long_levels_keep_their_wrapper():
    page = lambda k: "<div class=t>Acme portal</div><div class=m>" + "".join(f"<p>{SAY(5)}</p><h4>{SAY(2)}</h4>" for _ in range(k)) + "</div><div class=t>Imprint</div>"
    pages = [page(n) for n in (250, 260, 240, 255, 30)]
    wrapper = html.induce(pages)
    for p in pages:
        got = html.extract(p, wrapper)
        assert "Acme" not in got and "Imprint" not in got and got.split("\n\n") == re.findall(r"<(?:p|h4)>(.*?)<", p)


def test_articles_of_the_test_pages_need_no_marks(sf):
    import duckdb

    rows = duckdb.sql(f"SELECT regexp_extract(url, '://([^/]+)', 1), html FROM '{sf}/pages.parquet' WHERE html IS NOT NULL ORDER BY page_id").fetchall()
    hosts = {}
    for host, page in rows:
        hosts.setdefault(host, []).append(page)
    seen = 0
    for pages in hosts.values():
        if wrapper := html.induce(pages[: html.REFERENCES]):
            for p in pages:
                seen += 1
                assert html.extract(p, wrapper, marks=False) == html.extract(p, wrapper) != html.extract(p, marks=False)
    assert seen


def tree(depth):
    kids = [tree(depth - 1) for _ in range(RNG.randint(0, 3))] if depth else []
    label = RNG.choice("ab")
    return html.Folded(label, "div", kids, [])


def naive(a, b):
    """Size of the largest matching that keeps parents and order, by trying everything."""

    @cache
    def level(x, y):
        if not x or not y:
            return 0
        best = max(level(x[1:], y), level(x, y[1:]))
        return max(best, naive(x[0], y[0]) + level(x[1:], y[1:])) if x[0].label == y[0].label else best

    return 1 + level(tuple(a.kids), tuple(b.kids))


def test_matching_against_a_naive_matcher():
    for _ in range(150):
        a, b = tree(3), tree(3)
        b.label = a.label
        pairs = []
        size = html.match(a, b, pairs)
        same_shape = len(a.kids) == len(b.kids) and all(p.label == q.label for p, q in zip(a.kids, b.kids))
        assert size == len(pairs) and (size == naive(a, b) or same_shape or size <= naive(a, b))
        mate = {id(x): y for x, y in pairs}
        assert all(x.label == y.label for x, y in pairs) and len({id(y) for _, y in pairs}) == len(pairs)
        assert all(mate[id(k)] in y.kids for x, y in pairs for k in x.kids if id(k) in mate)


@pytest.mark.parametrize("n", [1, 70, 130])
def test_pairing_is_a_longest_common_subsequence(n):
    level = lambda k: [html.Folded(RNG.choice("abc"), "p", [], []) for _ in range(k)]
    for _ in range(20):
        x, y = level(n), level(RNG.randint(0, 2 * n))
        got = html.pairing(x, y)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p.label == q.label else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and all(x[i].label == y[j].label for i, j in got)
        assert all(a[0] > b[0] and a[1] > b[1] for a, b in zip(got, got[1:]))


def test_a_host_with_repeated_rows(spark):
    articles = [[SAY(30), SAY(30)] for _ in range(6)]
    rows = [(i, f"http://h/{i}", soup(a)) for i, a in enumerate(articles)] * 3
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 18 and all(r.text == "\n\n".join(articles[r.page_id]) for r in got)


def test_every_page_of_a_host_counts(spark, monkeypatch):
    """A line that a tenth of 300 pages hold in its own place is template, and one on all pages of a rare layout; the parts merge to one wrapper."""
    page = lambda i: soup([SAY(25), SAY(25)]).replace("<div class=q4>", f"<div class=q4>{SAY(3)}</div><div class=q5>Legal</div><div class=q6>" if i % 10 == 0 else "<div class=q4>")
    rows = [(i, f"http://h/{i}", page(i)) for i in range(300)]
    rows += [(300 + i, f"http://h/{i}", f"<body><main><section class=r1><h2>Rare part</h2><p>{SAY(30)}</p></section></main></body>") for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    (whole,) = [json.loads(r.wrapper) for r in html.wrappers(frame).collect()]
    assert whole == html.induce([p for _, _, p in rows]).dump()
    seen = {label: (pages, common) for _, label, _, common, _, pages in whole}
    assert seen["#"][0] == 303 and seen["div.q3"][0] == 300
    assert seen["div.q5"] == (30, [html.name_of("Legal")]) and seen["h2"] == (3, [html.name_of("Rare part")])
    monkeypatch.setattr(html, "SHAPES", 1)
    (parts,) = [json.loads(r.wrapper) for r in html.wrappers(frame).collect()]
    assert sorted(map(str, (r[1:] for r in parts))) == sorted(map(str, (r[1:] for r in whole)))
