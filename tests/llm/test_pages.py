"""Main text of pages whose text is known, with null, empty, repeated and oddly formed rows."""

import html as h
import os

import numpy as np
import pytest

from antipode.llm import page_text
from antipode.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, _html string, n_chars int"


def built(seed, article=True):
    """(page, its text): paragraphs with markup, references and white space, between menus, notices and scripts."""
    rng = np.random.default_rng(seed)
    words = ["harbour", "tide", "naïve", "a < b", "R&D", "“quoted”", "slow", "engine", "field", "seven", "日本"]
    say = lambda n: " ".join(rng.choice(words, n))
    paragraphs = [say(int(rng.integers(25, 60))) for _ in range(int(rng.integers(3, 7)))]
    marked = lambda p: "<p>\n  " + h.escape(p).replace(" ", " \n\t", 1).replace("tide", "<b>tide</b>") + " </p>"
    links = "".join(f"<li><a href='/{i}'>{say(2)[:9].replace('<', '').replace('&', '')}</a></li>" for i in range(12))
    body = "".join(marked(p) for p in paragraphs)
    page = (f"<html><head><title>t</title><style>p {{ color: red }}</style><script>var x = '<p>no</p>';</script></head><body>"
            f"<nav><ul>{links}</ul></nav><header>Site name</header>{'<article>' if article else '<div>'}{body}{'</article>' if article else '</div>'}"
            f"<aside><ul>{links}</ul></aside><form><input value='q'>Search</form><footer>© all rights</footer></body></html>")
    return page, "\n\n".join(" ".join(p.split()) for p in paragraphs)


def extracted(spark, rows, **settings):
    df = spark.createDataFrame([(i, f"u{i}", x, "clash", "clash", 3) for i, x in rows], PAGES).repartition(3)
    return page_text.extract_pages(df, keep=["url"], **settings).collect()


@pytest.mark.parametrize("article", [True, False])
def test_text_of_built_pages(spark, article):
    pages = {i: built(i, article) for i in range(12)}
    got = {r.page_id: r for r in extracted(spark, [(i, p[0]) for i, p in pages.items()])}
    for i, (_, text) in pages.items():
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].url == f"u{i}"


def test_odd_pages(spark):
    page, text = built(99)
    long_page, long_text = built(5)
    long_text = "\n\n".join([long_text] * 200)
    long_page = long_page.replace("</article>", "") .split("<article>")[0] + "<article>" + "".join(
        f"<p>{h.escape(p)}</p>" for p in long_text.split("\n\n")) + "</article></body></html>"
    rows = [(1, None), (2, ""), (3, " \n"), (4, page), (4, page), (None, page), (5, "<p"), (6, "<nav><a href='x'>only a link</a></nav>"),
            (7, "<script>var a = 1;</script>"), (8, "plain text without any markup"), (9, long_page), (10, page[: len(page) // 2])]
    got = extracted(spark, rows)
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == by[2] == by[3] == by[6] == by[7] == [""]
    assert by[4] == [text, text] and by[None] == [text] and by[8] == ["plain text without any markup"]
    assert by[9] == [long_text]
    assert extracted(spark, []) == []


def test_smoothed_ratio_decides_without_an_article():
    """With a constant ratio the lines of a page without an article are chosen otherwise."""
    rng = np.random.default_rng(1)
    block = lambda n: " ".join(rng.choice(["river", "stone", "wide", "evening", "market"], n))
    noise = "".join(f"<div><span>{block(2)}</span><i></i><b></b><u></u></div>" for _ in range(25))
    page = f"<body>{noise}{''.join(f'<p>{block(60)}</p>' for _ in range(6))}{noise}</body>"
    text = page_text.main_text(page)
    kept = page_text.smoothed
    try:
        page_text.smoothed = lambda ratio: np.ones_like(ratio)
        assert page_text.main_text(page) != text
    finally:
        page_text.smoothed = kept


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")
def test_query_covers_every_page(spark):
    got = QUERIES["op10_page_text"](spark, SF_DIR)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == pages.count()
    assert got.where("text IS NULL OR n_chars <> length(text)").count() == 0
