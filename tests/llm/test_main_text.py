"""Minimum cuts against trying every labelling, and pages of many kinds."""

import html
import itertools
import random
import re

import odd
import pytest

from runloom.llm import main_text as M
from runloom.llm.queries import QUERIES


def cost(scores, edges, labels):
    total = sum(max(0, s) if not kept else max(0, -s) for s, kept in zip(scores, labels, strict=True))
    return total + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cuts_against_every_labelling():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.choice([-3, -1.5, -0.4, 0, 0.3, 1, 2.5]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.2, 0.5, 1.0])) for a in range(n) for b in range(a)
                 if rng.random() < 0.4]
        got = M.minimum_cut(scores, edges)
        best = min(cost(scores, edges, x) for x in itertools.product([True, False], repeat=n))
        assert cost(scores, edges, got) == pytest.approx(best)


LONG = "This is a sentence of the article, with enough words in it to be told from a menu. "


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("no markup at all, but a whole sentence that reads like a text of its own kind.",
               "no markup at all, but a whole sentence that reads like a text of its own kind."),
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article>"
     f"<footer>(c) all of us</footer>", f"Title {LONG}Short."),
    (f"<article><p>a&amp;b &lt;c&gt; &#233;&nbsp;&eacute;  x\n y {LONG}<script>no()</script></p></article>",
     f"a&b <c> é é x y {LONG.strip()}"),
    (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p></div>", LONG.strip()),
    (f"<main><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></main>", LONG.strip()),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}<div class=ad>{LONG}</div></article>",
     LONG.strip()),
    (f"<main><p>{LONG}<form><label>Mail</label><input><button>Go</button></form></main>", LONG.strip()),
    (f"<nav><ul><li><a href='/a'>never closed<article><p>{LONG}</p></article>", LONG.strip()),
    (f"<article><p><b>bo<i>ld</i>er</b> t<!-- no -- > <p> -->ext {LONG}</article>",
     f"bolder text {LONG.strip()}"),
    (f"<article><p title='a > b' data-x=\"<p>\">{LONG}</p></article>", LONG.strip()),
    (f"<article class='post has-sidebar'><p>{LONG}</p></article><article class=comment>{LONG}</article>",
     LONG.strip()),
    (f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><main>{LONG}</main>", LONG.strip()),
])
def test_pages(page, want):
    assert M.main_text(page) == want


VALUE = "y > z " * 500
SCRIPT = "</article> <script>" + "v " * 1300


@pytest.mark.parametrize("page", [
    f"<article><p data-x=\"{VALUE}\">{LONG}</p></article>", f"<article><p data-x='{SCRIPT}'>{LONG}</p></article>",
    f"<article><p data-x = \"{SCRIPT}\" hidden-by=none title=\"the hidden part\">{LONG}</p></article>",
    f"<article><p title=it's>{LONG}</p></article><footer title=\"that's\">x</footer>",
    f"<article><p>{LONG}</p></article><p title=\"never closed>"])
def test_attribute_values_of_any_length(page):
    assert M.main_text(page) == LONG.strip()


@pytest.mark.parametrize(("inside", "want"), [
    (f"<svg width=1>{LONG}", LONG.strip() + " " + LONG.strip()),
    (f"<select>{LONG}", LONG.strip() + " " + LONG.strip()),
    (f"<svg><title>icon</title></svg>{LONG}", LONG.strip() + " " + LONG.strip()),
    (f"{LONG}<math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds.", f"{LONG}x+1 holds. {LONG.strip()}"),
    (f"<noscript><p>{LONG}</p></noscript>", LONG.strip() + " " + LONG.strip()),
    (f"<iframe src=x>{LONG}</iframe><template><p>{LONG}</p></template>", LONG.strip())])
def test_elements_inside_an_article(inside, want):
    assert M.main_text(f"<article>{inside}<p>{LONG}</p></article>") == want


def test_broken_and_long_pages_end():
    for page in ("<" * 50_000, "<p " * 20_000, "<div>" * 20_000, "<a href=\"" * 5_000,
                 "<svg>" * 20_000, "<p x=\"" * 5_000, "<p x='\">" * 20_000, "<!--" * 20_000, "</p>" * 20_000, "<p>x" * 5_000, "<script>" + "x" * 50_000):
        assert isinstance(M.main_text(page), str)


def test_odd_pages(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (3, "u", "", None),
            (None, None, "<p>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"),
            (4, "u", f"<article><p>{LONG * 3000}</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in M.query_rows(pages).collect()]
    want = [(1, "u", LONG.strip(), len(LONG) - 1), (2, None, "", 0), (3, "u", "", 0), (None, None, "", 0),
            (1, "u", LONG.strip(), len(LONG) - 1), (4, "u", (LONG * 3000).strip(), 3000 * len(LONG) - 1)]
    assert odd.keyed(got) == odd.keyed(want)
    assert M.extract(pages).columns == [*pages.columns, "text_"]
    assert M.query_rows(pages.limit(0)).collect() == []


def test_query_against_the_articles(spark, sf_dir):
    """The given pages have one article element each; what it holds is their main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = {}
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        inside = re.sub(r"<[^>]+>", "", re.sub(r"</?(h1|p|br)>", " ", inside))
        want[page["page_id"]] = " ".join(html.unescape(inside).split())
    got = QUERIES["op8_main_text"](spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(pages)
