"""Extraction against labels that it does not see, a plain search of all runs, and pages with odd markup."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codestrata.llm import html_extract as x

WORDS = "river stone paper window garden letter winter music ladder copper".split()


def article(r):
    blocks = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 9)))] + [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))) for _ in range(r.randint(2, 8))]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    links = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in r.sample(WORDS, 5))
    page = f"<html><head><title>{blocks[0]}</title></head><body><nav><ul>{links}</ul></nav><div class=zebra>buy this paper now and save</div><article>{inner}</article><footer>contact us here</footer></body></html>"
    return page, "\n".join(blocks)


def test_finds_the_content_of_pages_whose_labels_are_hidden():
    r = random.Random(1)
    odds = x.weights(x.count([article(r)[0] for _ in range(100)]))
    assert odds["name", "zebra"] < x.OUTSIDE_SCORE  # learned, no prior knows it
    for _ in range(100):
        page, want = article(r)
        assert x.extract(page, odds) == want
        assert x.extract(page.replace("article>", "div>"), odds) == want


def test_best_run_equals_all_runs():
    r = random.Random(2)
    for _ in range(300):
        score = [r.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(r.randint(0, 14))]
        a, b = x.best_run(score)
        assert sum(score[a:b]) == max([0, *(sum(score[i:j]) for i in range(len(score)) for j in range(i, len(score) + 1))])


PROBES = [
    ('<div class="content has-sidebar"><p>One two three.</p></div>', "One two three."),
    ('<div class="layout-with-sidebar"><article><p>One two</p></article></div>', "One two"),
    ('<article><h2 class="section-header">Head</h2><p class="social-history">Two words</p></article>', "Head\nTwo words"),
    ("<nav><a href=x>m</a></nav><div><h1>Story of it</h1><p>" + "word " * 20 + "</p><table>" + "<tr><td>a</td><td>1</td></tr>" * 30 + "</table><p>after the table some more text</p></div><footer>f</footer>", "Story of it\n" + ("word " * 20).strip() + "\n" + "a\n1\n" * 30 + "after the table some more text"),
    ("<article><p>A b c</p><ul>" + "<li><a href=x>link</a></li>" * 10 + "</ul><p>End.</p></article>", "A b c\n" + "link\n" * 10 + "End."),
    ("<article><p>" + "a " * 30 + "</p><aside><p>" + "x " * 200 + "</p></aside><p>" + "b " * 20 + "</p></article>", ("a " * 30).strip() + "\n" + ("b " * 20).strip()),
    ('<div class="site-footer">contact</div><p>Kept text</p><div id=comments><p>first!</p></div>', "Kept text"),
    ("<p hidden>no</p><p>yes</p><div style='display: none'>no</div>", "yes"),
]


@pytest.mark.parametrize("k", range(len(PROBES)))
def test_probe(k):
    r = random.Random(3)
    page, want = PROBES[k]
    for odds in ({}, x.weights(x.count([article(r)[0] for _ in range(50)]))):
        assert x.extract(page, odds) == want


def test_time_is_linear_in_open_tags():
    def took(n):
        t = time.process_time()
        x.extract("<div>" * n + "text", {})
        x.extract("<div><b>" * n + "<p>text</i>" * n, {})
        return time.process_time() - t

    took(1000)
    assert took(40_000) < 12 * took(10_000)


def test_columns_with_clashing_names(spark):
    rows = [(1, "u", "<article><p>a b</p></article>", "own", 7), (1, "u", "<article><p>a b</p></article>", "own", 7), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").withColumn("h", F.lit(1))
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in x.extracted(pages).collect())
    assert got == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
