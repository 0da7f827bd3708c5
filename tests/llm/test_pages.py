"""Main text of pages: the model on layouts it has not seen, messages against enumeration, odd pages."""

import html
import itertools
import re

import numpy as np
import pytest

from riskpanel.llm import html_extract, labelled_pages, queries
from riskpanel.llm.html_tree import DEEPEST, Forest

SCHEMA = "page_id long, url string, html string, text string, n_chars int, kept boolean"


def extract(spark, pages):
    rows = [(i, f"u{i}", page, "t", 1, True) for i, page in enumerate(pages)]
    return [r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, SCHEMA).repartition(2)).orderBy("page_id").collect()]


def test_given_pages(spark):
    """The given pages hold their article in one element: every page comes out exactly."""
    sf = "/root/testdata/sf0.01"
    wanted = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article.replace("<br>", " ")))
        wanted[r.page_id] = "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
    found = queries.op11_html_extraction(spark, sf)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert {r.page_id: r.text for r in rows} == wanted and all(r.n_chars == len(r.text) for r in rows)


def test_other_layouts():
    forest = Forest(labelled_pages.MARK)
    for page in labelled_pages.pages(200, seed=77):
        forest.add(page)
    content = html_extract.layout_model().content(forest)
    truth = np.array([marked for *_, marked in forest.runs])
    found = np.array([content[node] >= 0.5 for node, *_ in forest.runs])
    assert (found & truth).sum() >= 0.97 * truth.sum() and (found & truth).sum() >= 0.98 * found.sum()


@pytest.mark.parametrize("seed", range(4))
def test_messages_give_exact_marginals(seed):
    draw = np.random.default_rng(seed)
    forest = Forest()
    forest.parent, forest.depth = [-1, 0, 1, 1, 0, 4, 4, 6, -1, 8], [0, 1, 2, 2, 1, 2, 2, 3, 0, 1]
    n = len(forest.parent)
    unary, pair = draw.normal(size=n) * 2, draw.normal(size=(n, 2, 2)) * 2
    weights = {}
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(unary[i] * labels[i] + (pair[i, labels[forest.parent[i]], labels[i]] if forest.parent[i] >= 0 else 0) for i in range(n))
        weights[labels] = np.exp(score)
    total = sum(weights.values())
    found = html_extract.pass_messages(unary, pair, forest.levels(), with_pairs=True)
    for i in range(n):
        assert np.isclose(found.content[i], sum(w for y, w in weights.items() if y[i]) / total)
        if forest.parent[i] >= 0:
            for a, b in itertools.product((0, 1), repeat=2):
                assert np.isclose(found.pairs[i, a, b], sum(w for y, w in weights.items() if (y[forest.parent[i]], y[i]) == (a, b)) / total)


def test_gradient_fit_learns_own_labels():
    """A caller's labels decide: here the sidebar is the main text."""
    page = "<html><body><article><p>{0} is said here at length, and more of it.</p></article><aside><p data-main>{0} is what we want from the side, all of it.</p></aside></body></html>"
    model = html_extract.fit([page.format(word) for word in ("This", "That", "Such", "Much", "More")], steps=200)
    assert model.texts([page.format("None")]) == ["None is what we want from the side, all of it."]


PROSE = "The quick brown fox jumps over the lazy dog, and runs away into the dark wood. Nobody has seen it since then."


def test_blocks_and_references(spark):
    pages = [
        f"<article><h1>A &amp; B</h1><p>{PROSE}\n two&nbsp;&nbsp;spaces<br>and &#233;&#x41;&copy &am</p><p>{PROSE} &lt;p&gt;</article>",
        f"<body><div class='post'>{PROSE}<div class=ad>Buy <a href=x>this now</a></div>{PROSE}<script>var a='<p>x</p>'</script><!-- <p>no</p> --></div>",
        f"<main><p>{PROSE}<p>{PROSE}<ul><li>{PROSE}<li>{PROSE}</ul></main><section class='comments'><p>{PROSE}</p></section>",
    ]
    assert extract(spark, pages) == [
        f"A & B\n{PROSE} two spaces and éA© &am\n{PROSE} <p>",
        f"{PROSE}\n{PROSE}",
        "\n".join([PROSE] * 4),
    ]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>" + "</div>" * 3000
    long = "<article>" + f"<p>{PROSE}</p>" * 12_000 + "</article>"
    broken = f"<article><p>{PROSE}</p></b></nope><p title=\"5\" tall\">{PROSE}</p> a < b <"
    got = extract(spark, [None, "", "   ", "<", "<script>", "<!-- x", deep, long, broken, broken])
    assert got[:6] == ["", "", "", got[3], "", ""] and got[3] in ("", "<")
    assert DEEPEST < 3000 and got[6] in ("", PROSE) and got[7] == "\n".join([PROSE] * 12_000)
    assert got[8] == got[9] and got[8].startswith(f"{PROSE}\n{PROSE}")
    assert html_extract.extract(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, None, f"<article><p>{PROSE}</p></article>", "t", 1, True)] * 3, SCHEMA)
    assert [tuple(r) for r in html_extract.extract(spark, rows).collect()] == [(None, None, PROSE, len(PROSE))] * 3
