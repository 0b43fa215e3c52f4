"""Extraction of main text: the trees, the marginals against all assignments, whole pages against their templates."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest
from compare import SF

from lumisonde.llm import dom_extraction as d
from lumisonde.llm import queries

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return d.fit(pages)


def plain(source: str) -> str:
    """The article of a page of the tables, by its template."""
    inner = re.search("<article>(.*)</article>", source, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark, pages):
    want = {(r.page_id, r.url): plain(r.html) for r in pages.collect()}
    got = queries.op12_main_text(spark, SF).collect()
    assert {(r.page_id, r.url): r.text for r in got} == want and len(got) == pages.count()
    assert all(r.n_chars == len(r.text) for r in got)


def test_marginals_are_those_of_all_assignments():
    rng = np.random.default_rng(3)
    for _ in range(6):
        n = 7
        parents = np.array([-1, *[rng.integers(0, v) for v in range(1, n)]])
        depths = np.zeros(n, int)
        for v in range(1, n):
            depths[v] = depths[parents[v]] + 1
        kinds = np.where(rng.random(n) < 0.5, rng.integers(0, d.KINDS, n), d.KINDS)
        f = d.Forest(parents, depths, rng.integers(0, 4, n), kinds, np.array([0, n]))
        model = d.model_of(rng.integers(0, 20, (4, 3, 3)).astype(float), rng.integers(0, 20, (d.KINDS, 3)).astype(float))
        total = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n - 1):
            y = (d.OUTSIDE, *y)
            w = sum(model.edges[f.saying[v], y[parents[v]], y[v]] + model.runs[kinds[v], y[v]] for v in range(1, n))
            for v in range(n):
                total[v, y[v]] += np.exp(w)
        assert np.allclose(d.marginals(f, model), total / total.sum(1, keepdims=True), atol=1e-9)


BODY = "<h1>A title stands here</h1><p>This is a first paragraph of the article, and it has some words to go on with.</p><p>Short one.</p><ul><li>An item of a list, in the text</li></ul><p>The last paragraph has a <a href='x'>link</a> inside, and then it ends with a full stop.</p>"
TEXT = "A title stands here\n\nThis is a first paragraph of the article, and it has some words to go on with.\n\nShort one.\n\nAn item of a list, in the text\n\nThe last paragraph has a link inside, and then it ends with a full stop."
LONG = "We say a thing here that is long enough to look like an article's paragraph, with commas, and a full stop."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article>{BODY}</article></body>",
        f"<body><div class='post-content'>{BODY}</div><div id=sidebar><p>{LONG}</p></div></body>",
        f"<body><header><h2>Site</h2></header><main>{BODY}</main><aside><p>{LONG}</p></aside></body>",
        f"<article>{BODY}<section class='comments-list'><p>{LONG}</p><p>{LONG}</p></section></article>",
        f"<div class=cookieNotice><p>{LONG}</p></div><article>{BODY}</article><div id='ad-3'>{LONG}</div>",
        f"<article>{BODY}<form action=x><p>{LONG}</p><button>Go</button></form><aside>{LONG}</aside></article>",
        f"<article>{BODY}<div hidden>{LONG}</div><p style='display: none'>{LONG}</p><nav><a href=y>{LONG}</a></nav></article>",
        f"<html><body><div role=banner>{LONG}</div><div role=main>{BODY}</div><div role=contentinfo>{LONG}</div></body></html>",
        f"<article>{BODY}<script>if (a < b) {{ x = '</p><p>{LONG}' }}</script><style>p {{}}</style><!-- {LONG} --><noscript>{LONG}</noscript></article>",
        f"<div><div><div>{BODY.replace('Short one', LONG[:-1] + ' Short one')}</div></div></div>".replace(LONG[:-1] + " ", ""),
    ],
)
def test_templates_that_no_labelled_page_had(page, model):
    got = d.texts_of([page], model)[0]
    assert got == TEXT


def blocks(source: str) -> list[str]:
    page = d.parse(source)
    out = [""] * len(page.runs)
    for r, _, _, raw in page.texts:
        out[r] += raw
    return [d._squeezed(t) for t in out if t.strip()]


def test_markup():
    assert blocks("<p>a<p>b<b>c</p>d") == ["a", "bc", "d"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>e</ul>f") == ["a", "b", "c", "e", "f"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("x<br>y &amp;&lt; &#233;&nbsp;\n z") == ["x y &< é z"]
    assert blocks("a < b <3 & c <p") == ["a < b <3 & c"]
    assert blocks("<!-- a --!>b<!-->c<!-- d") == ["bc"] and blocks("<title>t</title>u<script>v") == ["u"]
    assert blocks("<p title=it's>a</p><a href='b>c'>d</a><i x=\"e\"f>g") == ["a", "dg"]
    assert blocks("<div><td>a</div>b</td></table>c") == ["a", "b", "c"]
    assert blocks("<b><p>a</b>b</p>c") == ["ab", "c"] and blocks("</p></x>a</br>b") == ["a b"]


def test_labels_from_known_text():
    page = d.parse("<body><div><p>known text here</p><p>and more</p><p>unknown</p></div><p>known</p><i>zzz</i></body>")
    y = d.states(page, "known text here  and more")
    assert [y[r] for r in page.runs] == [d.ARTICLE, d.ARTICLE, d.BOILERPLATE, d.ARTICLE, d.BOILERPLATE]
    assert d.states(page) is None and d.states(d.parse("<article></article>")) is None


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "  \n"), (None, "w", f"<article>{BODY}</article>"), (4, "x", f"<article>{BODY}</article>"), (4, "x", f"<article>{BODY}</article>")]
    rows += [(5, "y", "<article><p>" + "word, " * 200_000 + "</article>"), (6, "z", "<div>" * 3000 + "deep"), (7, "z", "<article>\x00é漢😀 &#xD800;</article>"), (8, "q", "<a href='" * 300)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA + ", n_chars int, text string")
    got = d.extract(df, model).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "n_chars", "text", "text_", "n_chars_"]
    texts = [r.text_ for r in got]
    assert texts[:3] == ["", "", ""] and texts[3:6] == [TEXT] * 3 and len(texts[6]) == 1_199_999 and got[6].n_chars_ == 1_199_999
    assert d.extract(df.limit(0), d.fit(df.limit(0))).count() == 0
    assert d.texts_of([f"<article>{BODY}</article>"], d.fit(df.limit(0)))[0] == TEXT


def test_counts_do_not_depend_on_partitions(pages):
    one, many = d.fit(pages.coalesce(1)), d.fit(pages.repartition(7))
    assert (one.edges == many.edges).all() and (one.runs == many.runs).all()
