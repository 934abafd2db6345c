"""Articles with lists, code, tables and captions, what is not shown, and pages nested deep."""

import re
import time
from itertools import product

import numpy as np
import pytest

from tessella.llm import html_blocks, html_extraction

ONE = "The council met on Monday to discuss the plan, and most members spoke for it at some length before the vote."
TWO = "Work is to begin in March, said the mayor, although the cost is not yet known and will surely be high."
HEAD = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
#: (page, blocks of its main text).
PAGES = [
    (f"{HEAD}<article><h1>Plan agreed</h1><p>{ONE}</p><ul><li>Close the old road</li><li>Build a bridge</li></ul><p>{TWO}</p><pre>make plan\nrun plan --all</pre><figure><img src=x><figcaption>The bridge in May</figcaption></figure><table><tr><td>Cost</td><td>400</td></tr></table><h2>What comes next</h2><p>{ONE}</p></article><footer>All rights reserved</footer></body></html>", ["Plan agreed", ONE, "Close the old road", "Build a bridge", TWO, "make plan run plan --all", "The bridge in May", "Cost", "400", "What comes next", ONE]),
    (f"<html><body class='blog'><div id='page'><header class='site-header'><a href='/'>My blog</a><p>Just another site</p></header><div class='menu'><ul><li><a href='/a'>About</a></li></ul></div><div class='entry-content'><h1>Plan agreed</h1><p>{ONE}</p><ul><li>Close the old road</li><li>Build a bridge</li></ul><p>{TWO}</p></div><div id='sidebar' class='widget'><h3>Recent posts</h3><ul><li><a href='/1'>One post</a></li><li><a href='/2'>Two posts</a></li></ul></div><div class='footer'>Powered by nobody</div></div></body></html>", ["Plan agreed", ONE, "Close the old road", "Build a bridge", TWO]),
    (f"<html><body><div class='nav'><a href='/'>Index</a></div><div class='section'><h1>The plan command</h1><p>{ONE}</p><pre>plan --help</pre><p>{TWO}</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-a</td><td>all plans</td></tr></table><p>{ONE}</p></div><div class='footer'><p>Made in 2020</p></div></body></html>", ["The plan command", ONE, "plan --help", TWO, "Option", "Meaning", "-a", "all plans", ONE]),
    (f"<html><body><p hidden>Secret words that nobody sees here.</p><div style='color: red; display : none'><p>More of them, also unseen.</p></div>{HEAD[12:]}<article><h1>T</h1><p>{ONE}</p><p>{TWO}</p></article></body></html>", ["T", ONE, TWO]),
]


def main_text(model, html):
    blocks = html_blocks.leaf_blocks(html)
    keep = html_extraction.viterbi(html_extraction.emissions(model[0], html_extraction.feature_rows(blocks)), model[1])
    return [b.text for b, k in zip(blocks, keep, strict=True) if k]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_articles_keep_all_their_blocks(spark, folder):
    model = html_extraction.train(spark.read.parquet(f"/root/testdata/{folder}/pages.parquet"))
    for page, want in PAGES:
        assert main_text(model, page) == want


def test_pages_of_the_table_are_extracted_exactly(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_extraction.extract(pages, html_extraction.train(pages)).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:h1|p)>", article)]
        assert texts[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_hidden_elements_end_where_they_should():
    texts = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert texts("<p hidden>x<p>a<div hidden><p>y</p></div>b") == ["a", "b"]
    assert texts("<p>a <span style='display:none'>x</span>b</p><li style='DISPLAY: NONE'>y<li>c") == ["a b", "c"]
    assert texts("<div hidden>x</div><div style='display:block'>a</div>") == ["a"]


def test_deep_pages_end_in_seconds():
    began = time.time()
    blocks = html_blocks.leaf_blocks("<div class='a'>x" * 40000 + "</q></z>" * 40000)
    flat, first = html_extraction.feature_rows(blocks)
    assert len(blocks) == 40000 and len(first) == 40000 and time.time() - began < 20


def test_the_field_is_fitted_by_maximum_likelihood():
    """The gradient of the regularised likelihood, taken over all label sequences one by one, is 0 at the weights found."""
    rng, features = np.random.default_rng(8), 6
    chains = []
    for n in (1, 2, 3, 4, 3, 2):
        rows = [np.unique(rng.integers(1, features, 3)).astype(np.int32) for _ in range(n)]
        sizes = np.array([len(r) for r in rows])
        chains.append(((np.concatenate(rows), np.cumsum(sizes) - sizes), rng.integers(0, 2, n)))
    l2, total = 0.01, sum(len(y) for _, y in chains)

    def loss(w, move):
        out = 0.0
        for x, y in chains:
            emit = html_extraction.emissions(w, x)
            value = lambda p: sum(emit[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            out += np.log(sum(np.exp(value(p)) for p in product((0, 1), repeat=len(y)))) - value(tuple(y))
        return out / total + l2 / 2 * ((w**2).sum() + (move**2).sum())

    w, move = html_extraction.fit_crf(chains, rounds=3000, l2=l2, rate=0.01)
    for array in (w, move):
        for place in np.ndindex(min(len(array), features), 2):
            kept, found = array[place], []
            for step in (1e-4, -1e-4):
                array[place] = kept + step
                found.append(loss(w, move))
            array[place] = kept
            assert abs(found[0] - found[1]) / 2e-4 < 1e-4
