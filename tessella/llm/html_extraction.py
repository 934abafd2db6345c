"""Operator 9. Main-text extraction: a linear-chain conditional random field over DOM leaf blocks, with ancestor-tag and
text features, trained on labelled pages and decoded by Viterbi."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.html_blocks import TRANSPARENT, Block, leaf_blocks

#: Size of the hashed feature space.
DIM = 1 << 14
#: Tags that mark main text in pages that label themselves (fixed values: HTML's sectioning semantics). They are never
#: features, so the model has to know main text by all else.
MAIN_TAGS = ("article", "main")
#: Tags and names of what is no main text even inside those (fixed values).
ASIDES = {"in nav", "in aside", "in footer", "in form", "name comment", "name comments", "name respond", "name replies"}
#: Furniture that training pages hold besides what pages have themselves: (markup before, markup after).
FURNITURE = [
    ('<aside class="sidebar"><p>', "</p></aside>"),
    ('<div class="sidebar related"><ul><li><a href="/r">', "</a></li></ul></div>"),
    ('<div class="cookie notice" role="alert"><p>', "</p></div>"),
    ('<div class="banner consent">', "</div>"),
    ('<section class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>', "</p></div></section>"),
    ('<div id="comments"><ol class="comment-list"><li class="comment"><div class="comment-body"><p>', "</p></div></li></ol></div>"),
    ('<form action="/s"><label>', '</label><input name="q"></form>'),
    ('<form><p>', '</p><input name="mail"></form>'),
    ('<div class="cookie consent gdpr"><p>', "</p></div>"),
    ('<div class="advert ad-slot"><p>', "</p></div>"),
    ('<div class="bottom footer"><p>', "</p></div>"),
    ('<table><tr><td class="sidebar nav"><p>', "</p></td></tr></table>"),
    ('<div class="ad advert sponsored"><p>', "</p></div>"),
    ('<table><tr><td class="nav"><a href="/a">', '</a><br><a href="/b">more</a></td></tr></table>'),
    ('<div class="nav top"><a href="/">', "</a></div>"),
    ('<header class="site-header"><a href="/">', "</a></header>"),
    ('<nav class="menu navbar"><ul><li><a href="/a">', '</a></li><li><a href="/b">more</a></li></ul></nav>'),
    ('<div class="footer copyright"><p>', "</p></div>"),
    ('<div class="share social newsletter subscribe"><p>', "</p></div>"),
    ('<div id="sidebar" class="widget promo"><h3>Related</h3><p>', "</p></div>"),
    ('<div class="replies user-comments"><p>', '</p><p>I agree.</p></div>'),
    ('<footer><p>', "</p></footer>"),
    ('<div class="menu"><a href="/">Home</a> <a href="/b">', "</a></div>"),
    ('<div class="ads" id="advertisement">', "</div>"),
    ('<div class="breadcrumb navigation"><a href="/">', "</a></div>"),
]
#: Further training pages that are made of each page.
VARIANTS = 4
#: Containers that stand in for <article> in the variants.
CONTAINERS = [("<main>", "</main>"), ("<div>", "</div>"), ('<div class="content post-body">', "</div>"), ('<div id="article-text" class="entry">', "</div>"), ('<section class="story main">', "</section>"), ("<table><tr><td>", "</td></tr></table>"), ('<div class="c inner wrap">', "</div>"), ('<div class="col row"><div id="content">', "</div></div>"), ('<div class="page"><div class="text">', "</div></div>"), (f"<{TRANSPARENT}>", f"</{TRANSPARENT}>")]
#: Sentences of the pages that training always has, so that a table without any page that labels itself has a model too.
SEED = ["The river rose over its banks in the spring and the mill stood under water for a week.", "Nobody in the village had seen such a flood before; the oldest spoke of one in their childhood.", "When the water fell, the road to the harbour was gone, and the bridge with it.", "What is to be done about it was argued all summer.", "A new bridge came two years later.", "It stands today, though the mill does not, and boats pass below it from May to October."]


def seed_pages() -> list[str]:
    out = []
    for k in range(12):
        text = "".join(f"<p>{' '.join((SEED * 3)[(k + 2 * i) % 6 :][: 1 + (k + i) % 4])}</p>" for i in range(3 + k % 5))
        extra = f"<h2>{SEED[(k + 3) % 6][:24]}</h2><ul><li>{SEED[k % 6]}</li><li>{SEED[(k + 1) % 6]}</li></ul><p>{SEED[(k + 2) % 6]}</p>" if k % 2 else f"<blockquote><p>{SEED[k % 6]}</p></blockquote><p>{SEED[(k + 4) % 6]}</p>"
        out.append(f'<html><body><nav><ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li></ul></nav><article><h1>{SEED[k % 6][:30]}</h1>{text}{extra}</article><footer>All rights kept</footer></body></html>')
    return out


#: Words of a block that counts as running text, and features that say nothing.
RUNNING, PLAIN = 10, {f"in {t}" for t in ("html", "body", "b", "br", "div", *MAIN_TAGS)}


def running_text(blocks: list[Block]) -> Counter:
    """How much running text each container of a page holds, in blocks."""
    out: Counter = Counter()
    for b in blocks:
        if b.inside and b.text.count(" ") >= RUNNING and 2 * b.linked < len(b.text):
            out.update({b.inside.home, b.inside.outer})
    return out


def block_features(block: Block, at: int, n: int, running: Counter = Counter()) -> list[int]:
    """Hashed features of a block: the tags and names around it, the shape of its text, the running text beside it."""
    text, inside = block.text, block.inside
    words = text.count(" ") + 1
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    size = min(words.bit_length(), 8)
    own = inside.own if inside else "none"
    own = "none" if own in MAIN_TAGS else own
    out = {"own " + own, f"words {size}", f"link {min(4, 4 * block.linked // max(1, len(text)))}", f"end {text[-1] in '.!?:'}", f"marks {min(marks.bit_length(), 5)}", f"{own} {size}", f"first {at == 0}", f"last {at == n - 1}", "bias"}
    if inside:
        beside, around = running[inside.home], running[inside.outer]
        out |= {f"beside {min(beside.bit_length(), 3)}", f"around {min(around.bit_length(), 3)}"} | (inside.around - PLAIN)
    return sorted(zlib.crc32(f.encode()) % (DIM - 1) + 1 for f in out)


def feature_rows(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all blocks in one array, and where each block's begin; every block has some."""
    running = running_text(blocks)
    rows = [block_features(b, i, len(blocks), running) for i, b in enumerate(blocks)]
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows).astype(np.int32), np.cumsum(sizes) - sizes


def emissions(w: np.ndarray, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(blocks, 2): the sum of the weights of each block's features."""
    return np.add.reduceat(w[features[0]], features[1], axis=0)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label sequence: emit is (blocks, 2), move[a, b] the score of label b after label a."""
    back = np.zeros(emit.shape, np.int8)
    best = emit[0]
    for t in range(1, len(emit)):
        step = best[:, None] + move
        back[t] = step.argmax(0)
        best = step.max(0) + emit[t]
    path = [int(best.argmax())]
    for t in range(len(emit) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def fit_crf(chains: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]], rounds: int = 240, l2: float = 1e-4, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, 2) and moves (2, 2) by maximum likelihood: gradients from forward and backward sums over all chains
    at once (chains are padded to the longest), Adam steps."""
    n, long = len(chains), max(len(y) for _, y in chains)
    y, on = np.zeros((n, long), np.int64), np.zeros((n, long))
    for i, (_, labels) in enumerate(chains):
        y[i, : len(labels)], on[i, : len(labels)] = labels, 1
    sizes = np.concatenate([np.diff(np.append(first, len(flat))) for (flat, first), _ in chains])
    features = np.concatenate([flat for (flat, _), _ in chains]), np.cumsum(sizes) - sizes
    there = on > 0
    w = [np.zeros((DIM, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    true = np.eye(2)[y] * on[..., None]
    pair = on[:, 1:] * on[:, :-1]
    true_moves = np.einsum("nta,ntb,nt->ab", true[:, :-1], true[:, 1:], pair)
    total = on.sum()
    for k in range(1, rounds + 1):
        emit = np.zeros((n, long, 2))
        emit[there] = emissions(w[0], features)
        a, b = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        a[:, 0] = emit[:, 0]
        for t in range(1, long):
            a[:, t] = np.where(on[:, t, None] > 0, np.logaddexp.reduce(a[:, t - 1, :, None] + w[1], axis=1) + emit[:, t], a[:, t - 1])
        for t in range(long - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None] > 0, np.logaddexp.reduce(w[1] + (emit[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), b[:, t + 1])
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        one = np.exp(np.clip(a + b - z[:, None, None], -60, 0)) * on[..., None]
        two = np.exp(np.clip(a[:, :-1, :, None] + w[1] + (emit + b)[:, 1:, None, :] - z[:, None, None, None], -60, 0)) * pair[..., None, None]
        off = np.repeat(((one - true) / total)[there], sizes, axis=0)
        g = np.stack([np.bincount(features[0], off[:, k], DIM) for k in (0, 1)], axis=1)
        for i, grad in enumerate((g + l2 * w[0], (two.sum((0, 1)) - true_moves) / total + l2 * w[1])):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-9)
    return w[0], w[1]


def shaped_text(filler: list[str], rng: np.random.Generator) -> list[str]:
    """Markup that articles hold besides paragraphs, filled with short phrases without a full stop, numbers and code."""

    def phrase(most: int) -> str:
        words = filler[rng.integers(len(filler))].split()
        at = int(rng.integers(max(1, len(words) - most)))
        return " ".join(words[at : at + 1 + int(rng.integers(most))]).strip(".,!?;: ") or "and so on"

    def some(tag: str, n: int, most: int) -> str:
        return "".join(f"<{tag}>{phrase(most)}</{tag}>" for _ in range(n))

    n = int(rng.integers(2, 6))
    code = " ".join(f"{phrase(1)} = {phrase(1)}({rng.integers(99)});" for _ in range(n))
    cells = "".join(f"<tr><td>{phrase(3)}</td><td>{rng.integers(9999)}</td></tr>" for _ in range(n))
    return [
        f"<ul>{some('li', n, 8)}</ul>",
        f"<ol>{some('li', n, 14)}</ol>",
        f"<ul>{some('li', n, 2)}</ul>",
        f"<pre>{code}</pre>",
        f"<pre><code>{code}</code></pre>",
        f"<table><tr>{some('th', 2, 2)}</tr>{cells}</table>",
        f"<table><caption>{phrase(6)}</caption><tbody>{cells}</tbody></table>",
        f'<figure><img src="/i.png" alt=""><figcaption>{phrase(12)}</figcaption></figure>',
        f"<blockquote><p>{phrase(20)}</p></blockquote>",
        f"<dl><dt>{phrase(2)}</dt><dd>{phrase(12)}</dd></dl>",
        f"<h2>{phrase(5)}</h2>",
        f"<h3>{phrase(4)}</h3>",
        f'<p>{phrase(9)} <a href="/x">{phrase(3)}</a>.</p>',
        f'<ul><li>{phrase(6)} <a href="/y">{phrase(2)}</a></li><li>{phrase(7)}</li></ul>',
    ]


def labelled_variants(html: str, filler: list[str], number: int) -> list[str]:
    """A page that labels itself (its text stands in <article> or <main>) as training pages, with data-main marks: as it
    is, with lists, tables, code and captions in its text, cut to one and two short paragraphs, and in other containers with
    furniture around and inside."""
    opening = re.search(rf"<({'|'.join(MAIN_TAGS)})\b[^>]*>", html)
    tag = opening[1] if opening else ""
    if not opening or f"</{tag}>" not in html[opening.end() :]:
        return []
    before, rest = html[: opening.start()], html[opening.end() :]
    body, _, after = rest.rpartition(f"</{tag}>")
    mark = lambda s, v: s.replace(">", f' data-main="{v}">', 1)
    rng = np.random.default_rng(number)

    def enriched(body: str) -> str:
        """The text with markup of several shapes between its paragraphs and after them."""
        shapes = shaped_text(filler, rng)
        cuts = [m.start() for m in re.finditer("<p>", body)][1:] + [len(body)]
        places = sorted(int(c) for c in rng.choice(cuts, size=int(rng.integers(2, 6))))
        parts = [body[a:b] for a, b in zip([0, *places], [*places, len(body)], strict=True)]
        return "".join(p + s for p, s in zip(parts, [*(shapes[k] for k in rng.permutation(len(shapes))[: len(places)]), ""], strict=True))

    short = re.sub(r"(<p>[^<.]*\.)[^<]*", r"\1", body)
    ends = [m.start() for m in re.finditer("<p>", short)][1:] + [len(short)]
    out = [before + mark(opening[0], 1) + text + f"</{tag}>{after}" for text in (body, enriched(body), short[: ends[0]], short[: ends[min(1, len(ends) - 1)]])]
    for turn in range(VARIANTS):
        opened, closed = CONTAINERS[(VARIANTS * number + turn) % len(CONTAINERS)]
        extra = [mark(a, 0) + filler[rng.integers(len(filler))] + b for a, b in (FURNITURE[k] for k in rng.permutation(len(FURNITURE))[:9])]
        # Every other one has short paragraphs: their first sentence.
        text = enriched(short if turn % 2 else body)
        cuts = [m.start() for m in re.finditer("<p>", text)][1:] + [len(text)]
        one, two = sorted(cuts[i] for i in rng.integers(len(cuts), size=2))
        inside = text[:one] + extra[0] + text[one:two] + extra[1] + text[two:]
        k = rng.integers(2, 9)
        out.append(before + "".join(extra[2:k]) + mark(opened, 1) + inside + closed + "".join(extra[k:]) + after)
    return out


def main_label(block: Block) -> int:
    aside = block.inside is not None and not block.inside.around.isdisjoint(ASIDES)
    return int(block.mark == "1" and not aside)


def train(pages: DataFrame, n_pages: int = 240, n_varied: int = 80, run: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves.

    Bound on the training sample: n_pages pages, whole, of those whose own markup labels them - the ones of the smallest
    hash of page_id; where an id has several pages, that of the least hash. The first n_varied of them train in all
    variants, the others as they are. Only ids are sorted for it, and only the chosen pages reach the driver. A chain of more than `run` blocks trains as several. SEED pages are always in the sample.
    """
    tagged = pages.where(F.col("html").rlike(rf"<({'|'.join(MAIN_TAGS)})\b[^>]*>") & F.col("page_id").isNotNull())
    chosen = tagged.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(n_pages)
    got = tagged.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    rows = sorted(got.collect(), key=lambda r: (zlib.crc32(str(r["page_id"]).encode()), str(r["page_id"])))
    varied = min(n_varied, len(rows))
    sample = [r["html"] for r in rows[:varied]] + seed_pages() + [r["html"] for r in rows[varied:]]
    filler = [b.text.replace("&", "&amp;").replace("<", "&lt;") for h in sample[:20] + seed_pages()[:2] for b in leaf_blocks(h)]
    chains = []
    for i, html in enumerate(sample):
        for page in labelled_variants(html, filler, i)[: None if i < varied + len(SEED) * 2 else 1]:
            blocks = leaf_blocks(page, "data-main")
            if blocks:
                (flat, first), labels = feature_rows(blocks), np.array([main_label(b) for b in blocks])
                for k in range(0, len(blocks), run):
                    ends = np.append(first, len(flat))
                    part = slice(ends[k], ends[min(k + run, len(blocks))])
                    chains.append(((flat[part], first[k : k + run] - ends[k]), labels[k : k + run]))
    return fit_crf(chains)


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(page_id, url, text) per row: the blocks that Viterbi labels main, in page order, joined by blank lines; empty if
    there are none. Null and empty pages have no blocks; a page is read whole, however long; repeated rows are extracted
    once each; other columns of pages are not read."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    known = np.flatnonzero(np.abs(model[0]).sum(1))
    weights, move = model[0][known], model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((DIM, 2))
        w[known] = weights

        def main_text(html: str | None) -> str:
            blocks = leaf_blocks(html)
            if not blocks:
                return ""
            keep = viterbi(emissions(w, feature_rows(blocks)), move)
            return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
