"""Page texts and neighbours against plain versions, with their defined cases."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewake.llm import htmltext, neighbours


def article(page):
    """The text of the article element of a generated page."""
    inside = page[page.index("<article>") + 9 :]
    inside = inside[: inside.index("</article>")]
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(line for line in lines if line)


def test_pages_match_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    got = htmltext.extract(pages).collect()
    assert len(got) == len(truth)
    assert all(r.text == truth[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_blocks_of_untidy_html():
    page = (
        '<header>Site</header><nav><ul><li>A<li>B</ul></nav><div class="cookie-notice">c</div><main><article><header><h1>Head &amp; line</h1></header>'
        '<p>One <b>bold<br>two <p>Three&nbsp;&lt;x&gt; <ul><li>i1<li>i2</ul><div id="comments"><p>rude</div><form>f<input></form><script>var a="</p>";</script>tail</article></main>'
        "<aside>s</aside><footer>f</footer>"
    )
    assert htmltext.main_text(page, {}) == "Head & line\nOne bold two\nThree <x>\ni1\ni2\ntail"
    assert htmltext.main_text("plain  text < b &amp;", {}) == "plain text < b &"
    assert htmltext.main_text("", {}) == ""


@pytest.mark.parametrize(("page", "text"), [
    ('<div class="content no-sidebar"><article><p>Hello</p></article></div>', "Hello"),
    ('<main class="page has-sidebar"><p>Hello</p></main>', "Hello"),
    ('<article class="post tags-news"><p>Hello</p></article>', "Hello"),
    ('<article><p>Hello</p><div class="related-work"><p>Work</p></div></article>', "Hello\nWork"),
    ('<div class="sidebar layout"><div class="ad">x</div><article><p>Hello</p></article></div>', "Hello"),
    ('<div class="main-nav">menu</div><div class="text"><p>Hello</p></div><div class="comment-list">c</div>', "Hello"),
    ('<article><p>Hello</p><section id="comments"><article class="comment">rude</article></section></article><article class="comment">rude</article>', "Hello"),
    ('<div class="share-bar">s</div><nav><article>x</article></nav><p>Hello</p>', "Hello"),
])
def test_names_of_elements(page, text):
    assert htmltext.main_text(page, {}) == text


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<li>" * 20_000])
def test_stray_tags_take_no_longer_than_others(page):
    start = time.perf_counter()
    assert htmltext.main_text(page, {}) == ""
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("page", ["<b" * 100_000, "<div>" * 50_000 + "x", '<p a="' * 20_000, "<!--" * 50_000, "</p>" * 50_000])
def test_hostile_html_ends_soon(page):
    assert len(htmltext.main_text(page, {})) <= 1


def test_style_tree_drops_what_pages_share(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=x>same bar</div><div class=y><p>text {i} {i * i}</p></div>") for i in range(60)]
    rows += [(100, None, None), (101, "", "<p>alone"), (102, "no url", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("host", "tree", "path")})
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(frame).collect()}
    assert got[7] == ("text 7 49", 9) and got[100] == got[102] == ("", 0) and got[101] == ("alone", 5)
    assert htmltext.extract(frame.limit(0)).count() == 0


def test_copied_pages_are_no_menus(spark):
    """Copies under other titles keep their text, inside an article and outside, on one host and over many."""
    same = "".join(f"<p>paragraph {i} of a text</p>" for i in range(4))
    said = "\n".join(f"paragraph {i} of a text" for i in range(4))
    rows = [(i, f"http://a.example/{i}", f"<article><h1>title {i}</h1><p>by author {i % 2}</p>{same}</article>") for i in range(400)]
    rows += [(1000 + i, f"http://b.example/{i}", f"<div class=post><h1>title {i}</h1>{same}</div>") for i in range(400)]
    rows += [(2000 + i, f"http://c{i}.example/", f"<div class=post><h1>title {i}</h1>{same}</div>") for i in range(100)]
    rows += [(3000 + i, f"http://d.example/{i}", f"<div class=x>same bar</div><div class=y><p>text {i}</p></div>") for i in range(100)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == f"title 7\nby author 1\n{said}"
    assert got[1007] == got[2007] == f"title 7\n{said}" and got[3007] == "text 7"


def plain_nearest(rows, query, k=20):
    width = max(len(v) for _, v in rows)
    padded = {i: np.pad(np.array(v, dtype=np.float32).astype(float), (0, width - len(v))) for i, v in rows}
    scores = sorted((-float(padded[i] @ padded[query]), i) for i in padded if i != query)
    return scores[:k]


def test_recall_and_scores(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in neighbours.op3_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    hits = total = 0
    for query, found in got.items():
        want = plain_nearest(rows, query)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        hits += len({v for _, v, _ in found} & {v for _, v in want})
        total += len(want)
        best = sorted(found)[0]
        assert best[2] <= -want[0][0] + 1e-9
    assert hits / total >= 0.9


def test_ties_repeats_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(200)] + [(300 + i, [float(i % 7), float(i % 3), 1.0]) for i in range(100)]
    bad = [(500, None), (520, []), (540, [0.0, 0.0]), (560, [1.0, None]), (580, [float("nan"), 1.0]), (620, [float("inf")]), (None, [1.0])]
    short = [(600, [2.0])]
    frame = spark.createDataFrame(rows + bad + short + rows[:3], "vec_id long, embedding array<float>").withColumn("vec", F.lit(1))
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i, _ in rows + short if i % 20 == 0}
    for query in (0, 20, 320, 600):
        assert [got[query][r] for r in range(1, 21)] == [(i, -s) for s, i in plain_nearest(rows + short, query)]
    few = neighbours.nearest(frame.filter("vec_id < 3")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(frame.limit(0)).collect() == []
