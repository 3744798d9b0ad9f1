"""Nearest neighbours against all distances, and page texts."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeline.llm import op5_nearest, op10_html_text


def exact(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max({len(v) for _, v in ok}, key=[len(v) for _, v in ok].count)
    ok = [(i, v / np.linalg.norm(v)) for i, v in ok if len(v) == width]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((-float(x @ v), i) for i, v in ok if i != q))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in op5_nearest.nearest(df, every=50).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows, 50, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(found[a][1] >= found[a + 1][1] - 1e-12 for a in range(1, 5))


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 400)] + [(i, [0.0, 1.0, 0.5]) for i in range(400, 410)]
    rows += [(1000, None), (1050, []), (1100, [0.0, 0.0, 0.0]), (1150, [1.0, None, 0.0]), (1200, [nan, 1.0, 1.0]), (1250, [inf, 0.0, 1.0]), (1300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rep string, cell int")
    got = {}
    for r in op5_nearest.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[400] == [401, 402, 403, 404, 405]
    assert max(got) == 400
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in op5_nearest.nearest(few, every=50).collect()] == [(0, 1)]
    assert op5_nearest.nearest(df.where("false"), every=50).count() == 0


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("<p>just text", "just text"),
    ("plain", "plain"),
    ("<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>One  two\n three<p>Four&nbsp;five"
     "<br>six</article><footer>foot</footer>", "Head & more\nOne two three\nFour five six"),
    ('<body><div class="content has-sidebar"><p>Body of it.</p></div></body>', "Body of it."),
    ('<body><article class="post no-comments"><p>Body of it.</p></article></body>', "Body of it."),
    ('<body><main class="ad-free"><p>Body of it.</p></main></body>', "Body of it."),
    ('<body><article class="social-policy"><p>Body of it.</p></article></body>', "Body of it."),
    ('<body><div class="page with-menu"><p>Body of it.</p></div></body>', "Body of it."),
    ('<body><nav><a href=x>menu</a><article><p>Body of it.</p></article></body>', "Body of it."),
    ('<body><article><p>Body of it.</p></article><div class="comments"><article>Said a reader.</article></div></body>', "Body of it."),
    ("<body><header>top</header><div class='sidebar'>side side side side</div><main><h1>A</h1><div><p>Body of the text, long enough to count.</p>"
     "<form>Name <input></form><script>x('</p>')</script><div class=ad>buy</div><p>B</p></div></main><section id=comments><p>A reader's rather long "
     "comment on all this, longer than the text itself, which must go.</p></section>", "A\nBody of the text, long enough to count.\nB"),
    ("<article><p>a</p><article class='comment'>no</article></article>", "a"),
    ("<div><div><p>" + "word " * 40 + "</p><p>x</p></div></div><ul><li><a>l</a></li><li><a>m</a></li></ul>", ("word " * 40).strip() + "\nx"),
    ("<p>broken <b <i>&#x41;&bogus; <", None),
])
def test_pages(html, text):
    got = "\n".join(op10_html_text.main_lines(html))
    assert text is None or got == text


def test_page_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "v", "<p>hi</p>", "t"), (3, "w", "<p>" + "long " * 100_000, "t"), (3, "w", "<p>again", "t")]
    got = op10_html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert op10_html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
