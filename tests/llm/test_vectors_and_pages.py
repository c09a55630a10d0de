"""Vector searches against brute force; page extraction on layouts that training did not see."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.llm import ann, html_text, topk
from pulsegrid.llm.fmindex import FMIndex, Wavelet


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # ties
    rows += [(2000, None), (2001, [float("nan")] + [0.0] * 15), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (None, rows[5][1]), (7, rows[7][1]), (2004, []), (2005, [float("inf")] * 16), (2050, [1.0, 2.0])]
    return rows, spark.createDataFrame([(*r, "x", 1, 0.0) for r in rows], "vec_id bigint, embedding array<float>, shard string, block int, score double")


def usable(rows, nonzero):
    out = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and (not nonzero or any(v)):
            out.setdefault(i, v)
    return out


@pytest.mark.parametrize("shard", [200, 5000])
def test_exact_top_k(vectors, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 5)
    rows, df = vectors
    v = {i: np.floor(np.array(x, float) * 256).astype(int) for i, x in usable(rows, False).items()}
    want = {}
    for q in (i for i in v if i % 50 == 0):
        scored = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scored)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, 5, 50).collect()}
    assert got == want
    assert topk.exact_top_k(df.limit(0), 5, 50).count() == 0


def test_large_integers_are_exact():
    points = np.array([[2.0**40, 3.0], [2.0**40, 4.0], [5.0, -(2.0**41)]])
    tree = topk.Tree(points)
    found = topk.search(tree, np.array([1, 2, 3]), np.array([9]), np.array([[2.0**20 + 1, 1.0]]), 2, [None])
    assert sorted(found[0], reverse=True) == [((2**20 + 1) * 2**40 + 4, 2), ((2**20 + 1) * 2**40 + 3, 1)]


@pytest.mark.parametrize("shard", [300, 5000])
def test_approximate_recall(vectors, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard)
    rows, df = vectors
    v = {i: np.array(x, np.float64) for i, x in usable(rows, True).items()}
    got = ann.approximate_nearest(df, 20, 20, rerank=60).collect()
    hit = total = 0
    for q in (i for i in v if i % 20 == 0):
        same = [c for c in v if c != q and len(v[c]) == len(v[q])]
        want = sorted(same, key=lambda c: (-(v[c] * v[q]).sum(), c))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx((v[c] * v[q]).sum(), rel=1e-12) for _, c, s in mine)
        hit += len({c for _, c, _ in mine} & set(want))
        total += len(want)
    assert hit / total >= 0.9
    assert ann.approximate_nearest(df.limit(0), 20, 20).count() == 0


def test_beam_search_beats_greedy():
    """On vectors that the books were not fitted on: those that they were are met exactly, up to rounding."""
    x = np.random.default_rng(0).standard_normal((1600, 12)).astype(np.float32)
    books, fresh = ann.fit(x[:600]), x[600:]
    error = [((fresh - ann.decode(ann.encode(fresh, books, beam), books)) ** 2).sum() for beam in (1, 8)]
    assert 1e-4 < error[1] < 0.9 * error[0]


def test_wavelet_and_backward_search():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 500)
    w = Wavelet(s, 37)
    at = rng.integers(0, 501, 200)
    c = rng.integers(0, 37, 200)
    assert w.rank(c, at).tolist() == [int((s[:a] == x).sum()) for a, x in zip(at, c)]
    texts = [rng.integers(0, 4, n).astype(np.uint64) for n in (5, 6, 9, 10, 8, 7)]
    got = FMIndex(texts, np.array([5, 3, 4, 1, 2, 0]), 5).statistics(texts)
    least = {}
    for t, o in zip(texts, [5, 3, 4, 1, 2, 0]):
        for k in range(len(t) - 4):
            least[t[k : k + 5].tobytes()] = min(o, least.get(t[k : k + 5].tobytes(), 9))
    assert [g.tolist() for g in got] == [[least[t[k : k + 5].tobytes()] for k in range(len(t) - 4)] for t in texts]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><div class="wrap"><header>Site name</header>
<ul class="menu"><li><a href=1>Home</a><li><a href=2>News</a></ul><div class="cookie-notice">We use cookies here.</div><article><h1>A  title &amp; more</h1><p>First
paragraph of text,<br>with words.<p><b>Second</b> paragraph.<div class="ad">Buy this now!</div><p>Third one.</article><section class="comments"><h3>Comments</h3><p>Nice post!</p></section>
<form><label>Email</label><button>Send</button></form><footer>&copy; 2020 Owner</footer></div>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<!-- never closed"), (None, "u", "<script>x"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.extract_main_text(df).collect()
    want = "A title & more\nFirst paragraph of text, with words.\nSecond paragraph.\nThird one."
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == sorted((i or 0, want if h == PAGE else "") for i, _, h in rows)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_labeller_on_held_out_pages():
    rng, net = np.random.default_rng(77), html_text.labeller()
    right = total = 0
    for _ in range(120):
        page, labels = html_text.synthetic_page(rng)
        found = html_text.blocks(page)
        x, mask = html_text._padded([html_text.vectors(found)])
        right += ((net.probabilities(x, mask)[:, 0] > 0.5) == np.array(labels)).sum()
        total += len(labels)
    assert right / total > 0.98


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = html_text.Lstm(5, rng)
    x, mask = rng.standard_normal((4, 3, 5)).astype(np.float32), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], np.float32)
    x *= mask[:, :, None]
    y = (rng.random(mask.shape) > 0.5).astype(np.float32) * mask

    def loss():
        p = np.clip(net.probabilities(x, mask), 1e-7, 1 - 1e-7).astype(float)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grad = net.gradients(x, y, mask)
    for k in net.w:
        at = tuple(0 for _ in net.w[k].shape)
        net.w[k][at] += 1e-3
        up = loss()
        net.w[k][at] -= 2e-3
        down = loss()
        net.w[k][at] += 1e-3
        assert grad[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_end_tags_of_what_is_nested_deeper(monkeypatch):
    page = "<body><div class=comments>" + "<div>" * 250 + "x" + "</div>" * 250 + "<p>comment</p></div><p>after</p>"
    paths = {b.text: [t for t, _ in b.path] for b in html_text.blocks(page)}
    assert paths["comment"] == ["body", "div", "p"] and paths["after"] == ["body", "p"]
    assert len(paths["x"]) == html_text.DEEP
    # With any depth, what is not nested deeper has the path that it has without a bound.
    rng = np.random.default_rng(8)
    tags = ["div", "ul", "li", "p", "td", "tr", "table", "center", "section", "option"]
    for _ in range(300):
        page = "<body>" + "".join(f"<{'/' if rng.random() < 0.45 else ''}{tags[rng.integers(len(tags))]}>w{i} " for i in range(80))
        monkeypatch.setattr(html_text, "DEEP", 10_000)
        whole = html_text.blocks(page)
        monkeypatch.setattr(html_text, "DEEP", 4)
        assert [(b.text, b.path) for b in html_text.blocks(page)] == [(b.text, b.path[:4]) for b in whole]
