"""Clusters, hard negatives and page texts against brute force, and rows of odd kinds."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.llm import hard_negatives as hn
from molquarry.llm.centroids import centroid_clusters, nearest
from molquarry.llm.hard_negatives import hard_negatives
from molquarry.llm.html_text import extracted, main_text

#: Columns that clash with names that the operators use inside.
VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, h string, sums string, g int, key long, anchor string, slot int, rank int, cluster int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, y, 1, "a", "b", "c", 2, 3, "d", 4, 5, 6) for i, e, y in rows], VECTORS.replace("float", kind))


def whole(e, dim):
    return e is not None and (dim is None or len(e) == dim) and all(x is not None and math.isfinite(x) for x in e)


def floors(e):
    return [math.floor(256 * float(np.float32(x))) for x in e]


def clusters(rows, k, dim, rounds):
    kept = [(i, floors(e)) for i, e, _ in rows if whole(e, dim)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[best(x)].append(x)
        centroids = [[sum(col) // len(members[c]) for col in zip(*members[c], strict=True)] if c in members else m for c, m in enumerate(centroids)]
    told = [(i, best(x), far(x, centroids[best(x)])) for i, x in kept]
    sums = defaultdict(int)
    for _, c, d in told:
        sums[c] += d
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in told]


def odd_vectors(rng, n, dim, labels=3):
    rows = [(rng.choice([k, k, k, rng.randint(0, n), None]), [round(rng.uniform(-1, 1), 2) for _ in range(dim)], rng.choice([*range(labels), None])) for k in range(n)]
    rows += rows[:5] + [(7, rows[3][1], 1), (100, None, 1), (101, [None] * dim, 1), (102, [float("nan")] * dim, 2), (103, [float("inf")] + [0.0] * (dim - 1), 2), (104, [0.0] * dim, 1), (0, [0.0] * dim, 1)]
    return rows + [(k, [0.25] * dim, 0) for k in range(200, 260)]


@pytest.mark.parametrize(("k", "scale"), [(4, 1), (7, 1), (500, 1), (5, 1e12), (5, 3e30)])
def test_clusters(spark, k, scale):
    rng = random.Random(k)
    rows = [(i, e if e is None else [None if x is None else x * scale for x in e], y) for i, e, y in odd_vectors(rng, 60, 3)] + [(1000, [1.0, 2.0], 1), (1001, [], 1), (1002, [1.0] * 4, 1)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted((tuple(r) for r in centroid_clusters(table(spark, rows), k=k, dim=3, rounds=3).collect()), key=key)
    fits = lambda v: v if v < 1 << 63 else None
    wanted = [(i, c, *map(fits, (d, s, t)), h) for i, c, d, s, t, h in clusters(rows, k, 3, 3)]
    assert got == sorted(wanted, key=key)


def test_products_near_the_bound_are_exact():
    rng = np.random.default_rng(1)
    for top in (2**20, 2**25, 2**40):
        x, c = rng.integers(-top, top, (50, 5)), rng.integers(-top, top, (7, 5))
        cluster, distance = nearest(x.astype(float), c.astype(object))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m, strict=True)) for m in c] for r in x]
        assert [min(r) for r in exact] == [int(d) for d in distance] and [r.index(min(r)) for r in exact] == list(cluster)


def mined(rows, of, positives, negatives, dim=None):
    kept = [(i, floors(e), y) for i, e, y in rows if y is not None and whole(e, dim)]
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    order = lambda s: (-s[0], math.inf if s[1] is None else s[1])
    out = []
    for i, x, y in {(i, tuple(x), y) for i, x, y in kept if i is not None and of(i)}:
        near = sorted(((score(x, e), j) for j, e, z in kept if z == y and j != i), key=order)[:positives]
        for s, j in near:
            found = sorted(((t, n) for t, n in ((score(x, e), n) for n, e, z in kept if z != y) if 30 * s <= 100 * t <= 90 * s), key=order)[:negatives]
            out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize(("seed", "rows_of_block", "anchors_of_block", "blocks"), [(1, 4096, 512, 64), (2, 16, 4, 64), (3, 16, 4, 1), (4, 7, 1, 2)])
def test_hard_negatives(spark, monkeypatch, seed, rows_of_block, anchors_of_block, blocks):
    for name, value in (("ROWS", rows_of_block), ("ANCHORS", anchors_of_block), ("BLOCKS", blocks)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(seed)
    rows = odd_vectors(rng, 120, 4) + [(50, [0.5, 0.5], 1), (55, [], 2), (60, [], 2)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, positives=3, negatives=4)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(mined(rows, lambda i: i % 5 == 0, 3, 4), key=key)


def test_pairs_that_stay_possible_are_exact():
    rng = np.random.default_rng(2)
    for top, width in ((3, 8), (150, 64), (1 << 20, 5), (1 << 27, 2), (0, 3)):
        a, b = rng.integers(-top, top + 1, (20, width)), rng.integers(-top, top + 1, (90, width))
        best = hn._Best(20, 5)
        i, r, score = hn.qualified(a, b, np.ones((20, 90), bool), hn._among_best(best))
        best.add(i, score, r)
        exact = a @ b.T
        assert (exact[i, r] == score).all()
        wanted = [sorted((-int(s), k) for k, s in enumerate(row))[:5] for row in exact]
        assert [list(zip(-best.score[best.key == k], best.id[best.key == k], strict=True)) for k in range(20)] == wanted
        if top > 1:
            assert len(i) < 20 * 90 / 2  # most pairs were dropped before their last plane


def test_vectors_of_empty_tables(spark):
    none = table(spark, [])
    assert centroid_clusters(none).count() == 0 and hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    no_anchor = table(spark, [(1, [0.5], 1), (2, [0.5], 2)])
    assert hard_negatives(no_anchor, F.col("vec_id") % 100 == 0).count() == 0


LONG = "A sentence with commas, clauses, and words enough to count as one. "
CASES = [
    ("", ""),
    ("plain text", "plain text"),
    ("<p>a</p>", "a"),
    ("<article><h1>T</h1><p>Hello&nbsp;<b>wor</b>ld.<br>x</p>\n<p>\t y  z </p></article>", "T Hello world. x y z"),
    (f"<nav><a href=1>Home</a></nav><div id=c><h1>T</h1><p>{LONG}</p><p>short</p></div><div class='comments'><p>{LONG * 9}</p></div><footer>f</footer>", f"T {LONG.strip()} short"),
    (f"<article><header><h1>T</h1><p>by me</p></header><p>{LONG}</p><aside>no</aside><section class=comments><p>{LONG * 5}</p></section><article><p>{LONG}</p></article></article>", f"T {LONG.strip()}"),
    (f"<div class='cookie-notice'>{LONG}</div><main><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section><section><p>{LONG}</p></section></main>", f"A {LONG}B {LONG}{LONG}".strip()),
    (f"<table><tr><td><ul><li><a href=1>a</a><li><a href=2>b</a></ul><td><p>{LONG}<p>{LONG}</table>", f"{LONG}{LONG}".strip()),
    (f"<div>{LONG}<br><br>{LONG}<div class='ad'>{LONG}</div></div>", f"{LONG}{LONG}".strip()),
    ("<form><p>only a form</p></form>", "only a form"),
    ("<article><p>a &lt;b&gt; &#65;&am &copy</p></article>", "a <b> A&am ©"),
    ("<article><p title='a>b'>x<p title=it's>y<!-- c > --><script>'</p>'</script>z</article>", "x yz"),
    (f"<body class='has-sidebar'><div class='content with-comments'><p>{LONG}</p><p style='display: none'>{LONG}</p><ul class=share><li>s</ul></div>", LONG.strip()),
    (f"<article><p>{LONG}</p><ul><li><a href=1>one more</a></li><li><a href=2>two more</a></li></ul><ul><li>point</li></ul></article>", f"{LONG}point"),
    ("<p>open <b>bold<p>next</b> end", "open bold next end"),
    ("a < b <", "a < b <"),
    ("<p>x</p><script>never closed", "x"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages_of_odd_kinds(spark):
    big = "<article>" + "".join(f"<p>{LONG}{k}</p>" for k in range(20000)) + "</article>"
    rows = [(1, "u", None, "t", 1), (1, None, "<p>é\u2003è</p>", "t", 1), (None, "u", big, "t", 1), (1, "u", None, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in extracted(pages).collect()]
    whole = " ".join(f"{LONG}{k}" for k in range(20000))
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (1, None, "é è", 3), (None, "u", whole, len(whole))], key=str)
    assert extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<a" * 50000, "<p" * 50000 + ">", "<div>" * 20000, "<!--" * 50000, "<script" * 50000, '<a href="' * 50000, "<table><tr><td>" * 5000 + "</div>" * 5000])
def test_broken_pages_take_linear_time(html):
    assert isinstance(main_text(html), str)
