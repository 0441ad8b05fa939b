"""Hard negatives against brute force; the tree's own promises."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import covertree as ct

DDL = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=5, least=80):
    fine = {}
    for i, v, l in rows:
        if i is None or l is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = ((l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v])
        fine[i] = min(fine.get(i, new), new)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (l, v) in fine.items():
        if not anchor(a):
            continue
        scored = sorted(((-dot(v, w), i, m) for i, (m, w) in fine.items() if i != a))
        for s, p, _ in [x for x in scored if x[2] == l][:positives]:
            fit = [(n, t) for t, n, m in scored if m != l and least * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=5, **more):
    df = spark.createDataFrame(rows, DDL).withColumn("id", F.lit(-1)).withColumn("v", F.lit("z")).withColumn("s", F.lit(0)).repartition(6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, ct.mine(df, F.col("id") % every == 0, label, **more).collect()))


def vectors(seed, n, d, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / 8
    if kind == "clusters":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + x / 10
    if kind == "copies":
        x[: n // 3] = x[0]
        x[n // 3: n // 2] = np.round(x[n // 3: n // 2])
    if kind == "long":
        x *= 10.0 ** rng.uniform(-2, 2, size=(n, 1))
    return [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in zip(rng.permutation(3 * n)[:n], x)]


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "long"])
@pytest.mark.parametrize("shard", [4096, 40])
def test_equals_brute_force(spark, monkeypatch, kind, shard):
    monkeypatch.setattr(ct, "SHARD", shard)
    monkeypatch.setattr(ct, "BLOCK", max(5, shard // 10))
    monkeypatch.setattr(ct, "PIVOTS", 5)
    rows = vectors(4, 300, 7, kind)
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (7, [0.5, 0.25], 0), (1, [0.5, 0.2], 2), (2, [0.45, 0.25], 2), (3, None, 1), (4, [], 1), (5, [nan, 1.0], 1),
            (6, [inf, 0.0], 2), (8, [None, 1.0], 2), (9, [0.5, 0.25], None), (None, [0.5, 0.25], 2), (2, [0.45, 0.25], 2), (1, [0.5, 0.2], 3),
            (10, [0.0, 0.0], 1), (15, [-0.5, -0.5], 1), (20, [0.0, 0.0], 2), (11, [-1.0, 0.1], 5), (12, [0.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    other = [(100, [1.0], 1), (105, [1.0, 2.0, 3.0], 1)]
    assert mined(spark, rows + other) == brute(rows, lambda i: i % 5 == 0)
    for few in ([], rows[3:5], rows[:1]):
        assert mined(spark, few) == brute(few, lambda i: i % 5 == 0) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-(1 << 22), 1 << 22, 9) / 256).tolist(), int(i) % 3) for i in range(90)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_tree_covers_and_separates():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.integers(-300, 300, (900, 6)), np.full((50, 6), 11)])
    longest2 = float((x * x).sum(1).max())
    tree = ct.CoverTree(x, np.arange(len(x)), np.zeros(len(x), np.int64), longest2, leaf=10, small=1)
    assert sorted(tree.ids.tolist()) == list(range(len(x)))
    points = ct.augmented(tree.x, longest2)

    def below(i):
        kids = range(tree.first[i], tree.last[i])
        return np.concatenate([np.arange(tree.begin[i], tree.end[i]), *map(below, kids)]).astype(int)

    assert sorted(below(0).tolist()) == list(range(len(x))) and (tree.first < tree.last).sum() > 5
    for i in range(len(tree.radius)):
        rows = below(i)
        assert tree.centre[i] in rows and np.sqrt(((points[rows] - points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-6
        if tree.first[i] < tree.last[i]:
            kids = np.concatenate([tree.centre[tree.first[i]:tree.last[i]], np.arange(tree.begin[i], tree.end[i])])
            apart = np.sqrt(((points[kids][:, None] - points[kids][None]) ** 2).sum(2)) + 1e12 * np.eye(len(kids))
            assert apart.min() > tree.radius[i] / ct.BASE - 1e-6


def test_search_skips_nodes(monkeypatch):
    """With clustered candidates most rows are never multiplied."""
    rng = np.random.default_rng(9)
    x = np.round((rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) / 50) * 256).astype(np.int64)
    longest2 = float((x * x).sum(1).max())
    tree = ct.CoverTree(x, np.arange(4000), np.arange(4000) % 5, longest2)
    met = []
    real = ct.CoverTree.products
    monkeypatch.setattr(ct.CoverTree, "products", lambda self, rows, *a: met.append(rows.stop - rows.start if isinstance(rows, slice) else len(rows)) or real(self, rows, *a))
    scores = np.sort(x @ x[3])[::-1]
    (ids, found), = tree.search(3, 3, x[3], [(-(1 << 61), 1 << 61)], False, 5, longest2)
    want = sorted((-s, i) for i, s in enumerate((x @ x[3]).tolist()) if i % 5 != 3)[:5]
    assert list(zip((-found).tolist(), ids.tolist())) == want and scores[0] >= found[0]
    assert sum(met) < 2000
