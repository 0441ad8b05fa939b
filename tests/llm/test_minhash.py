"""Near-duplicate classes against all-pairs brute force."""

import random

import numpy as np
import pytest

from chorus.llm import graph, minhash
from chorus.llm.graph import components


def brute(rows, threshold=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    texts = [None, "", "  \n\t", "one two", "ONE  two", "one two three", "é É ẞ a b c d", "É é ẞ a b c d"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([4, 5, 6, 9, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts.append("w " * 30_000)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and tasks
        for name, value in (("BLOCK", 4), ("TASK_ROWS", 50), ("SET_BLOCK", 3), ("SET_TASK_ROWS", 20)):
            monkeypatch.setattr(minhash, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, -1, "z") for i, t in rows], "doc_id long, text string, n_shingles int, label string").repartition(6)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    want = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_repeated_rows_null_ids_and_no_rows(spark):
    ddl = "doc_id long, text string"
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "x"), (None, "alone here"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, ddl)).collect()
    want = [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (1, 1, 1, True), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], ddl)).collect() == []


def test_registers_keep_leading_zeros_and_mantissa():
    h = np.array([1 << 40, (3 << 56) | (0b101 << 53), (3 << 56) | (0b11 << 54)], np.uint64)
    r = minhash.registers(np.sort(h))
    assert r[0] == ((56 - 41 << 10) | 0) + 1
    assert r[3] == ((0 << 10) | (0b01 << 8)) + 1  # 0b101...: no leading zero, then the bits after the leading one
    assert (r != 0).sum() == 2


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    err = []
    for j in (0.5, 0.75, 0.9):
        cut = int(len(base) * 2 * j / (1 + j))
        rest = (len(base) - cut)
        other = np.unique(np.concatenate([base[rng.permutation(len(base))[:cut]], rng.integers(0, 1 << 63, rest).astype(np.uint64)]))
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        value, used = minhash.estimate(minhash.registers(base)[None], minhash.registers(other)[None], np.array([len(base)]), np.array([len(other)]))
        err.append(abs(value[0] - true))
        assert used[0] == minhash.REGISTERS
    assert max(err) < 0.12


def test_components_of_large_graphs_with_hot_nodes(spark, monkeypatch):
    """The form for many edges, in which only heavy nodes are broadcast."""
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    monkeypatch.setattr(graph, "HEAVY", 5)
    rng = random.Random(6)
    edges = [(50, i) for i in range(60, 120)] + [(i, 300) for i in range(200, 240)] + [(119, 200)] + [(1000 + i, 1001 + i) for i in range(12)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
