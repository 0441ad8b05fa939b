"""Merkle manifest and proofs against a plain recursive build."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chorus.llm import merkle
from chorus.llm.queries import _manifest

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*[field(v) for v in row])


def climb(nodes):
    """(root, proofs): siblings of every node, level by level, with their places."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for i, p in enumerate(at):
            run = runs[p // 3]
            proofs[i].append((run[:p % 3], run[p % 3 + 1:]))
            at[i] = p // 3
        nodes = [h(*r) for r in runs]
    return nodes[0], proofs


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    root, above = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for r, low in zip(groups[s], trees[s][1]):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            f = leaf(changed)
            for left, right in low + up:
                f = h(*left, f, *right)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[x for a, b in low + up for x in a + b]), f, f == root))
    return out


def corpus():
    rng = random.Random(2)
    rows = []
    for s, n in ((None, 4), ("", 1), ("a", 200), ("é", 9), ("z", 10), ("Z", 27), ("b", 3), ("c", 2), ("solo", 1), ("日", 28)):
        for i in range(n):
            text = rng.choice([None, "", "x\ny", "é\n\n", "plain", f"{i}\n{s}"])
            rows.append((rng.randrange(10**9), s, rng.choice([None, "", "en"]), rng.choice([None, 0, 12]), text))
    rows += [(7, "a", "en", 1, "same"), (7, "a", "en", 1, "same"), (7, "a", "en", 1, "other"), (None, "a", None, None, None), (-5, "z", None, -3, "a\nb")]
    return rows


@pytest.mark.parametrize("height", [1, 2, 8])
def test_equals_recursive_build(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = corpus()
    df = spark.createDataFrame(rows, DDL).withColumn("rank", F.lit(-1)).withColumn("proof", F.lit("z")).repartition(5)
    got = [tuple(r) for r in _manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_row_and_none(spark):
    one = [(3, "s", "en", 1, "a\nb")]
    got = _manifest(spark.createDataFrame(one, DDL)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert [tuple(r) for r in got] == brute(one) and got[0]["leaf"] == got[0]["root"]
    assert _manifest(spark.createDataFrame([], DDL)).collect() == []


def test_some_requests_and_the_store(spark, monkeypatch):
    """Proofs for a few leaves; every record's digest is that of its children."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = corpus()
    df = spark.createDataFrame(rows, DDL).withColumn("leaf", merkle.digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    made = merkle.Manifest(df)
    for record in made.sources.records.collect():
        assert record["digest"] == h(*record["children"])
    some = made.prove(made.leaves.filter("rank % 7 = 3"))
    got = some.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert got and all(r["folded"] == made.root for r in got)
    want = {r[1]: r[4] for r in brute(rows)}
    assert all(h("".join(r["proof"]).replace("*", "")) == want[r["leaf"]] for r in got)
