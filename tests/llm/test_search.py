"""Nearest neighbours by recall, BM25 by brute force and by SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorus.llm import ann, topk
from chorus.llm.queries import ORACLES, op7_topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keys must meet across partitions, not because all lie in one."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def exact_nearest(ids, x, q, k):
    norm = np.sqrt((x * x).sum(1))
    s = (x * x[q]).sum(1) / (norm * norm[q])
    s[q] = -9
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]]


@pytest.mark.parametrize("split", [False, True])
def test_ann_recall_on_the_table(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(ann, "SHARD", 60)
        monkeypatch.setattr(ann, "BLOCK", 3)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = dict(exact_nearest(ids, x, q, 5))
        mine = got[int(ids[q])]
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        hits += sum(v in want for _, v, _ in mine)
        total += 5
        for _, v, s in mine:
            if v in want:
                assert s == pytest.approx(want[v], abs=1e-12)
    assert hits / total >= 0.9
    assert len(got) == (ids % 50 == 0).sum()


def drawn(kind, n, dim):
    rng = np.random.default_rng(0)
    if kind == "clusters":
        return rng.normal(size=(20, dim))[rng.integers(0, 20, n)] * 2 + rng.normal(size=(n, dim)) + 1
    if kind == "decay":
        return rng.normal(size=(n, dim)) / np.arange(1, dim + 1) ** 0.7 + 0.3
    return rng.normal(size=(n, dim)) + kind


@pytest.mark.parametrize("dim", [64, 384])  # fewer and more than bits
@pytest.mark.parametrize("kind", [0, 1, 2, "decay", "clusters"])
def test_ann_recall_with_a_mean_and_clusters(kind, dim):
    x = drawn(kind, 3000, dim)
    ids, norm = np.arange(len(x)), np.sqrt((x * x).sum(1))
    centre, projection = ann.learn(x[:1500], 128)
    codes = ann.substrings(x, centre, projection)
    index, rows, sizes = ann.MultiIndex(codes), [np.array([i]) for i in ids], ann.lengths(x, centre, projection)
    hits, asked = 0, range(0, len(x), 100)
    for q in asked:
        found, _ = ann.search(index, rows, x, norm, q, x[q], codes[q], 5, 128, 2.0, sizes, sizes[q])
        hits += len(set(found.tolist()) & {i for i, _ in exact_nearest(ids, x, q, 5)})
    assert hits / (5 * len(asked)) >= 0.9


def test_ann_finds_neighbours_of_vectors_with_a_mean(spark):
    x = drawn(2, 1500, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("id") % 50 == 0).collect()}
    want = {(q, i) for q in range(0, 1500, 50) for i, _ in exact_nearest(np.arange(1500), x, q, 5)}
    assert len(got & want) / len(want) >= 0.9


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 0.0, 0.0]
    rows = [(0, good, 9), (1, good, 1), (2, good, 1), (3, good, 1), (4, good, 1), (5, good, 1), (6, good, 1), (7, [0.0, 1.0, 0.0], 1),
            (0, good, 9), (None, good, 1), (8, None, 1), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [nan, 1.0, 0.0], 1),
            (12, [inf, 1.0, 0.0], 1), (13, [None, 1.0, 0.0], 1), (14, [1.0, 2.0], 1), (50, [0.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")  # a clashing extra column
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got[:5]] == [(0, i, i) for i in range(1, 6)]  # ties to smaller ids
    assert got[5][:3] == (50, 1, 7) and got[5][3] == 1.0
    assert [g[2] for g in got[6:]] == [0, 1, 2, 3]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert ann.nearest(df.filter("vec_id = 0"), F.col("id") % 50 == 0).collect() == []  # no candidate


def test_multi_index_meets_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index, met = ann.MultiIndex(codes), {}
    far = np.array([sum(bin(int(a ^ b)).count("1") for a, b in zip(row, codes[0])) for row in codes])
    for radius, rows, distance in index.probe(codes[0]):
        met |= dict(zip(rows.tolist(), distance.tolist()))
        assert set(np.flatnonzero(far <= radius)) <= met.keys()
    assert met == dict(enumerate(far.tolist()))


def bm25(rows, k):
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in rows]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for q in {i for i, _ in bags if i is not None and i % 20 == 0}:
        words = {w for i, b in bags if i == q for w in b}
        scores = []
        for i, b in bags:
            if i is not None and i != q:
                length = sum(b.values())
                s = sum(idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in sorted(words) if b[w])
                if s > 0:
                    scores.append((-round(s, 9), i))
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("split", [False, True])
def test_topk_equals_brute_force(spark, monkeypatch, split):
    if split:
        for name, value in (("SHARD", 60), ("PART", 25), ("TOGETHER", 2), ("BLOCK", 3), ("SPAN", 4)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    word = lambda: rng.choice("the of a an é ß x9 wörd".split()) if rng.random() < 0.5 else f"W{rng.randint(0, 60)}"
    rows = [(i, " ".join(word() + rng.choice(["", ".", "!!"]) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(150)]
    rows += [(150, None), (151, ""), (160, "!!"), (180, "Nowhere else"), (None, "the of w1"), (200, rows[3][1]), (201, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, rank int").repartition(4)
    got = defaultdict(list)
    for r in topk.search(df, F.col("doc_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    want = {q: a for q, a in bm25(rows, 7).items() if a}
    assert got.keys() == want.keys()
    for q in want:
        assert [a[:2] for a in got[q]] == [a[:2] for a in want[q]]
        assert [a[2] for a in got[q]] == pytest.approx([a[2] for a in want[q]], abs=2e-9)
    assert topk.search(df.limit(0), F.col("doc_id") % 20 == 0).collect() == []


def test_topk_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[:2]: r[2:] for r in duckdb.sql(ORACLES["op7_topk"]).fetchall()}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in op7_topk(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_search_workers_forget_their_words():
    topk.words_of("some words of a task")
    assert len(topk._hash)
    topk._ended()
    assert not len(topk._hash)


def test_topk_shuffles_no_document_and_answers_are_few(spark, monkeypatch):
    for name, value in (("SHARD", 5), ("PART", 5), ("BLOCK", 3), ("LEAST", 1)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(i, f"word w{i % 7} v{i % 11}") for i in range(100)], "doc_id long, text string").repartition(4)
    found = topk.search(df, F.col("doc_id") % 20 == 0, k=2)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan  # blocks of queries meet parts of the index where they are written
    pairs = found._jdf.queryExecution().sparkPlan().toString()
    assert f"Coalesce {topk.SHARDS}" in pairs  # a query has at most as many partial answers, however many parts there are
    assert {r["query_id"]: r["rank"] for r in found.orderBy("rank").collect()} == {q: 2 for q in range(0, 100, 20)}


def test_topk_passes_a_part_by_that_cannot_answer(monkeypatch):
    """Twelve documents equal to the query give its ten best; documents with one of its words can't be among them."""
    bags = [topk.words_of(t) for t in ["one two three four five"] * 12 + ["one other"] * 20]
    parts = [topk._part(0, list(range(1, 13)), bags[:12]), topk._part(1, list(range(13, 33)), bags[12:])]
    parts = [topk.ShardIndex({c: p[c][0].as_buffer() for c in ("doc_id", "length", "words", "df", "doc", "tf")}, 3.0, 1.2, 0.75) for p in parts]
    words = bags[0][0]
    columns = {"query_id": [0], "size": [len(words)], "word": words, "often": [32 if w == topk.words_of("one")[0][0] else 12 for w in words]}
    asked = topk.Asked({c: pa.py_buffer(np.array(x, np.int64).tobytes()) for c, x in columns.items()}, 10, 32)
    put, best = [], topk.ShardIndex.best
    monkeypatch.setattr(topk.ShardIndex, "best", lambda self, queries, *a: put.append(len(queries)) or best(self, queries, *a))
    for part in parts:
        asked.meet(part)
    assert sum(put) == 1
    assert asked.answers()["doc_id"].to_pylist() == list(range(1, 11))


def test_topk_reads_texts_once_for_index_and_frequencies(spark, monkeypatch):
    """Frequencies come from the written parts; only rows with a null id, which are in none, are cut into words for them."""
    seen, kept = [], topk._frequencies
    monkeypatch.setattr(topk, "_frequencies", lambda index, others: seen.append((index.columns, others.count())) or kept(index, others))
    docs = spark.createDataFrame([(20, "a b"), (1, "a c"), (2, "b b"), (None, "a a a"), (None, None)], "doc_id long, text string")
    found = topk.search(docs, F.col("doc_id") % 20 == 0).orderBy("rank").collect()
    assert len(seen) == 1 and "words" in seen[0][0] and seen[0][1] == 2
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    score = lambda df, tf, n: round(idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.8)), 9)
    assert {(r.doc_id, r.score) for r in found} == {(1, score(3, 1, 2)), (2, score(2, 2, 2))}


def in_languages(n, seed=5):
    """(ids, texts, languages): short and long texts in three vocabularies with few words in common, some mixed, copied or empty."""
    rng = random.Random(seed)
    texts, langs = [], []
    for i in range(n):
        lang = rng.choice("aaabc")
        size = rng.choice([3, 30, 30, 60, 400])
        words = [f"{lang}{min(int(rng.paretovariate(0.6)), 3000)}" if rng.random() < 0.98 else f"n{rng.randint(0, 50)}" for _ in range(size)]
        if i % 50 == 7:
            words, lang = [rng.choice("abc") + w for w in words], "mixed"
        texts.append("" if i % 90 == 11 else texts[i - 5] if i % 60 == 20 else " ".join(words))
        langs.append(langs[i - 5] if i % 60 == 20 else lang)
    return list(range(n)), texts, langs


def test_topk_puts_documents_of_one_language_together():
    """Once a query has its answers, parts of other languages are passed by without adding up postings."""
    ids, texts, langs = in_languages(1200)
    bags = [topk.words_of(t) for t in texts]
    groups = topk._groups(bags)
    assert sorted(i for g in groups for i in g) == ids
    clear = [g for g in groups if len(g) > 100]
    assert len(clear) == 3 and all(len({langs[i] for i in g if len(bags[i][0]) > 20}) == 1 for g in clear)
    length = [int(n.sum()) for _, n in bags]
    df = Counter(w for words, _ in bags for w in words.tolist())
    shards = [topk.ShardIndex({c: p[c][0].as_buffer() for c in ("doc_id", "length", "words", "df", "doc", "tf")}, sum(length) / len(ids), 1.2, 0.75)
              for p in (topk._part(i, [ids[j] for j in g], [bags[j] for j in g]) for i, g in enumerate(clear))]
    own = next(i for i, g in enumerate(clear) if langs[g[-1]] == "a")
    queries = [i for i in clear[own] if langs[i] == "a" and len(bags[i][0]) > 20]
    words = np.concatenate([bags[i][0] for i in queries])
    columns = {"query_id": queries, "size": [len(bags[i][0]) for i in queries], "word": words, "often": [df[w] for w in words.tolist()]}
    asked = topk.Asked({c: pa.py_buffer(np.array(x, np.int64).tobytes()) for c, x in columns.items()}, 10, len(ids))
    asked.meet(shards[own])
    assert (asked.least > -np.inf).all()
    added, parts = [], topk.ShardIndex.rare_parts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk.ShardIndex, "rare_parts", lambda self, who, rare, q, *a: added.append(q) or parts(self, who, rare, q, *a))
        for i, shard in enumerate(shards):
            if i != own:
                asked.meet(shard)
    assert sum(added) < 0.2 * 2 * len(queries)


@pytest.mark.parametrize("columns", [0, 448])
def test_topk_in_languages_equals_brute_force(spark, monkeypatch, columns):
    """Parts by language and length; sums in 16-bit units and single precision leave out no answer, with equal scores too."""
    for name, value in (("PART", 150), ("SHARD", 200), ("TOGETHER", 7), ("LONG", 5), ("COLUMNS", columns)):
        monkeypatch.setattr(topk, name, value)
    ids, texts, _ = in_languages(900)
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = defaultdict(list)
    for r in topk.search(df, F.col("doc_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    want = {q: a for q, a in bm25(rows, 10).items() if a}
    assert got.keys() == want.keys()
    for q in want:
        assert [a[2] for a in got[q]] == pytest.approx([a[2] for a in want[q]], abs=2e-9)
        assert [a[:2] for a in got[q]] == [a[:2] for a in want[q]]
