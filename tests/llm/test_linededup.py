"""Line dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import linededup as ld

WHITE = " \t\n\x0b\x0c\r"
DDL = "doc_id long, text string"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least, shortest, keep):
    held = defaultdict(list)
    for d, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= max(1, shortest):
                held[k].append(i)
    common = {k: min((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    if keep == "first":
        common = {k: f for k, f in common.items() if f is not None}
    out = []
    for i, t in rows:
        lines, left, seen = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if k not in common or (keep == "first" and common[k] == i and k not in seen):
                left.append(x)
            seen.add(k)
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def corpus():
    rng = random.Random(3)
    lines = ["", " ", "\t", "Hello World", "hello world  ", "\x0bhello WORLD", "ÄÖ Straße", "äö straße", " nbsp", "日本 語", "x", "X", "aİb"]
    lines += [f"Line number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 5, 30])))) for i in range(80)]
    rows += [(None, "hello world\nLine number 3"), (None, "only without id\nonly without id"), (None, "only without id"),
             (200, None), (201, ""), (202, "\n\n"), (5, "Line number 5\nline NUMBER 5"), (5, "Line number 5\nline NUMBER 5"),
             (300, "\n".join(f"long {i % 9000}" for i in range(20_000))), (301, "long 17\nq" * 3), (302, "ends with\n")]
    return rows


@pytest.mark.parametrize("least,shortest,keep", [(2, 1, "first"), (2, 1, "none"), (10, 1, "none"), (3, 6, "first"), (1, 1, "none"), (1, 1, "first")])
@pytest.mark.parametrize("large", [False, True])
def test_equals_brute_force(spark, monkeypatch, least, shortest, keep, large):
    if large:  # many segments and parts of filters, no broadcast, positions joined
        for name, value in (("SEGMENT", 64), ("HELD", 50), ("WORDS", 0), ("KEY_BYTES", -1)):
            monkeypatch.setattr(ld, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, DDL).withColumn("key", F.lit("z")).withColumn("n_lines", F.lit(-1)).repartition(7)
    got = ld.drop_repeated(df, least, shortest, keep).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, least, shortest, keep), key=str)


def test_no_rows(spark):
    assert ld.drop_repeated(spark.createDataFrame([], DDL)).collect() == []


def test_filter_holds_every_repeat_and_few_others():
    rng = np.random.default_rng(1)
    once, again = rng.integers(-(1 << 63), 1 << 63, 40_000), rng.integers(-(1 << 63), 1 << 63, 500)
    parts = [np.concatenate([p, again]) for p in np.split(once, 8)]
    words = (len(once) + 8 * len(again)) // ld.LINES_A_WORD
    seen = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    for p in parts:
        word, bits = ld._words(p, words)
        for w, b in zip(word, bits):
            seen[1][w] |= seen[0][w] & b
            seen[0][w] |= b
    hit = lambda h: np.array([seen[1][w] & b == b for w, b in zip(*ld._words(h, words))])
    assert hit(again).all() and hit(once).mean() < 0.02


def test_hash_places_are_the_same_in_spark_and_numpy(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("h"))
    word, bits = ld.word_and_bits(F.col("h"), 1031)
    got = rows.select("h", word.alias("w"), bits.alias("b")).collect()
    w, b = ld._words(np.array([r["h"] for r in got]), 1031)
    assert [r["w"] for r in got] == w.tolist() and [r["b"] for r in got] == b.view(np.int64).tolist()


def test_only_suspects_are_shuffled(spark, monkeypatch):
    """The rows that meet the exchange by key are those that pass the twice-filter."""
    texts = [(i, f"mine {i}\nalso {i}\nshared") for i in range(400)]
    df = spark.createDataFrame(texts, DDL)
    found = ld.repeated_keys(df, 10)
    assert [tuple(r) for r in found.collect()] == [("shared", 400, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
