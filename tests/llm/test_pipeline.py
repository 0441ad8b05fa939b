"""The pipeline against its operators and brute force, and the guard of the entry module."""

import os
import re
import subprocess
import sys
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from chorus.llm import langid, quality
from chorus.llm.common import table, written

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def first_of_each_class(rows):
    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_stages(spark):
    docs, steps = table(spark, SF, "documents"), []
    for name, stage in pipe.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        steps.append((name, docs))
    got = dict(steps)
    assert [n for n, _ in steps] == ["language_id", "quality", "near_dedup", "pii", "packing"]
    for name, df in steps[:-1]:
        assert df.columns == pipe.COLUMNS, name
    source = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    # language: what the operator rejects goes, rows are otherwise untouched
    kept = {r["doc_id"]: r for r in got["language_id"].collect()}
    plain = table(spark, SF, "documents")
    judged = langid.predict(plain, langid.train(plain)).collect()
    assert set(kept) == {r["doc_id"] for r in judged if not r["rejected"]}
    assert all(r == source[i] for i, r in kept.items())
    # quality
    judged = quality.judge(got["language_id"], table(spark, SF, "labels")).collect()
    kept = {r["doc_id"]: r["text"] for r in got["quality"].collect()}
    assert set(kept) == {r["doc_id"] for r in judged if r["kept"]}
    # near duplicates: one of each class stays
    assert {r["doc_id"] for r in got["near_dedup"].collect()} == first_of_each_class(kept)
    # personal data: gone from the text, all else as before
    before = {r["doc_id"]: r for r in got["near_dedup"].collect()}
    after = {r["doc_id"]: r for r in got["pii"].collect()}
    assert set(before) == set(after)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, r in after.items():
        assert not email.search(r["text"]) and r["n_chars"] == len(r["text"])
        assert "<" in r["text"] or r["text"] == before[i]["text"]
    # packing: the pieces of each document are its ids
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in got["packing"].collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    assert set(pieces) == set(after)
    for i, r in after.items():
        raw = b"".join(p for _, p in sorted(pieces[i]))
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        assert raw == b"".join(x.to_bytes(4, "little") for x in ids)


def test_odd_documents(spark):
    good = " ".join(f"the and of that word{i % 7} with for" for i in range(30))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good, "en", "s", 1), (3, None, "en", "s", 0), (4, "", None, None, None),
            (None, good + " x", "en", "s", 2), (5, "1234 !!", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for _, stage in pipe.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "odd-stage")
    assert [r["doc_id"] for r in docs.collect()] == [1]
    empty = docs.limit(0)
    for _, stage in pipe.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == []


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and repeated ids: distinct texts stay, copies and equal rows leave one, an id in use names the class."""
    clean = [r for r in table(spark, SF, "documents").join(table(spark, SF, "labels").filter("quality = 1 and toxic = 0"), "doc_id", "left_semi")
             .filter("lang = 'en' and n_chars between 400 and 4000").orderBy("doc_id").collect()]
    classes = first_of_each_class({r["doc_id"]: r["text"] for r in clean})
    texts = [r["text"] for r in clean if r["doc_id"] in classes]
    assert len(texts) >= 8
    ids = [None, None, 7, 7, 7, 8, None, 9]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    rows += [(7, texts[2], "en", "s", len(texts[2])), (None, texts[7], "en", "s", 1), (None, texts[0], None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = written(pipe.near_dedup(spark, docs, SF), "unnamed").collect()
    assert sorted(r["text"] for r in out) == sorted(texts[:8])
    assert next(r["doc_id"] for r in out if r["text"] == texts[7]) == 9
    good = written(pipe.good_text(spark, docs, SF), "unnamed-good").collect()
    assert len(good) == len(rows) and {r["text"] for r in good} == set(texts[:8])
    every = table(spark, SF, "documents").select(*pipe.COLUMNS).unionByName(docs.filter("doc_id is null"))
    assert pipe.language(spark, every, SF).filter("doc_id is null").count() == 5


def test_entry_works_without_the_subpackage(tmp_path):
    """Copy the library without these folders and the pipeline: the entry still imports and lists its queries."""
    import shutil
    shutil.copytree(os.path.join(REPO, "chorus"), tmp_path / "chorus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    code = "import __spark_entry__ as e; q = e.queries(); assert {'pipeline', 'op1_near_dedup', 'op10_urls'} <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, env=env, check=True, timeout=120)
