"""Foreign CSV, many tasks a file, against Python's csv module."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.schemas import DATASET_SCHEMA
from chorus.session import scratch_path
from chorus.sources import files as FS
from chorus.sources import records as R

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "more")])


def written(spark, name, rows, end="\n", bom=False, head=("id", "text", "more"), path=None):
    path = path or scratch_path(spark, "foreign").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.csv", "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([head, *rows])
    return path


def corpus(seed, n):
    rng = random.Random(seed)
    piece = ["word", "two\nlines", 'a "quoted" word', "\n", '"', '""', ",", "50%25 off %0A ok", "é😀", "\r\n", " ", "\\", "tab\t", "x" * 90]
    text = lambda: "".join(rng.choice(piece) for _ in range(rng.choice([0, 1, 3, 40])))
    return [(str(i), text(), text()) for i in range(n)]


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_equals_the_csv_module(spark, monkeypatch, small_splits, end, shuffled):
    if shuffled:
        monkeypatch.setattr(R, "ODD_SPLITS", 0)
    path, want = None, []
    for n, (size, bom) in enumerate(((120, False), (1, True), (0, False), (40, True))):
        rows = [(f"{n}-{i}", a, b) for i, a, b in corpus(n, size)]
        path = written(spark, f"f{n}", rows, end, bom, path=path)
        want += [tuple(v or None for v in r) for r in rows]
    states = R.split_states(spark, path)
    assert states.count() > 20 and states.where("starts = 1").count() > 3  # files are cut inside texts
    got = [tuple(r) for r in FS.read_csv(spark, path, SCHEMA, foreign=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_text_over_several_splits(spark, small_splits):
    rows = [("1", "start\n" + "a line of text\n" * 400 + "end", "m"), ("2", "b", "c"), ("3", 'x"\n"y' * 300, "\n")]
    path = written(spark, "long", rows)
    assert sorted(map(tuple, FS.read_csv(spark, path, SCHEMA, foreign=True).collect())) == rows


def test_the_comment_dataset_comes_back_unchanged(spark, small_splits):
    names = DATASET_SCHEMA.names
    row = {c: "" for c in names} | {"CommentID": "Ugx-1", "CommentText": 'line one\nline two, "quoted", 50%25 off %0A ok', "CountryCode": "US", "Likes": "3"}
    path = written(spark, "comments", [[row[c] for c in names]] * 30, head=names)
    got = FS.read_comment_dataset(spark, path, foreign=True)
    assert got.schema.names == names and got.count() == 30
    assert {(r["CommentText"], r["CountryCode"], r["Likes"]) for r in got.collect()} == {(row["CommentText"], "US", 3)}
    splits = FS.load_splits(spark, {"train": path, "test": path}, DATASET_SCHEMA, foreign=True)
    assert {(r["split"], r["n"]) for r in splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {("train", 30), ("test", 30)}


def test_what_is_no_such_file_is_refused(spark):
    other = written(spark, "x", [("1", "a", "b")], head=("id", "more", "text"))
    with pytest.raises(Exception, match="the header is"):
        FS.read_csv(spark, other, SCHEMA, foreign=True).collect()
    path = scratch_path(spark, "open").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/x.csv", "w") as f:
        f.write('id,text,more\n1,"never closed,b\n')
    with pytest.raises(ValueError, match="not closed"):
        FS.read_csv(spark, path, SCHEMA, foreign=True)
