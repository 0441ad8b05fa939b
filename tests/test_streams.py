"""The commit log, running counts over it, and incremental ingest with changed, missing and broken comments."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from chorus.session import scratch_path
from chorus.sources import api_json as JS
from chorus.streaming import counts as SC
from chorus.streaming import ingest as SI
from chorus.sources import log as L

ROWS = "videoId long, sentiment string, publishingDate timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def folder(spark, name):
    path = scratch_path(spark, name)
    os.makedirs(path.removeprefix("file:"), exist_ok=True)
    return path


def land(path, name, items):
    with open(f"{path.removeprefix('file:')}/{name}.json", "w") as f:
        f.write(items if isinstance(items, str) else json.dumps({"nextPageToken": name, "items": items}))


def item(i, text="t", day=1, likes=0):
    return {"id": i, "snippet": {"videoId": "vid", "topLevelComment": {"snippet": {
        "textDisplay": text, "likeCount": likes, "publishedAt": None if day is None else f"2024-01-{day:02d}T00:00:00Z"}}}}


# ------------------------------------------------------------------ the log

def test_versions_are_committed_once(spark):
    log = L.CommitLog(spark, folder(spark, "log"))
    assert log.state() == (0, [])
    log.commit(0, {"writer": "a", "batch": 0})
    with pytest.raises(L.Conflict):
        log.commit(0, {"writer": "b", "batch": 0})
    log.append({"writer": "b", "batch": 0})
    assert log.versions() == [0, 1] and log.done("b", 0) and not log.done("b", 1) and not log.done("c", 0)
    assert [e["writer"] for e in log.state()[1]] == ["a", "b"]


def test_folds_keep_what_was_done(spark, monkeypatch):
    monkeypatch.setattr(L, "FOLD", 3)
    log = L.CommitLog(spark, folder(spark, "log"))
    seen = []

    def write(entries, first):
        seen.append(([e["n"] for e in entries], first))
        return {"n": sum(e["n"] for e in entries)}

    for i in range(11):
        log.append({"writer": "w" if i % 2 else "v", "batch": i // 2, "n": 1})
        log.fold(write)
    version, live = log.state()
    assert sum(e["n"] for e in live) == 11 and [e["n"] for e in live] == [9, 1, 1]
    assert seen == [([1, 1, 1], True), ([1, 1, 1], False), ([1, 1, 1], False), ([3, 3, 3], True)]
    assert all(log.done("v", i) for i in range(6)) and all(log.done("w", i) for i in range(5))
    assert not log.done("v", 6) and not log.done("w", 5)


# ------------------------------------------------------------------ ST2

def counts(df):
    return sorted((r["videoId"], r["n"]) for r in df.collect())


def test_a_second_stream_adds_to_the_result(spark):
    """Five rows, then a second source with a new checkpoint of two: seven, not two."""
    result = scratch_path(spark, "result")
    for n in (5, 2):
        landing = scratch_path(spark, "landing")
        df = spark.createDataFrame([(1, "Positive", DAY)] * n, ROWS)
        df.write.parquet(landing)
        got = SC.run_daily_counts(spark, landing, df.schema, result, scratch_path(spark, "ck"))
    assert counts(got) == [(1, 7)]


def test_counts_ignore_a_batch_that_was_not_committed(spark, monkeypatch):
    landing, result, ck = (scratch_path(spark, n) for n in ("landing", "result", "ck"))
    df = spark.createDataFrame([(1, "Positive", DAY)] * 3, ROWS)
    df.write.parquet(landing)
    real = L.CommitLog.append

    def crash(self, entry):
        raise RuntimeError("lost between write and commit")

    monkeypatch.setattr(SC.CommitLog, "append", crash)
    with pytest.raises(Exception, match="lost between write and commit"):
        SC.run_daily_counts(spark, landing, df.schema, result, ck)
    assert SC.read_daily_counts(spark, result).collect() == []
    monkeypatch.setattr(SC.CommitLog, "append", real)
    assert counts(SC.run_daily_counts(spark, landing, df.schema, result, ck)) == [(1, 3)]
    # the batch runs again after its commit
    SC.publish_counts(spark, result, df, L.writer_of(spark, ck), 0)
    assert counts(SC.read_daily_counts(spark, result)) == [(1, 3)]


def test_counts_are_folded(spark, monkeypatch):
    monkeypatch.setattr(L, "FOLD", 3)
    result = scratch_path(spark, "result")
    for i in range(7):
        SC.publish_counts(spark, result, spark.createDataFrame([(i % 2, "Neutral", DAY)] * (i + 1), ROWS), "w", i)
    assert len(L.CommitLog(spark, result).state()[1]) == 3
    assert counts(SC.read_daily_counts(spark, result)) == [(0, 1 + 3 + 5 + 7), (1, 2 + 4 + 6)]


# ------------------------------------------------------------------ ST1

def stored(df):
    return sorted(((r["id"], r["commentText"], r["publishingDate"] and r["publishingDate"].day, r["likeCount"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("fold", [2, 16])
def test_the_copy_landed_last_is_stored(spark, monkeypatch, fold):
    monkeypatch.setattr(L, "FOLD", fold)
    landing, sink, ck = folder(spark, "land"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    batches = [
        [item("a", "one", 1), item("b", "one", 1), item("c", "one", None), item(None, "no id", 2), item("a", "one", 1)],
        [item("a", "one", 1), item("b", "two", 1), item("c", "now dated", 3), item(None, "no id", 2), item("d", "new", 9)],
        [item("a", "moved", 2), item("d", "moved", 1)],
        [item("a", "back", 1), item("d", "moved", 1), item("c", None, None)],
    ]
    at = 1_700_000_000
    for n, page in enumerate(batches):
        land(landing, f"p{n}", page)
        os.utime(f"{landing.removeprefix('file:')}/p{n}.json", (at + n, at + n))
        got = SI.run_ingest(spark, landing, sink, ck)
    want = [("a", "back", 1, 0), ("b", "two", 1, 0), ("c", None, None, 0), ("d", "moved", 1, 0), (None, "no id", 2, 0), (None, "no id", 2, 0)]
    assert stored(got) == sorted(want, key=str)
    table = SI.CommentSink(spark, sink)
    key = spark.range(1).select(JS.video_id(F.lit("vid"))).first()[0]
    assert {r["videoId"] for r in got.collect()} == {key}
    # a new checkpoint over the same pages, all in one batch: nothing is stored twice but comments without an id
    again = SI.run_ingest(spark, landing, sink, scratch_path(spark, "ck"))
    assert [r for r in stored(again) if r[0]] == [r for r in stored(got) if r[0]]
    assert table.rejected().collect() == []


def test_only_the_batch_days_and_buckets_are_read(spark):
    landing, sink, ck = folder(spark, "land"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    land(landing, "p", [item(f"i{n}", "t", 1 + n % 28) for n in range(200)])
    SI.run_ingest(spark, landing, sink, ck)
    table = SI.CommentSink(spark, sink)
    live = table.log.state()[1]
    keys = spark.createDataFrame([("i5", "2024-01-06"), ("i6", "2024-01-20")], "id string, day string")
    same, other = table.same_day(live, keys), table.other_day(live, keys)
    for df in (same, other):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
    assert [r["id"] for r in same.collect()] == ["i5"]
    assert sorted((r["id"], r["day"]) for r in other.collect()) == [("i5", "2024-01-06"), ("i6", "2024-01-07")]


def test_stored_and_rejected_are_what_landed(spark):
    landing, sink = folder(spark, "land"), scratch_path(spark, "sink")
    odd = item("e")
    odd["snippet"]["topLevelComment"]["snippet"]["likeCount"] = "many"
    late = item("f")
    late["snippet"]["topLevelComment"]["snippet"]["publishedAt"] = "soon"
    quoted = item("g")
    quoted["snippet"]["topLevelComment"]["snippet"]["likeCount"] = "12"
    land(landing, "good", [item("UgxA-_1", likes=3), item("b"), quoted])
    land(landing, "odd", [odd, late, {"id": "h"}, item("i")])
    land(landing, "broken", '{"nextPageToken": "x", "items": [{"id"\n[1, 2]\n')
    got = SI.run_ingest(spark, landing, sink, scratch_path(spark, "ck"))
    assert sorted((r["id"], r["likeCount"]) for r in got.collect()) == [("UgxA-_1", 3), ("b", 0), ("g", 12), ("i", 0)]
    bad = SI.CommentSink(spark, sink).rejected().collect()
    assert sorted(r["reason"] for r in bad) == ["likeCount is not a number", "no comment in the item", "not a comment page", "not a comment page",
                                                "publishedAt is not a time"]
    assert all(r["file"].endswith(("odd.json", "broken.json")) and r["raw"] for r in bad)
    batch = JS.read_items(JS.read_comment_pages(spark, landing))
    assert JS.stored_comments(batch).count() + JS.rejected_items(batch).count() == batch.count() == 9


def test_a_lost_commit_stores_nothing_and_a_conflict_is_worked_again(spark, monkeypatch):
    landing, sink, ck = folder(spark, "land"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    land(landing, "p", [item("a", "mine"), item("b")])
    real, calls = L.CommitLog.commit, []

    def first_lost(self, version, entry):
        calls.append(version)
        if len(calls) == 1:
            raise RuntimeError("lost before commit")
        if len(calls) == 2:  # another writer is quicker, with an older copy of one comment
            monkeypatch.setattr(L.CommitLog, "commit", real)
            other = JS.stored_comments(JS.read_items(JS.read_comment_pages(spark, theirs)))
            SI.CommentSink(spark, sink).add(JS.latest_copies(other), spark.createDataFrame([], SI._REJECTED), {"writer": "other", "batch": 0})
        return real(self, version, entry)

    theirs = folder(spark, "theirs")
    land(theirs, "p", [item("a", "theirs", 5), item("z")])
    monkeypatch.setattr(L.CommitLog, "commit", first_lost)
    with pytest.raises(Exception, match="lost before commit"):
        SI.run_ingest(spark, landing, sink, ck)
    assert SI.CommentSink(spark, sink).log.versions() == []
    got = SI.run_ingest(spark, landing, sink, ck)
    assert stored(got) == [("a", "mine", 1, 0), ("b", "t", 1, 0), ("z", "t", 1, 0)]
