"""Cases that once gave wrong answers: strict joins, NULLs, CSV texts, time stamps, streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from chorus.functions.scalar import parse_iso_timestamp, sentiment_order, unparsed_timestamps
from chorus.operators import joins as J
from chorus.operators import profile as P
from chorus.operators import stats as S
from chorus.session import ensure_checkpoint_dir, scratch_path
from chorus.sources import adapters as A
from chorus.sources import api_json as JS
from chorus.sources import files as FS
from chorus.streaming import counts as SC
from chorus.streaming import ingest as SI
from conftest import SF_SMALL


def test_strict_lookup_fails_whatever_is_selected(spark):
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    good = spark.createDataFrame([(1, 2), (1, 3)], "x int, v int")
    bad = spark.createDataFrame([(1, 2), (9, 3)], "x int, v int")
    assert J.lookup_strict(good, F.col("x"), names, "k", "name").agg(F.sum("v")).first()[0] == 5
    with pytest.raises(Exception, match="unmapped value: 9"):
        J.lookup_strict(bad, F.col("x"), names, "k", "name").count()
    with pytest.raises(Exception, match="unmapped value: 9"):
        J.lookup_strict(bad, F.col("x"), names, "k", "name").agg(F.sum("v")).collect()


def test_attach_refuses_unequal_sides(spark):
    five, three = spark.range(5).toDF("a"), spark.range(3).toDF("b")
    assert J.attach_by_position(five, spark.range(5).toDF("b")).count() == 5
    for left, right in ((five, three), (three.toDF("a"), five.toDF("b"))):
        with pytest.raises(Exception, match="different numbers of rows"):
            J.attach_by_position(left, right).count()
    rows, preds = spark.range(3).toDF("id"), spark.createDataFrame([(0, "x"), (1, "y")], "id long, p string")
    with pytest.raises(Exception, match="do not match at 2"):
        J.attach_predictions(rows, preds, "id").count()
    assert J.attach_predictions(rows.where("id < 2"), preds, "id").count() == 2


def test_with_scalars_takes_one_row(spark):
    df = spark.range(3)
    assert J.with_scalars(df, df.agg(F.max("id").alias("m"))).where("m = 2").count() == 3
    assert J.with_scalars(df, df.where("id > 9").withColumnRenamed("id", "m")).count() == 0
    with pytest.raises(Exception, match="one row"):
        J.with_scalars(df, df.withColumnRenamed("id", "m")).count()


def test_shares_with_only_null_classes(spark):
    df = spark.createDataFrame([("a", "Positive"), ("b", None), ("b", None)], "g string, s string")
    got = {r["g"]: (r["Negative"], r["Neutral"], r["Positive"]) for r in P.proportions_wide(df, "g", "s").collect()}
    assert got == {"a": (0.0, 0.0, 1.0), "b": (0.0, 0.0, 0.0)}
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "g string, v int")
    assert [r["share_v"] for r in P.share_of_totals(zero, "g", ["v"]).collect()] == [None, None]


def test_percent_counts_unknowns_in_the_denominator(spark):
    df = spark.createDataFrame([("en",), ("de",), (None,), (None,)], "l string")
    assert P.pct_where(df, {"p": F.col("l") == "en"}).first()["p"] == 25.0


def test_kruskal_groups_and_size(spark):
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = S.kruskal_wallis(two, "v", "g").first()
    assert r["k"] == 2 and abs(r["p_value"] - 0.121335) < 1e-6
    with pytest.raises(ValueError):
        S.kruskal_wallis(two, "v", "g", k=3)


def test_quantiles_and_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([("a" if i % 3 else "b", i * 37 % 101) for i in range(500)] + [("c", 5), ("c", None)], "g string, v int")
    import numpy as np
    pdf = df.toPandas().dropna()
    for how in ("nearest", "linear"):
        got = {(r["g"], r["quantile"]): r["value"] for r in S.quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], ["g"], how).collect()}
        for (g, q), value in got.items():
            x = np.sort(pdf[pdf.g == g].v.to_numpy())
            want = x[int((len(x) - 1) * q + 0.5)] if how == "nearest" else np.quantile(x, q)
            assert value == pytest.approx(want)
        assert len(got) == 12
    ranks = {r["v"]: r["avg_rank"] for r in S.average_ranks(df, "v").collect()}
    want = pdf.v.rank().groupby(pdf.v).first().to_dict()
    assert ranks == pytest.approx({int(k): v for k, v in want.items()})


def test_chisquare_on_sums(spark):
    df = spark.createDataFrame([("Positive", 30), ("Neutral", 15), ("Neutral", 5), ("Negative", 10)], "s string, likes int")
    r = S.chisquare_uniform(df, "s", ["Positive", "Neutral", "Negative"], value_col="likes").first()
    assert abs(r["statistic"] - 10) < 1e-9 and abs(r["p_value"] - 0.006738) < 1e-6 and r["reject"]


def test_report_order(spark):
    df = spark.createDataFrame([("Negative",), ("Positive",), ("Neutral",)], "s string")
    assert [r[0] for r in df.orderBy(sentiment_order(F.col("s"))).collect()] == ["Positive", "Neutral", "Negative"]


def test_iso_timestamps(spark):
    d = dt.datetime
    want = {"2024-01-02T03:04:05Z": d(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05.123456": d(2024, 1, 2, 3, 4, 5, 123456),
            "2024-01-02T03:04:05+02:00": d(2024, 1, 2, 1, 4, 5), "2024-01-02T03:04:05-0130": d(2024, 1, 2, 4, 34, 5),
            "2024-01-02": d(2024, 1, 2), "2024-01-02 03:04:05": d(2024, 1, 2, 3, 4, 5), "2024-01-02T03": d(2024, 1, 2, 3),
            "2024-01-02T03:04": d(2024, 1, 2, 3, 4), "2024-13-02": None, "soon": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_iso_timestamp(F.col("s")).alias("t")).collect()}
    assert got == want
    assert df.agg(unparsed_timestamps(F.col("s"))).first()[0] == 3


def test_csv_keeps_texts_as_they_are(spark):
    texts = ["  lead and trail  ", "", None, 'a "quoted" text', "two\nlines\r\nand \\ more", "100%", "%0A", "\\N", "a,b", "\t", "é😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    path = scratch_path(spark, "csv")
    FS.write_csv(df, path, rows_per_file=3)
    assert [r["t"] for r in FS.read_csv(spark, path, df.schema).orderBy("i").collect()] == texts
    assert sum(f.endswith(".csv") for f in os.listdir(path.removeprefix("file:"))) >= 4
    foreign = scratch_path(spark, "foreign").removeprefix("file:")
    os.makedirs(foreign)
    with open(f"{foreign}/x.csv", "w") as f:
        f.write('i,t\n1,"two\nlines"\n2,\n3, kept \n')
    got = [r["t"] for r in FS.read_csv(spark, f"file://{foreign}", df.schema, foreign=True).orderBy("i").collect()]
    assert got == ["two\nlines", None, " kept "]


def test_stream_ingest_loses_no_comment(spark):
    base = dt.datetime(2020, 1, 1)
    ids = [(i * 7919) % 600 for i in range(600)]  # any order of dates
    item = lambda i: {"id": str(i), "snippet": {"videoId": "1", "topLevelComment": {"snippet": {
        "textDisplay": f"t{i}", "likeCount": i, "publishedAt": None if i % 50 == 0 else (base + dt.timedelta(days=i)).isoformat() + "Z"}}}}
    landing, sink, ck = (scratch_path(spark, n) for n in ("land", "sink", "ck"))
    folder = landing.removeprefix("file:")
    os.makedirs(folder)
    pages = [ids[at:at + 50] for at in range(0, 600, 50)]
    for n, page in enumerate(pages[:8] + pages[2:5]):  # some pages landed twice
        with open(f"{folder}/{n}.json", "w") as f:
            f.write(json.dumps({"nextPageToken": str(n), "items": [item(i) for i in page + page[:3]]}))
    SI.run_ingest(spark, landing, sink, ck, max_files_per_trigger=2)
    for n, page in enumerate(pages[6:], 100):
        with open(f"{folder}/{n}.json", "w") as f:
            f.write(json.dumps({"nextPageToken": str(n), "items": [item(i) for i in page]}))
    got = SI.run_ingest(spark, landing, sink, ck)
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(600))
    assert got.where("publishingDate IS NULL").count() == 12


def test_stream_counts_keep_missing_dates_and_grow(spark):
    rows = [(1, "Positive", dt.datetime(2024, 1, 1, 5)), (1, "Positive", dt.datetime(2024, 1, 1, 9)), (1, None, None), (2, "Neutral", None)]
    df = spark.createDataFrame(rows, "videoId long, sentiment string, publishingDate timestamp_ntz")
    landing, result, ck = (scratch_path(spark, n) for n in ("land", "res", "ck"))
    df.write.parquet(landing)
    SC.run_daily_counts(spark, landing, df.schema, result, ck)
    df.write.mode("append").parquet(landing)
    got = SC.run_daily_counts(spark, landing, df.schema, result, ck)
    day = dt.datetime(2024, 1, 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(day, 1, "Positive", 4), (None, 1, None, 2), (None, 2, "Neutral", 2)], key=str)


def test_videos_have_a_stable_id_and_the_last_copy_counts(spark):
    path = scratch_path(spark, "videos")
    page = lambda likes: [{"pageInfo": {"totalResults": 1}, "items": [{"id": "abc", "snippet": {
        "title": "t", "channelTitle": "c", "publishedAt": "2024-01-02T03:04:05Z", "categoryId": "10"},
        "statistics": {"viewCount": "1", "likeCount": likes, "commentCount": "1"}}]}]
    import time
    for n, likes in enumerate(("9", "100", "20")):
        spark.read.schema(JS.VIDEO_PAGE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(p) for p in page(likes)], 1)) \
            .write.json(f"{path}/{n}")
        time.sleep(0.05)
    got = JS.ingest_videos(JS.read_video_pages(spark, f"{path}/*"), A.category_map(spark)).collect()
    assert [(r["videoKey"], r["likeCount"], r["category"]) for r in got] == [("abc", 20, "Music")]
    want = spark.createDataFrame([("abc",)], "k string").select(JS.video_id(F.col("k"))).first()[0]
    assert got[0]["id"] == want


def test_every_comment_has_a_sentiment_and_no_document_is_lost(spark):
    docs = A.read_table(spark, SF_SMALL, "documents").count()
    c = A.comments(spark, SF_SMALL)
    assert c.count() == docs and c.where("sentiment IS NULL").count() == 0
    assert A.predictions(spark, SF_SMALL, with_text=True).where("Predicted IS NOT NULL AND Sentiment IS NOT NULL").count() == docs


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_texts_do_not_move_for_word_counts(spark):
    from chorus.plans import catalog
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["a26_category_words"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in plan.splitlines():
        if "Exchange hashpartitioning(videoId" in line or "Exchange hashpartitioning(source" in line:
            assert "commentText" not in line and "text" not in line
