"""Hand-made cases for the operators (ties, NULLs, empty input, missing classes)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chorus.operators import evaluate as E
from chorus.operators import joins as J
from chorus.operators import model as M
from chorus.operators import profile as P
from chorus.operators import stats as S
from chorus.operators import video as V
from chorus.operators import words as W
from chorus.sources import adapters as A


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_a1_counts_with_null(spark):
    df = spark.createDataFrame([(1, 1, "Positive"), (2, 1, "Positive"), (3, 1, "Negative"), (4, 1, None)],
                               "id long, videoId long, sentiment string")
    got = {r["sentiment"]: r["n_comments"] for r in V.sentiment_counts(df, 1).collect()}
    assert got == {"Positive": 2, "Negative": 1, None: 1}
    with pytest.raises(V.NotFound):
        V.require_rows(V.sentiment_counts(df, 99), "comments")


def test_a3_distinct_counts_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    assert P.distinct_counts(df, ["x"], count_null=False).first()[0] == 2
    assert P.distinct_counts(df, ["x"], count_null=True).first()[0] == 3


def test_a6_a7_occurrences(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "author string")
    h = P.occurrence_histogram(df, "author")
    assert rows(h, "occurrences", "n_keys") == [(1, 2), (2, 1)]
    assert round(P.first_bucket_share(h).first()["pct"], 2) == 66.67


def test_a12_nearest_and_linear(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "v double")
    q = {r["quantile"]: r["value"] for r in S.quantiles(df, "v").collect()}
    assert q == {0.0: 1.0, 0.25: 2.0, 0.5: 3.0, 0.75: 3.0, 1.0: 4.0}
    med = S.median_linear(df, "v").first()["median"]
    assert med == 2.5


def test_quantiles_many_values_match_numpy(spark):
    import numpy as np
    vals = [(i * 7919) % 1000 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = {r["quantile"]: r["value"] for r in S.quantiles(df, "v", [0.1, 0.5, 0.99]).collect()}
    s = sorted(vals)
    for q, v in got.items():
        assert v == s[int(math.floor((len(s) - 1) * q + 0.5))]
    lin = S.quantiles(df, "v", [0.37], interpolation="linear").first()["value"]
    assert abs(lin - float(np.quantile(vals, 0.37))) < 1e-9


def test_w2_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [10, 20, 20, 30, 30, 30]], "v long")
    got = rows(S.average_ranks(df, "v"), "v", "avg_rank")
    assert got == [(10, 1.0), (20, 2.5), (30, 5.0)]


def test_a14_entropy(spark):
    df = spark.createDataFrame([("a", .5, .25, .25), ("b", 1.0, 0.0, 0.0), ("c", 1 / 3, 1 / 3, 1 / 3)],
                               "g string, Negative double, Neutral double, Positive double")
    got = {r["g"]: r["entropy"] for r in P.entropy(df, "g").collect()}
    assert abs(got["a"] - 0.946395) < 1e-6 and got["b"] == 0.0 and abs(got["c"] - 1.0) < 1e-12


def test_a22_chisquare(spark):
    data = [("Positive",)] * 30 + [("Neutral",)] * 20 + [("Negative",)] * 10
    df = spark.createDataFrame(data, "s string")
    r = S.chisquare_uniform(df, "s", ["Positive", "Neutral", "Negative"]).first()
    assert abs(r["statistic"] - 10.0) < 1e-12 and abs(r["p_value"] - 0.006738) < 1e-6 and r["reject"]


def test_chi2_sf_odd_and_even(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    r = df.select(S.chi2_sf(F.col("x"), 1).alias("a"), S.chi2_sf(F.col("x"), 3).alias("b"),
                  S.chi2_sf(F.col("x"), 4).alias("c")).first()
    # reference values of the chi-square upper tail at x = 3
    assert abs(r["a"] - 0.0832645166635504) < 1e-9
    assert abs(r["b"] - 0.3916251762710877) < 1e-9
    assert abs(r["c"] - 0.5578254003710745) < 1e-9


@pytest.mark.parametrize("groups,h,p", [
    ({"a": [1, 2], "b": [3, 4], "c": [5, 6]}, 4.571429, 0.101701),
    ({"a": [1, 1], "b": [1, 2], "c": [2, 3]}, 3.583333, 0.166682),
])
def test_a23_kruskal(spark, groups, h, p):
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v double")
    r = S.kruskal_wallis(df, "v", "g", k=3).first()
    assert abs(r["statistic"] - h) < 1e-6 and abs(r["p_value"] - p) < 1e-6 and not r["reject"]


def test_a23_null_value_raises(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "g string, v double")
    with pytest.raises(Exception):
        S.kruskal_wallis(df, "v", "g", k=3).collect()


def test_a18_a19_a20(spark):
    pf = spark.createDataFrame([("Positive", "Positive"), ("Positive", "Negative"),
                                ("Negative", "Negative"), ("Neutral", "Negative")],
                               "Sentiment string, Predicted string")
    cm = {r["Predicted"]: r.asDict() for r in E.confusion_matrix(pf).collect()}
    assert cm["Negative"]["Negative"] == .25 and cm["Negative"]["Positive"] == .25
    assert cm["Negative"]["Neutral"] == .25 and cm["Positive"]["Positive"] == .25
    assert cm["Positive"]["Neutral"] == 0.0 and "Neutral" not in cm
    acc = {r["Sentiment"]: r["accuracy"] for r in E.class_accuracy(pf).collect()}
    assert acc == {"Positive": .5, "Negative": 1.0, "Neutral": 0.0}
    assert E.accuracy(pf).first()["accuracy"] == .5


def test_a21_cross_entropy(spark):
    lg = spark.createDataFrame([([2.0, 1.0, 0.0], 0), ([0.0, 0.0, 0.0], 2)], "logits array<double>, label int")
    assert abs(E.cross_entropy(lg).first()["cross_entropy"] - 0.753109) < 1e-6


def test_a25_most_common_words(spark):
    df = spark.createDataFrame([(1, 7, "Don't stop, STOP!!", "Positive"), (2, 7, "stop 123 the video", "Positive")],
                               "id long, videoId long, commentText string, sentiment string")
    got = rows(W.most_common_words(df, "Positive", 10, video_id=7), "word", "n")
    assert got == [("stop", 3), ("video", 1)]
    empty = W.most_common_words(df, "Negative", 10, video_id=7)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        W.most_common_words(df, "Angry", 10)


def test_t1_most_liked_ties(spark):
    df = spark.createDataFrame([(i, 1, f"t{i}", like, "Positive") for i, like in
                                [(1, 5), (2, 9), (3, 9), (4, 1), (5, 9), (6, 0)]],
                               "id long, videoId long, commentText string, likeCount long, sentiment string")
    assert [r["id"] for r in V.most_liked(df, 3, video_id=1).collect()] == [2, 3, 5]
    assert rows(V.most_liked(df, 2), "id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        V.most_liked(df, -1, video_id=1)


def test_p5_inclusive_range(spark):
    ts = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(i, 1, "Positive", t) for i, t in enumerate(ts)],
                               "id long, videoId long, sentiment string, publishingDate timestamp_ntz")
    got = V.comments_in_range(df, "2024-01-01 00:00:00", "2024-01-02 00:00:00", video_id=1)
    assert rows(got, "id") == [(0,), (1,)]


def test_p8_ties_and_p9_cut(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdefghi"), (3, "ihgfedcba")], "id long, t string")
    assert rows(P.rows_at_max(df, F.char_length("t"), "len"), "id") == [(2,), (3,)]
    vals = spark.createDataFrame([(float(x),) for x in [1] * 10 + [100]], "x double")
    assert rows(P.outlier_cut(vals, F.col("x"), 2.0), "x") == [(1.0,)] * 10


def test_j3_strict_and_j4_default(spark):
    cats = A.category_map(spark)
    df = spark.createDataFrame([(27,), (999,)], "c int")
    got = rows(J.lookup_default(df, F.col("c"), cats, "categoryId", "category", "No category"), "c", "category")
    assert got == [(27, "Education"), (999, "No category")]
    with pytest.raises(Exception):
        J.lookup_strict(df, F.col("c"), cats, "categoryId", "category").collect()
    ok = J.lookup_strict(df.where("c = 27"), F.col("c"), cats, "categoryId", "category")
    assert ok.first()["category"] == "Education"


def test_j1_positional(spark):
    a = spark.createDataFrame([(i,) for i in range(50)], "x long").orderBy("x")
    b = spark.createDataFrame([(i * 10,) for i in range(50)], "y long").orderBy("y")
    got = rows(J.attach_by_position(a, b), "x", "y")
    assert got == [(i, i * 10) for i in range(50)]


def test_x1_hash_buckets(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "id long")
    got = [r[0] for r in df.orderBy("id").select(M.hash_bucket(F.col("id"))).collect()]
    assert got == [16, 60, 5, 10, 57, 27]
    split = M.hash_split(spark.range(1000), F.col("id"), 0.8)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 1000 and 700 < counts["train"] < 900


def test_f14_pad_and_truncate(spark):
    import hashlib
    a, b, c, zz = (int(hashlib.md5(w.encode()).hexdigest()[:15], 16) + 2 for w in ("a", "b", "c", "zz"))
    df = spark.createDataFrame([(1, "a b c"), (2, "A zz!"), (3, ""), (4, None)], "id long, t string")
    seq = {r["id"]: r["x"] for r in df.select("id", M.token_sequence(F.col("t"), 5).alias("x")).collect()}
    assert seq == {1: [a, b, c, 0, 0], 2: [a, zz, 0, 0, 0], 3: [0] * 5, 4: [0] * 5}
    short = {r["id"]: r["x"] for r in df.select("id", M.token_sequence(F.col("t"), 2).alias("x")).collect()}
    assert short == {1: [a, b], 2: [a, zz], 3: [0, 0], 4: [0, 0]}


def test_a24_group_text_order(spark):
    df = spark.createDataFrame([(1, 2, "world"), (1, 1, "hello"), (2, 1, "solo")], "g long, o long, t string")
    assert rows(W.group_text(df, ["g"], "t", "o"), "g", "text") == [(1, "hello world"), (2, "solo")]
    assert rows(W.group_text(df, ["g"], "t", "o", part_rows=2), "g", "part", "text") == [
        (1, 0, "hello"), (1, 1, "world"), (2, 0, "solo")]


def test_a17_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x double")
    got = rows(P.histogram(df, "x", 5, lower=1, upper=4), "bin", "n")
    # kept 1..4, width 0.6: 1->0, 2->1, 3->3, 4->4 (last bin closed)
    assert got == [(0, 1), (1, 1), (3, 1), (4, 1)]


def test_s8_delete_missing_id_is_noop(spark):
    from chorus.sources import store as ST
    videos = spark.createDataFrame([(1,), (2,)], "id long")
    comments = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "videoId long, cid long")
    v, c = ST.delete_videos(videos, comments, spark.createDataFrame([(99,)], "id long"))
    assert v.count() == 2 and c.count() == 3
    v, c = ST.delete_videos(videos, comments, spark.createDataFrame([(2,)], "id long"))
    assert rows(v, "id") == [(1,)] and rows(c, "cid") == [(10,)]


def test_a3_approximate_close_to_exact(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"))
    exact = P.distinct_counts(df, ["k"], count_null=False).first()[0]
    approx = P.distinct_counts(df, ["k"], count_null=False, approximate=True, rsd=0.01).first()[0]
    assert exact == 5000 and abs(approx - exact) / exact < 0.05
