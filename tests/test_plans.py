"""Physical-plan properties the library relies on at scale."""

import __spark_entry__ as entry
from conftest import SF_SMALL

Q = entry.queries()


def plan(spark, name):
    df = Q[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_group_limits_before_the_shuffle(spark):
    for name in ("t1_most_liked", "a25_most_common_words", "a26_category_words"):
        p = plan(spark, name)
        assert "WindowGroupLimit" in p, name


def test_word_counts_aggregate_partially(spark):
    p = plan(spark, "a25_most_common_words")
    assert "partial_count" in p


def _formatted(df):
    from io import StringIO
    import contextlib
    buf = StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_columns_pruned_at_the_scan(spark):
    out = _formatted(Q["a1_sentiment_counts"](spark, SF_SMALL))
    # only the two columns the question needs are read from lineitem
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in out


def test_date_filter_reaches_the_scan(spark):
    out = _formatted(Q["p5_date_range"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in out


def test_no_python_in_core_queries(spark):
    for name in ("a25_most_common_words", "a12_like_reply_quantiles", "a23_kruskal_likes", "f14_token_ids",
                 "p2_video_info", "a18_confusion_matrix"):
        p = plan(spark, name)
        assert "Python" not in p and "ArrowEvalPython" not in p, name


def test_tables_that_no_column_needs_are_not_joined(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("f3_words", "f14_token_ids", "f15_token_length", "u4_batched_map", "a10_country_pct", "a11_language_counts", "p12_comment_lengths",
                     "p6_english_comments", "a26_category_words"):
            p = plan(spark, name)
            wanted = {"p6_english_comments": 1, "p12_comment_lengths": 1, "a26_category_words": 1}.get(name, 0)  # labels, labels, videos
            assert p.count("SortMergeJoin") == wanted, name
            assert "events.parquet" not in p, name
        p = plan(spark, "p9_outlier_cut")
        assert "SortMergeJoin" not in p and "labels.parquet" not in p and "events.parquet" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
