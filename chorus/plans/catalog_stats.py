"""Registered queries: quantiles, ranks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_length
from ..operators import joins as J
from ..operators import profile as P
from ..operators import stats as S
from ..schemas import QUANTILES, SENTIMENTS
from ..sources import adapters as A
from .catalog_profile import _nearest_sql
from .registry import register


@register("a12_like_reply_quantiles", A.with_adapters("comments_wide") + """
, lq AS """ + _nearest_sql("comments_wide", "likeCount", QUANTILES) + """
, rq AS """ + _nearest_sql("comments_wide", "replies", QUANTILES) + """
SELECT lq.quantile, lq.value AS likeCount, rq.value AS replies FROM lq JOIN rq USING (quantile)""")
def a12_like_reply_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A12 + J8 + F18: nearest quantiles (0, .25, .5, .75, 1) of likes and replies, side by side."""
    w = A.comments_wide(spark, sf)
    lq = S.quantiles(w, "likeCount").withColumnRenamed("value", "likeCount")
    rq = S.quantiles(w, "replies").withColumnRenamed("value", "replies")
    return J.zip_on(lq, rq, "quantile")


@register("a12_comments_per_video_quantiles", A.with_adapters("comments_wide") + """
, per AS (SELECT videoId, count(*) AS n FROM comments_wide GROUP BY videoId)
SELECT * FROM """ + _nearest_sql("per", "n", QUANTILES))
def a12_comments_per_video_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest quantiles of the comment count per video."""
    per = P.rows_per_key(A.comments_wide(spark, sf), "videoId")
    return S.quantiles(per, "n")


@register("a12_length_q99_by_sentiment", A.with_adapters("comments") + """
, lens AS (SELECT sentiment, length(commentText) AS length FROM comments WHERE sentiment IS NOT NULL)
SELECT * FROM """ + _nearest_sql("lens", "length", [0.99], "sentiment"))
def a12_length_q99_by_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """A12 (grouped): the .99 nearest quantile of comment length per sentiment."""
    c = A.comments(spark, sf, "sentiment", "commentText").where(F.col("sentiment").isNotNull())
    lens = c.select("sentiment", char_length(F.col("commentText")).alias("length"))
    return S.quantiles(lens, "length", [0.99], ["sentiment"])


@register("w2_like_average_ranks", A.with_adapters("comments_wide") + """
, vc AS (SELECT likeCount, count(*) AS cnt FROM comments_wide GROUP BY likeCount)
SELECT likeCount, cnt,
  sum(cnt) OVER (ORDER BY likeCount ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt
    + (cnt + 1) / 2.0 AS avg_rank
FROM vc""")
def w2_like_average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Average-tie rank of every distinct like count (distributed, no global window)."""
    return S.average_ranks(A.comments_wide(spark, sf), "likeCount")


@register("a22_chisquare_sentiment", A.with_adapters("comments_wide") + """
, o AS (SELECT s.sentiment, CAST(count(w.sentiment) AS DOUBLE) AS o
        FROM (VALUES ('Positive'), ('Neutral'), ('Negative')) AS s(sentiment)
        LEFT JOIN comments_wide w ON w.sentiment = s.sentiment GROUP BY s.sentiment)
, st AS (SELECT sum((o - e) * (o - e) / e) AS statistic FROM o, (SELECT sum(o) / 3.0 AS e FROM o) t)
SELECT round(statistic, 9) AS statistic, round(exp(-(statistic / 2.0)), 12) AS p_value,
       exp(-(statistic / 2.0)) < 0.05 AS reject FROM st""")
def a22_chisquare_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square goodness of fit of the sentiment counts against equal shares."""
    t = S.chisquare_uniform(A.comments_wide(spark, sf), "sentiment", SENTIMENTS)
    return t.select(F.round("statistic", 9).alias("statistic"), F.round("p_value", 12).alias("p_value"),
                    "reject")


@register("a22_chisquare_likes", A.with_adapters("comments_wide") + """
, o AS (SELECT s.sentiment, CAST(coalesce(sum(w.likeCount), 0) AS DOUBLE) AS o
        FROM (VALUES ('Positive'), ('Neutral'), ('Negative')) AS s(sentiment)
        LEFT JOIN comments_wide w ON w.sentiment = s.sentiment GROUP BY s.sentiment)
, st AS (SELECT sum((o - e) * (o - e) / e) AS statistic FROM o, (SELECT sum(o) / 3.0 AS e FROM o) t)
SELECT round(statistic, 6) AS statistic, round(exp(-(statistic / 2.0)), 12) AS p_value,
       exp(-(statistic / 2.0)) < 0.05 AS reject FROM st""")
def a22_chisquare_likes(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square goodness of fit of the likes per sentiment against equal shares."""
    t = S.chisquare_uniform(A.comments_wide(spark, sf), "sentiment", SENTIMENTS, value_col="likeCount")
    return t.select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 12).alias("p_value"),
                    "reject")


def _kruskal_sql(src: str) -> str:
    return f"""
, x AS (SELECT g, v FROM {src} WHERE g IS NOT NULL)
, vc AS (SELECT v, count(*) AS t FROM x GROUP BY v)
, r AS (SELECT v, t, sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t
          + (t + 1) / 2.0 AS avg_rank FROM vc)
, gs AS (SELECT x.g, sum(r.avg_rank) AS R, count(*) AS ng FROM x JOIN r USING (v) GROUP BY x.g)
, tot AS (SELECT CAST(sum(t) AS DOUBLE) AS N, sum(CAST(t AS DOUBLE) ^ 3 - t) AS tie FROM vc)
, h AS (SELECT (12.0 / (N * (N + 1)) * (SELECT sum(R * R / ng) FROM gs) - 3 * (N + 1))
               / (1.0 - tie / (N * N * N - N)) AS H, N, (SELECT count(*) FROM gs) AS k FROM tot)
SELECT CAST(N AS BIGINT) AS n, k, round(H, 9) AS statistic, round(exp(-(H / 2.0)), 12) AS p_value,
       exp(-(H / 2.0)) < 0.05 AS reject FROM h"""


@register("a23_kruskal_length", A.with_adapters("comments") + """
, src AS (SELECT sentiment AS g, length(commentText) AS v FROM comments)""" + _kruskal_sql("src"))
def a23_kruskal_length(spark: SparkSession, sf: str) -> DataFrame:
    """A23 + W2: Kruskal-Wallis test of comment length across the three sentiments."""
    c = A.comments(spark, sf, "sentiment", "commentText").select("sentiment", char_length(F.col("commentText")).alias("length"))
    t = S.kruskal_wallis(c, "length", "sentiment")
    return t.select("n", "k", F.round("statistic", 9).alias("statistic"),
                    F.round("p_value", 12).alias("p_value"), "reject")


@register("a23_kruskal_likes", A.with_adapters("comments_wide") + """
, src AS (SELECT sentiment AS g, likeCount AS v FROM comments_wide)""" + _kruskal_sql("src"))
def a23_kruskal_likes(spark: SparkSession, sf: str) -> DataFrame:
    """Kruskal-Wallis test of likes across sentiments (heavy ties)."""
    w = A.comments_wide(spark, sf)
    t = S.kruskal_wallis(w, "likeCount", "sentiment")
    return t.select("n", "k", F.round("statistic", 9).alias("statistic"),
                    F.round("p_value", 12).alias("p_value"), "reject")
