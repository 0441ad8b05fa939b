"""Registered queries: dataset profiling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_length
from ..operators import joins as J
from ..operators import profile as P
from ..operators import stats as S
from ..operators.batches import map_rows
from ..schemas import LABEL_IDS, LENGTH_HISTOGRAM_BINS
from ..session import scratch_path
from ..sources import adapters as A
from .registry import register

LN3 = repr(math.log(3.0))


def _wide_with_category(spark: SparkSession, sf: str) -> DataFrame:
    w = A.comments_wide(spark, sf)
    v = A.videos(spark, sf).select(F.col("id").alias("__vid"), "category")
    return w.join(v, w["videoId"] == v["__vid"], "inner").drop("__vid")


_CW_SQL = A.with_adapters("comments_wide", "videos") + """
, cw AS (SELECT w.*, v.category FROM comments_wide w JOIN videos v ON v.id = w.videoId)
"""


@register("a3_distinct_counts", A.with_adapters("comments_wide") + """
SELECT CAST(count(DISTINCT videoId) + max(CASE WHEN videoId IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_videoId,
       CAST(count(DISTINCT authorId) + max(CASE WHEN authorId IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_authorId
FROM comments_wide""")
def a3_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A3: distinct videos and authors (NULL counted as a value)."""
    return P.distinct_counts(A.comments_wide(spark, sf), ["videoId", "authorId"])


@register("a3_distinct_by_month", A.with_adapters("comments_wide") + """
SELECT date_trunc('month', publishingDate) AS period, count(DISTINCT videoId) AS exact_videoId, count(DISTINCT authorId) AS exact_authorId,
  true AS videos_within_error, true AS authors_within_error FROM comments_wide GROUP BY 1""")
def a3_distinct_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """A3: distinct videos and authors by month from stored daily sketches, within 5 percent of the exact counts (six standard errors)."""
    w, path = A.comments_wide(spark, sf), scratch_path(spark, "daily-sketches")
    P.distinct_sketches(w, F.date_trunc("day", "publishingDate"), ["videoId", "authorId"]).write.parquet(path)
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    told = P.merged_distinct(spark.read.parquet(path), ["videoId", "authorId"], month("part"))
    exact = w.groupBy(month("publishingDate").alias("period")).agg(F.countDistinct("videoId").alias("exact_videoId"), F.countDistinct("authorId").alias("exact_authorId"))
    near = lambda c: (F.abs(F.col(f"n_{c}") - F.col(f"exact_{c}")) <= 0.05 * F.col(f"exact_{c}"))
    return exact.join(told, exact["period"].eqNullSafe(told["period"])).select(
        exact["period"], "exact_videoId", "exact_authorId", near("videoId").alias("videos_within_error"), near("authorId").alias("authors_within_error"))


@register("a4_mean_rows_per_video", A.with_adapters("comments_wide") + """
SELECT count(*) / count(DISTINCT videoId) AS mean_rows FROM comments_wide""")
def a4_mean_rows_per_video(spark: SparkSession, sf: str) -> DataFrame:
    """A4: mean comments per distinct video."""
    return P.mean_rows_per_key(A.comments_wide(spark, sf), "videoId")


@register("a5_rows_per_author", A.with_adapters("comments_wide") + """
SELECT authorId, count(*) AS n FROM comments_wide GROUP BY authorId""")
def a5_rows_per_author(spark: SparkSession, sf: str) -> DataFrame:
    """A5: comments per author."""
    return P.rows_per_key(A.comments_wide(spark, sf), "authorId")


@register("a5_rows_per_video", A.with_adapters("comments_wide") + """
SELECT videoId, count(*) AS n FROM comments_wide GROUP BY videoId""")
def a5_rows_per_video(spark: SparkSession, sf: str) -> DataFrame:
    """A5: comments per video."""
    return P.rows_per_key(A.comments_wide(spark, sf), "videoId")


@register("a6_author_occurrences", A.with_adapters("comments_wide") + """
SELECT occurrences, count(*) AS n_keys FROM
  (SELECT authorId, count(*) AS occurrences FROM comments_wide GROUP BY authorId) t
GROUP BY occurrences""")
def a6_author_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + T5: how many authors wrote 1, 2, ... comments (ascending)."""
    return P.occurrence_histogram(A.comments_wide(spark, sf), "authorId")


@register("a7_first_bucket_pct", A.with_adapters("comments_wide") + """
, h AS (SELECT occurrences, count(*) AS n_keys FROM
  (SELECT authorId, count(*) AS occurrences FROM comments_wide GROUP BY authorId) t GROUP BY occurrences)
SELECT arg_min(n_keys, occurrences) / sum(n_keys) * 100.0 AS pct FROM h""")
def a7_first_bucket_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Percent of authors in the lowest occurrence bucket."""
    return P.first_bucket_share(P.occurrence_histogram(A.comments_wide(spark, sf), "authorId"))


@register("a8_top_author", A.with_adapters("comments_wide") + """
SELECT authorId, count(*) AS n FROM comments_wide GROUP BY authorId ORDER BY n DESC, authorId LIMIT 1""")
def a8_top_author(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent author (ties: smallest id)."""
    return P.most_frequent(A.comments_wide(spark, sf), "authorId")


_DATASET_COLS = ["CommentID", "VideoID", "VideoTitle", "AuthorName", "AuthorChannelID", "CommentText",
                 "Sentiment", "Likes", "Replies", "PublishedAt", "CountryCode", "CategoryID"]


@register("a9_null_counts", A.with_adapters("dataset") + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _DATASET_COLS) + " FROM dataset")
def a9_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """NULL count of every dataset column, one pass."""
    return P.null_counts(A.dataset(spark, sf), _DATASET_COLS)


@register("a10_country_pct", A.with_adapters("dataset") + """
, vc AS (SELECT CountryCode, count(*) AS n FROM dataset GROUP BY CountryCode)
SELECT CountryCode, n, n / (SELECT sum(n) FROM vc) * 100.0 AS pct FROM vc""")
def a10_country_pct(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + J6: rows per country code with percent of all rows, descending."""
    return P.value_counts_pct(A.dataset(spark, sf, "CountryCode"), "CountryCode")


@register("a11_sentiment_counts", A.with_adapters("comments_wide") + """
SELECT sentiment, count(*) AS n FROM comments_wide GROUP BY sentiment""")
def a11_sentiment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per sentiment."""
    return P.value_counts(A.comments_wide(spark, sf), "sentiment")


@register("a11_language_counts", A.with_adapters("comments") + """
SELECT language, count(*) AS n FROM comments GROUP BY language""")
def a11_language_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per language."""
    return P.value_counts(A.comments(spark, sf, "language"), "language")


@register("a11_category_counts", _CW_SQL + "SELECT category, count(*) AS n FROM cw GROUP BY category")
def a11_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + J4: rows per category name."""
    return P.value_counts(_wide_with_category(spark, sf), "category")


def _label_map(spark: SparkSession) -> DataFrame:
    from ..sources.literal import literal_table
    return literal_table(spark, list(LABEL_IDS.items()), [("sentiment", "string"), ("label", "int")])


@register("j3_strict_label_encode", A.with_adapters("comments_wide") + """
SELECT w.videoId, w.authorId, w.sentiment, m.label FROM comments_wide w
JOIN (VALUES ('Positive', 0), ('Neutral', 1), ('Negative', 2)) AS m(sentiment, label)
  ON m.sentiment = w.sentiment""")
def j3_strict_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + F13: strict sentiment -> label id (an unmapped value fails the job)."""
    w = A.comments_wide(spark, sf).select("videoId", "authorId", "sentiment")
    return J.lookup_strict(w, F.col("sentiment"), _label_map(spark), "sentiment", "label")


@register("j3_unmapped_categories", A.with_adapters("videos_raw", "category_map") + """
SELECT DISTINCT CAST(categoryId AS INTEGER) AS value FROM videos_raw
WHERE CAST(categoryId AS INTEGER) NOT IN (SELECT categoryId FROM category_map)""")
def j3_unmapped_categories(spark: SparkSession, sf: str) -> DataFrame:
    """J3 pre-check: category ids a strict lookup would reject."""
    v = A.videos_raw(spark, sf)
    return J.unmapped_values(v, F.col("categoryId").cast("int"), A.category_map(spark), "categoryId")


@register("w1_category_sentiment_share", _CW_SQL + """
SELECT category, sentiment, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY category) AS proportion
FROM cw GROUP BY category, sentiment""")
def w1_category_sentiment_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each sentiment inside each category."""
    return P.group_proportions(_wide_with_category(spark, sf), "category", "sentiment")


_A13_SQL = _CW_SQL + """
, c AS (SELECT category,
   count(*) FILTER (WHERE sentiment = 'Negative') AS neg,
   count(*) FILTER (WHERE sentiment = 'Neutral') AS neu,
   count(*) FILTER (WHERE sentiment = 'Positive') AS pos
   FROM cw GROUP BY category)
, wide AS (SELECT category, neg / (neg + neu + pos) AS Negative, neu / (neg + neu + pos) AS Neutral,
   pos / (neg + neu + pos) AS Positive FROM c)
"""


@register("a13_category_sentiment_wide", _A13_SQL + "SELECT * FROM wide")
def a13_category_sentiment_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Per-category sentiment shares pivoted wide (missing class 0.0)."""
    return P.proportions_wide(_wide_with_category(spark, sf), "category", "sentiment")


def _ent_term(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN {c} * (ln({c}) / {LN3}) ELSE 0.0 END"


@register("a14_category_entropy", _A13_SQL + f"""
SELECT category, round(-({_ent_term('Negative')} + {_ent_term('Neutral')} + {_ent_term('Positive')}) + 0.0, 9)
  AS entropy FROM wide""")
def a14_category_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """A14 + F11 + U3: normalised sentiment entropy (base 3) per category, ascending."""
    wide = P.proportions_wide(_wide_with_category(spark, sf), "category", "sentiment")
    e = P.entropy(wide, "category")
    return e.select("category", F.round("entropy", 9).alias("entropy")).orderBy("entropy", "category")


@register("u3_entropy_rows", _A13_SQL + f"""
SELECT category, round(-({_ent_term('Negative')} + {_ent_term('Neutral')} + {_ent_term('Positive')}) + 0.0, 9)
  AS entropy FROM wide""")
def u3_entropy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The entropy of A14 as a Python function of each row; the same values."""
    wide = P.proportions_wide(_wide_with_category(spark, sf), "category", "sentiment")
    base = math.log(3)
    found = map_rows(wide, lambda r: -sum(p * math.log(p) / base for p in r[1:] if p > 0), "double", "entropy")
    return found.select("category", (F.round("entropy", 9) + 0.0).alias("entropy"))


@register("a15_sentiment_share", A.with_adapters("comments_wide") + """
, s AS (SELECT sentiment, sum(likeCount) AS l, sum(replies) AS r FROM comments_wide GROUP BY sentiment)
SELECT sentiment, l / (SELECT sum(l) FROM s) AS share_likeCount, r / (SELECT sum(r) FROM s) AS share_replies
FROM s""")
def a15_sentiment_share(spark: SparkSession, sf: str) -> DataFrame:
    """A15 + J6: each sentiment's share of all likes and all replies."""
    return P.share_of_totals(A.comments_wide(spark, sf), "sentiment", ["likeCount", "replies"])


def _linear_median_sql(src: str, group: str, val: str) -> str:
    return f"""
(SELECT {group}, CASE WHEN lo_v IS NULL THEN NULL ELSE lo_v + (hi_v - lo_v) * frac END AS median FROM (
  SELECT {group},
    max(CASE WHEN i = floor((n - 1) * 0.5) THEN {val} END)::DOUBLE AS lo_v,
    max(CASE WHEN i = ceil((n - 1) * 0.5) THEN {val} END)::DOUBLE AS hi_v,
    max((n - 1) * 0.5 - floor((n - 1) * 0.5)) AS frac
  FROM (SELECT {group}, {val}, row_number() OVER (PARTITION BY {group} ORDER BY {val}) - 1 AS i,
               count(*) OVER (PARTITION BY {group}) AS n FROM {src}) r
  GROUP BY {group}) m)"""


@register("a16_length_stats", A.with_adapters("comments") + """
, lens AS (SELECT sentiment, length(commentText) AS length FROM comments WHERE sentiment IS NOT NULL)
, med AS """ + _linear_median_sql("lens", "sentiment", "length") + """
SELECT l.sentiment, avg(length) AS mean, round(stddev_samp(length), 9) AS std, any_value(med.median) AS median,
  CASE l.sentiment WHEN 'Positive' THEN 0 WHEN 'Neutral' THEN 1 ELSE 2 END AS rank
FROM lens l JOIN med USING (sentiment) GROUP BY l.sentiment""")
def a16_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A16 + T4: median, mean and sample std of comment length per sentiment."""
    out = P.length_stats(A.comments(spark, sf, "commentText", "sentiment"), "commentText", "sentiment")
    return out.withColumn("std", F.round("std", 9))


def _nearest_sql(src: str, val: str, probs: list[float], group: str | None = None) -> str:
    part = f"PARTITION BY {group}" if group else ""
    gsel = f"{group}, " if group else ""
    qs = " UNION ALL ".join(f"SELECT {q!r}::DOUBLE AS quantile" for q in probs)
    return f"""
(SELECT {gsel}q.quantile, CAST(r.{val} AS DOUBLE) AS value
 FROM (SELECT {gsel}{val}, row_number() OVER ({part} ORDER BY {val}) - 1 AS rn__,
              count(*) OVER ({part}) AS cnt__ FROM {src} WHERE {val} IS NOT NULL) r
 JOIN ({qs}) q ON r.rn__ = floor((r.cnt__ - 1) * q.quantile + 0.5))"""


@register("a17_length_histogram", A.with_adapters("comments") + """
, lens AS (SELECT length(commentText) AS x FROM comments)
, q AS """ + _nearest_sql("lens", "x", [0.99]) + """
, kept AS (SELECT CAST(x AS DOUBLE) AS x FROM lens WHERE x >= 1 AND x <= (SELECT value FROM q))
, rng AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 450.0 AS w FROM kept)
, b AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 449) ELSE 0 END AS INTEGER) AS bin,
          lo, w FROM kept, rng)
SELECT bin, count(*) AS n, any_value(lo) + bin * any_value(w) AS bin_start,
       any_value(lo) + (bin + 1) * any_value(w) AS bin_end FROM b GROUP BY bin""")
def a17_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A17 + A12: 450-bin histogram of comment length, limited to [1, q99]."""
    lens = A.comments(spark, sf, "commentText").select(char_length(F.col("commentText")).alias("x"))
    counts = S.value_counts(lens, "x")
    q99 = S.quantiles(lens, "x", [0.99], counts=counts).select(F.col("value").alias("__q99"))
    kept = J.with_scalars(counts, q99).where((F.col("x") >= 1) & (F.col("x") <= F.col("__q99")))
    return P.histogram(kept, "x", LENGTH_HISTOGRAM_BINS, weight="cnt")


@register("a17_video_count_histogram", A.with_adapters("comments_wide") + """
, per AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM comments_wide GROUP BY videoId)
, rng AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30.0 AS w FROM per)
, b AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 29) ELSE 0 END AS INTEGER) AS bin,
          lo, w FROM per, rng)
SELECT bin, count(*) AS n, any_value(lo) + bin * any_value(w) AS bin_start,
       any_value(lo) + (bin + 1) * any_value(w) AS bin_end FROM b GROUP BY bin""")
def a17_video_count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """30-bin histogram of comments per video."""
    per = P.rows_per_key(A.comments_wide(spark, sf), "videoId")
    return P.histogram(per, "n", 30)


@register("a28_pct_predicates", A.with_adapters("comments") + """
SELECT avg(CAST(coalesce(language = 'en', false) AS DOUBLE)) * 100.0 AS pct_en,
       avg(CAST(coalesce(likeCount > 0, false) AS DOUBLE)) * 100.0 AS pct_liked,
       avg(CAST(coalesce(replies > 0, false) AS DOUBLE)) * 100.0 AS pct_replied FROM comments""")
def a28_pct_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Percent of comments in English, with likes, with replies."""
    c = A.comments(spark, sf, "language", "likeCount", "replies")
    return P.pct_where(c, {"pct_en": F.col("language") == "en", "pct_liked": F.col("likeCount") > 0,
                           "pct_replied": F.col("replies") > 0})


@register("p6_english_comments", A.with_adapters("comments") + """
SELECT id, videoId, sentiment FROM comments WHERE language = 'en'""")
def p6_english_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Keep English comments."""
    return P.keep_value(A.comments(spark, sf, "id", "videoId", "sentiment", "language"), "language", "en").select("id", "videoId", "sentiment")


@register("p7_top_author_names", A.with_adapters("dataset") + """
SELECT d.CommentID, d.AuthorName FROM dataset d WHERE d.AuthorChannelID =
  (SELECT AuthorChannelID FROM dataset GROUP BY AuthorChannelID ORDER BY count(*) DESC, AuthorChannelID LIMIT 1)""")
def p7_top_author_names(spark: SparkSession, sf: str) -> DataFrame:
    """P7 + A8: names on the rows of the most frequent author channel."""
    d = A.dataset(spark, sf, "CommentID", "AuthorName", "AuthorChannelID")
    top = P.most_frequent(d, "AuthorChannelID").select("AuthorChannelID")
    return d.join(F.broadcast(top), "AuthorChannelID", "left_semi").select("CommentID", "AuthorName")


@register("p8_longest_comments", A.with_adapters("comments") + """
SELECT id, videoId, length(commentText) AS commentLength FROM comments
WHERE length(commentText) = (SELECT max(length(commentText)) FROM comments)""")
def p8_longest_comments(spark: SparkSession, sf: str) -> DataFrame:
    """P8 + J6: every comment of maximal length (ties kept)."""
    c = A.comments(spark, sf, "id", "videoId", "commentText")
    return P.rows_at_max(c, char_length(F.col("commentText")), "commentLength").drop("commentText")


@register("p10_rename", A.with_adapters("dataset") + """
SELECT CommentID AS comment_id, Sentiment AS label, Likes AS likes FROM dataset""")
def p10_rename(spark: SparkSession, sf: str) -> DataFrame:
    """P10: rename and reorder columns."""
    d = A.dataset(spark, sf, "CommentID", "Sentiment", "Likes")
    return P.rename(d, {"CommentID": "comment_id", "Sentiment": "label", "Likes": "likes"})


@register("p11_likes_shift", A.with_adapters("dataset") + """
SELECT Likes + 1 AS Likes, Replies, Sentiment FROM dataset""")
def p11_likes_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Likes + 1, Replies, Sentiment."""
    return P.likes_shift(A.dataset(spark, sf))


@register("t3_top_languages", A.with_adapters("comments") + """
SELECT language, count(*) AS n FROM comments GROUP BY language ORDER BY n DESC, language LIMIT 10""")
def t3_top_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most common languages."""
    return P.top_values(A.comments(spark, sf, "language"), "language", 10)


@register("f20_category_order", A.with_adapters("comments", "videos") + """
, f AS (SELECT v.category, min(c.id) AS first FROM comments c JOIN videos v ON v.id = c.videoId
        GROUP BY v.category)
SELECT category, first, row_number() OVER (ORDER BY first, category) - 1 AS position FROM f""")
def f20_category_order(spark: SparkSession, sf: str) -> DataFrame:
    """categories in first-appearance order of the comments."""
    c = A.comments(spark, sf, "id", "videoId")
    v = A.videos(spark, sf).select(F.col("id").alias("__vid"), "category")
    cv = c.join(v, c["videoId"] == v["__vid"], "inner")
    return P.first_appearance_order(cv, "category", "id")
