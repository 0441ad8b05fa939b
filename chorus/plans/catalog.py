"""The registered queries: every one reads the driver tables (through the adapters) in full.

Per-video questions are registered in their all-videos form (grouped by ``videoId``), which is
the whole-table batch job; the single-video form is the same operator with ``video_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import video as V
from ..operators import words as W
from ..sources import adapters as A
from ..schemas import EMOJI_PATTERN
from .registry import REGISTRY, register
from .sqltext import SQL_STOPWORDS, sql_str, sql_words

# Loaded for their @register side effects.
from . import catalog_profile, catalog_stats, catalog_eval, catalog_io  # noqa: F401,E402




# ---------------------------------------------------------------------------- video ----

@register("p1_list_videos", A.with_adapters("videos_raw") + "SELECT videoName, id, channelName FROM videos_raw")
def p1_list_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Every video's name, id and channel."""
    return V.list_videos(A.videos_raw(spark, sf))


@register("p2_video_info", A.with_adapters("videos", "comments_wide") + """
, st AS (SELECT videoId, sum(likeCount) AS likeCount, count(*) AS commentCount
         FROM comments_wide GROUP BY videoId)
SELECT v.id, v.videoName, v.channelName, v.videoKey, v.categoryId, v.viewCount, v.publishingDate, v.category,
  CAST(coalesce(st.likeCount, 0) AS BIGINT) AS likeCount,
  CAST(coalesce(st.commentCount, 0) AS BIGINT) AS commentCount,
  CASE WHEN v.viewCount <> 0
       THEN CAST(coalesce(st.likeCount, 0) + coalesce(st.commentCount, 0) AS DOUBLE) / CAST(v.viewCount AS DOUBLE)
       ELSE 0.0 END AS engagementRate
FROM videos v LEFT JOIN st ON st.videoId = v.id""")
def p2_video_info(spark: SparkSession, sf: str) -> DataFrame:
    """P2 + F9 + J4: video rows with like/comment totals and engagement rate."""
    return V.video_info(A.videos(spark, sf), A.comments_wide(spark, sf))


@register("p3_video_comments", A.with_adapters("comments") + """
SELECT id, videoId, commentText, sentiment, likeCount, publishingDate FROM comments""")
def p3_video_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The comments of every video (stored Comment columns)."""
    return V.video_comments(A.comments(spark, sf, "id", "videoId", "commentText", "sentiment", "likeCount", "publishingDate")).select(
        "id", "videoId", "commentText", "sentiment", "likeCount", "publishingDate")


@register("p4_negative_comments", A.with_adapters("comments_wide") + """
SELECT videoId, authorId, likeCount, publishingDate FROM comments_wide WHERE sentiment = 'Negative'""")
def p4_negative_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of one sentiment (Negative), for every video."""
    return V.comments_with_sentiment(A.comments_wide(spark, sf), "Negative").select(
        "videoId", "authorId", "likeCount", "publishingDate")


@register("p5_date_range", A.with_adapters("comments") + """
SELECT id, videoId, sentiment, publishingDate FROM comments
WHERE publishingDate BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 00:00:00'""")
def p5_date_range(spark: SparkSession, sf: str) -> DataFrame:
    """P5: comments published between two instants, both included."""
    return V.comments_in_range(A.comments(spark, sf), "2024-01-02 00:00:00", "2024-01-03 00:00:00")


@register("p12_comment_lengths", A.with_adapters("comments") + """
SELECT id, videoId, sentiment, length(commentText) AS commentLength FROM comments""")
def p12_comment_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """P12 + F5: sentiment and character length of every comment."""
    return V.comment_lengths(A.comments(spark, sf, "id", "videoId", "sentiment", "commentText"))


@register("a1_sentiment_counts", A.with_adapters("comments_wide") + """
SELECT videoId, sentiment, count(*) AS n_comments FROM comments_wide GROUP BY videoId, sentiment""")
def a1_sentiment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1: comment count per video and sentiment (high-volume stream)."""
    return V.sentiment_counts(A.comments_wide(spark, sf))


@register("a1_sentiment_counts_text", A.with_adapters("comments") + """
SELECT videoId, sentiment, count(*) AS n_comments FROM comments GROUP BY videoId, sentiment""")
def a1_sentiment_counts_text(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on the text comments: unlabelled comments form the NULL sentiment group."""
    return V.sentiment_counts(A.comments(spark, sf, "videoId", "sentiment"))


@register("a2_like_totals", A.with_adapters("comments_wide") + """
SELECT videoId, sentiment, sum(likeCount) AS likes FROM comments_wide GROUP BY videoId, sentiment""")
def a2_like_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A2: like total per video and sentiment."""
    return V.like_totals(A.comments_wide(spark, sf))


@register("t1_most_liked", A.with_adapters("comments") + """
SELECT * FROM (
  SELECT videoId, id, commentText, likeCount, sentiment,
    row_number() OVER (PARTITION BY videoId ORDER BY likeCount DESC, id ASC) AS rank
  FROM comments) t WHERE rank <= 5""")
def t1_most_liked(spark: SparkSession, sf: str) -> DataFrame:
    """Five most liked comments of every video (ties by id)."""
    return V.most_liked(A.comments(spark, sf), 5)


@register("j7_comment_video", A.with_adapters("comments", "videos") + """
SELECT c.id, c.videoId, c.sentiment, v.videoName, v.category
FROM comments c JOIN videos v ON v.id = c.videoId""")
def j7_comment_video(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with their video's name and category (foreign-key join)."""
    from ..operators.joins import with_parent
    c = A.comments(spark, sf, "id", "videoId", "sentiment")
    return with_parent(c, A.videos(spark, sf), "videoId", "id", ["videoName", "category"])


@register("j7_orphan_comments", A.with_adapters("comments_wide", "videos_raw") + """
SELECT w.videoId, w.authorId, w.likeCount FROM comments_wide w
WHERE NOT EXISTS (SELECT 1 FROM videos_raw v WHERE v.id = w.videoId)""")
def j7_orphan_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments whose video does not exist (anti join)."""
    from ..operators.joins import orphans
    w = A.comments_wide(spark, sf).select("videoId", "authorId", "likeCount")
    return orphans(w, A.videos_raw(spark, sf), "videoId", "id")


# ---------------------------------------------------------------------------- words ----

@register("f3_words", A.with_adapters("comments") + f"""
SELECT id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word
FROM (SELECT id, {sql_words('commentText')} AS w FROM comments) t""")
def f3_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every comment with its position (punctuation/digits deleted,
    lower-cased, split on Unicode whitespace)."""
    return W.word_rows(A.comments(spark, sf, "id", "commentText"), "commentText", ["id"], with_position=True)


@register("a25_most_common_words", A.with_adapters("comments") + f"""
, sw AS ({SQL_STOPWORDS}),
wr AS (SELECT videoId, sentiment, unnest({sql_words('commentText')}) AS word
       FROM comments WHERE sentiment IS NOT NULL),
cnt AS (SELECT videoId, sentiment, word, count(*) AS n FROM wr
        WHERE word NOT IN (SELECT word FROM sw) GROUP BY videoId, sentiment, word)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY videoId, sentiment ORDER BY n DESC, word)
  AS rank FROM cnt) t WHERE rank <= 10""")
def a25_most_common_words(spark: SparkSession, sf: str) -> DataFrame:
    """A25 + P4 + J5 + T2: ten most common non-stopwords per video and sentiment."""
    return W.most_common_words(A.comments(spark, sf, "videoId", "commentText", "sentiment"), None, 10)


@register("a26_category_words", A.with_adapters("comments", "videos") + f"""
, sw AS ({SQL_STOPWORDS}),
wr AS (SELECT v.category, unnest({sql_words('c.commentText')}) AS word
       FROM comments c JOIN videos v ON v.id = c.videoId),
cnt AS (SELECT category, word, count(*) AS n FROM wr
        WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM sw) GROUP BY category, word)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word)
  AS rank FROM cnt) t WHERE rank <= 100""")
def a26_category_words(spark: SparkSession, sf: str) -> DataFrame:
    """A26 + W3: word-cloud table, top 100 words (length >= 2) per video category."""
    return W.category_words(A.comments(spark, sf, "videoId", "commentText"), A.videos(spark, sf), 100)


@register("a24_conversation_text", """
SELECT conv_id, turn // 256 AS part, string_agg(text, ' ' ORDER BY turn) AS text
FROM conversations GROUP BY ALL""")
def a24_conversation_text(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of a conversation joined in turn order, in parts of 256 turns."""
    conv = A.read_table(spark, sf, "conversations")
    return W.group_text(conv, ["conv_id"], "text", "turn")


@register("f4_strip_emoji", f"""
SELECT doc_id, regexp_replace(text, {sql_str(EMOJI_PATTERN)}, '', 'g') AS text_clean FROM documents""")
def f4_strip_emoji(spark: SparkSession, sf: str) -> DataFrame:
    """documents with every emoji code point removed."""
    from ..functions.text import strip_emoji
    d = A.read_table(spark, sf, "documents")
    return d.select("doc_id", strip_emoji(F.col("text")).alias("text_clean"))


def queries() -> dict:
    return {name: e.build for name, e in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}
