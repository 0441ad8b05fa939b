"""Word statistics over comment text.

Text is split with built-in expressions, exploded, and counted with a partial aggregation
before the shuffle, so a very common word (or a video holding a third of all comments) is
collapsed map-side into one row per task before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..schemas import COMMON_WORDS_LIMIT, STOPWORDS, WORDCLOUD_TOP
from .joins import exclude_words
from .video import _check_sentiment, top_k_per_group


def word_rows(df: DataFrame, text_col: str, keep: list[str], with_position: bool = False) -> DataFrame:
    """One row per word occurrence: ``keep`` columns + ``word`` (+ 1-based ``pos``)."""
    if with_position:
        return df.select(*keep, F.posexplode(words(F.col(text_col))).alias("pos", "word")) \
                 .withColumn("pos", F.col("pos") + 1)
    return df.select(*keep, F.explode(words(F.col(text_col))).alias("word"))


def word_counts(df: DataFrame, text_col: str, group_cols: list[str], drop_stopwords: bool = True,
                min_length: int = 1) -> DataFrame:
    """Count of each word per group; stopwords leave inside the array, before it is exploded."""
    w = words(F.col(text_col))
    if min_length > 1:
        w = F.filter(w, lambda x: F.char_length(x) >= min_length)
    if drop_stopwords:
        w = exclude_words(w, STOPWORDS)
    rows = df.select(*group_cols, F.explode(w).alias("word"))
    return rows.groupBy(*group_cols, "word").agg(F.count(F.lit(1)).alias("n"))


def most_common_words(comments: DataFrame, sentiment: str | None = None, limit: int = COMMON_WORDS_LIMIT,
                      video_id: int | None = None) -> DataFrame:
    """The ``limit`` most common non-stopwords per (video, sentiment); ties by word."""
    src = comments.where(F.col("sentiment").isNotNull())
    if sentiment is not None:
        _check_sentiment(sentiment)
        src = src.where(F.col("sentiment") == F.lit(sentiment))
    if video_id is not None:
        src = src.where(F.col("videoId") == F.lit(video_id))
    counts = word_counts(src, "commentText", ["videoId", "sentiment"])
    return top_k_per_group(counts, ["videoId", "sentiment"], [F.desc("n"), F.asc("word")], limit)


def category_words(comments: DataFrame, videos: DataFrame, top: int = WORDCLOUD_TOP) -> DataFrame:
    """Word-cloud frequencies: top ``top`` words of length >= 2 per video category.

    Words are counted per video first; only the counts meet the videos, so no text moves.
    """
    per_video = word_counts(comments, "commentText", ["videoId"], min_length=2)
    cat = videos.select(F.col("id").alias("__vid"), "category")
    counts = per_video.join(cat, F.col("videoId") == F.col("__vid"), "inner") \
        .groupBy("category", "word").agg(F.sum("n").alias("n"))
    return top_k_per_group(counts, ["category"], [F.desc("n"), F.asc("word")], top)


def group_text(df: DataFrame, group_cols: list[str], text_col: str, order_col: str,
               sep: str = " ", part_rows: int = 256) -> DataFrame:
    """A group's texts joined by ``sep`` in ``order_col`` order, in parts of bounded size.

    ``order_col`` is an integer; ``part`` is its value div ``part_rows``. The parts of a group, joined
    by ``sep`` in their order, are its whole text; no group is gathered into one row.
    """
    part = F.floor(F.col(order_col) / F.lit(part_rows)).cast("bigint").alias("part")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                   F.col(text_col).alias("t"))))
    return df.groupBy(*group_cols, part).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), sep)
                                             .alias("text"))
