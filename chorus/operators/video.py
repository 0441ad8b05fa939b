"""Per-video questions (P1-P5, P12, A1, A2, T1) and the video statistics they rely on.

Each operator takes the comments (and videos) DataFrames. With ``video_id`` it answers for one
video (the filter reaches the Parquet scan); without, it answers for every video at once,
grouped by ``videoId`` - the batch form used on whole tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import engagement_rate
from ..functions.text import char_length
from ..schemas import MOST_LIKED_LIMIT, SENTIMENTS


class NotFound(LookupError):
    """The question names a video (or comments) that do not exist."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise ``NotFound`` when ``df`` is empty (one-row probe, not a count)."""
    if not df.take(1):
        raise NotFound(f"{what} not found")
    return df


def _for_video(comments: DataFrame, video_id: int | None) -> DataFrame:
    return comments if video_id is None else comments.where(F.col("videoId") == F.lit(video_id))


def _check_sentiment(sentiment: str) -> None:
    if sentiment not in SENTIMENTS:
        raise ValueError(f"sentiment must be one of {SENTIMENTS}, got {sentiment!r}")


def list_videos(videos: DataFrame) -> DataFrame:
    """Name, id and channel of every video."""
    return videos.select("videoName", "id", "channelName")


def video_stats(comments: DataFrame) -> DataFrame:
    """Per-video like total and comment count (partial aggregation before the shuffle)."""
    return comments.groupBy("videoId").agg(
        F.sum("likeCount").alias("likeCount"), F.count(F.lit(1)).alias("commentCount"))


def video_info(videos: DataFrame, comments: DataFrame, video_id: int | None = None) -> DataFrame:
    """Video rows with their counts and the engagement rate."""
    v = videos if video_id is None else videos.where(F.col("id") == F.lit(video_id))
    stats = video_stats(_for_video(comments, video_id))
    out = (v.join(stats, v["id"] == stats["videoId"], "left").drop("videoId")
           .withColumn("likeCount", F.coalesce("likeCount", F.lit(0)).cast("bigint"))
           .withColumn("commentCount", F.coalesce("commentCount", F.lit(0)).cast("bigint")))
    return out.withColumn("engagementRate",
                          engagement_rate(F.col("likeCount"), F.col("commentCount"), F.col("viewCount")))


def video_comments(comments: DataFrame, video_id: int | None = None) -> DataFrame:
    """All comments of a video (empty -> use ``require_rows`` for not-found)."""
    return _for_video(comments, video_id)


def comments_with_sentiment(comments: DataFrame, sentiment: str, video_id: int | None = None) -> DataFrame:
    """Comments of a video AND of one sentiment."""
    _check_sentiment(sentiment)
    return _for_video(comments, video_id).where(F.col("sentiment") == F.lit(sentiment))


def comments_in_range(comments: DataFrame, lower: datetime | str, upper: datetime | str,
                      video_id: int | None = None) -> DataFrame:
    """P5: sentiment and date of comments published in [lower, upper], both ends included."""
    lo = F.lit(lower).cast("timestamp_ntz")
    hi = F.lit(upper).cast("timestamp_ntz")
    return (_for_video(comments, video_id)
            .where(F.col("publishingDate").between(lo, hi))
            .select("id", "videoId", "sentiment", "publishingDate"))


def comment_lengths(comments: DataFrame, video_id: int | None = None) -> DataFrame:
    """Sentiment and character length of each comment."""
    return _for_video(comments, video_id).select(
        "id", "videoId", "sentiment", char_length(F.col("commentText")).alias("commentLength"))


def sentiment_counts(comments: DataFrame, video_id: int | None = None) -> DataFrame:
    """A1: comment count per (video, sentiment); only sentiments present appear."""
    return (_for_video(comments, video_id).groupBy("videoId", "sentiment")
            .agg(F.count(F.lit(1)).alias("n_comments")))


def like_totals(comments: DataFrame, video_id: int | None = None) -> DataFrame:
    """A2: like total per (video, sentiment)."""
    return (_for_video(comments, video_id).groupBy("videoId", "sentiment")
            .agg(F.sum("likeCount").alias("likes")))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    ``row_number() <= k`` lets Spark insert a partial per-partition limit before the shuffle
    (WindowGroupLimit), so a group holding a third of all rows sends at most ``k`` rows per
    map task across the network.
    """
    if k < 0:
        raise ValueError("limit must be >= 0")
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def most_liked(comments: DataFrame, limit: int = MOST_LIKED_LIMIT,
               video_id: int | None = None) -> DataFrame:
    """The ``limit`` most liked comments of each video (ties broken by id)."""
    src = _for_video(comments, video_id).select(
        "videoId", "id", "commentText", "likeCount", "sentiment")
    if video_id is not None:
        if limit < 0:
            raise ValueError("limit must be >= 0")
        return src.orderBy(F.desc("likeCount"), F.asc("id")).limit(limit)
    return top_k_per_group(src, ["videoId"], [F.desc("likeCount"), F.asc("id")], limit)
