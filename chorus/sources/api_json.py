"""Landed API responses (JSON pages) -> Video and Comment rows.

Pages are read with an explicit nested schema, exploded and flattened by struct paths; counts
arrive as strings and are cast, timestamps arrive as ISO-8601 text and are parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_iso_timestamp
from ..operators.joins import lookup_default
from ..schemas import COMMENT_LANDING_SCHEMA, NO_CATEGORY, VIDEO_PAGE_SCHEMA

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def to_iso(ts) -> F.Column:
    return F.date_format(ts, ISO_FORMAT)


def video_pages(videos: DataFrame, stats: DataFrame) -> DataFrame:
    """Build landed video-metadata responses (one per video) from video rows + their stats."""
    v = videos.join(stats, videos["id"] == stats["videoId"], "left")
    item = F.struct(
        F.col("videoKey").alias("id"),
        F.struct(F.col("videoName").alias("title"), F.col("channelName").alias("channelTitle"),
                 to_iso(F.col("publishingDate")).alias("publishedAt"),
                 F.col("categoryId").alias("categoryId")).alias("snippet"),
        F.struct(F.col("viewCount").cast("string").alias("viewCount"),
                 F.coalesce("likeCount", F.lit(0)).cast("string").alias("likeCount"),
                 F.coalesce("commentCount", F.lit(0)).cast("string").alias("commentCount")).alias("statistics"))
    return v.select(F.struct(F.lit(1).alias("totalResults")).alias("pageInfo"), F.array(item).alias("items"))


def empty_video_pages(keys: DataFrame) -> DataFrame:
    """Responses for links that resolve to no video (totalResults = 0, no items)."""
    return keys.select(F.struct(F.lit(0).alias("totalResults")).alias("pageInfo"),
                       F.array().cast(VIDEO_PAGE_SCHEMA["items"].dataType).alias("items"))


def read_video_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIDEO_PAGE_SCHEMA).json(path)


def video_id(key) -> F.Column:
    """A stable id of a video key."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def ingest_videos(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """Responses -> Video rows. Zero-result responses are rejected; unknown category ids
    become "No category"; of a key posted again the response landed last counts (by the file's
    modification time, then its path; within a file the largest row).

    ``id`` is made from the video key (60 bits of its md5), so it is the same whenever and wherever
    the video is ingested, and comments can refer to it before the video arrives.
    """
    landed = pages.select("*", F.col("_metadata.file_modification_time").alias("__at"), F.col("_metadata.file_path").alias("__file"))
    ok = landed.where(F.col("pageInfo.totalResults") > 0).where(F.size("items") > 0)
    first = ok.select(F.element_at("items", 1).alias("it"), "__at", "__file")
    rows = first.select(
        "__at", "__file", video_id(F.col("it.id")).alias("id"),
        F.col("it.id").alias("videoKey"),
        F.col("it.snippet.title").alias("videoName"),
        F.col("it.snippet.channelTitle").alias("channelName"),
        F.col("it.snippet.categoryId").alias("categoryId"),
        F.col("it.statistics.viewCount").cast("bigint").alias("viewCount"),
        F.col("it.statistics.likeCount").cast("bigint").alias("likeCount"),
        F.col("it.statistics.commentCount").cast("bigint").alias("commentCount"),
        parse_iso_timestamp(F.col("it.snippet.publishedAt")).alias("publishingDate"))
    rows = lookup_default(rows, F.col("categoryId").cast("int"), categories, "categoryId", "category",
                          NO_CATEGORY).drop("categoryId")
    names = [c for c in rows.columns if c not in ("__at", "__file")]
    last = F.max(F.struct("__at", "__file", *[c for c in names if c != "videoKey"])).alias("v")
    return rows.groupBy("videoKey").agg(last).select(*[F.col(c) if c == "videoKey" else F.col(f"v.{c}") for c in names])


def comment_pages(comments: DataFrame, page_size: int = 100) -> DataFrame:
    """Build landed comment pages: a video's comments whose ids share ``id div page_size``
    form one page (at most ``page_size`` comments; no per-video window, so a video holding a
    third of all comments is still split over many tasks). Pages name the video by ``videoKey``."""
    numbered = comments.withColumn("__page", F.floor(F.col("id") / F.lit(page_size)))
    item = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(F.col("videoKey").alias("videoId"),
                 F.struct(F.struct(F.col("commentText").alias("textDisplay"),
                                   F.col("likeCount").alias("likeCount"),
                                   to_iso(F.col("publishingDate")).alias("publishedAt")).alias("snippet"))
                 .alias("topLevelComment")).alias("snippet"))
    return numbered.groupBy("videoKey", "__page").agg(F.collect_list(item).alias("items")).select(
        F.concat_ws("-", "videoKey", F.col("__page").cast("string")).alias("nextPageToken"), "items")


def read_comment_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed comment pages; a line that is no page is kept as it is, for ``rejected_items``."""
    return spark.read.schema(COMMENT_LANDING_SCHEMA).json(path)


def read_items(pages: DataFrame) -> DataFrame:
    """One row for each item of the pages, and one for each line that is no page: (it, broken, at, file)."""
    broken = F.col("_corrupt_record").isNotNull()
    items = F.when(broken, F.array(F.lit(None).cast(COMMENT_LANDING_SCHEMA["items"].dataType.elementType))).otherwise(F.col("items"))
    return pages.select(F.explode(items).alias("it"), F.col("_corrupt_record").alias("broken"),
                        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))


_SNIPPET = "it.snippet.topLevelComment.snippet"


def _problem() -> F.Column:
    """Why an item cannot be stored (NULL: it can)."""
    likes, date = F.col(f"{_SNIPPET}.likeCount"), F.col(f"{_SNIPPET}.publishedAt")
    return (F.when(F.col("broken").isNotNull(), F.lit("not a comment page"))
            .when(F.col(_SNIPPET).isNull(), F.lit("no comment in the item"))
            .when(likes.isNotNull() & likes.try_cast("bigint").isNull(), F.lit("likeCount is not a number"))
            .when(date.isNotNull() & parse_iso_timestamp(date).isNull(), F.lit("publishedAt is not a time")))


def stored_comments(items: DataFrame) -> DataFrame:
    """Items -> comments (F17 nested paths, F18 explode, F8, F10), copies included, with when and where they landed.

    ``id`` is the API's key as it is; ``videoId`` is ``video_id`` of the video's key, the id under which S5 stores the video.
    """
    return items.where(_problem().isNull()).select(
        F.col("it.id").alias("id"),
        video_id(F.col("it.snippet.videoId")).alias("videoId"),
        F.col(f"{_SNIPPET}.textDisplay").alias("commentText"),
        F.col(f"{_SNIPPET}.likeCount").try_cast("bigint").alias("likeCount"),
        parse_iso_timestamp(F.col(f"{_SNIPPET}.publishedAt")).alias("publishingDate"), "at", "file")


def rejected_items(items: DataFrame) -> DataFrame:
    """(file, reason, raw) of the items that cannot be stored."""
    return items.select("file", _problem().alias("reason"), F.coalesce("broken", F.to_json("it")).alias("raw")).where("reason is not null")


def latest_copies(comments: DataFrame) -> DataFrame:
    """Of each id the copy landed last (by the file's modification time, then its path; within a file the largest row); all rows without an id."""
    values = [c for c in comments.columns if c not in ("at", "file")]
    last = F.max(F.struct("at", "file", *[c for c in values if c != "id"])).alias("v")
    known = comments.where("id is not null").groupBy("id").agg(last).select(*[F.col(c) if c == "id" else F.col(f"v.{c}") for c in values])
    return known.unionByName(comments.where("id is null").select(*values))


def explode_comment_pages(pages: DataFrame) -> DataFrame:
    """Comment pages -> one row per comment."""
    return stored_comments(read_items(pages)).drop("at", "file")


def ingest_comments(pages: DataFrame) -> DataFrame:
    """Every page of every video -> Comment rows, of each comment the copy landed last."""
    return latest_copies(stored_comments(read_items(pages)))
