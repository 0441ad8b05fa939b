"""Registered queries: sources, sinks, links and streams (S1-S9, J1, J2, P13, F6-F8, F10, F17,
F18, ST1, ST2).

Queries that exercise a file format first land data derived from the driver tables in a fresh
folder under the shared checkpoint directory, then read it back through the operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import is_video_link, video_key
from ..operators import joins as J
from ..operators import model as M
from ..operators import profile as P
from ..operators.video import video_stats
from ..schemas import DATASET_SCHEMA, SENTIMENTS, VIDEO_KEY_PATTERN, VIDEO_LINK_PATTERN
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import api_json as JS
from ..sources import files as FS
from ..sources import store as ST
from ..streaming import counts as SC
from ..streaming import ingest as SI
from .registry import register
from .sqltext import sql_str

_DATASET_ALL = ", ".join(f.name for f in DATASET_SCHEMA.fields)


@register("s1_comment_csv_scan", A.with_adapters("dataset") + f"SELECT {_DATASET_ALL} FROM dataset")
def s1_comment_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The comment dataset written as CSV (quoted, multi-line texts) and scanned back with
    its explicit schema."""
    path = scratch_path(spark, "dataset-csv")
    FS.write_csv(A.dataset(spark, sf), path)
    return FS.read_comment_dataset(spark, path)


@register("s1_foreign_csv_scan", A.with_adapters("dataset") + f"SELECT {_DATASET_ALL} FROM dataset")
def s1_foreign_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The comment dataset as another program writes it (texts quoted where needed, with their line breaks,
    nothing coded) scanned back as it is."""
    d = A.dataset(spark, sf)
    path = scratch_path(spark, "foreign-csv")
    fields = []
    for f in d.schema.fields:
        value = F.col(f.name)
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if f.dataType.typeName() == "timestamp_ntz" else value.cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.coalesce(F.when(F.translate(text, '",\n\r', "") != text, quoted).otherwise(text), F.lit("")))
    rows = d.select(F.concat_ws(",", *fields).alias("line"), F.xxhash64("CommentID").alias("h"))
    # one task writes one file, its header first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = spark.range(parts).select(F.lit(_DATASET_ALL.replace(", ", ",")).alias("line"), F.col("id").alias("part"), F.lit(0).alias("o"))
    both = rows.select("line", F.pmod("h", F.lit(parts)).alias("part"), F.lit(1).alias("o")).unionByName(heads)
    both.repartition("part").sortWithinPartitions("part", "o").select("part", "line").write.partitionBy("part").text(path)
    return FS.read_comment_dataset(spark, path, foreign=True)


@register("s2_language_sidecar", A.with_adapters("dataset", "comments") + """
SELECT d.CommentID, d.Sentiment FROM dataset d JOIN comments c ON CAST(c.id AS VARCHAR) = d.CommentID
WHERE c.language = 'en'""")
def s2_language_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + S2 + J1 + P6: store the language column as a keyed sidecar, read it back,
    attach it by key and keep English comments."""
    c = A.comments(spark, sf, "id", "language").select(F.col("id").cast("string").alias("CommentID"),
                                     F.col("language").alias("Language"))
    path = scratch_path(spark, "language-sidecar")
    FS.write_sidecar(c, "CommentID", "Language", path)
    side = FS.read_language_sidecar(spark, path)
    d = A.dataset(spark, sf, "CommentID", "Sentiment")
    return P.keep_value(J.attach_by_key(d, side, "CommentID", "inner"), "Language", "en") \
        .select("CommentID", "Sentiment")


@register("s4_named_splits", A.with_adapters("dataset") + """
SELECT CommentID, CommentText, CASE WHEN (('0x' || substr(md5(CommentText), 1, 8))::UBIGINT % 100) < 90
  THEN 'train' ELSE 'test' END AS split FROM dataset""")
def s4_named_splits(spark: SparkSession, sf: str) -> DataFrame:
    """X1 + S4: hash-split the dataset into train/test CSV files, load both as named splits."""
    d = M.hash_split(A.dataset(spark, sf), F.col("CommentText"), 0.9)
    base = scratch_path(spark, "splits")
    for name in ("train", "test"):
        FS.write_csv(d.where(F.col("split") == name).drop("split"), f"{base}/{name}")
    out = FS.load_splits(spark, {"train": f"{base}/train", "test": f"{base}/test"}, DATASET_SCHEMA)
    return out.select("CommentID", "CommentText", "split")


@register("s5_video_ingest", A.with_adapters("videos", "comments_wide") + """
, st AS (SELECT videoId, sum(likeCount) AS likeCount, count(*) AS commentCount FROM comments_wide GROUP BY videoId)
SELECT CAST('0x' || substr(md5(v.videoKey), 1, 15) AS BIGINT) AS id, v.videoKey, v.videoName, v.channelName, v.category, v.viewCount,
  CAST(coalesce(st.likeCount, 0) AS BIGINT) AS likeCount, CAST(coalesce(st.commentCount, 0) AS BIGINT) AS commentCount,
  v.publishingDate
FROM videos v LEFT JOIN st ON st.videoId = v.id""")
def s5_video_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + F8 + F10 + F17 + J4: land video-metadata responses (every video, re-posted copies,
    empty responses) and ingest them into Video rows."""
    v = A.videos_raw(spark, sf)
    pages = JS.video_pages(v, video_stats(A.comments_wide(spark, sf)))
    path = scratch_path(spark, "video-pages")
    pages.write.json(f"{path}/first")
    pages.where(F.element_at("items", 1)["id"] < "4").write.json(f"{path}/reposted")
    JS.empty_video_pages(A.read_table(spark, sf, "pages").select("page_id")).write.json(f"{path}/empty")
    got = JS.ingest_videos(JS.read_video_pages(spark, f"{path}/*"), A.category_map(spark))
    return got.select("id", "videoKey", "videoName", "channelName", "category", "viewCount", "likeCount",
                      "commentCount", "publishingDate")


#: The id of a comment's video, made from the key its page gives, as S5 does.
_VIDEO_ID_SQL = "CAST('0x' || substr(md5(substr(md5(CAST(videoId AS VARCHAR)), 1, 11)), 1, 15) AS BIGINT)"


def _comment_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every comment, in pages that name its video by the video's key."""
    key = F.substring(F.md5(F.col("videoId").cast("string")), 1, 11)
    return JS.comment_pages(A.comments(spark, sf, "id", "videoId", "commentText", "likeCount", "publishingDate").withColumn("videoKey", key), 100)


def _with_number(comments: DataFrame) -> DataFrame:
    """The keys of these comments are numbers; the SQL has them as such."""
    return comments.withColumn("id", F.col("id").cast("bigint"))


@register("s6_comment_ingest", A.with_adapters("comments") + """
SELECT id, """ + _VIDEO_ID_SQL + """ AS videoId, commentText, likeCount, publishingDate FROM comments""")
def s6_comment_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + F18: land every comment page (and a re-landed copy of some), ingest each comment once."""
    pages = _comment_pages(spark, sf)
    path = scratch_path(spark, "comment-pages")
    pages.write.json(f"{path}/a")
    pages.where(F.col("nextPageToken").endswith("-1")).write.json(f"{path}/b")
    return _with_number(JS.ingest_comments(JS.read_comment_pages(spark, f"{path}/*")))


_WIDE_COLS = "videoId, authorId, sentiment, likeCount, replies, publishingDate"


@register("s7_store_roundtrip", A.with_adapters("comments_wide") + f"SELECT {_WIDE_COLS} FROM comments_wide")
def s7_store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Append the comment stream to the video-clustered Parquet store and read it back."""
    path = scratch_path(spark, "store")
    ST.store_by_video(A.comments_wide(spark, sf), path)
    return ST.read_store(spark, path)


@register("s8_delete_videos", A.with_adapters("comments_wide", "videos") + f"""
SELECT {_WIDE_COLS} FROM comments_wide
WHERE videoId NOT IN (SELECT id FROM videos WHERE category = 'No category')""")
def s8_delete_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Delete every uncategorised video and its comments; rewrite both to new paths."""
    vids = A.videos(spark, sf)
    doomed = vids.where(F.col("category") == "No category").select("id")
    v2, c2 = ST.delete_videos(vids, A.comments_wide(spark, sf), doomed)
    ST.rewrite(v2, scratch_path(spark, "videos-after-delete"))
    return ST.rewrite(c2, scratch_path(spark, "comments-after-delete"))


@register("s7_bucketed_join", A.with_adapters("comments_wide", "videos") + """
SELECT w.videoId, w.authorId, w.likeCount, v.videoName, v.category FROM comments_wide w JOIN videos v ON v.id = w.videoId""")
def s7_bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + J7: comments and videos stored in equal buckets of the video's id, and joined where they lie."""
    tag = uuid.uuid4().hex[:12]
    kept = {}
    for name, df in (("comments", A.comments_wide(spark, sf).select("videoId", "authorId", "likeCount")),
                     ("videos", A.videos(spark, sf).select(F.col("id").alias("videoId"), "videoName", "category"))):
        kept[name] = ST.store_bucketed(df, f"chorus_{name}_{tag}", 8, path=scratch_path(spark, f"bucketed-{name}"))
    return kept["comments"].join(kept["videos"].hint("merge"), "videoId").select("videoId", "authorId", "likeCount", "videoName", "category")


@register("s8_store_delete", A.with_adapters("comments_wide", "videos") + f"""
SELECT {_WIDE_COLS} FROM comments_wide
WHERE videoId NOT IN (SELECT id FROM videos WHERE category = 'No category')""")
def s8_store_delete(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S8: comments stored by video, then every uncategorised video deleted: only the files that hold one are rewritten."""
    store = ST.VideoStore(spark, scratch_path(spark, "video-store"))
    store.append(A.comments_wide(spark, sf))
    store.delete(A.videos(spark, sf).where(F.col("category") == "No category").select("id"))
    return store.read()


@register("s9_preview", A.with_adapters("comments") + """
SELECT id, videoId, sentiment, likeCount FROM comments ORDER BY id LIMIT 5""")
def s9_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first five comments by id."""
    c = A.comments(spark, sf, "id", "videoId", "sentiment", "likeCount")
    return FS.preview(c, ["id"], 5)


@register("s11_aligned_lists", A.with_adapters("comments") + """
SELECT videoId, id // 1000 AS part, list(length(commentText) ORDER BY id) AS lengths, list(likeCount ORDER BY id) AS likes
FROM comments GROUP BY ALL""")
def s11_aligned_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per video, the lengths and likes of its comments as aligned lists, in bounded parts."""
    c = A.comments(spark, sf, "videoId", "id", "commentText", "likeCount").select("videoId", "id", F.char_length("commentText").cast("bigint").alias("lengths"),
                                     F.col("likeCount").alias("likes"))
    return FS.aligned_lists(c, ["videoId"], ["lengths", "likes"], "id", 1000)


_LINK_SQL = A.with_adapters("links") + f"""
, parsed AS (SELECT page_id, kind, url,
  coalesce(regexp_matches(url, {sql_str(VIDEO_LINK_PATTERN)}), false) AS is_valid,
  nullif(regexp_extract(url, {sql_str(VIDEO_KEY_PATTERN)}, 1), '') AS video_key FROM links)
"""


def _parsed_links(spark: SparkSession, sf: str) -> DataFrame:
    lk = A.links(spark, sf)
    return lk.select("page_id", "kind", "url", is_video_link(F.col("url")).alias("is_valid"),
                     video_key(F.col("url")).alias("video_key"))


@register("f6_f7_link_parse", _LINK_SQL + "SELECT * FROM parsed")
def f6_f7_link_parse(spark: SparkSession, sf: str) -> DataFrame:
    """F6 + F7: validate every candidate link and extract its video key."""
    return _parsed_links(spark, sf)


@register("p13_valid_links", _LINK_SQL + "SELECT page_id, kind, video_key FROM parsed WHERE is_valid AND video_key IS NOT NULL")
def p13_valid_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links accepted (valid shape and a key)."""
    p = _parsed_links(spark, sf)
    return p.where(F.col("is_valid") & F.col("video_key").isNotNull()).select("page_id", "kind", "video_key")


@register("p13_rejected_links", _LINK_SQL + "SELECT page_id, kind, url FROM parsed WHERE NOT (is_valid AND video_key IS NOT NULL)")
def p13_rejected_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links rejected (bad shape, or no key)."""
    p = _parsed_links(spark, sf)
    return p.where(~(F.col("is_valid") & F.col("video_key").isNotNull())).select("page_id", "kind", "url")


@register("j1_positional_sidecar", A.with_adapters("comments") + "SELECT id, language FROM comments")
def j1_positional_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """J1 (positional): attach an un-keyed column by row position after the same ordering."""
    c = A.comments(spark, sf, "id", "language")
    left = c.select("id").orderBy("id")
    side = c.select("id", "language").orderBy("id").select("language")
    return J.attach_by_position(left, side)


@register("j2_attach_predictions", A.with_adapters("predictions_text") + """
SELECT id, CommentText, Sentiment, Predicted FROM predictions_text""")
def j2_attach_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Attach predictions to their text rows by id."""
    docs = A.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                                       F.col("text").alias("CommentText"))
    preds = A.predictions(spark, sf, with_text=True).select("id", "Sentiment", "Predicted")
    return J.attach_predictions(docs, preds, "id")


@register("f18_unpivot", A.with_adapters("comments_wide", "videos") + """
, cw AS (SELECT w.*, v.category FROM comments_wide w JOIN videos v ON v.id = w.videoId)
, c AS (SELECT category, count(*) FILTER (WHERE sentiment = 'Negative') AS neg,
   count(*) FILTER (WHERE sentiment = 'Neutral') AS neu, count(*) FILTER (WHERE sentiment = 'Positive') AS pos
   FROM cw GROUP BY category)
SELECT category, 'Negative' AS sentiment, neg / (neg + neu + pos) AS proportion FROM c
UNION ALL SELECT category, 'Neutral', neu / (neg + neu + pos) FROM c
UNION ALL SELECT category, 'Positive', pos / (neg + neu + pos) FROM c""")
def f18_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """the wide category x sentiment table unpivoted back to long form."""
    w = A.comments_wide(spark, sf)
    v = A.videos(spark, sf).select(F.col("id").alias("__vid"), "category")
    wide = P.proportions_wide(w.join(v, w["videoId"] == v["__vid"]), "category", "sentiment")
    return wide.unpivot("category", ["Negative", "Neutral", "Positive"], "sentiment", "proportion")


@register("st1_stream_ingest", A.with_adapters("comments") + """
SELECT id, """ + _VIDEO_ID_SQL + """ AS videoId, commentText, likeCount, publishingDate FROM comments""")
def st1_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: comment pages landed in two waves (the second re-lands some pages) ingested by a
    Structured Streaming query with de-duplication; equals the batch ingest."""
    pages = _comment_pages(spark, sf)
    landing = scratch_path(spark, "landing")
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    pages.write.json(landing)
    SI.run_ingest(spark, landing, sink, ckpt)
    pages.where(F.col("nextPageToken").endswith("-1")).write.mode("append").json(landing)
    return _with_number(SI.run_ingest(spark, landing, sink, ckpt))


@register("st1_scored_ingest", A.with_adapters("comments") + """
SELECT id, """ + _VIDEO_ID_SQL + """ AS videoId, commentText, likeCount, publishingDate, true AS has_label FROM comments""")
def st1_scored_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 + S6 + U1: land comment pages, score them with a trained sentiment model while they are
    ingested, store them; the stored comments refer to the video's id (``has_label``: the stored
    sentiment is one of the three)."""
    c = A.comments(spark, sf, "id", "commentText", "sentiment")
    model = M.train_sentiment(M.labelled_comments(c))
    landing, sink = scratch_path(spark, "landing"), scratch_path(spark, "stream-sink")
    _comment_pages(spark, sf).write.json(landing)
    stored = SI.run_ingest(spark, landing, sink, scratch_path(spark, "stream-ckpt"), model=model)
    return _with_number(stored).select("id", "videoId", "commentText", "likeCount", "publishingDate",
                         F.coalesce(F.col("sentiment").isin(SENTIMENTS), F.lit(False)).alias("has_label"))


@register("st2_daily_counts", A.with_adapters("comments_wide") + """
SELECT date_trunc('day', publishingDate) AS day, videoId, sentiment, count(*) AS n
FROM comments_wide GROUP BY ALL""")
def st2_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: running comment counts per day, video and sentiment over a file stream."""
    w = A.comments_wide(spark, sf)
    landing = scratch_path(spark, "wide-landing")
    w.write.parquet(landing)
    return SC.run_daily_counts(spark, landing, w.schema, scratch_path(spark, "daily-counts"),
                               scratch_path(spark, "daily-ckpt"))
