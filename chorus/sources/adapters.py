"""Adapters: the driver's tables seen as the comment-analytics data model.

* ``comments``       one row per document: text, sentiment (from labels, else by id), likes, date, author
* ``comments_wide``  one row per line item: the high-volume, text-free comment stream
* ``videos``         one row per part, with its category resolved through the category map
* ``dataset``        the comment-dataset CSV layout (CommentID, VideoID, ..., CategoryID)
* ``predictions``    a prediction frame: truth and argmax of three logits per embedding
* ``links``          candidate video links, valid ones built from page urls plus the raw urls

Every adapter is a lazy DataFrame over ``spark.read.parquet``; Catalyst prunes the columns a
query does not use and pushes its filters into the scans. ``ADAPTER_SQL`` holds the same
definitions as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sentiment_from_labels(toxic: Column, quality: Column, key: Column) -> Column:
    """Every comment has a sentiment: from its label, else by its id modulo three."""
    by_id = F.element_at(F.array(*[F.lit(s) for s in schemas.SENTIMENTS]), (F.pmod(key, F.lit(3)) + 1).cast("int"))
    return (F.when(toxic == 1, F.lit("Negative"))
            .when(quality == 1, F.lit("Positive"))
            .when(quality == 0, F.lit("Neutral"))
            .otherwise(by_id))


def comments(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The comments, or the ``wanted`` columns of them.

    Likes, replies, dates and authors come from ``events``, sentiments from ``labels``. Neither is known to have one row an
    id, so Spark could not leave an unused join out by itself: tables that no wanted column needs are not joined.
    """
    rows = read_table(spark, sf_dir, "documents")
    columns = {
        "id": F.col("doc_id"),
        "videoId": F.substring("source", 4, 1 << 20).cast("bigint"),
        "commentText": F.col("text"),
        "sentiment": sentiment_from_labels(F.col("toxic"), F.col("quality"), F.col("doc_id")),
        "likeCount": F.floor("value").cast("bigint"),
        "replies": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"),
        "publishingDate": F.col("ts"),
        "authorId": F.col("user_id"),
        "language": F.col("lang"),
    }
    wanted = wanted or tuple(columns)
    if {"likeCount", "replies", "publishingDate", "authorId"} & set(wanted):
        rows = rows.join(read_table(spark, sf_dir, "events"), F.col("doc_id") == F.col("event_id"), "left")
    if "sentiment" in wanted:
        rows = rows.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(*[columns[c].alias(c) for c in wanted])


def comments_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("videoId"),
        F.col("l_suppkey").alias("authorId"),
        F.when(F.col("l_returnflag") == "R", "Positive")
         .when(F.col("l_returnflag") == "N", "Neutral")
         .otherwise("Negative").alias("sentiment"),
        F.floor("l_quantity").cast("bigint").alias("likeCount"),
        F.col("l_linenumber").cast("bigint").alias("replies"),
        F.col("l_shipdate").alias("publishingDate"),
    )


def category_map(spark: SparkSession) -> DataFrame:
    """The 32-row category dictionary (fixed size: safe to broadcast)."""
    from .literal import literal_table
    rows = [(k, v) for k, v in schemas.CATEGORIES.items()]
    return F.broadcast(literal_table(spark, rows, [("categoryId", "int"), ("category", "string")]))


def videos_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("videoName"),
        F.col("p_brand").alias("channelName"),
        F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 11).alias("videoKey"),
        F.col("p_size").cast("string").alias("categoryId"),
        F.floor("p_retailprice").cast("bigint").alias("viewCount"),
        F.timestamp_add("MINUTE", F.col("p_partkey"),
                        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("publishingDate"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with the category name resolved (unknown id -> "No category")."""
    from ..operators.joins import lookup_default

    v = videos_raw(spark, sf_dir)
    return lookup_default(v, F.col("categoryId").cast("int"), category_map(spark),
                          "categoryId", "category", schemas.NO_CATEGORY)


def dataset(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The comment dataset in its CSV layout, or the ``wanted`` columns of it, from the tables these need."""
    columns = {  # column: (its expression, what it needs of the comments)
        "CommentID": (F.col("id").cast("string"), "id"),
        "VideoID": (F.col("videoKey"), "videoId"),
        "VideoTitle": (F.col("videoName"), "videoId"),
        "AuthorName": (F.concat(F.lit("user"), F.col("authorId").cast("string")), "authorId"),
        "AuthorChannelID": (F.concat(F.lit("UC"), F.col("authorId").cast("string")), "authorId"),
        "CommentText": (F.col("commentText"), "commentText"),
        "Sentiment": (F.col("sentiment"), "sentiment"),
        "Likes": (F.col("likeCount"), "likeCount"),
        "Replies": (F.col("replies"), "replies"),
        "PublishedAt": (F.col("publishingDate"), "publishingDate"),
        "CountryCode": (F.upper("language"), "language"),
        "CategoryID": (F.col("categoryId").cast("int"), "videoId"),
    }
    wanted = wanted or tuple(columns)
    rows = comments(spark, sf_dir, *dict.fromkeys(columns[c][1] for c in wanted))
    if {"VideoID", "VideoTitle", "CategoryID"} & set(wanted):
        v = videos_raw(spark, sf_dir).select(F.col("id").alias("vid"), "videoKey", "videoName", "categoryId")
        rows = rows.join(v, F.col("videoId") == F.col("vid"), "left")
    return rows.select(*[columns[c][0].alias(c) for c in wanted])


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class scores: the first three embedding dimensions; truth is label mod 3."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.slice("embedding", 1, 3).cast("array<double>").alias("logits"),
        (F.col("label") % 3).alias("label"),
    )


def predictions(spark: SparkSession, sf_dir: str, with_text: bool = False, with_length: bool = False) -> DataFrame:
    """Prediction frame (id, [CommentText or length,] Sentiment, Predicted) from the logits.

    ``with_length`` has the number of words in place of the text: made before the join, so that no text is shuffled.
    """
    from ..functions.scalar import argmax, decode_label
    from ..functions.text import words

    lg = logits(spark, sf_dir)
    pf = lg.select(
        "id",
        decode_label(F.col("label")).alias("Sentiment"),
        decode_label(argmax(F.col("logits"))).alias("Predicted"),
    )
    if with_text or with_length:
        of_text = F.size(words(F.col("text"))).alias("length") if with_length else F.col("text").alias("CommentText")
        docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), of_text)
        # a document without logits gets truth and prediction from its id
        by_id = lambda c, k: F.coalesce(c, decode_label(F.pmod(F.col("id") * k, F.lit(10)) % 3))
        pf = docs.join(pf, "id", "left").select(
            "id", docs.columns[1], by_id("Sentiment", 1).alias("Sentiment"), by_id("Predicted", 7).alias("Predicted"))
    return pf


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate links: a well-formed watch link per page, plus each page's raw url."""
    pg = read_table(spark, sf_dir, "pages")
    built = pg.select(
        F.col("page_id"), F.lit("built").alias("kind"),
        F.concat(F.lit("https://www.youtube.com/watch?v="),
                 F.substring(F.md5("url"), 1, 11)).alias("url"))
    raw = pg.select(F.col("page_id"), F.lit("raw").alias("kind"), F.col("url"))
    return built.unionByName(raw)


# --------------------------------------------------------------------------------------
# The same adapters as SQL text (DuckDB oracle).
# --------------------------------------------------------------------------------------

def _category_values() -> str:
    rows = ", ".join(
        f"({k}, '{v}')" for k, v in schemas.CATEGORIES.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(categoryId, category)"


ADAPTER_SQL: dict[str, str] = {
    "comments": """
SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS BIGINT) AS videoId, d.text AS commentText,
  CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
       WHEN l.quality = 0 THEN 'Neutral'
       ELSE list_extract(['Positive', 'Neutral', 'Negative'], CAST(((d.doc_id % 3) + 3) % 3 + 1 AS INT)) END AS sentiment,
  CAST(floor(e.value) AS BIGINT) AS likeCount,
  CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS replies,
  e.ts AS publishingDate, e.user_id AS authorId, d.lang AS language
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "comments_wide": """
SELECT l_partkey AS videoId, l_suppkey AS authorId,
  CASE l_returnflag WHEN 'R' THEN 'Positive' WHEN 'N' THEN 'Neutral' ELSE 'Negative' END AS sentiment,
  CAST(floor(l_quantity) AS BIGINT) AS likeCount, CAST(l_linenumber AS BIGINT) AS replies,
  l_shipdate AS publishingDate
FROM lineitem""",
    "category_map": _category_values(),
    "videos_raw": """
SELECT p_partkey AS id, p_name AS videoName, p_brand AS channelName,
  substr(md5(CAST(p_partkey AS VARCHAR)), 1, 11) AS videoKey,
  CAST(p_size AS VARCHAR) AS categoryId, CAST(floor(p_retailprice) AS BIGINT) AS viewCount,
  TIMESTAMP '2023-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS publishingDate
FROM part""",
    "videos": """
SELECT v.*, coalesce(m.category, 'No category') AS category
FROM videos_raw v LEFT JOIN category_map m ON m.categoryId = CAST(v.categoryId AS INTEGER)""",
    "dataset": """
SELECT CAST(c.id AS VARCHAR) AS CommentID, v.videoKey AS VideoID, v.videoName AS VideoTitle,
  'user' || CAST(c.authorId AS VARCHAR) AS AuthorName,
  'UC' || CAST(c.authorId AS VARCHAR) AS AuthorChannelID,
  c.commentText AS CommentText, c.sentiment AS Sentiment, c.likeCount AS Likes,
  c.replies AS Replies, c.publishingDate AS PublishedAt, upper(c.language) AS CountryCode,
  CAST(v.categoryId AS INTEGER) AS CategoryID
FROM comments c LEFT JOIN videos_raw v ON v.id = c.videoId""",
    "logits": """
SELECT vec_id AS id, CAST(embedding[1:3] AS DOUBLE[]) AS logits, label % 3 AS label
FROM embeddings""",
    "predictions": """
SELECT id,
  CASE label WHEN 0 THEN 'Positive' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Negative' END AS Sentiment,
  CASE list_position(logits, list_max(logits)) - 1
    WHEN 0 THEN 'Positive' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Negative' END AS Predicted
FROM logits""",
    "predictions_text": """
SELECT d.doc_id AS id, d.text AS CommentText,
  coalesce(p.Sentiment, list_extract(['Positive', 'Neutral', 'Negative'], CAST((d.doc_id % 10) % 3 + 1 AS INT))) AS Sentiment,
  coalesce(p.Predicted, list_extract(['Positive', 'Neutral', 'Negative'], CAST((d.doc_id * 7 % 10) % 3 + 1 AS INT))) AS Predicted
FROM documents d LEFT JOIN predictions p ON d.doc_id = p.id""",
    "links": """
SELECT page_id, 'built' AS kind,
  'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) AS url FROM pages
UNION ALL
SELECT page_id, 'raw' AS kind, url FROM pages""",
}

# Which adapters each adapter needs (for assembling WITH clauses in dependency order).
_ADAPTER_DEPS = {
    "comments": [], "comments_wide": [], "category_map": [], "videos_raw": [],
    "videos": ["videos_raw", "category_map"], "dataset": ["comments", "videos_raw"],
    "logits": [], "predictions": ["logits"], "predictions_text": ["predictions"],
    "links": [],
}


def with_adapters(*names: str) -> str:
    """``WITH`` clause defining the named adapters (and what they depend on)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _ADAPTER_DEPS[n]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({ADAPTER_SQL[n]})" for n in order) + "\n"
