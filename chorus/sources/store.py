"""The stored tables (S7, S8): Parquet laid out by ``videoId``.

Rows are hash-partitioned by ``videoId`` (skewed videos split by AQE) and sorted inside each file, so a per-video question
reads few row groups (Parquet min/max statistics on ``videoId``) and a later aggregation by
``videoId`` finds each video in one file set. Rewrites go to a new path; a path that is being
read is never overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import CommitLog, Conflict


def store_by_video(df: DataFrame, path: str, mode: str = "append",
                   sort_cols: Sequence[str] = ("videoId",)) -> None:
    """Append rows to a Parquet table clustered by video.

    ``rebalance`` hash-partitions by ``videoId`` and lets AQE split a partition that is too
    large (a video holding a third of all comments becomes several files) and merge small ones.
    """
    (df.hint("rebalance", "videoId").sortWithinPartitions(*sort_cols)
       .write.mode(mode).parquet(path))


def store_bucketed(df: DataFrame, table: str, buckets: int, key: str = "videoId", mode: str = "append", path: str | None = None) -> DataFrame:
    """S7 (catalog form): a bucketed, sorted table; joins and aggregations on ``key`` against it need no shuffle of
    its side, and two tables with the same number of buckets meet without any.

    ``path``: a shared folder for its files; without it they lie in the warehouse.
    """
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_videos(videos: DataFrame, comments: DataFrame, doomed: DataFrame,
                  key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Videos and comments without the ``doomed`` video ids (a DataFrame of ids).

    Anti joins, so any number of ids works; ids that do not exist are a no-op. Write the
    results to new paths (see ``rewrite``).
    """
    ids = doomed.select(F.col(key).alias("__del")).distinct()
    v = videos.join(ids, videos["id"] == ids["__del"], "left_anti")
    c = comments.join(ids, comments["videoId"] == ids["__del"], "left_anti")
    return v, c


def rewrite(df: DataFrame, new_path: str) -> DataFrame:
    """Write ``df`` to a fresh path and return the re-read table."""
    df.write.mode("errorifexists").parquet(new_path)
    return df.sparkSession.read.parquet(new_path)


class VideoStore:
    """S7 + S8: comments clustered by video, at ``path``, with a log of the files that hold them.

    A delete rewrites the files in which a doomed video occurs and no others: those stay as they are, and the log's
    next entry names what took the place of what. Old files are left for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "videoId"):
        self.spark, self.path, self.key, self.log = spark, path.rstrip("/"), key, CommitLog(spark, path)

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        store_by_video(df, f"{self.path}/data/{name}", "errorifexists", (self.key,))
        return name

    def _live(self, entries: list[dict]) -> list[str]:
        gone = {f for e in entries for f in e.get("removed", ())}
        names = [e["rows"] for e in entries if e.get("rows")]
        files = self._open(names).inputFiles() if names else []
        return sorted(f for f in (f.rsplit("/data/", 1)[1] for f in files) if f not in gone)

    def _open(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names])

    def append(self, df: DataFrame) -> None:
        """Add rows."""
        self.log.append({"rows": self._write(df), "schema": df.schema.json()})

    def files(self) -> list[str]:
        """The files that hold the store's rows now, below ``path``/data."""
        return self._live(self.log.state()[1])

    def read(self) -> DataFrame:
        return self._open(self.files())

    def holding(self, files: list[str], doomed: DataFrame) -> DataFrame:
        """(file): those of the files with a row of a ``doomed`` (id) video; reads nothing but ids."""
        ids = doomed.select(F.col("id").alias(self.key)).distinct()
        file = F.regexp_extract("_metadata.file_path", "^.*/data/(.*)$", 1).alias("file")
        found = self._open(files).select(self.key, file)
        return found.join(ids, self.key, "left_semi").select("file").distinct()

    def delete(self, doomed: DataFrame) -> list[str]:
        """Remove the rows of the ``doomed`` (id) videos; returns the files that were rewritten (none: nothing happens)."""
        while True:
            version, live = self.log.state()
            files = self._live(live)
            if not files:
                return []
            touched = sorted(r["file"] for r in self.holding(files, doomed).collect())  # a name a file
            if not touched:
                return []
            ids = doomed.select(F.col("id").alias(self.key)).distinct()
            kept = self._write(self._open(touched).join(ids, self.key, "left_anti"))
            try:
                self.log.commit(version, {"rows": kept, "removed": touched})
                return touched
            except Conflict:
                continue  # rows came or went meanwhile: look again
