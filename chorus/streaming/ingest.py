"""ST1: incremental ingest of landed comment pages; of every comment the copy landed last is stored.

``readStream`` over the landing folder -> explode -> ``foreachBatch``. The stream keeps no state and has no
watermark, so a comment of any age and in any order is stored. The sink is a table with a commit log
(``log``): a batch writes rows, partitioned by publishing day, and commits them, once, with the next version.

Which of a batch's comments are there already is found in two steps, neither of which reads the history:

1. Same day: the sink's (day, id) pairs that are also in the batch, from the days of the batch alone (dynamic
   partition pruning). An equal copy is left out; a changed one replaces the stored one.
2. Another day: ids not found so are looked up in the id index, (id, day) partitioned by a hash of the id, in the
   buckets of those ids alone. A comment whose date changed replaces the stored one. Feeds whose dates never change
   can leave this step out (``dates_change=False``).

A replaced row is not rewritten: its (day, id) goes to a small table of gone rows, which readers join away
and folding applies. Comments without an id cannot be told apart and are all kept; those without a date have a day
of their own. What cannot be read as a comment goes to the sink's ``rejected`` rows, with file and reason, so
that stored, replaced, repeated and rejected rows add up to what landed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMMENT_LANDING_SCHEMA
from ..session import scratch_path
from ..sources.api_json import latest_copies, read_items, rejected_items, stored_comments
from ..sources.log import CommitLog, Conflict, writer_of

NO_DAY = "none"
#: Partitions of the id index.
BUCKETS = 64
_GONE, _INDEX = "id string, day string, upto long", "id string, day string, version long, batch string, bucket int"
_REJECTED = "file string, reason string, raw string"


def comment_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The items of a landing folder of JSON pages, copies and broken ones included, with their file."""
    reader = spark.readStream.schema(COMMENT_LANDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return read_items(reader.json(landing))


class CommentSink:
    """The table of stored comments at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def _parts(self, live: list[dict], kind: str, schema: str) -> DataFrame:
        names = [e[kind] for e in live if e.get(kind)]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def rows(self, live: list[dict]) -> DataFrame:
        """Stored rows that no later version replaced, with ``day``, ``version`` and ``fingerprint``."""
        schema = next((e["schema"] for e in reversed(live) if e.get("schema")), None)
        if schema is None:
            return self.spark.createDataFrame([], "id string, day string, version long, fingerprint binary, batch string")
        rows = self._parts(live, "rows", schema)
        if not any(e.get("gone") for e in live):
            return rows
        gone = self._parts(live, "gone", _GONE).select(F.col("id").alias("g_id"), F.col("day").alias("g_day"), "upto")
        return rows.join(gone, (rows["id"] == gone["g_id"]) & (rows["day"] == gone["g_day"]) & (rows["version"] < gone["upto"]), "left_anti")

    def same_day(self, live: list[dict], keys: DataFrame) -> DataFrame:
        """(id, day, stored) of the batch's (id, day) pairs in the sink; only the days of ``keys`` are read.

        The days of a batch are calendar days, a few thousand at most, so their table may be broadcast.
        """
        days = keys.select("day").where("day >= ''").distinct()
        near = self.rows(live).select("id", "day", F.col("fingerprint").alias("stored")).join(F.broadcast(days), "day", "left_semi")
        return near.join(keys.select("id", "day"), ["id", "day"], "left_semi")

    def other_day(self, live: list[dict], ids: DataFrame) -> DataFrame:
        """(id, day): where the index has these ids last; only their buckets are read (at most ``BUCKETS`` broadcast rows)."""
        index = self._parts(live, "index", _INDEX)
        buckets = ids.select(_bucket().alias("bucket")).where("bucket >= 0").distinct()
        near = index.join(F.broadcast(buckets), "bucket", "left_semi").join(ids.select("id"), "id", "left_semi")
        return near.groupBy("id").agg(F.max_by("day", "version").alias("day"))

    def _write(self, df: DataFrame, kind: str, *by: str) -> str:
        name = f"batch={uuid.uuid4().hex}"
        df = df.drop("batch")
        (df.hint("rebalance", *by) if by else df).write.partitionBy(*by).parquet(f"{self.path}/{kind}/{name}")
        return name

    def add(self, comments: DataFrame, bad: DataFrame, entry: dict, dates_change: bool = True, score=None) -> None:
        """Commit one batch: ``comments`` has one row for each id, and any number without an id."""
        day = F.coalesce(F.date_format("publishingDate", "yyyy-MM-dd"), F.lit(NO_DAY))
        fingerprint = F.unhex(F.md5(F.to_json(F.struct(*comments.columns))))
        batch = _once(comments.withColumns({"day": day, "fingerprint": fingerprint}), "ingest-batch")
        bad = _once(bad, "ingest-rejected")
        keys = batch.where("id is not null").select("id", "day", "fingerprint")
        while True:
            version, live = self.log.state()
            near = _once(self.same_day(live, keys).join(keys, ["id", "day"]).select("id", "day", (F.col("stored") == F.col("fingerprint")).alias("equal")), "ingest-near")
            gone = near.where("not equal").select("id", "day")
            if dates_change:
                gone = gone.unionByName(self.other_day(live, keys.join(near, "id", "left_anti")).select("id", "day"))
            gone = _once(gone.withColumn("upto", F.lit(version).cast("long")), "ingest-gone")
            fresh = batch.join(near.where("equal").select("id", "day"), ["id", "day"], "left_anti").withColumn("version", F.lit(version).cast("long"))
            fresh = fresh if score is None else score(fresh)
            made = dict(entry)
            made["rows"] = self._write(fresh, "rows", "day")
            made["schema"] = _ddl(fresh)
            index = fresh.where("id is not null").select("id", "day", "version", _bucket().alias("bucket"))
            made["index"] = self._write(index, "index", "bucket")
            if not gone.isEmpty():
                made["gone"] = self._write(gone, "gone")
            if not bad.isEmpty():
                made["rejected"] = self._write(bad, "rejected")
            try:
                self.log.commit(version, made)
                break
            except Conflict:
                continue  # another writer came first: what is stored has to be looked up again
        self.log.fold(self._fold)

    def _fold(self, entries: list[dict], first: bool) -> dict:
        """Neighbouring entries as one: replaced rows left out, the last place of each id, gone rows only while older entries are there."""
        made = {"schema": entries[-1]["schema"], "rows": self._write(self.rows(entries), "rows", "day")}
        index = self._parts(entries, "index", _INDEX).groupBy("id", "bucket").agg(F.max(F.struct("version", "day")).alias("v"))
        made["index"] = self._write(index.select("id", "v.day", "v.version", "bucket"), "index", "bucket")
        for kind, schema in (("gone", _GONE), ("rejected", _REJECTED)):
            if any(e.get(kind) for e in entries) and not (kind == "gone" and first):
                made[kind] = self._write(self._parts(entries, kind, schema), kind)
        return made

    def read(self) -> DataFrame:
        """The stored comments."""
        return self.rows(self.log.state()[1]).drop("day", "version", "fingerprint", "batch")

    def rejected(self) -> DataFrame:
        """(file, reason, raw) of what could not be stored."""
        return self._parts(self.log.state()[1], "rejected", _REJECTED)


def _bucket():
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _once(df: DataFrame, name: str) -> DataFrame:
    """Computed once, kept in the shared folder while the batch is worked on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ddl(rows: DataFrame) -> str:
    """The schema of a rows folder as text: what is written, then the partition columns."""
    fields = [f for f in rows.schema.fields if f.name not in ("batch", "day")]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", batch string, day string"


def start_ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 model=None, dates_change: bool = True):
    """Start the ingest query; rows land in the table at ``sink``. Returns the StreamingQuery.

    With a fitted sentiment ``model`` (U1), each micro-batch is scored before it is stored and
    the rows carry a ``sentiment`` column.
    """

    def scored(rows: DataFrame) -> DataFrame:
        from ..operators.model import score
        out = score(model, rows.withColumn("text", F.col("commentText")))
        return out.drop("text", "probability").withColumnRenamed("Predicted", "sentiment")

    def publish(batch: DataFrame, batch_id: int) -> None:
        table, writer = CommentSink(spark, sink), writer_of(spark, checkpoint)
        if not table.log.done(writer, batch_id):
            table.add(latest_copies(stored_comments(batch)), rejected_items(batch), {"writer": writer, "batch": batch_id},
                      dates_change, None if model is None else scored)

    writer = (comment_stream(spark, landing, max_files_per_trigger).writeStream
              .foreachBatch(publish).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def run_ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
               max_files_per_trigger: int | None = None, model=None, dates_change: bool = True) -> DataFrame:
    """Process everything landed so far, then return the stored comments."""
    q = start_ingest(spark, landing, sink, checkpoint, True, max_files_per_trigger, model, dates_change)
    q.awaitTermination()
    return CommentSink(spark, sink).read()
