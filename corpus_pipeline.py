"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; ``run`` writes every result as Parquet below ``spark.checkpoint.dir`` and reads it back for
the next. All but the last return the columns of ``documents``.

Rows are followed by a key: their id where no different row has it, else (null ids, ids of several rows) a
number made from the whole row, above all ids. So such rows are judged one by one: clean, distinct texts
stay, and rows that are equal in every column count as one, which stays once. A label belongs to all rows
with its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm import langid, minhash, packing, pii, quality
from chorus.llm.common import small_or_plain, table, written
from chorus.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Keys of rows whose id does not name them start here; ids of the tables lie below.
UNNAMED = 1 << 62


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a column ``key``; text moves only if very many ids are repeated."""
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*[F.col(c).isNull() for c in COLUMNS], *COLUMNS).bitwiseAND(F.lit(UNNAMED - 1)) + F.lit(UNNAMED)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    again = docs.join(small_or_plain(written(repeated, "repeated-ids")), "doc_id", "left_semi").select("doc_id", row.alias("row"))
    several = written(again.groupBy("doc_id").agg((F.min("row") < F.max("row")).alias("several")).filter("several"), "ids-of-several")
    named = F.col("doc_id").isNotNull() & F.col("several").isNull()
    return docs.join(small_or_plain(several), "doc_id", "left").select(*COLUMNS, F.when(named, F.col("doc_id")).otherwise(row).alias("key"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is not among ``keys`` (column ``doc_id``); text moves only if these are very many."""
    gone = written(keys.select(F.col("doc_id").alias("key")).distinct(), "gone")
    return keyed.join(small_or_plain(gone), "key", "left_anti").select(*COLUMNS, "key")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents whose language cannot be told go."""
    docs = docs.select(*COLUMNS)
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return langid.predict(rows, langid.train(docs), id_col="row").filter(~F.col("rejected")).select("row.*")


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents too surprising to a model of trusted text go."""
    keyed, labels = _keyed(docs), table(spark, sf_dir, "labels")
    unnamed = keyed.filter(F.col("key") >= UNNAMED).select("doc_id", "key").distinct()
    theirs = labels.join(unnamed, "doc_id").select(F.col("key").alias("doc_id"), "quality", "toxic")
    labels = written(labels.select("doc_id", "quality", "toxic").unionByName(theirs), "labels-by-key")
    judged = quality.judge(keyed, labels, id_col="key")
    return _without(keyed, judged.filter(~F.col("kept"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document with the smallest key stays, once."""
    keyed = _keyed(docs)
    found = written(minhash.near_duplicates(keyed, id_col="key"), "near-classes")
    kept = _without(keyed, found.filter(~F.col("kept")))
    twice = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "equal-rows")
    equal = kept.join(small_or_plain(twice.withColumnRenamed("doc_id", "key")), "key", "left_semi")
    return _without(kept, twice).select(*COLUMNS).unionByName(equal.dropDuplicates(["key"]).select(*COLUMNS))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all remaining documents in windows of 2048 tokens, with their ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("language_id", language), ("quality", good_text), ("near_dedup", near_dedup), ("pii", private_data), ("packing", pack)]

#: No stage can be said in SQL: each trains a model, or needs the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
