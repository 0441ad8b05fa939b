"""Registered queries: evaluation tables and the model pieces."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import argmax, decode_label, encode_label
from ..functions.text import words
from ..operators import evaluate as E
from ..operators import model as M
from ..operators import profile as P
from ..operators.batches import batched_map
from ..operators.derived import DerivedColumn, fingerprint
from ..operators.joins import with_scalars
from ..schemas import PUNCTUATION_AND_DIGITS, QUANTILES, RUN_LOG_SCHEMA, SENTIMENTS, SEQ_LEN_TRAIN
from ..session import scratch_path
from ..sources import adapters as A
from .registry import register

from .catalog_profile import _nearest_sql
from .sqltext import sql_words as _sql_words


@register("f12_argmax", A.with_adapters("logits") + """
SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted FROM logits""")
def f12_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """index of the first maximal logit."""
    return A.logits(spark, sf).select("id", argmax(F.col("logits")).alias("predicted"))


@register("f13_label_roundtrip", A.with_adapters("logits") + """
SELECT id, CASE label WHEN 0 THEN 'Positive' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Negative' END AS Sentiment,
  label AS label_id FROM logits""")
def f13_label_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """decode label ids to names and encode them back."""
    lg = A.logits(spark, sf).select("id", decode_label(F.col("label")).alias("Sentiment"))
    return lg.withColumn("label_id", encode_label(F.col("Sentiment")))


@register("a18_confusion_matrix", A.with_adapters("predictions") + """
SELECT Predicted,
  count(*) FILTER (WHERE Sentiment = 'Positive') / (SELECT count(*) FROM predictions) AS Positive,
  count(*) FILTER (WHERE Sentiment = 'Neutral') / (SELECT count(*) FROM predictions) AS Neutral,
  count(*) FILTER (WHERE Sentiment = 'Negative') / (SELECT count(*) FROM predictions) AS Negative
FROM predictions GROUP BY Predicted""")
def a18_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix as shares of all rows, Predicted descending."""
    return E.confusion_matrix(A.predictions(spark, sf))


@register("a19_class_accuracy", A.with_adapters("predictions") + """
SELECT Sentiment, avg(CAST(Sentiment = Predicted AS DOUBLE)) AS accuracy FROM predictions GROUP BY Sentiment""")
def a19_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A19 + F19: accuracy per true class."""
    return E.class_accuracy(A.predictions(spark, sf))


@register("a20_accuracy", A.with_adapters("predictions") + """
SELECT avg(CAST(Sentiment = Predicted AS DOUBLE)) AS accuracy FROM predictions""")
def a20_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Overall accuracy."""
    return E.accuracy(A.predictions(spark, sf))


@register("a21_cross_entropy", A.with_adapters("logits") + """
SELECT round(avg(ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))))
                 + list_max(logits) - logits[label + 1]), 9) AS cross_entropy FROM logits""")
def a21_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cross-entropy of the logits against the labels."""
    ce = E.cross_entropy(A.logits(spark, sf))
    return ce.select(F.round("cross_entropy", 9).alias("cross_entropy"))


def _p9_sql() -> str:
    return A.with_adapters("comments") + f"""
, l AS (SELECT id, len({_sql_words('commentText')}) AS length FROM comments)
SELECT id, length FROM l
WHERE length < (SELECT avg(length) + 2.0 * stddev_samp(length) FROM l)"""


def p9_outlier_cut(spark: SparkSession, sf: str) -> DataFrame:
    """P9 + J6 + F15: comments whose word count is below mean + 2 sample std."""
    c = A.comments(spark, sf, "id", "commentText")
    return P.outlier_cut(c, F.size(words(F.col("commentText"))), 2.0, "length").select("id", "length")


def _a27_summary_sql() -> str:
    return A.with_adapters("predictions_text") + f"""
, l AS (SELECT Sentiment = Predicted AS Correct, len({_sql_words('CommentText')}) AS length FROM predictions_text)
, k AS (SELECT * FROM l WHERE length < (SELECT avg(length) + 2.0 * stddev_samp(length) FROM l))
SELECT Correct, count(*) AS n, avg(length) AS mean_length FROM k GROUP BY Correct"""


def a27_length_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Token-length summary of correct vs wrong predictions after the outlier cut."""
    summary, _ = E.length_accuracy(A.predictions(spark, sf, with_length=True), length_col="length")
    return summary


def _a27_quantiles_sql() -> str:
    return A.with_adapters("predictions_text") + f"""
, l AS (SELECT Sentiment = Predicted AS Correct, len({_sql_words('CommentText')}) AS length FROM predictions_text)
, k AS (SELECT * FROM l WHERE length < (SELECT avg(length) + 2.0 * stddev_samp(length) FROM l))
SELECT * FROM """ + _nearest_sql("k", "length", QUANTILES, "Correct")


def a27_length_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A27 + A12: nearest quantiles of token length for correct vs wrong predictions."""
    _, q = E.length_accuracy(A.predictions(spark, sf, with_length=True), length_col="length")
    return q


@register("u5_report_set", A.with_adapters("predictions") + """
, n AS (SELECT count(*) AS total FROM predictions)
SELECT 'confusion' AS report, Predicted AS row_key, s.c AS "column", CAST(
  count(*) FILTER (WHERE Sentiment = s.c) AS DOUBLE) / any_value(n.total) AS value
FROM predictions, n, (VALUES ('Positive'), ('Neutral'), ('Negative')) AS s(c)
GROUP BY Predicted, s.c
UNION ALL
SELECT 'class_accuracy', Sentiment, 'accuracy', avg(CAST(Sentiment = Predicted AS DOUBLE))
FROM predictions GROUP BY Sentiment
UNION ALL
SELECT 'accuracy', '', 'accuracy', avg(CAST(Sentiment = Predicted AS DOUBLE)) FROM predictions""")
def u5_report_set(spark: SparkSession, sf: str) -> DataFrame:
    """The default report set run over one cached prediction frame, in long form."""
    return E.reports_long(E.evaluate(A.predictions(spark, sf)))


@register("x1_hash_split", """
SELECT doc_id, CAST((('0x' || substr(md5(text), 1, 8))::UBIGINT % 100) AS INTEGER) AS bucket,
  CASE WHEN (('0x' || substr(md5(text), 1, 8))::UBIGINT % 100) < 90 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def x1_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic 0.9 / 0.1 split by the md5 of the text (copies stay together)."""
    d = A.read_table(spark, sf, "documents")
    return M.hash_split(d.select("doc_id", "text"), F.col("text"), 0.9) \
        .select("doc_id", M.hash_bucket(F.col("text")).alias("bucket"), "split")


def _f14_sql() -> str:
    return A.with_adapters("comments") + f"""
SELECT id, list_resize(list_transform(list_slice({_sql_words('commentText')}, 1, {SEQ_LEN_TRAIN}),
    lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) + 2), {SEQ_LEN_TRAIN}, 0::BIGINT) AS token_ids FROM comments"""


def f14_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """the fixed-length token id vector of every comment (hashed words, 0 pads)."""
    c = A.comments(spark, sf, "id", "commentText")
    return c.select("id", M.token_sequence(F.col("commentText"), SEQ_LEN_TRAIN).alias("token_ids"))


_TEXT_FOLD = "(('0x' || substr(md5(commentText), 1, 8))::UBIGINT % 100) < 80"


def _f14_vocabulary_sql() -> str:
    return A.with_adapters("comments") + f"""
, w AS (SELECT id, {_TEXT_FOLD} AS known, {_sql_words('commentText')} AS w FROM comments)
, v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 1 AS t FROM (SELECT unnest(w) AS word FROM w WHERE known) GROUP BY word)
, p AS (SELECT id, unnest(list_slice(w, 1, {SEQ_LEN_TRAIN})) AS word, unnest(generate_series(1, len(list_slice(w, 1, {SEQ_LEN_TRAIN})))) AS pos FROM w)
, q AS (SELECT id, list(coalesce(t, 1) ORDER BY pos) AS ids FROM p LEFT JOIN v ON v.word = p.word GROUP BY id)
SELECT c.id, list_resize(coalesce(q.ids, []), {SEQ_LEN_TRAIN}, 0::BIGINT) AS token_ids FROM comments c LEFT JOIN q ON q.id = c.id"""


def f14_vocabulary_ids(spark: SparkSession, sf: str) -> DataFrame:
    """a vocabulary of the hashed 0.8 fold's words, ids by rank; every comment as a fixed-length vector of ids (0 pads, 1 unknown)."""
    c = A.comments(spark, sf, "id", "commentText")
    known = M.hash_split(c, F.col("commentText"), 0.8).where("split = 'train'")
    return M.token_ids(c, M.vocabulary(known, "commentText"), "id", "commentText")


def _f15_sql() -> str:
    return A.with_adapters("comments") + f"""
SELECT id, len({_sql_words('commentText')}) AS n_tokens FROM comments"""


def f15_token_length(spark: SparkSession, sf: str) -> DataFrame:
    """token count of every comment."""
    c = A.comments(spark, sf, "id", "commentText")
    return c.select("id", F.size(words(F.col("commentText"))).alias("n_tokens"))


def _u4_sql() -> str:
    return A.with_adapters("comments") + f"""
SELECT id, CAST(length(commentText) AS BIGINT) AS n_chars,
  CAST(len({_sql_words('commentText')}) AS BIGINT) AS n_words FROM comments"""


def _text_counts(table: pa.Table) -> pa.Table:
    """Characters and words of a batch, by Arrow's compute functions."""
    text = pc.fill_null(table["commentText"], "")
    bare = pc.utf8_lower(pc.replace_substring_regex(text, f"[{re.escape(PUNCTUATION_AND_DIGITS)}]", ""))
    words = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(bare)))
    n_words = pc.if_else(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(bare)), 0), 0, words)
    return pa.table({"id": table["id"], "n_chars": pc.cast(pc.utf8_length(text), pa.int64()), "n_words": pc.cast(n_words, pa.int64())})


def u4_batched_map(spark: SparkSession, sf: str) -> DataFrame:
    """U4: a vectorised function mapped over batches of comments (character and word counts)."""
    c = A.comments(spark, sf, "id", "commentText")
    return batched_map(c, _text_counts, "id long, n_chars long, n_words long")


register("p9_outlier_cut", _p9_sql())(p9_outlier_cut)
register("a27_length_accuracy", _a27_summary_sql())(a27_length_accuracy)
register("a27_length_quantiles", _a27_quantiles_sql())(a27_length_quantiles)
register("f14_token_ids", _f14_sql())(f14_token_ids)
register("f14_vocabulary_ids", _f14_vocabulary_sql())(f14_vocabulary_ids)
register("f15_token_length", _f15_sql())(f15_token_length)
register("u4_batched_map", _u4_sql())(u4_batched_map)


# ------------------------------------------------------------------ model rows ---
# What a model answers cannot be said in SQL; these queries return facts about the answers that must
# hold, and the oracle states them as true next to the counts it can compute.

def _folds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows of the comments that someone labelled, by the hash of their text."""
    known = A.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    lab = M.labelled_comments(A.comments(spark, sf, "id", "commentText", "sentiment").join(known, "id", "left_semi"))
    lab = M.hash_split(lab, F.col("text"), 0.8)
    return tuple(lab.where(F.col("split") == name).drop("split") for name in ("train", "test"))


@register("u1_score_comments", A.with_adapters("comments") + """
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, true AS all_labelled, true AS probabilities_add_up FROM comments""")
def u1_score_comments(spark: SparkSession, sf: str) -> DataFrame:
    """U6 + U1: train the sentiment classifier on the hashed 0.8 fold, score every comment: as many
    rows as comments, every label in the enum, probabilities adding up to one."""
    model = M.train_sentiment(_folds(spark, sf)[0])
    rows = A.comments(spark, sf, "id", "commentText").select("id", F.col("commentText").alias("text"))
    scored = M.score(model, rows)
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"),
                      F.every(F.coalesce(F.col("Predicted").isin(SENTIMENTS), F.lit(False))).alias("all_labelled"),
                      F.every(F.abs(total - 1) < 1e-9).alias("probabilities_add_up"))


@register("u6_classifier_report", A.with_adapters("comments") + f"""
, t AS (SELECT sentiment FROM comments WHERE id IN (SELECT doc_id FROM labels) AND NOT {_TEXT_FOLD}), c AS (SELECT count(*) AS n FROM t GROUP BY sentiment)
SELECT (SELECT count(*) FROM t) AS n_test, round(max(n) / sum(n), 9) AS majority_accuracy,
  round(-sum(n / (SELECT count(*) FROM t) * ln(n / (SELECT count(*) FROM t))), 9) AS prior_loss,
  true AS beats_majority, true AS beats_prior, true AS finds_negatives FROM c""")
def u6_classifier_report(spark: SparkSession, sf: str) -> DataFrame:
    """U6 + U5: the classifier on the held-out fold, next to always answering the most frequent
    class and to the fold's own class shares: it beats the one in accuracy, the other in log loss, and finds half of the
    negative comments or more (asked only where eight are there to be found).
    """
    train, test = _folds(spark, sf)
    scored = M.score(M.train_sentiment(train), test).withColumn("Sentiment", decode_label(F.col("label").cast("int")))
    truth = F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1)
    got = scored.agg(F.avg((F.col("Sentiment") == F.col("Predicted")).cast("double")).alias("accuracy"),
                     F.avg(-F.log(F.greatest(truth, F.lit(1e-15)))).alias("loss"), F.count(F.lit(1)).alias("n_test"),
                     F.avg(F.when(F.col("Sentiment") == "Negative", (F.col("Predicted") == "Negative").cast("double"))).alias("recall"),
                     F.count(F.when(F.col("Sentiment") == "Negative", 1)).alias("n_negative"))
    share = test.groupBy("label").count().agg(F.collect_list("count").alias("c"))  # a row per class
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    prior = share.select((F.array_max("c") / total).alias("majority"), F.aggregate(
        "c", F.lit(0.0), lambda a, x: a - x / total * F.log(x / total)).alias("prior"))
    both = with_scalars(got, prior)
    return both.select("n_test", F.round("majority", 9).alias("majority_accuracy"), F.round("prior", 9).alias("prior_loss"),
                       (F.col("accuracy") > F.col("majority")).alias("beats_majority"),
                       (F.col("loss") < F.col("prior")).alias("beats_prior"),
                       ((F.col("n_negative") < 8) | (F.col("recall") >= 0.5)).alias("finds_negatives"))


@register("u2_language_id", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE lang = 'en') AS n_en, true AS beats_always_en,
  true AS only_known_languages FROM documents""")
def u2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language identification (char 3-grams + naive Bayes) for every language that occurs,
    trained on the hashed 0.8 fold of documents, applied to every document."""
    docs = A.read_table(spark, sf, "documents")
    langs = M.languages_of(docs)
    rows = M.hash_split(M.language_training_rows(docs, langs), F.col("text"), 0.8)
    model = M.language_pipeline().fit(rows.where(F.col("split") == "train").where(F.col("label").isNotNull()))
    truth = docs.select(F.col("doc_id").alias("id"), "lang")
    found = M.predict_language(model, rows.select("id", "text"), langs).join(truth, "id")
    right = F.avg(F.coalesce(F.col("language") == F.col("lang"), F.lit(False)).cast("double"))
    english = F.avg(F.coalesce(F.col("lang") == "en", F.lit(False)).cast("double"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("lang") == "en", 1)).alias("n_en"),
                     (right > english).alias("beats_always_en"),
                     F.every(F.col("language").isin(langs)).alias("only_known_languages"))


@register("u7_search_run_log", A.with_adapters("comments") + """
SELECT 15 AS n_runs, 45 AS n_values, true AS best_is_lowest, true AS losses_finite,
  (SELECT count(*) FROM comments) AS n_scored, 0 AS n_changed_by_reload""")
def u7_search_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """U7 + S12 + U8: 15-trial random search, every trial on the whole training fold (hashed validation fold, lowest log loss),
    the trials in the run log; the best model is saved, loaded again, and must answer as before."""
    train, _ = _folds(spark, sf)
    best, results = M.search_sentiment(train, trials=15, halving=False)
    log, path = scratch_path(spark, "run-log"), scratch_path(spark, "best-model")
    M.log_runs(spark, log, [(params, {"val_log_loss": loss}) for params, loss in results])
    M.save_model(best, path)
    rows = A.comments(spark, sf, "id", "commentText").select("id", F.col("commentText").alias("text"))
    a = M.score(best, rows).select("id", F.col("Predicted").alias("a"))
    b = M.score(M.load_model(path), rows).select("id", F.col("Predicted").alias("b"))
    same = a.join(b, "id").agg(F.count(F.lit(1)).alias("n_scored"),
                               F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).cast("int").alias("n_changed_by_reload"))
    runs = spark.read.schema(RUN_LOG_SCHEMA).parquet(log)
    loss = F.when(F.col("key") == "val_log_loss", F.col("value").cast("double"))
    used = best.stages[-1].getRegParam()
    logged = runs.groupBy("run_id").agg(F.min(loss).alias("loss"), F.count(F.lit(1)).alias("n"), F.max(
        F.when(F.col("key") == "reg_param", F.col("value").cast("double"))).alias("reg"))
    facts = logged.agg(F.count(F.lit(1)).cast("int").alias("n_runs"), F.sum("n").cast("int").alias("n_values"),
                       (F.abs(F.min_by("reg", "loss") - F.lit(used)) < 1e-12).alias("best_is_lowest"),
                       F.every(F.col("loss") < 100).alias("losses_finite"))
    return with_scalars(facts, same)


@register("s10_cached_language", A.with_adapters("comments") + "SELECT id, true AS known FROM comments")
def s10_cached_language(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + U2: languages are predicted once into keyed Parquet and re-read afterwards: the second
    call must not compute, and gets a row per comment with one of the known languages."""
    path = scratch_path(spark, "language-cache")
    docs = A.read_table(spark, sf, "documents")
    langs = M.languages_of(docs)
    rows = M.language_training_rows(docs, langs)

    def predicted() -> DataFrame:
        model = M.language_pipeline().fit(rows.where(F.col("label").isNotNull()))
        return M.predict_language(model, rows.select("id", "text"), langs).select("id", "language")

    def again() -> DataFrame:
        raise AssertionError("the stored column was not found")

    M.cached_column(spark, path, predicted)
    return M.cached_column(spark, path, again).select("id", F.col("language").isin(langs).alias("known"))


@register("s10_new_rows_only", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_computed_later, 0 AS n_computed_again, true AS known FROM documents""")
def s10_new_rows_only(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + U2: languages stored for most documents; when the others arrive, only these are computed, and nothing when all are asked for again."""
    docs = A.read_table(spark, sf, "documents")
    langs = M.languages_of(docs)
    rows = M.language_training_rows(docs, langs)
    model = M.language_pipeline().fit(rows.where(F.col("label").isNotNull()))
    column = DerivedColumn(spark, scratch_path(spark, "languages"), fingerprint(model, *langs), "id",
                           lambda new: M.predict_language(model, new, langs).select("id", "language"))
    asked = rows.select("id", "text")
    column.of(asked.where("id % 7 <> 0"))
    later = column.missing(asked).agg(F.count(F.lit(1)).alias("n_computed_later"))
    found = column.of(asked).agg(F.count(F.lit(1)).alias("n_rows"), F.every(F.col("language").isin(langs)).alias("known"))
    again = column.missing(asked).agg(F.count(F.lit(1)).cast("int").alias("n_computed_again"))
    return with_scalars(with_scalars(found, _fixed(later)), again)


def _fixed(one_row: DataFrame) -> DataFrame:
    """A one-row answer as of now."""
    return one_row.checkpoint()


@register("f16_report_values", A.with_adapters("comments_wide", "comments") + """
, h AS (SELECT occurrences, count(*) AS n_keys FROM
  (SELECT authorId, count(*) AS occurrences FROM comments_wide GROUP BY authorId) t GROUP BY occurrences)
SELECT round((SELECT count(*) / count(DISTINCT videoId) FROM comments_wide), 2) AS mean_rows,
       round((SELECT arg_min(n_keys, occurrences) / sum(n_keys) * 100.0 FROM h), 2) AS pct_first_bucket,
       round((SELECT avg(CAST(coalesce(language = 'en', false) AS DOUBLE)) * 100.0 FROM comments), 2) AS pct_en""")
def f16_report_values(spark: SparkSession, sf: str) -> DataFrame:
    """F16: report values with two decimals (mean comments per video, first-bucket share,
    percent English)."""
    from ..functions.scalar import report_round
    w = A.comments_wide(spark, sf)
    a = P.mean_rows_per_key(w, "videoId")
    b = P.first_bucket_share(P.occurrence_histogram(w, "authorId"))
    c = P.pct_where(A.comments(spark, sf, "language"), {"pct_en": F.col("language") == "en"})
    return with_scalars(with_scalars(a, b), c).select(
        report_round(F.col("mean_rows")).alias("mean_rows"),
        report_round(F.col("pct")).alias("pct_first_bucket"),
        report_round(F.col("pct_en")).alias("pct_en"))
