"""Splits, token ids and the text classifiers.

Training and scoring are Spark ML pipelines: features are built per partition, the optimiser
aggregates gradients with tree aggregation, and scoring is a plain ``transform`` (no Python
per row). The neural models of the analysed application are re-aimed as linear text models.
"""

from __future__ import annotations

import datetime as _dt
import random
import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decode_label, encode_label
from ..functions.text import strip_emoji, words
from ..schemas import RUN_LOG_SCHEMA, SEQ_LEN_TRAIN
from ..session import scratch_path
from .grams import CharGrams
from .joins import with_row_index


# ------------------------------------------------------------------ X1: hash split ----

def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Deterministic bucket 0..buckets-1 from the md5 of the key's text."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key: Column, train_fraction: float = 0.9,
               names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Add ``split`` (train/test) by hash bucket; the same key always lands on one side.

    Hashing the text (not the id) keeps exact copies of a text on one side.
    """
    cut = int(round(train_fraction * 100))
    return df.withColumn("split", F.when(hash_bucket(key) < cut, F.lit(names[0])).otherwise(F.lit(names[1])))


# ------------------------------------------------------------------ F14: token ids ----

PAD_ID = 0


def token_id(word: Column) -> Column:
    """The id of a word: 2 + 60 bits of its md5; every word has one, clashes are negligible."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint") + 2


def token_sequence(text: Column, seq_len: int = SEQ_LEN_TRAIN, pad_id: int = PAD_ID) -> Column:
    """the text's first ``seq_len`` word ids, padded on the right: array of that length.

    One expression: no vocabulary pass, no shuffle. The fixed length is the operator's definition.
    """
    ids = F.transform(F.slice(words(text), 1, seq_len), token_id)
    ids = F.coalesce(ids, F.array().cast("array<bigint>"))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), F.lit(seq_len) - F.size(ids)))


UNKNOWN_ID, FIRST_ID = 1, 2


def vocabulary(df: DataFrame, text_col: str = "text", size: int | None = None) -> DataFrame:
    """(word, n, token_id): the words by falling frequency, then by word, numbered from 2 without gaps.

    Counts are partial before the shuffle; ranks come from sorted ranges of the counts and their offsets, so no task
    sees all words. ``size`` keeps the most frequent.
    """
    counts = df.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_row_index(counts.orderBy(F.desc("n"), "word"), "__rank")
    out = ranked.select("word", "n", (F.col("__rank") + FIRST_ID).alias("token_id"))
    return out if size is None else out.where(F.col("token_id") < FIRST_ID + size)


def token_ids(df: DataFrame, vocab: DataFrame, key: str, text_col: str = "text", seq_len: int = SEQ_LEN_TRAIN) -> DataFrame:
    """(key, token_ids): ids of the first ``seq_len`` words of each text by ``vocab``, padded on the right; other words are ``UNKNOWN_ID``.

    Rows are packed by Arrow batch, with each word of a batch once; only these words are shuffled to meet the
    vocabulary, not the tokens, so a word that is everywhere is one row a batch.
    """
    type_ = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.slice(words(F.col(text_col)), 1, seq_len), F.array().cast("array<string>")).alias("w"))

    def pack(batches):
        for n, batch in enumerate(batches):
            found = batch.column("w").flatten().dictionary_encode()
            one = lambda a, t: pa.array([a.to_pylist()], pa.list_(t))
            yield pa.record_batch([
                pa.array([(TaskContext.get().partitionId() << 32) + n]), pa.array([batch.column("key").to_pylist()], pa.list_(batch.column("key").type)),
                one(pc.list_value_length(batch.column("w")), pa.int32()), one(found.indices, pa.int32()), one(found.dictionary, pa.string())],
                names=["part", "keys", "sizes", "codes", "dictionary"])

    path = scratch_path(df.sparkSession, "token-parts")
    rows.mapInArrow(pack, f"part long, keys array<{type_}>, sizes array<int>, codes array<int>, dictionary array<string>").write.parquet(path)
    packed = df.sparkSession.read.parquet(path)
    asked = packed.select("part", F.posexplode("dictionary").alias("pos", "word"))
    told = asked.join(vocab.select("word", "token_id"), "word", "left").groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("t")))).alias("told"))
    answered = packed.drop("dictionary").join(told, "part", "left").select("keys", "sizes", "codes", F.transform("told", lambda x: x["t"]).alias("told"))

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes, codes, told = (batch.column(c)[i] for c in ("keys", "sizes", "codes", "told"))
                n = sizes.values.to_numpy()
                out = np.full((len(n), seq_len), PAD_ID, np.int64)
                if told.is_valid and len(codes.values):
                    ids = told.values.to_numpy(zero_copy_only=False)[codes.values.to_numpy()]
                    row = np.repeat(np.arange(len(n)), n)
                    out[row, np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)] = ids
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * seq_len, pa.int32()), pa.array(out.reshape(-1)))
                yield pa.record_batch([keys.values, flat], names=[key, "token_ids"])

    return answered.mapInArrow(unpack, f"`{key}` {type_}, token_ids array<bigint>")


# ------------------------------------------------------------------ U6: classifier ----

STYLE_SQL = """
SELECT *,
  CASE WHEN size(__toks) = 0 THEN 0.0 ELSE size(array_distinct(__toks)) / size(__toks) END AS style_distinct,
  CASE WHEN char_length(__text) = 0 THEN 0.0
       ELSE char_length(regexp_replace(__text, '[\\\\p{L}\\\\p{N}\\\\s]+', '')) / char_length(__text) END AS style_symbols,
  CASE WHEN char_length(regexp_replace(__text, '[^\\\\p{L}]+', '')) = 0 THEN 0.0
       ELSE char_length(regexp_replace(__text, '[^\\\\p{Lu}]+', '')) / char_length(regexp_replace(__text, '[^\\\\p{L}]+', ''))
  END AS style_upper
FROM __THIS__
"""


#: Words the classifier looks at.
SELECTED_WORDS = 200


def word_classes(train: DataFrame) -> DataFrame:
    """(word, label, n): texts of each class that hold each word; partial counts before the shuffle."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "\\W+"), lambda w: w != ""))
    return train.where(F.col("label").isNotNull()).select("label", F.explode(tokens).alias("word")).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))


def chi_square_words(train: DataFrame, top: int = SELECTED_WORDS) -> list[str]:
    """The ``top`` words whose presence depends most on the class, by the chi-square statistic of word x class; ties by word.

    No word is left out before the statistic is known; the best are taken by a distributed top-k, and only these
    (a parameter) are gathered.
    """
    sizes = {r["label"]: r["n"] for r in train.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    n = F.sum("n")
    per = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) for k in sizes]
    # observed minus expected is the same, but for the sign, among texts with the word and those without
    gap = sum(((F.pow(o - n * F.lit(v / total), 2) / F.lit(v / total)) for o, v in zip(per, sizes.values())), F.lit(0.0))
    chi2 = F.when(n < total, gap * (1 / n + 1 / (F.lit(total) - n))).otherwise(0.0)
    found = word_classes(train).groupBy("word").agg(chi2.alias("chi2"))
    return [r["word"] for r in found.orderBy(F.desc("chi2"), "word").limit(top).collect()]


def feature_stages(selected: Sequence[str]) -> list:
    """Text -> presence of the selected words + three style ratios.

    A NULL text is an empty one: it has no words, and its label is what the class shares make of that.
    """
    text = SQLTransformer(statement="SELECT *, coalesce(text, '') AS __text FROM __THIS__")
    tok = RegexTokenizer(inputCol="__text", outputCol="__toks", pattern="\\W+", toLowercase=True)
    style = SQLTransformer(statement=STYLE_SQL)
    tf = CountVectorizerModel.from_vocabulary(list(selected) or [" "], "__toks", "__tf", binary=True)  # no word is a blank
    asm = VectorAssembler(inputCols=["__tf", "style_distinct", "style_symbols", "style_upper"], outputCol="features")
    return [text, tok, style, tf, asm]


def classifier(reg_param: float = 0.01, elastic_net: float = 0.0, max_iter: int = 30) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                              maxIter=max_iter, regParam=reg_param, elasticNetParam=elastic_net)


def sentiment_pipeline(selected: Sequence[str], **params) -> Pipeline:
    """Text -> features -> multinomial logistic regression.

    Input columns: ``text`` (string) and ``label`` (double, 0 Positive / 1 Neutral / 2 Negative).
    """
    return Pipeline(stages=[*feature_stages(selected), classifier(**params)])


def labelled_comments(comments: DataFrame) -> DataFrame:
    """Training rows: (id, text, label double) for comments with a sentiment."""
    return comments.where(F.col("sentiment").isNotNull()).select(
        "id", F.col("commentText").alias("text"), encode_label(F.col("sentiment")).cast("double").alias("label"))


def train_sentiment(train: DataFrame, selected_words: int = SELECTED_WORDS, **params) -> PipelineModel:
    """Select the words, then fit the classifier pipeline; features are made once and kept while it is fitted."""
    stages = sentiment_pipeline(chi_square_words(train, selected_words), **params).getStages()
    made = Pipeline(stages=stages[:-1]).fit(train)
    rows = made.transform(train).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=[*made.stages, stages[-1].fit(rows)])
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Score every row: adds ``Predicted`` (label name) and ``probability``."""
    src = df if text_col == "text" else df.withColumn("text", F.col(text_col))
    out = model.transform(src)
    keep = [c for c in df.columns if c != "text" or text_col == "text"]
    return out.select(*keep, decode_label(F.col("prediction").cast("int")).alias("Predicted"),
                      "probability")


def save_model(model: PipelineModel, path: str) -> None:
    """U8: persist the fitted pipeline (label map is fixed in ``schemas``)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """U8: load a persisted pipeline."""
    return PipelineModel.load(path)


# ------------------------------------------------------------------ U7: search --------

#: Settings kept after a rung: one in so many; rungs: the share of the training fold grows by the same factor.
KEEP = 3
#: Rows of each class in the first rung, at least.
LEAST_OF_CLASS = 5


def search_sentiment(train: DataFrame, trials: int = 15, seed: int = 7, train_fraction: float = 0.8, parallel: int = 4,
                     halving: bool = True) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """Search over ``trials`` sampled settings by successive halving; the lowest validation log loss wins.

    All settings are fitted on a ninth of the training fold, the best third of them on a third, the best of these on
    all of it (small folds start at a larger share); a rung's fits run as parallel jobs. That is about a third of the fits' work without pruning. Shares go by a hash of the
    text, each within the next, and all rungs are judged on the same validation fold, which no copy of a training text can be in.

    Without ``halving`` every setting is fitted on all of the training fold: the whole search.

    Features are made once and kept while the settings are tried. Returns the best model (refit on all of ``train``) and,
    for each trial, (params, log loss), with ``halving`` of the last rung it reached and with that rung's share as ``fitted_share``.
    """
    rng = random.Random(seed)
    shared = Pipeline(stages=feature_stages(chi_square_words(train))).fit(train)
    text = F.coalesce("text", F.lit(""))
    fold, share = hash_bucket(F.concat(F.lit("fold "), text)), hash_bucket(F.concat(F.lit("rung "), text), 900)
    rows = shared.transform(train).select("features", "label", (fold < round(train_fraction * 100)).alias("__fit"), share.alias("__share"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                           probabilityCol="probability", metricName="logLoss")
    settings = [{"reg_param": 10 ** rng.uniform(-4, -0.5), "elastic_net": rng.choice([0.0, 0.0, 0.5])} for _ in range(trials)]
    results: dict[int, tuple[dict, float]] = {}
    # the first rung is the smallest share that holds every class of the fold often enough to be fitted
    sizes = [900 // KEEP ** i for i in ((2, 1, 0) if halving else (0,))]
    held = rows.where("__fit").groupBy("label").agg(*[F.count(F.when(F.col("__share") < s, 1)).alias(str(s)) for s in sizes]).collect()
    left, size = list(range(trials)), next((s for s in sizes[:-1] if all(r[str(s)] >= LEAST_OF_CLASS for r in held)), sizes[-1])

    def tried(i: int) -> float:
        # the loss is a mean over rows, so on a share of them the same penalty counts that much more
        penalty = {"reg_param": settings[i]["reg_param"] * 900 / size}
        fitted = classifier(**settings[i] | penalty).fit(rows.where(F.col("__fit") & (F.col("__share") < size)))
        return float(ev.evaluate(fitted.transform(rows.where("not __fit"))))

    try:
        while True:
            with ThreadPool(min(parallel, len(left))) as pool:
                losses = pool.map(inheritable_thread_target(rows.sparkSession)(tried), left)
            results |= {i: (settings[i] | ({"fitted_share": size / 900} if halving else {}), loss) for i, loss in zip(left, losses)}
            left = [i for _, i in sorted(zip(losses, left))][:max(1, len(left) // KEEP)]
            if size == 900:
                break
            size *= KEEP
        last = classifier(**settings[left[0]]).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*shared.stages, last]), [results[i] for i in range(trials)]


# ------------------------------------------------------------------ U2: language -----

def language_pipeline(num_features: int = 4096) -> Pipeline:
    """Character 3-grams of the whole (emoji-stripped) text -> hashed counts -> naive Bayes.

    Input: ``text``, ``label`` (double language index); see ``language_training_rows``.
    """
    grams = CharGrams(inputCol="text", outputCol="features", numFeatures=num_features)
    nb = NaiveBayes(featuresCol="features", labelCol="label", modelType="multinomial", smoothing=1.0)
    return Pipeline(stages=[grams, nb])


def languages_of(docs: DataFrame) -> list[str]:
    """The languages that occur, in order (one row each is gathered)."""
    return sorted(r[0] for r in docs.select("lang").where(F.col("lang").isNotNull()).distinct().collect())


def language_training_rows(docs: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(id, text, label): emoji-stripped text, language index in ``languages`` order."""
    idx = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(float(i)))])
    return docs.select(F.col("doc_id").alias("id"), strip_emoji(F.col("text")).alias("text"),
                       F.element_at(idx, F.col("lang")).alias("label"))


def predict_language(model: PipelineModel, df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Adds ``language`` predicted from the text."""
    names = F.array(*[F.lit(x) for x in languages])
    out = model.transform(df)
    return out.select(*df.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("language"))


# ------------------------------------------------------------------ S10 / S12 ---------

def cached_column(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read a stored derived column when it exists, else compute it, store it, read it.

    ``compute`` returns a keyed DataFrame; storage is Parquet at ``path`` (a shared folder).
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_runs(spark: SparkSession, path: str, runs: Sequence[tuple[dict, dict]]) -> list[str]:
    """Append the params and metrics of runs to the run-log table at ``path``, in one write."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    ids, rows = [], []
    for params, metrics in runs:
        ids.append(uuid.uuid4().hex)
        rows += [(ids[-1], k, str(v), "param", now) for k, v in params.items()]
        rows += [(ids[-1], k, str(v), "metric", now) for k, v in metrics.items()]
    spark.createDataFrame(rows, RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return ids


def log_run(spark: SparkSession, path: str, params: dict, metrics: dict) -> str:
    """Append one run."""
    return log_runs(spark, path, [(params, metrics)])[0]
