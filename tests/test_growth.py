"""Stores that are changed in part, columns that grow, sketches that merge, buckets that meet, words that are chosen."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chorus.functions.text import strip_emoji
from chorus.operators import batches as B
from chorus.operators import derived as D
from chorus.operators import evaluate as E
from chorus.operators import model as M
from chorus.operators import profile as P
from chorus.plans import catalog_eval as CE
from chorus.session import scratch_path
from chorus.sources import log as L
from chorus.sources import store as ST
from conftest import SF_SMALL


def test_a_delete_rewrites_only_the_files_it_must(spark):
    store = ST.VideoStore(spark, scratch_path(spark, "store"))
    for part in range(4):
        store.append(spark.range(part * 100, part * 100 + 100).select((F.col("id") % 10 + part * 10).alias("videoId"), "id"))
    before = store.files()
    doomed = spark.createDataFrame([(3,), (15,), (99,), (3,)], "id long")
    rows = store.holding(before, doomed)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<videoId:bigint>" in plan  # ids alone are read to find the files
    touched = store.delete(doomed)
    after = store.files()
    untouched = [f for f in before if f not in touched]
    assert 0 < len(touched) < len(before) and set(untouched) <= set(after) and not set(touched) & set(after)
    assert sorted(r["id"] for r in store.read().collect()) == [i for i in range(400) if i // 100 * 10 + i % 10 not in (3, 15)]
    assert store.delete(spark.createDataFrame([(99,)], "id long")) == [] and store.files() == after
    store.append(spark.createDataFrame([(3, 1000)], "videoId long, id long"))  # a deleted video may come back
    assert store.read().where("videoId = 3").count() == 1


def test_a_delete_sees_rows_that_come_meanwhile(spark, monkeypatch):
    store = ST.VideoStore(spark, scratch_path(spark, "store"))
    store.append(spark.createDataFrame([(1, 1), (2, 2)], "videoId long, id long"))
    real, first = L.CommitLog.commit, []

    def late(self, version, made):
        if not first:
            first.append(1)
            store.append(spark.createDataFrame([(1, 3), (4, 4)], "videoId long, id long"))
        return real(self, version, made)

    monkeypatch.setattr(L.CommitLog, "commit", late)
    store.delete(spark.createDataFrame([(1,)], "id long"))
    assert sorted(r["id"] for r in store.read().collect()) == [2, 4]


def test_ten_new_rows_compute_ten(spark, monkeypatch):
    monkeypatch.setattr(L, "FOLD", 2)
    seen = []

    def compute(rows):
        seen.append(sorted(r["id"] for r in rows.select("id").collect()))
        return rows.select("id", F.length("text").alias("n"))

    path = scratch_path(spark, "derived")
    column = D.DerivedColumn(spark, path, D.fingerprint("length"), "id", compute)
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("text"))
    assert column.of(rows).count() == 100 and column.of(rows).count() == 100
    more = rows.unionByName(spark.range(100, 110).select("id", F.lit("new").alias("text")))
    got = {r["id"]: r["n"] for r in column.of(more).collect()}
    assert len(got) == 110 and got[105] == 3 and got[4] == 4
    changed = more.withColumn("text", F.when(F.col("id") == 4, F.lit("longer text")).otherwise(F.col("text")))
    assert {r["id"]: r["n"] for r in column.of(changed).collect()} == got | {4: 11}
    assert seen == [list(range(100)), list(range(100, 110)), [4]]
    other = D.DerivedColumn(spark, path, D.fingerprint("another version"), "id", compute)
    assert other.of(rows.limit(7)).count() == 7 and len(seen[-1]) == 7
    assert column.of(rows.limit(0)).collect() == []


def test_fingerprints_follow_the_model(spark):
    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i % 5}", float(i % 2) * 2) for i in range(40)], "id long, text string, label double")
    a, b, c = M.train_sentiment(rows, 10), M.train_sentiment(rows, 10), M.train_sentiment(rows, 10, reg_param=0.3)
    assert D.fingerprint(a) == D.fingerprint(b) != D.fingerprint(c)


def test_sketches_of_days_merge_to_months(spark):
    df = spark.range(200_000).select((F.col("id") % 60).alias("day"), F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("a"),
                                     F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("b"))
    path = scratch_path(spark, "sketches")
    P.distinct_sketches(df.where("day < 30"), F.col("day"), ["a", "b"]).write.parquet(path)
    P.distinct_sketches(df.where("day >= 30"), F.col("day"), ["a", "b"]).write.mode("append").parquet(path)  # only new days are counted
    kept = spark.read.parquet(path)
    assert kept.count() == 60
    exact = df.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    got = P.merged_distinct(kept, ["a", "b"]).first()
    assert abs(got["n_a"] / exact[0] - 1) < 0.03 and got["n_b"] == exact[1] == 7
    halves = {r["period"]: r["n_a"] for r in P.merged_distinct(kept, ["a"], F.col("part") >= 30).collect()}
    assert set(halves) == {True, False}


def test_bucketed_tables_meet_without_an_exchange(spark):
    df = entry.queries()["s7_bucketed_join"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Bucketed: true" in plan


def test_row_functions_have_their_declared_type(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "i int, s string, x array<double>")
    got = B.map_rows(df, lambda r: [r[1] or "", str(len(r[2] or []))], "array<string>", "told").collect()
    assert [tuple(r) for r in got] == [(1, "a", None, ["a", "0"]), (2, None, [1.5], ["", "1"])]
    assert B.map_rows(df.limit(0), lambda r: 1, "bigint").collect() == []
    with pytest.raises(Exception):
        B.map_rows(df, lambda r: "no number", "bigint").collect()


def test_vocabulary_and_ids(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{chr(97 + min(int(rng.expovariate(0.3)), 25))}" for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "Rare, wa!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    count = Counter(w for t in texts for w in (t or "").lower().replace(",", "").replace("!", "").split())
    order = sorted(count, key=lambda w: (-count[w], w))
    vocab = M.vocabulary(df)
    assert [(r["word"], r["n"], r["token_id"]) for r in vocab.orderBy("token_id").collect()] == [(w, count[w], i) for i, w in enumerate(order, 2)]
    few = M.vocabulary(df, size=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r["id"]: r["token_ids"] for r in M.token_ids(df, few, "id", seq_len=6).collect()}
        assert M.token_ids(df.limit(0), few, "id").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {w: i for i, w in enumerate(order[:5], 2)}
    for i, t in enumerate(texts):
        want = [ids.get(w, 1) for w in (t or "").lower().replace(",", "").replace("!", "").split()][:6]
        assert got[i] == want + [0] * (6 - len(want))
    plan = vocab._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "__cnt" in plan  # the only window runs over the counts of partitions


def test_chosen_words_are_those_of_the_chi_square_statistic(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        label = rng.choice([0.0, 0.0, 0.0, 1.0, 2.0])
        words = {f"n{rng.randrange(30)}" for _ in range(8)} | ({"awful"} if label == 2 and rng.random() < 0.7 else set()) | ({"meh"} if label == 1 else set()) | {"all"}
        rows.append((i, " ".join(sorted(words)).upper() + "!", label))
    df = spark.createDataFrame(rows, "id long, text string, label double")
    sizes = Counter(r[2] for r in rows)
    has = Counter((w, r[2]) for r in rows for w in r[1].lower().rstrip("!").split())

    def chi2(w):
        total = sum(has[w, k] for k in sizes)
        out = 0.0
        for k, n in sizes.items():
            for seen, rowsum in ((has[w, k], total), (n - has[w, k], len(rows) - total)):
                want = rowsum * n / len(rows)
                out += (seen - want) ** 2 / want if want else 0.0
        return out

    names = {w for w, _ in has}
    assert M.chi_square_words(df, 12) == sorted(names, key=lambda w: (-round(chi2(w), 9), w))[:12]
    assert M.chi_square_words(df, 2) == ["meh", "awful"]
    assert M.chi_square_words(df.limit(0)) == []


@pytest.fixture(scope="module")
def folds(spark):
    return tuple(df.cache() for df in CE._folds(spark, "/root/testdata/sf0.1"))


def test_negative_comments_are_found(spark, folds):
    scored = M.score(M.train_sentiment(folds[0]), folds[1])
    assert scored.where("label = 2").agg(F.avg((F.col("Predicted") == "Negative").cast("double"))).first()[0] > 0.7


def test_halving_finds_as_good_a_setting_with_less_work(spark, folds, monkeypatch):
    fitted, real = [], M.classifier

    def counted(**p):
        fitted.append(p)
        return real(**p)

    monkeypatch.setattr(M, "classifier", counted)
    train = folds[0]
    best, results = M.search_sentiment(train, trials=9)
    assert len(results) == 9 and sorted({p["fitted_share"] for p, _ in results}) == [1 / 9, 1 / 3, 1.0]
    shares = [p["fitted_share"] for p, _ in results]
    work = 9 / 9 + sum(s > 1 / 9 for s in shares) / 3 + sum(s == 1 for s in shares)
    assert work <= 9 / 2 and len(fitted) == 9 + 3 + 1 + 1
    # every setting on the whole fold
    rows = Pipeline(stages=M.feature_stages(M.chi_square_words(train))).fit(train).transform(train)
    fit = M.hash_bucket(F.concat(F.lit("fold "), "text")) < 80
    rows = rows.select("features", "label", fit.alias("f")).cache()
    ev = MulticlassClassificationEvaluator(metricName="logLoss")
    losses = [ev.evaluate(real(reg_param=p["reg_param"], elastic_net=p["elastic_net"]).fit(rows.where("f")).transform(rows.where("not f"))) for p, _ in results]
    won = min(loss for p, loss in results if p["fitted_share"] == 1)
    assert won <= min(losses) * 1.01 and math.isfinite(won)


def test_the_whole_search_fits_every_setting_on_the_whole_fold(spark, monkeypatch):
    sizes, real = [], M.classifier

    def counted(**p):
        made = real(**p)
        fit = made.fit
        made.fit = lambda rows: sizes.append(rows.count()) or fit(rows)
        return made

    monkeypatch.setattr(M, "classifier", counted)
    train = spark.createDataFrame([(i, f"{('good', 'fair', 'bad')[i % 3]} text {i}", float(i % 3)) for i in range(90)], "id long, text string, label double")
    fold = train.where(M.hash_bucket(F.concat(F.lit("fold "), "text")) < 80).count()
    best, results = M.search_sentiment(train, trials=4, halving=False)
    assert sorted(sizes) == [fold] * 4 + [90]
    assert all(set(p) == {"reg_param", "elastic_net"} for p, _ in results)
    assert min(results, key=lambda r: r[1])[0]["reg_param"] == best.stages[-1].getRegParam()


def test_grams_are_those_of_ngram_and_hashing_tf(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "abc"), (5, "ÄÖÜ Straße İstanbul 日本語テキスト 😀😀a😀"), (6, "😀é日"), (7, "\x01 \n\tABC abc"), (8, "word " * 500)]
    docs = spark.createDataFrame(rows, "id long, text string")
    chars = SQLTransformer(statement="SELECT *, split(lower(coalesce(text, '')), '') AS c FROM __THIS__")
    for size in (64, 4096):
        by_stage = Pipeline(stages=[chars, NGram(n=3, inputCol="c", outputCol="g"), HashingTF(inputCol="g", outputCol="f", numFeatures=size)]).fit(docs).transform(docs)
        found = M.CharGrams(inputCol="text", outputCol="f", numFeatures=size).transform(docs)
        assert {r["id"]: r["f"] for r in found.collect()} == {r["id"]: r["f"] for r in by_stage.collect()}
    stages = [type(s).__name__ for s in M.language_pipeline().getStages()]
    assert stages == ["CharGrams", "NaiveBayes"]  # no object for each character and 3-gram
    path = scratch_path(spark, "language-model")
    rows = docs.withColumn("label", (F.col("id") % 2).cast("double"))
    model = M.language_pipeline(64).fit(rows)
    M.save_model(model, path)
    answers = [[r["language"] for r in M.predict_language(m, rows, ["a", "b"]).orderBy("id").collect()] for m in (model, M.load_model(path))]
    assert answers[0] == answers[1]


def test_emoji_are_found_above_the_look_ahead(spark):
    docs = spark.createDataFrame([(1, "a©b®c"), (2, "é😀é☀️x"), (3, "plain"), (4, None), (5, ""), (6, "¨ÿ日本")], "id long, text string")
    got = {r["id"]: r["t"] for r in docs.select("id", strip_emoji(F.col("text")).alias("t")).collect()}
    assert got == {1: "abc", 2: "ééx", 3: "plain", 4: None, 5: "", 6: "¨ÿ日本"}
    assert "CASE WHEN" in docs.select(strip_emoji(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_inputs_do_not_move_to_find_what_is_missing(spark):
    plans = []

    def compute(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.select("id", F.length("text").alias("n"))

    column = D.DerivedColumn(spark, scratch_path(spark, "derived"), D.fingerprint("length"), "id", compute)
    rows = spark.range(0, 200, 1, 4).select("id", F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text"))
    column.of(rows.where("id % 7 <> 0"))
    assert {r["id"]: r["n"] for r in column.of(rows).collect()} == {i: i % 9 for i in range(200)}
    assert len(plans) == 2 and "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1] and "hashpartitioning(id" not in plans[1]
    nulls = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y"), (2, None)], "id long, text string")
    assert sorted((r["id"], r["n"] or 0) for r in column.of(nulls).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_length_accuracy_shuffles_no_text(spark, monkeypatch):
    plans, real = [], E.length_accuracy

    def seen(pf, *args, **more):
        plans.append(pf._jdf.queryExecution().optimizedPlan().toString())
        return real(pf, *args, **more)

    monkeypatch.setattr(E, "length_accuracy", seen)
    found = {r["Correct"]: (r["n"], r["mean_length"]) for r in CE.a27_length_accuracy(spark, SF_SMALL).collect()}
    joined = plans[0][:plans[0].index("Join")] + plans[0][plans[0].index("Join"):].split("\n")[1]
    assert "CommentText" not in plans[0] and "length" in joined
    summary, _ = real(CE.A.predictions(spark, SF_SMALL, with_text=True))
    assert found == {r["Correct"]: (r["n"], r["mean_length"]) for r in summary.collect()}


def test_style_is_counted_by_runs(spark):
    docs = spark.createDataFrame([(1, "Abc DEF, 12!!"), (2, "ÄÖ ß日本 #"), (3, ""), (4, "123 ..."), (5, None)], "id long, text string")
    stages = M.feature_stages(["abc"])[:3]
    got = {r["id"]: (r["style_symbols"], r["style_upper"]) for r in Pipeline(stages=stages).fit(docs).transform(docs).collect()}
    assert got == {1: (3 / 13, 4 / 6), 2: (1 / 8, 2 / 5), 3: (0.0, 0.0), 4: (3 / 7, 0.0), 5: (0.0, 0.0)}
    assert stages[2].getStatement().count("]+'") == 4  # one replacement a run, not one a character


def test_features_are_made_once_for_the_fit(spark, monkeypatch):
    seen, real = [], M.classifier

    def kept(**p):
        made = real(**p)
        fit = made.fit
        made.fit = lambda rows: seen.append(rows.storageLevel.useMemory) or fit(rows)
        return made

    monkeypatch.setattr(M, "classifier", kept)
    rows = spark.createDataFrame([(i, f"{('good', 'fair', 'bad')[i % 3]} text {i}", float(i % 3)) for i in range(60)], "id long, text string, label double")
    model = M.train_sentiment(rows, 10)
    assert seen == [True]
    assert M.score(model, rows).where("Predicted is null").count() == 0
