"""Join-shaped operators.

Broadcast hints are only placed on one-row aggregates and bounded tables made here; owners of
fixed tables (the category map) hint them where they make them. Data-dependent sides are left to AQE, which converts a join to a broadcast only after measuring the real size at run
time and otherwise keeps the shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_default(df: DataFrame, key: Column, dictionary: DataFrame, dict_key: str,
                   dict_value: str, default: str | None) -> DataFrame:
    """Dictionary lookup; unmapped or NULL keys get ``default`` (or NULL).

    The dictionary carries no hint here: callers that own a fixed table hint it themselves.
    """
    d = dictionary.select(F.col(dict_key).alias("__lk"), F.col(dict_value).alias("__lv"))
    out = df.join(d, key == F.col("__lk"), "left")
    value = F.col("__lv") if default is None else F.coalesce(F.col("__lv"), F.lit(default))
    return out.withColumn(dict_value, value).drop("__lk", "__lv")


def lookup_strict(df: DataFrame, key: Column, dictionary: DataFrame, dict_key: str,
                  dict_value: str, out_col: str | None = None) -> DataFrame:
    """Dictionary lookup where an unmapped value is an error (raised in the task).

    The check sits in a filter, which stays in the plan whatever columns are used later.
    """
    out_col = out_col or dict_value
    d = dictionary.select(F.col(dict_key).alias("__lk"), F.col(dict_value).alias("__lv"))
    out = df.withColumn("__key", key).join(d, F.col("__key") == F.col("__lk"), "left")
    out = _require(out, F.col("__lk").isNotNull(),
                   F.concat(F.lit("unmapped value: "), F.coalesce(F.col("__key").cast("string"), F.lit("NULL"))))
    return out.withColumn(out_col, F.col("__lv")).drop("__key", "__lk", "__lv")


def _require(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """Stop the job at the first row that does not meet ``condition``."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def unmapped_values(df: DataFrame, key: Column, dictionary: DataFrame, dict_key: str) -> DataFrame:
    """J3 pre-check: the distinct values a strict lookup would reject."""
    d = dictionary.select(F.col(dict_key).alias("__lk"))
    return (df.select(key.alias("value")).distinct()
            .join(d, F.col("value") == F.col("__lk"), "left_anti"))


def exclude_words(words: Column, stopwords: Sequence[str]) -> Column:
    """A word array without the stopwords: a fixed list tested inside the array, no join."""
    return F.filter(words, lambda w: ~w.isin(list(stopwords)))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (totals, means, maxima) to every row.

    ``limit(2)`` bounds what is sent whatever is passed; a second row stops the job, and without
    any row nothing is returned.
    """
    first = one_row.limit(2).agg(F.collect_list(F.struct("*")).alias("__rows"))
    first = _require(first, F.size("__rows") < 2, F.lit("with_scalars needs one row")).where(F.size("__rows") == 1)
    return df.crossJoin(F.broadcast(first)).select(*[F.col(f"`{c}`") for c in df.columns],
                                                   *[F.col("__rows")[0][c].alias(c) for c in one_row.columns])


def attach_by_key(left: DataFrame, sidecar: DataFrame, key: str, how: str = "left") -> DataFrame:
    """J1 (keyed): attach sidecar columns by their key."""
    return left.join(sidecar, key, how)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Consecutive 0-based row positions in the current order, computed JVM-side.

    The input is checkpointed first (to the shared checkpoint folder), so its partitions and
    their row order are fixed for both passes. Each row's position inside its partition comes
    from ``monotonically_increasing_id`` (partition index in the upper bits); a table of one
    count per partition - bounded by the partition count - gives each partition its offset.
    """
    fixed = df.checkpoint(eager=True)
    tagged = (fixed.withColumn("__pid", F.spark_partition_id())
              .withColumn("__local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid", "inner")
            .withColumn(name, F.col("__off") + F.col("__local"))
            .drop("__pid", "__local", "__off"))


def attach_by_position(left: DataFrame, sidecar: DataFrame) -> DataFrame:
    """J1 (positional): row i of ``sidecar`` goes with row i of ``left``; unequal lengths are an error."""
    a = with_row_index(left, "__pos").withColumn("__l", F.lit(True))
    b = with_row_index(sidecar, "__pos").withColumn("__r", F.lit(True))
    both = a.join(b, "__pos", "full_outer")
    return _require(both, F.col("__l") & F.col("__r"), F.lit("the two sides have different numbers of rows")) \
        .drop("__pos", "__l", "__r")


def attach_predictions(rows: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Attach predictions to their rows by id; a row or a prediction left over is an error."""
    both = rows.withColumn("__l", F.lit(True)).join(preds.withColumn("__r", F.lit(True)), key, "full_outer")
    return _require(both, F.col("__l") & F.col("__r"), F.concat(
        F.lit("rows and predictions do not match at "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))) \
        .drop("__l", "__r")


def with_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id",
                parent_cols: Sequence[str] = ()) -> DataFrame:
    """Child rows with their parent's columns (inner foreign-key join)."""
    p = parent.select(F.col(pk).alias("__pk"), *parent_cols)
    return child.join(p, F.col(fk) == F.col("__pk"), "inner").drop("__pk")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose foreign key has no parent."""
    p = parent.select(F.col(pk).alias("__pk"))
    return child.join(p, F.col(fk) == F.col("__pk"), "left_anti")


def zip_on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put two tables that share a key side by side."""
    return left.join(right, key, "inner")
