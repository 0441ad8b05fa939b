"""Dataset profiling.

All of these are grouped aggregates with partial aggregation before the shuffle; table-wide
totals reach each row through a one-row broadcast (J6), never through a window without a
partition (which would run in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import log_base, sentiment_order
from ..functions.text import char_length
from ..schemas import DEFAULT_HISTOGRAM_BINS, OUTLIER_K, SENTIMENTS
from . import stats
from .joins import with_scalars


# ------------------------------------------------------------------ counts ----------

def distinct_counts(df: DataFrame, cols: Sequence[str], count_null: bool = True,
                    approximate: bool = False, rsd: float = 0.05) -> DataFrame:
    """A3: number of distinct values of each column (``n_<col>``).

    With ``count_null`` a NULL counts as one more value (as a dataframe ``n_unique`` does);
    ``approximate`` uses HyperLogLog++ with relative standard deviation ``rsd`` (one small
    sketch per task instead of a shuffle of the distinct values).
    """
    aggs = []
    for c in cols:
        d = F.approx_count_distinct(c, rsd) if approximate else F.countDistinct(c)
        if count_null:
            d = d + F.max(F.col(c).isNull().cast("int"))
        aggs.append(d.cast("bigint").alias(f"n_{c}"))
    return df.agg(*aggs)


def distinct_sketches(df: DataFrame, by: Column, cols: Sequence[str], lg_k: int = 14) -> DataFrame:
    """A3: (part, <col>...): one mergeable distinct-count sketch a part (a day, say) and column, of a few kilobytes each.

    Stored, they answer for any set of parts without the rows; new parts are added to them. The standard error is
    about 1.04 / sqrt(2 ** lg_k), 0.8 percent for 14. NULLs do not count.
    """
    return df.groupBy(by.alias("part")).agg(*[F.hll_sketch_agg(c, lg_k).alias(c) for c in cols])


def merged_distinct(sketches: DataFrame, cols: Sequence[str], by: Column | None = None) -> DataFrame:
    """A3: distinct counts (``n_<col>``) over all parts, or over those that share ``by``."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in cols]
    return sketches.agg(*merged) if by is None else sketches.groupBy(by.alias("period")).agg(*merged)


def mean_rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """A4: rows divided by the number of distinct keys."""
    return df.agg((F.count(F.lit(1)) / F.countDistinct(key)).alias("mean_rows"))


def rows_per_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A5: rows per key (partial aggregation absorbs a key holding a third of all rows)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def occurrence_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, ... (count of counts), ascending."""
    per = rows_per_key(df, key, "occurrences")
    return per.groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_keys")).orderBy("occurrences")


def first_bucket_share(hist: DataFrame) -> DataFrame:
    """Percent of keys in the lowest occurrence bucket of an A6 histogram."""
    return hist.agg((F.min_by("n_keys", "occurrences") / F.sum("n_keys") * 100.0).alias("pct"))


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows (ties: smallest key)."""
    per = rows_per_key(df, key, "n")
    return per.orderBy(F.desc("n"), F.asc(key)).limit(1)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column in one pass."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def value_counts_pct(df: DataFrame, col: str) -> DataFrame:
    """A10: rows per value, descending, with percent of all rows (J6 total)."""
    vc = value_counts(df, col)
    total = vc.agg(F.sum("n").alias("__total"))
    return (with_scalars(vc, total)
            .withColumn("pct", F.col("n") / F.col("__total") * 100.0).drop("__total")
            .orderBy(F.desc("n"), F.asc(col)))


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values (ties by value)."""
    return value_counts(df, col).orderBy(F.desc("n"), F.asc(col)).limit(k)


def first_appearance_order(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """categories in first-appearance order: (value, first, position 0..)."""
    firsts = df.groupBy(col).agg(F.min(order_col).alias("first"))
    # one row per distinct value: a bounded set of categories
    w = Window.orderBy("first", col)
    return firsts.withColumn("position", F.row_number().over(w) - 1)


# ------------------------------------------------------------------ proportions -----

def group_proportions(df: DataFrame, group_col: str, class_col: str) -> DataFrame:
    """Share of each class inside its group (count / group total)."""
    counts = df.groupBy(group_col, class_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group_col)
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(w))


def proportions_wide(df: DataFrame, group_col: str, class_col: str,
                     classes: Sequence[str] = ("Negative", "Neutral", "Positive")) -> DataFrame:
    """Per-group class shares pivoted wide; a missing class is 0.0, all of them in a group
    whose classes are all NULL."""
    wide = df.groupBy(group_col).pivot(class_col, list(classes)).count()
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in classes), F.lit(0))
    return wide.select(group_col, *[
        F.when(total > 0, F.coalesce(F.col(c), F.lit(0)) / total).otherwise(F.lit(0.0)).alias(c) for c in classes])


def entropy(wide: DataFrame, group_col: str, classes: Sequence[str] = ("Negative", "Neutral", "Positive"),
            base: float | None = None) -> DataFrame:
    """Normalised entropy ``-sum p log_k p`` per group (0 log 0 = 0), ascending."""
    base = base or float(len(classes))
    terms = [F.when(F.col(c) > 0, F.col(c) * log_base(F.col(c), base)).otherwise(F.lit(0.0))
             for c in classes]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return wide.select(group_col, (-total + F.lit(0.0)).alias("entropy")).orderBy("entropy", group_col)


def share_of_totals(df: DataFrame, group_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Each group's share of the table total of every value column (NULL if that is 0)."""
    sums = df.groupBy(group_col).agg(*[F.sum(c).alias(c) for c in value_cols])
    totals = sums.agg(*[F.sum(c).alias(f"__t_{c}") for c in value_cols])
    out = with_scalars(sums, totals)
    return out.select(group_col, *[
        F.try_divide(F.col(c), F.col(f"__t_{c}")).alias(f"share_{c}") for c in value_cols])


def pct_where(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Percent of all rows meeting each predicate (one pass); an unknown (NULL) does not meet it."""
    met = lambda p: F.coalesce(p, F.lit(False)).cast("double")
    return df.agg(*[(F.avg(met(p)) * 100.0).alias(name) for name, p in predicates.items()])


# ------------------------------------------------------------------ lengths ---------

def length_stats(df: DataFrame, text_col: str, group_col: str = "sentiment") -> DataFrame:
    """A16 + T4: median (interpolated), mean and sample std of text length per group,
    in the report order Positive, Neutral, Negative (column ``rank``).

    All three come from one table of length counts, so texts are read once.
    """
    lens = df.where(F.col(group_col).isNotNull()).select(
        group_col, char_length(F.col(text_col)).alias("length"))
    counts = stats.value_counts(lens, "length", [group_col])
    med = stats.median_linear(lens, "length", [group_col], counts)
    n, x = F.col("cnt"), F.col("length")
    mean = counts.groupBy(group_col).agg((F.sum(n * x) / F.sum(n)).alias("mean"))
    std = counts.join(mean, group_col).groupBy(group_col).agg(
        F.first("mean").alias("mean"),
        F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.sum(n) - 1, F.lit(0))).alias("std"))
    return (std.join(med, group_col, "inner").withColumn("rank", sentiment_order(F.col(group_col)))
            .orderBy("rank"))


def histogram(df: DataFrame, col: str, bins: int = DEFAULT_HISTOGRAM_BINS,
              lower: float | None = None, upper: float | None = None, weight: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of the kept values.

    Rows outside [lower, upper] are dropped first; ``weight`` names a column of counts where the
    rows are value counts. Output: bin, bin_start, bin_end, n.
    """
    x = F.col(col).cast("double")
    src = df.select(x.alias("__x"), (F.col(weight) if weight else F.lit(1)).alias("__c")).where(F.col("__x").isNotNull())
    if lower is not None:
        src = src.where(F.col("__x") >= F.lit(float(lower)))
    if upper is not None:
        src = src.where(F.col("__x") <= F.lit(float(upper)))
    rng = src.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    binned = with_scalars(src, rng).select(b.alias("bin"), F.col("__lo"), width.alias("__w"), "__c")
    return binned.groupBy("bin").agg(
        F.sum("__c").cast("bigint").alias("n"),
        (F.first("__lo") + F.col("bin") * F.first("__w")).alias("bin_start"),
        (F.first("__lo") + (F.col("bin") + 1) * F.first("__w")).alias("bin_end"))


# ------------------------------------------------------------------ filters ---------

def keep_value(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows whose ``col`` equals ``value`` (e.g. language 'en')."""
    return df.where(F.col(col) == F.lit(value))


def rows_at_max(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """All rows whose value equals the column maximum (ties kept)."""
    src = df.withColumn(name, value)
    mx = src.agg(F.max(name).alias("__max"))
    return with_scalars(src, mx).where(F.col(name) == F.col("__max")).drop("__max")


def outlier_cut(df: DataFrame, value: Column, k: float = OUTLIER_K, name: str = "value") -> DataFrame:
    """Keep rows with ``value < mean + k * sample std`` (strict)."""
    src = df.withColumn(name, value)
    m = src.agg(F.avg(name).alias("__mean"), F.stddev_samp(name).alias("__std"))
    return (with_scalars(src, m)
            .where(F.col(name) < F.col("__mean") + F.lit(k) * F.col("__std"))
            .drop("__mean", "__std"))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P10: rename columns (others kept in place)."""
    return df.withColumnsRenamed(mapping)


def likes_shift(df: DataFrame) -> DataFrame:
    """Likes + 1, Replies, Sentiment (a log-scale friendly projection)."""
    return df.select((F.col("Likes") + 1).alias("Likes"), "Replies", "Sentiment")

