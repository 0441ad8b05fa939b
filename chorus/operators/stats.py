"""Ranks, quantiles and tests without a one-partition window.

A global ``Window.orderBy`` would pull every row into one task. Instead:

1. collapse the data to value counts per (group, value) - a partial aggregation, so a value
   (or group) holding a third of all rows becomes one row per map task before the shuffle - and
   checkpoint them: the source is read once, whatever is asked of the counts;
2. deal the counts into buckets by ranges of (group, value); as many buckets as the number of
   distinct values asks for;
3. running totals inside each (group, bucket) window, plus the bucket offsets: one row per
   group and bucket, summed by a window per group.

Every distinct value then knows ``cum_before`` (rows with a smaller value in its group) and
``cnt``; the average-tie rank and any quantile follow from those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ALPHA, QUANTILES
from ..session import ensure_checkpoint_dir
from .joins import with_scalars

#: Distinct (group, value) rows of one bucket, about.
BUCKET_ROWS = 50_000


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., value, cnt) of the non-null values, checkpointed in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.where(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("cnt")).checkpoint())


def _ranked(counts: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with bucket and running totals, bucket offsets with group sizes) of value counts."""
    g = list(group_cols)
    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    if buckets == 1:
        vb = counts.withColumn("__bucket", F.lit(0))
    else:
        vb = (counts.repartitionByRange(buckets, *g, value_col)
              .withColumn("__bucket", F.spark_partition_id()).checkpoint())
    w_in = (Window.partitionBy(*g, "__bucket").orderBy(value_col)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    vb = vb.withColumn("__cum_in", F.sum("cnt").over(w_in))
    totals = vb.groupBy(*g, "__bucket").agg(F.sum("cnt").alias("__bt"))
    w_b = Window.partitionBy(*g).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (totals.withColumn("__off", F.sum("__bt").over(w_b) - F.col("__bt"))
               .withColumn("n_group", F.sum("__bt").over(Window.partitionBy(*g))))
    return vb, offsets


def value_ranks(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                counts: DataFrame | None = None) -> DataFrame:
    """Distinct (group, value) rows with ``cnt``, ``cum_before`` and ``n_group`` (group size).

    NULL values are not ranked (callers decide whether they are an error).
    """
    g = list(group_cols)
    vb, offsets = _ranked(counts if counts is not None else value_counts(df, value_col, g), value_col, g)
    out = vb.join(offsets, [*g, "__bucket"], "inner")
    return out.select(*g, value_col, "cnt",
                      (F.col("__off") + F.col("__cum_in") - F.col("cnt")).alias("cum_before"), "n_group")


def average_ranks(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                  counts: DataFrame | None = None) -> DataFrame:
    """Average-tie rank (1-based) of each distinct value: ``cum_before + (cnt + 1) / 2``."""
    r = value_ranks(df, value_col, group_cols, counts)
    return r.select(*group_cols, value_col, "cnt",
                    (F.col("cum_before") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def quantiles(df: DataFrame, value_col: str, probs: Sequence[float] = QUANTILES,
              group_cols: Sequence[str] = (), interpolation: str = "nearest",
              counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles per group, long format (group..., quantile, value double).

    ``nearest``: the value at 0-based sorted index ``floor((n - 1) q + 0.5)``.
    ``linear``: interpolate between the values at ``floor`` and ``ceil`` of ``(n - 1) q``.
    ``counts``: the ``value_counts`` of the column, where a caller has them already.

    Each wanted index is sent to the one bucket that holds it (by the offsets table), and only
    that bucket's rows of its group are compared with it.
    """
    if interpolation not in ("nearest", "linear"):
        raise ValueError("interpolation must be 'nearest' or 'linear'")
    g = list(group_cols)
    vb, offsets = _ranked(counts if counts is not None else value_counts(df, value_col, g), value_col, g)
    pos = (F.col("n_group") - 1) * F.col("quantile")
    at = [F.floor(pos + 0.5)] if interpolation == "nearest" else [F.floor(pos), F.ceil(pos)]
    wanted = offsets.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    wanted = wanted.withColumn("frac", (pos - F.floor(pos)) if len(at) > 1 else F.lit(0.0))
    wanted = wanted.select(*g, "__bucket", "__off", "__bt", "quantile", "frac",
                           F.posexplode(F.array(*at)).alias("side", "i"))
    wanted = wanted.where((F.col("__off") <= F.col("i")) & (F.col("i") < F.col("__off") + F.col("__bt"))) \
        .select(*g, "__bucket", "quantile", "frac", "side", (F.col("i") - F.col("__off")).alias("i"))
    found = wanted.join(vb, [*g, "__bucket"], "inner") \
        .where((F.col("i") < F.col("__cum_in")) & (F.col("i") >= F.col("__cum_in") - F.col("cnt")))
    v = F.col(value_col).cast("double")
    low, high = F.max(F.when(F.col("side") == 0, v)), F.max(F.when(F.col("side") == len(at) - 1, v))
    return found.groupBy(*g, "quantile").agg((low + (high - low) * F.first("frac")).alias("value"))


def median_linear(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                  counts: DataFrame | None = None) -> DataFrame:
    """Interpolated median per group (the ordinary median)."""
    q = quantiles(df, value_col, [0.5], group_cols, "linear", counts)
    return q.select(*group_cols, F.col("value").alias("median"))


# ------------------------------------------------------------------ chi-square tail ----

def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution with ``df`` degrees of freedom.

    Even ``df`` has a closed form: ``exp(-x/2) * sum_{i < df/2} (x/2)^i / i!`` (for df = 2 it
    is ``exp(-x/2)``). Odd ``df`` adds the normal tail, computed with ``erfc`` in a one-row
    pandas UDF (it runs on the single statistic row only).
    """
    if df < 1:
        raise ValueError("df must be >= 1")
    h = x / 2.0
    if df % 2 == 0:
        terms = [F.lit(1.0)]
        for i in range(1, df // 2):
            terms.append(F.pow(h, F.lit(float(i))) / F.lit(float(math.factorial(i))))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.exp(-h) * total
    return _chi2_sf_odd(x, F.lit(df))


def _chi2_sf_odd(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def sf(xs: pd.Series, ds: pd.Series) -> pd.Series:
        out = []
        for xv, dv in zip(xs, ds):
            if xv is None or pd.isna(xv):
                out.append(None)
                continue
            xv = max(float(xv), 0.0)
            s = math.sqrt(xv)
            q = math.erfc(s / math.sqrt(2.0))
            term = math.sqrt(2.0 / math.pi) * math.exp(-xv / 2.0) * s if xv > 0 else 0.0
            acc = 0.0
            for r in range(1, (int(dv) - 1) // 2 + 1):
                acc += term
                term *= xv / (2 * r + 1)
            out.append(q + acc)
        return pd.Series(out, dtype="float64")

    return sf(x.cast("double"), df)


def chisquare_uniform(df: DataFrame, class_col: str, classes: Sequence[str],
                      alpha: float = ALPHA, value_col: str | None = None) -> DataFrame:
    """Goodness of fit of the class totals against equal expected totals.

    Observed is the sum of ``value_col`` per class, or the number of rows without one. The
    classes are given (a missing class counts 0), so ``df = k - 1`` is known when the plan is
    built. Output: statistic, p_value, reject (p < alpha).
    """
    spark = df.sparkSession
    k = len(classes)
    total_of = F.count(F.lit(1)) if value_col is None else F.sum(value_col)
    observed = df.where(F.col(class_col).isin(list(classes))).groupBy(class_col).agg(total_of.alias("observed"))
    from ..sources.literal import literal_table
    all_cls = F.broadcast(literal_table(spark, [(c,) for c in classes], [(class_col, "string")]))
    obs = all_cls.join(observed, class_col, "left").select(
        class_col, F.coalesce("observed", F.lit(0)).cast("double").alias("o"))
    total = obs.agg(F.sum("o").alias("__total"))
    e = F.col("__total") / F.lit(float(k))
    stat = with_scalars(obs, total).agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / F.when(e != 0, e)).alias("statistic"))
    p = chi2_sf(F.col("statistic"), k - 1)
    return stat.select("statistic", p.alias("p_value")).withColumn(
        "reject", F.col("p_value") < F.lit(alpha))


def kruskal_wallis(df: DataFrame, value_col: str, group_col: str, k: int | None = None,
                   alpha: float = ALPHA) -> DataFrame:
    """Kruskal-Wallis H with tie correction over the groups of ``group_col``.

    Rows with a NULL group are not in any sample; a NULL value raises (like
    ``nan_policy="raise"``). The degrees of freedom come from the groups found; a given ``k``
    that differs from them is an error. H is summed from squared distances of the groups' mean
    ranks to the middle rank, so nothing cancels at large n.
    Output: n, k, statistic, p_value, reject.
    """
    src = df.where(F.col(group_col).isNotNull()).select(
        F.col(group_col).alias("__g"),
        F.when(F.col(value_col).isNull(), F.raise_error(F.lit(f"NULL in {value_col}")))
         .otherwise(F.col(value_col)).alias("__v"))
    ensure_checkpoint_dir(df.sparkSession)
    per = src.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c")).checkpoint()
    found = per.select("__g").distinct().count()
    if k is not None and k != found:
        raise ValueError(f"{found} groups found, {k} expected")
    pooled = per.groupBy("__v").agg(F.sum("__c").alias("cnt"))
    ranks = average_ranks(pooled, "__v", (), pooled)
    joined = per.join(ranks.select("__v", "avg_rank"), "__v", "inner")
    rs = joined.groupBy("__g").agg(
        F.sum(F.col("__c") * F.col("avg_rank")).alias("__R"), F.sum("__c").cast("double").alias("__ng"))
    ties = pooled.agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("__tie"),
                      F.sum("cnt").cast("double").alias("__N"))
    away = F.col("__R") / F.col("__ng") - (F.col("__N") + 1) / 2
    agg = with_scalars(rs, ties).groupBy().agg(
        F.sum(F.col("__ng") * away * away).alias("__s"),
        F.first("__N").alias("__N"), F.first("__tie").alias("__tie"),
        F.count(F.lit(1)).alias("k"))
    n = F.col("__N")
    corr = F.lit(1.0) - F.col("__tie") / (n * n * n - n)
    h = F.lit(12.0) / (n * (n + 1)) * F.col("__s") / F.when(corr != 0, corr)
    return agg.select(n.cast("bigint").alias("n"), "k", h.alias("statistic")) \
        .withColumn("p_value", chi2_sf(F.col("statistic"), max(1, found - 1))) \
        .withColumn("reject", F.col("p_value") < F.lit(alpha))
