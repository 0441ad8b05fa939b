"""Evaluation tables over a prediction frame.

A prediction frame has at least ``Sentiment`` (truth) and ``Predicted``; the logits frame has
``logits`` (array<double>) and ``label`` (int).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import correct_flag
from ..functions.text import words
from ..schemas import OUTLIER_K, QUANTILES, SENTIMENTS
from ..session import ensure_checkpoint_dir, scratch_path
from . import profile as P
from . import stats as S
from .joins import with_scalars

LABELS = list(SENTIMENTS)


def confusion_matrix(pf: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Share of ALL rows in each (Predicted, Sentiment) cell; missing cells are 0.0.

    One row per predicted label, one column per true label (fixed pivot list).
    """
    counts = pf.groupBy("Predicted").pivot("Sentiment", list(labels)).count()
    total = pf.agg(F.count(F.lit(1)).alias("__total"))
    return with_scalars(counts, total).select(
        "Predicted", *[(F.coalesce(F.col(c), F.lit(0)) / F.col("__total")).alias(c) for c in labels]
    ).orderBy(F.desc("Predicted"))


def class_accuracy(pf: DataFrame) -> DataFrame:
    """Accuracy per true class (recall)."""
    return pf.groupBy("Sentiment").agg(
        F.avg(correct_flag(F.col("Sentiment"), F.col("Predicted")).cast("double")).alias("accuracy"))


def accuracy(pf: DataFrame) -> DataFrame:
    """Overall accuracy."""
    return pf.agg(F.avg(correct_flag(F.col("Sentiment"), F.col("Predicted")).cast("double"))
                  .alias("accuracy"))


def row_cross_entropy(logits_col: str = "logits", label_col: str = "label"):
    """Per-row ``logsumexp(logits) - logits[label]`` with the max shift."""
    x = F.col(logits_col)
    m = F.array_max(x)
    sum_exp = F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v)
    return F.log(sum_exp) + m - F.element_at(x, F.col(label_col) + 1)


def cross_entropy(lg: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """Mean cross-entropy of softmax(logits) against the integer labels."""
    return lg.agg(F.avg(row_cross_entropy(logits_col, label_col)).alias("cross_entropy"))


def length_accuracy(pf: DataFrame, text_col: str = "CommentText", k: float = OUTLIER_K,
                    probs: Sequence[float] = QUANTILES, length_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A27 + F15 + P9: token length of correct vs wrong predictions after the outlier cut.

    Lengths are made once and kept in the shared folder; a frame that has them already names their ``length_col``.
    Returns (summary: Correct, n, mean_length) and (quantiles: Correct, quantile, value).
    """
    length = F.size(words(F.col(text_col))) if length_col is None else F.col(length_col)
    path = scratch_path(pf.sparkSession, "lengths")
    pf.select(correct_flag(F.col("Sentiment"), F.col("Predicted")).alias("Correct"), length.alias("length")).write.parquet(path)
    src = pf.sparkSession.read.parquet(path)
    kept = P.outlier_cut(src, F.col("length"), k, "length")
    summary = kept.groupBy("Correct").agg(F.count(F.lit(1)).alias("n"),
                                          F.avg("length").alias("mean_length"))
    q = S.quantiles(kept, "length", probs, ["Correct"])
    return summary, q


Report = Callable[[DataFrame], DataFrame]


def default_reports() -> dict[str, Report]:
    return {"confusion": confusion_matrix, "class_accuracy": class_accuracy, "accuracy": accuracy}


def evaluate(pf: DataFrame, reports: Mapping[str, Report] | None = None) -> dict[str, DataFrame]:
    """Run a set of report functions over one prediction frame (all of them by default).

    The frame is checkpointed once in the shared folder (the default reports need two columns of
    it), so predictions are not computed again for each report and no executor memory stays taken.
    """
    reports = dict(reports) if reports is not None else default_reports()
    ensure_checkpoint_dir(pf.sparkSession)
    src = pf.checkpoint() if any(r not in default_reports().values() for r in reports.values()) else \
        pf.select("Sentiment", "Predicted").checkpoint()
    return {name: fn(src) for name, fn in reports.items()}


def reports_long(results: Mapping[str, DataFrame]) -> DataFrame:
    """U5 output in one long table: (report, row_key, column, value)."""
    parts = []
    for name, df in results.items():
        key_cols = [c for c, t in df.dtypes if t == "string"]
        val_cols = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
        key = F.lit("") if not key_cols else F.concat_ws("|", *[F.col(c) for c in key_cols])
        stacked = df.select(key.alias("row_key"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in val_cols
        ])).alias("kv"))
        parts.append(stacked.select(F.lit(name).alias("report"), "row_key", "kv.column", "kv.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
