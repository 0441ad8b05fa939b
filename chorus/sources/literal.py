"""Small fixed tables built JVM-side (no Python worker, no RDD): dictionaries and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A DataFrame of ``rows`` with ``columns`` = [(name, type), ...], as a local relation."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, columns)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
