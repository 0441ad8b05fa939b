"""Derived columns that are computed once a row and stored, keyed; new rows add to them."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.log import CommitLog

#: Keys with the hashes of their inputs sent to all tasks at once, at most.
MOST_SENT = 1_000_000


def model_fingerprint(model: PipelineModel) -> str:
    """A hash of what a fitted pipeline answers by: its stages' parameters, vocabularies and coefficients."""
    h = hashlib.md5()
    for stage in model.stages:
        params = sorted((p.name, str(v)) for p, v in stage.extractParamMap().items() if not p.name.endswith("Col"))
        h.update(f"{type(stage).__name__} {params}".encode())
        if hasattr(stage, "vocabulary"):
            h.update("\0".join(stage.vocabulary).encode())
        for name in ("coefficientMatrix", "interceptVector", "theta", "pi"):
            if hasattr(stage, name):
                h.update(getattr(stage, name).toArray().tobytes())
    return h.hexdigest()


def fingerprint(*parts) -> str:
    """A hash of what a column is computed by: functions (their source), fitted pipelines, or text."""
    h = hashlib.md5()
    for p in parts:
        text = model_fingerprint(p) if isinstance(p, PipelineModel) else inspect.getsource(p) if callable(p) else str(p)
        h.update(f"{len(text)}:{text}".encode())
    return h.hexdigest()


def _once(df: DataFrame, name: str) -> DataFrame:
    """Computed once, kept in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class DerivedColumn:
    """Stored values of ``compute``, one for each key and input, at ``path``; another ``version`` (``fingerprint``) is another column.

    ``compute`` takes rows (key, inputs...) and returns (key, values...), one row a key.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, key: str, compute: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.key, self.compute = spark, f"{path.rstrip('/')}/{version}", key, compute
        self.log = CommitLog(spark, self.path)

    def stored(self) -> DataFrame | None:
        """(key, input, values...) of all commits, or None before the first."""
        live = self.log.state()[1]
        return self.spark.read.parquet(*[f"{self.path}/{e['rows']}" for e in live]) if live else None

    def _asked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__input", F.unhex(F.md5(F.to_json(F.struct(*sorted(rows.columns))))))

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows without a stored value: new keys, and keys whose inputs have changed since."""
        asked = self._asked(rows)
        have = self.stored()
        return asked if have is None else asked.join(have.select(self.key, "__input"), [self.key, "__input"], "left_anti")

    def of(self, rows: DataFrame) -> DataFrame:
        """(key, values...) of ``rows``, whose keys are unique; only what is missing is computed, and stored.

        Keys and hashes of the inputs are made once and kept in the shared folder; these alone meet the stored ones. The
        inputs of rows to compute move only where their keys are too many to broadcast (``MOST_SENT``).
        """
        asked, have = _once(self._asked(rows).select(self.key, "__input"), "derived-asked"), self.stored()
        todo = asked if have is None else _once(asked.join(have.select(self.key, "__input"), [self.key, "__input"], "left_anti"), "derived-todo")
        n = todo.count()
        if n:
            name = uuid.uuid4().hex
            new = rows
            if have is not None:
                keys = todo.select(F.col(self.key).alias("__key"), F.col("__input").alias("__hash")).distinct()
                same = F.col(self.key).eqNullSafe(F.col("__key")) & (F.col("__input") == F.col("__hash"))
                new = self._asked(rows).join(F.broadcast(keys) if n <= MOST_SENT else keys, same, "left_semi").drop("__input")
            todo.join(self.compute(new), self.key).write.parquet(f"{self.path}/{name}")
            self.log.append({"rows": name})
            self.log.fold(self._fold)
        have = self.stored()
        return rows.select(self.key).limit(0) if have is None else \
            asked.join(have.dropDuplicates([self.key, "__input"]), [self.key, "__input"]).drop("__input")

    def _fold(self, entries: list[dict], first: bool) -> dict:
        name = uuid.uuid4().hex
        self.spark.read.parquet(*[f"{self.path}/{e['rows']}" for e in entries]).write.parquet(f"{self.path}/{name}")
        return {"rows": name}
