"""Functions mapped over rows, or over Arrow batches, of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def batched_map(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to every batch of rows; it returns a table of ``schema`` with any number of rows.

    Batches are bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch``; nothing is shuffled,
    and ``fn`` must not depend on how rows fall into batches.
    """
    names = df.sparkSession.createDataFrame([], schema).columns

    def run(batches):
        for batch in batches:
            yield from fn(pa.Table.from_batches([batch])).select(names).to_batches()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[tuple], object], return_type: str, name: str = "map") -> DataFrame:
    """``fn`` of every row, a tuple of its columns in order, as a column of the declared type next to them.

    The general door for what no expression says. Rows cross to Python in Arrow batches; the function still runs once a
    row, so where an expression can say it, that is faster.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {return_type}"])
    type_ = to_arrow_type(DataType.fromDDL(return_type))

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else iter([()] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fn(r) for r in rows], type_)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
