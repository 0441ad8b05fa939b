"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import chorus
from chorus.session import scratch_path

_shipped: set[str] = set()
#: Rows hold whole documents: what is read, sent to Python and written at a time is small, unless the job sets its own.
_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: The same for the files of ``written``: bytes of a page and of a row group.
_PAGES = {"parquet.page.size": 256 << 10, "parquet.block.size": 32 << 20}


def ship(spark: SparkSession) -> None:
    """Make a session ready for this package's Python work.

    The package is sent to the workers, once per application, as ``--py-files`` would. What is read
    and sent at a time is bounded (see ``bounded``).
    """
    sc = spark.sparkContext
    bounded(spark)
    if sc.applicationId not in _shipped:
        root = Path(chorus.__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/chorus_package", "zip", root.parent, root.name)
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)


def bounded(spark: SparkSession) -> None:
    """Small batches of rows: a batch of whole documents is an array of many MB each time, and an executor's heap grows by such arrays."""
    set_by_job = spark.sparkContext.getConf()
    for key, value in _BOUNDS.items():
        if not set_by_job.contains(key):
            spark.conf.set(key, value)


def map_arrow(df: DataFrame, run, schema: str, after=None) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers.

    ``after`` is called in the worker at the end of each task: workers are used again, by other steps too, and keep what
    they hold (see ``give_back``).
    """
    ship(df.sparkSession)
    return df.mapInArrow(run if after is None else _ended(run, after), schema)


def _ended(run, after):
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            after()

    return whole


def give_back() -> None:
    """Return memory that this worker has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; its own policy holds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily by Spark (any file system Spark knows)."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir``, with these options of the writer, and read it back.

    Cuts the lineage (a lost executor re-reads shared files) and makes sure that Python work
    feeding several branches runs once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**_PAGES | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_plain(ids: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``ids`` (a written table of one long column) with a broadcast hint if it has few rows.

    Two million longs are 16 MB; a larger table is joined as Spark plans it.
    """
    return F.broadcast(ids) if ids.count() <= rows else ids
