"""CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DATASET_SCHEMA, LANGUAGE_SIDECAR_SCHEMA
from .records import read_foreign_csv

#: How NULL is written; no text is written like this, as backslashes are.
NULL = "\\N"
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "nullValue": NULL, "emptyValue": "",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "mode": "FAILFAST"}
#: Other programs' records, one at a time: line breaks inside quotes stay as they are, an empty field is NULL.
FOREIGN_OPTIONS = CSV_OPTIONS | {"header": "false", "multiLine": "true", "nullValue": ""}


def _on_texts(df: DataFrame, change) -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def _one_line(text: Column) -> Column:
    """Line breaks (and the marks used for them, and a backslash) as %XX, an empty text as %00; most texts have none of these."""
    coded = text
    for c, code in (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"), ("\\", "%5C")):
        coded = F.replace(coded, F.lit(c), F.lit(code))
    return F.when(text == "", F.lit("%00")).when(F.translate(text, "%\n\r\\", "") != text, coded).otherwise(text)


def _as_written(text: Column) -> Column:
    plain = text
    for c, code in (("\\", "%5C"), ("\r", "%0D"), ("\n", "%0A"), ("%", "%25")):
        plain = F.replace(plain, F.lit(code), F.lit(c))
    return F.when(F.contains(text, F.lit("%")), F.when(text == "%00", F.lit("")).otherwise(plain)).otherwise(text)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, foreign: bool = False) -> DataFrame:
    """Scan CSV with a header and an explicit schema (never inferred: inference is an extra
    pass over the data).

    Files of ``write_csv`` hold one record per line. ``foreign`` reads other programs' files, where a quoted
    text may run over lines and nothing is coded (``records``); an empty field is NULL. Either way one file
    can be read by many tasks.
    """
    if foreign:
        return read_foreign_csv(spark, path, schema, FOREIGN_OPTIONS)
    return _on_texts(spark.read.schema(schema).options(**CSV_OPTIONS).csv(path), _as_written)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 1_000_000) -> None:
    """CSV with one record per line, NULL and empty text told apart, blanks kept."""
    _on_texts(df, _one_line).write.mode(mode).options(**CSV_OPTIONS).option("maxRecordsPerFile", rows_per_file).csv(path)


def read_comment_dataset(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """The comment dataset CSV; ``foreign`` for a file that another program wrote."""
    return read_csv(spark, path, DATASET_SCHEMA, foreign)


def write_sidecar(df: DataFrame, key: str, col: str, path: str, mode: str = "errorifexists") -> None:
    """S3: store one derived column next to its key (keyed, so it survives any re-ordering)."""
    write_csv(df.select(key, col), path, mode)


def read_language_sidecar(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """The language sidecar (CommentID, Language)."""
    return read_csv(spark, path, LANGUAGE_SIDECAR_SCHEMA, foreign)


def load_splits(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType, foreign: bool = False) -> DataFrame:
    """Named splits from several files, one ``split`` column."""
    parts = [read_csv(spark, p, schema, foreign).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an explicit order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def schema_text(df: DataFrame) -> str:
    """The schema as text (what ``printSchema`` prints)."""
    return df.schema.simpleString()


def aligned_lists(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str], order_col: str,
                  part_rows: int = 1000) -> DataFrame:
    """Per group, one array per column, all in the same row order, in parts of bounded size.

    ``order_col`` is an integer; ``part`` is its value div ``part_rows``, so a part holds that many
    rows at most if the column tells the rows apart, and a group's parts in order are its lists. No
    group is ever gathered whole.
    """
    part = F.floor(F.col(order_col) / F.lit(part_rows)).cast("bigint").alias("part")
    packed = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("__o"), *[F.col(c) for c in cols])))
    out = df.groupBy(*group_cols, part).agg(packed.alias("__rows"))
    return out.select(*group_cols, "part", *[F.transform("__rows", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda s: s[name]
