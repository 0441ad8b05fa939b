"""CSV of other programs, where a quoted text may run over lines, read by many tasks a file.

A line break ends a record only outside quotes, which a task that starts in the middle of a file cannot know.
The number of quotes tells: escaped quotes are doubled, so a position is inside a text exactly if the count of quotes before it
in the file is odd.

1. Spark counts the quotes of every split of every file; a running sum over a file's splits gives the state in which each
   one starts. One row a split is written.
2. Tasks read their splits in order, from that state, and join lines to records (Arrow compute over batches, nothing per row).
   No text is shuffled.
3. A record that runs over the end of a split comes in fragments. Only splits that start or end inside quotes are read
   again for them; a record's fragments are brought together by file and the split it began in.
4. Records are parsed by ``from_csv``, so texts come back as they are, with their line breaks.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Splits that start inside quotes and are sent to all tasks (about 100 bytes each); beyond that, lines are dealt by split.
ODD_SPLITS = 200_000
HEAD, INNER, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, starts, ends): whether each split starts and ends inside quotes; a written table."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = _lines(spark, path).groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    upto = Window.partitionBy("file").orderBy("block")
    ends = (F.sum("odd").over(upto) % 2).cast("int")
    states = odd.select("file", "block", "odd", ends.alias("ends"), F.lead("block").over(upto).alias("next"))
    out = scratch_path(spark, "csv-splits")
    states.select("file", "block", ((F.col("ends") + F.col("odd")) % 2).cast("int").alias("starts"), "ends", "next").write.parquet(out)
    return spark.read.parquet(out)


def _segments(batch: pa.RecordBatch):
    """Runs of lines of one split."""
    block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode()
    code = file.indices.to_numpy()
    cut = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    for a, b in zip(cut, np.append(cut[1:], len(block))):
        yield (file.dictionary[int(code[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Records of lines, one from each start to the next."""
    if len(starts) == len(lines):
        return lines
    offsets = pa.array(np.append(starts, len(lines)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


def _parts(batches, names: list[str]):
    """Per split: ("record", records) as they end, then at most (HEAD or INNER, text) and (TAIL, text)."""
    now, held, inside, head = None, [], False, None

    def finish():
        if now is not None and held:
            yield now, (INNER if head is not None else TAIL), "\n".join(held)

    for batch in batches:
        for split, part in _segments(batch):
            if split != now:
                yield from finish()
                now, held, inside = split, [], bool(part.column("starts")[0].as_py())
                head = [] if inside else None  # lines of a record that began before this split
                first = split[1] == 0
            lines = part.column("value")
            odd = pc.count_substring(lines, '"').to_numpy() % 2
            after = (np.cumsum(odd) + inside) % 2  # inside quotes after each line
            closed = np.flatnonzero(after == 0)
            inside = bool(after[-1])
            if not len(closed):
                held += lines.to_pylist()
                continue
            end = int(closed[-1]) + 1
            before = np.concatenate([[0], closed[:-1] + 1])
            records = _joined(lines.slice(0, end), before)
            if held or head is not None:
                opened = "\n".join([*held, records[0].as_py()])
                records, held = records.slice(1), []
                if head is not None:
                    yield split, HEAD, opened
                    head = None
                else:
                    records = pa.concat_arrays([pa.array([opened], lines.type), records])
            if first and len(records):
                found = next(csv.reader([records[0].as_py().removeprefix("﻿").rstrip("\r")]), [])
                if found != names:
                    raise ValueError(f"{split[0]}: the header is {found}, not {names}")
                records, first = records.slice(1), False
            held = lines.slice(end).to_pylist()
            yield split, "record", records
    yield from finish()


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(record): the records of the files at ``path`` without their headers, which must be ``names``."""
    states = split_states(spark, path)
    open_end = states.where("next IS NULL AND ends = 1").select("file").first()
    if open_end is not None:
        raise ValueError(f"{open_end[0]}: a quote is not closed")
    odd = states.where("starts = 1").select("file", "block", "starts")
    lines = _lines(spark, path)
    if odd.count() <= ODD_SPLITS:
        lines = lines.join(F.broadcast(odd), ["file", "block"], "left")
    else:  # a split's lines stay together and in order
        lines = lines.withColumn("at", F.monotonically_increasing_id()).join(odd, ["file", "block"], "left") \
            .repartition("file", "block").sortWithinPartitions("file", "block", "at")
    lines = lines.select("value", "file", "block", F.coalesce("starts", F.lit(0)).alias("starts"))

    def whole(batches):
        for _, kind, records in _parts(batches, names):
            if kind == "record" and len(records):
                yield pa.record_batch([records], names=["record"])

    def fragments(batches):
        for (file, block), kind, text in _parts(batches, names):
            if kind != "record":
                yield pa.record_batch([pa.array([file]), pa.array([block]), pa.array([kind], pa.int32()), pa.array([text])],
                                      names=["file", "block", "kind", "text"])

    crossing = states.where("starts = 1 OR ends = 1").select("file", "block")
    if crossing.isEmpty():
        found = lines.mapInArrow(whole, "record string")
    else:
        few = crossing if crossing.count() > ODD_SPLITS else F.broadcast(crossing)
        parts = lines.join(few, ["file", "block"], "left_semi").mapInArrow(fragments, "file string, block long, kind int, text string")
        before = Window.partitionBy("file").orderBy("block", "kind")
        began = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(before)
        joined = parts.withColumn("began", began).groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p")) \
            .select(F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("record"))
        found = lines.mapInArrow(whole, "record string").unionByName(joined)
    return found.select(F.regexp_replace("record", "\r$", "").alias("record")).where(F.trim("record") != "")


def read_foreign_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Foreign CSV with a header and an explicit schema."""
    records = read_records(spark, path, schema.names)
    return records.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
