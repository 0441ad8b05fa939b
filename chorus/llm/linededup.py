"""Operator 11: lines that many documents share, found with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Two filters of 64-bit words
say which keys were seen once and which twice:

1. Tasks hash the distinct keys of each document and fill filters of their own, of which only the
   words that are not zero travel, packed by segment (a few bytes a key; no line is shuffled).
2. Segments are merged part by part: a bit set in both the once-filter so far and the part's is seen
   twice. What is kept is the twice-filter, as a table of its words, so it is as large as the repeats are many.
3. Lines are put to the twice-filter where they are read. Only suspected repeats are shuffled, counted by
   document within tasks first, for the exact confirmation by their whole text and the choice of the first document.
4. Texts are read once more and lose the confirmed lines; they are not shuffled.

The filter's words grow with the lines of the corpus (one word for four), so the share of false suspects
does not; a false suspect only costs a shuffled row. Up to ``WORDS`` words the twice-filter is broadcast, beyond
that lines meet it in a join by word, which then does shuffle them. Up to ``KEY_BYTES`` of confirmed keys
are sent to the tasks of step 4, beyond that the confirmed positions are joined to the documents.

Every key has one entry a task at most, so a line that a third of all documents hold is one
row a task wherever rows are shuffled.

Defined results: a null or empty text is one empty line; an empty key is no repeat, however often; every
row is a document, also if ids are null or repeated; with ``keep="first"`` the lines of the
smallest id stay, the first of them if that document repeats them itself (rows that share that id each keep theirs), and keys whose
documents all lack an id stay everywhere; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import map_arrow, ship, written

#: FIXED VALUES: what is stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one segment (8 MB a filter), keys held by a task before it emits its filters, lines for one word.
SEGMENT, HELD, LINES_A_WORD = 1 << 20, 2_000_000, 4
#: Bits of the hash that pick the word; the rest picks three bits of it.
WORD_BITS = 46
#: Most words of the twice-filter (16 bytes each), and bytes of confirmed keys, that are sent to every task.
WORDS, KEY_BYTES = 2_000_000, 32 << 20


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def distinct_keys(text: Column, shortest: int) -> Column:
    return F.array_distinct(F.filter(line_keys(text), lambda k: F.char_length(k) >= max(1, shortest)))


def word_and_bits(h: Column, words: int) -> tuple[Column, Column]:
    """Of a hash: its word in a filter of that many, and the three bits there (fewer if they fall together)."""
    word = F.pmod(h.bitwiseAND((1 << WORD_BITS) - 1), F.lit(words).cast("long"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, WORD_BITS + 6 * i).bitwiseAND(63).cast("int"))
    return word, bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def _words(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    one, six = np.uint64(1), np.uint64(63)
    bits = np.zeros(len(h), np.uint64)
    for i in range(3):
        bits |= one << (h >> np.uint64(WORD_BITS + 6 * i) & six)
    return (h & np.uint64((1 << WORD_BITS) - 1)) % np.uint64(words), bits


def _filters(hashes: list[np.ndarray], words: int, span: int):
    """The packed once- and twice-filters of one task's hashes, a row for each segment they touch."""
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    word, bits = _words(h, words)
    order = np.argsort(word, kind="stable")
    word, bits, again = word[order].astype(np.int64), bits[order], n[order] > 1
    first = np.flatnonzero(np.diff(word, prepend=-1))
    once = np.bitwise_or.reduceat(bits, first)
    twice = np.bitwise_or.reduceat(np.where(again, bits, np.uint64(0)), first)
    word = word[first]
    segment = word // span
    cut = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(segment))
    pack = lambda a: pa.compress(a.tobytes(), "zstd", asbytes=True)
    rows = [(int(segment[a]), b - a, pack(np.diff(word[a:b] % span, prepend=0).astype("<u4")), pack(once[a:b]), pack(twice[a:b]))
            for a, b in zip(cut[:-1], cut[1:])]
    names = ["segment", "size", "words", "once", "twice"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names).to_batches()


def twice_filter(hashes: DataFrame, words: int) -> DataFrame:
    """(word, bits): the words of the twice-filter that are not zero; ``hashes`` has one array a document."""

    span, most = SEGMENT, HELD

    def fill(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= most:
                yield from _filters(held, words, span)
                held, n = [], 0
        if n:
            yield from _filters(held, words, span)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(span, np.uint64), np.zeros(span, np.uint64)
        for batch in batches:
            for row in batch.select(["size", "words", "once", "twice"]).to_pylist():
                get = lambda c, t: np.frombuffer(pa.decompress(row[c], row["size"] * np.dtype(t).itemsize, "zstd", asbytes=True), t)  # noqa: E731,B023
                at, new = np.cumsum(get("words", "<u4")), get("once", "<u8")
                twice[at] |= get("twice", "<u8") | (once[at] & new)
                once[at] |= new
        at = np.flatnonzero(twice)
        yield pa.record_batch([pa.array(at + key[0].as_py() * span), pa.array(twice[at].view(np.int64))], names=["word", "bits"])

    ship(hashes.sparkSession)
    return map_arrow(hashes, fill, "segment long, size long, words binary, once binary, twice binary") \
        .groupBy("segment").applyInArrow(merge, "word long, bits long")


def repeated_keys(docs: DataFrame, least: int, shortest: int = 1) -> DataFrame:
    """(key, n_docs, first) of the keys that at least ``least`` rows (doc_id, text) hold; ``first`` is the smallest id."""
    keys = distinct_keys(F.col("text"), shortest)
    n_lines = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))).first()[0] or 0
    words = max(1024, n_lines // LINES_A_WORD)
    suspected = docs.select("doc_id", F.explode(keys).alias("key"))
    if least > 1:
        twice = written(twice_filter(docs.select(F.transform(keys, lambda k: F.xxhash64(k)).alias("h")), words), "lines-twice")
        if twice.count() <= WORDS:
            twice = F.broadcast(twice)
        word, bits = word_and_bits(F.col("h"), words)
        suspected = suspected.withColumn("h", F.xxhash64("key")).withColumns({"word": word, "asked": bits}) \
            .join(twice, "word").filter(F.col("asked").bitwiseAND(F.col("bits")) == F.col("asked"))
    return suspected.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first")).filter(F.col("n_docs") >= least)


def _without(ids: pa.Array, texts: pa.Array, gone) -> pa.RecordBatch:
    """One batch with lines left out; ``gone`` maps (keys, owner of each, ids) to a mask."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat, n = lines.flatten(), pc.list_value_length(lines).to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    stay = ~gone(flat, owner)
    left = np.bincount(owner, stay, len(n)).astype(np.int64)
    kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), flat.filter(pa.array(stay)))
    return pa.record_batch([ids, pa.array(n.astype(np.int64)), pa.array(n - left), pc.binary_join(kept, "\n")], names=["doc_id", "n_lines", "n_dropped", "text"])


_OUT = "doc_id long, n_lines long, n_dropped long, text string"


def drop_repeated(docs: DataFrame, least: int = 2, shortest: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), one row per input row, without the lines whose key at least ``least`` documents hold.

    ``keep``: "first" leaves each such line in the document with the smallest id, "none" in no document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = repeated_keys(docs, least, shortest)
    if keep == "first":
        common = common.filter("first is not null")
    common = written(common.select("key", F.col("first") if keep == "first" else F.lit(None).cast("long").alias("first")), "lines-common")
    size = common.agg(F.sum(F.octet_length("key") + 8)).first()[0] or 0
    return _by_keys(docs, common) if size <= KEY_BYTES else _by_positions(docs, common)


def _by_keys(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Few common keys (checked): every task has them all."""
    found = common.collect()
    keys, first = pa.array([r[0] for r in found], pa.string()), np.array([-1 if r[1] is None else r[1] for r in found], np.int64)
    chosen = np.array([r[1] is not None for r in found], bool)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)

            def gone(lines, owner):
                at = pc.index_in(pc.ascii_lower(pc.ascii_trim(lines, WHITE)), keys)  # noqa: B023
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                if chosen.any() and hit.any():
                    row = np.flatnonzero(hit)
                    key = pc.fill_null(at, 0).to_numpy()[row]
                    own = pc.fill_null(ids, 0).to_numpy()[owner[row]]  # noqa: B023
                    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[owner[row]]  # noqa: B023
                    mine = chosen[key] & known & (own == first[key])
                    _, one = np.unique(np.stack([owner[row], key])[:, mine], axis=1, return_index=True)
                    hit[row[np.flatnonzero(mine)[one]]] = False
                return hit

            yield _without(ids, batch.column(1), gone)

    return map_arrow(docs, run, _OUT)


def _by_positions(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Many common keys: the positions to drop are found by a join and brought to the documents by another."""
    docs = docs.withColumn("d", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text").cast("binary"), 256))
    at = docs.select("d", "doc_id", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).join(common, "key")
    # a document's lines of one key; equal rows have equal lines
    at = at.groupBy("d", "doc_id", "key", "first").agg(F.collect_set("pos").alias("all"))
    mine = F.coalesce(F.col("first") == F.col("doc_id"), F.lit(False))
    drop = at.select("d", F.when(mine, F.array_remove("all", F.array_min("all"))).otherwise(F.col("all")).alias("all")) \
        .groupBy("d").agg(F.flatten(F.collect_list("all")).alias("drop"))

    def run(batches):
        for batch in batches:
            def gone(lines, owner):
                hit = np.zeros(len(lines), bool)
                start = np.searchsorted(owner, np.arange(batch.num_rows))  # noqa: B023
                drop = batch.column(2)  # noqa: B023
                n = pc.fill_null(pc.list_value_length(drop), 0).to_numpy()
                hit[np.repeat(start, n) + drop.flatten().to_numpy()] = True
                return hit

            yield _without(batch.column(0), batch.column(1), gone)

    return map_arrow(docs.join(drop, "d", "left").select("doc_id", "text", "drop"), run, _OUT)
