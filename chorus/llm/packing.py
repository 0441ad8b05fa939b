"""Operator 6: bounded-space online packing of token sequences into fixed windows.

Each partition keeps ``open_windows`` windows open. A document's ids (with the closing id) are cut
into full windows plus a remainder; the remainder goes to the open window that it fills best. When
it fits in none, the fullest window is topped up with its first ids and emitted, and the rest is
placed again, so emitted windows hold no padding. At the end of a partition the open windows are
poured together, which leaves one partly filled window per partition at most. These leftovers are
merged in groups of partitions; the last window of a group is split at powers of two, which the
consumer takes without padding.

Defined results: a null or empty text is the closing id alone; every id of every row lies in
exactly one piece, repeated rows included (they share ``doc_id``, not pieces); other columns of the
input are not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import give_back, map_arrow, written
from chorus.llm.wordsplit import WordCodes, WordSplitter, byte_chars, slices

#: sequence_id = partition number * ROOM + running number; merged leftovers lie above MERGED.
ROOM, MERGED = 1 << 32, 1 << 62
#: Partitions whose leftovers are merged by one task: ``GROUP`` windows of ids at most.
GROUP = 64

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
          ("sequence_id", pa.int64()), ("offset", pa.int64())]
ROW = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def library_words(splitter: WordSplitter):
    """Word codes by the tokenizers library's own BPE model."""
    chars, model = byte_chars(), splitter.library.model

    def one(word: str) -> bytes:
        pieces = model.tokenize("".join([chars[b] for b in word.encode()]))
        return b"".join([t.id.to_bytes(4, "little") for t in pieces])

    def run(words: list[str]) -> list[bytes]:
        return [one(w) for w in words]

    return run


@functools.lru_cache(maxsize=2)
def cache_for(path: str) -> WordCodes:
    splitter = WordSplitter(path)
    return WordCodes(splitter, library_words(splitter))


def _forget() -> None:
    """At the end of a task: the tokenizer and the words coded so far, which other steps' tasks in this worker do not need."""
    cache_for.cache_clear()
    give_back()


class Packer:
    """Best fit into a fixed number of open windows; pieces are (doc, start, ids, total)."""

    def __init__(self, size: int, open_windows: int):
        self.size = size
        self.windows: list[list] = [[] for _ in range(open_windows)]
        self.free = [size] * open_windows

    def add(self, piece):
        """Place one piece; yields windows that became full."""
        doc, start, ids, total = piece
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                yield [(doc, start, ids[: 4 * self.size], total)]
                start, ids = start + self.size, ids[4 * self.size:]
                continue
            fits = [f for f in self.free if f >= n]
            if fits:
                at, take = self.free.index(min(fits)), n
            else:
                at = self.free.index(min(self.free))
                take = self.free[at]
            self.windows[at].append((doc, start, ids[: 4 * take], total))
            self.free[at] -= take
            start, ids = start + take, ids[4 * take:]
            if not self.free[at]:
                yield self.windows[at]
                self.windows[at], self.free[at] = [], self.size

    def rest(self):
        """Pour the open windows together: full windows, then one partly filled at most."""
        left = [p for w in self.windows for p in w]
        one = Packer(self.size, 1)
        for piece in left:
            yield from one.add(piece)
        if one.windows[0]:
            yield one.windows[0]


def powers(window: list, size: int):
    """Split a partly filled window into sequences whose lengths are powers of two."""
    n = sum(len(p[2]) // 4 for p in window)
    bits = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    todo = list(window)
    for want in bits:
        out = []
        while want:
            doc, start, ids, total = todo.pop(0)
            take = min(want, len(ids) // 4)
            out.append((doc, start, ids[: 4 * take], total))
            if len(ids) > 4 * take:
                todo.insert(0, (doc, start + take, ids[4 * take:], total))
            want -= take
        yield out


class _Rows:
    """Collects pieces and hands them on as record batches."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, window, seq: int) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, ids, total, seq, at))
            at += len(ids) // 4
            self.bytes += len(ids)

    def take(self):
        cols = list(zip(*self.rows)) or [()] * len(FIELDS)
        self.rows, self.bytes = [], 0
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS)], names=[n for n, _ in FIELDS])


def pack(docs: DataFrame, path: str, size: int = 2048, open_windows: int = 16, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``ROW``: a piece each, its ids as little-endian unsigned 32-bit bytes."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    close = end_id.to_bytes(4, "little")

    def run(batches):
        cache, packer, out = cache_for(path), Packer(size, open_windows), _Rows()
        base = TaskContext.get().partitionId() * ROOM
        seq = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts):
                flat, ends = cache.encode(texts.slice(lo, hi - lo))
                for doc, first, last in zip(ids[lo:hi], ends, ends[1:]):
                    code = flat[first:last].tobytes() + close
                    for window in packer.add((doc, 0, code, len(code) // 4)):
                        out.put(window, base + seq)
                        seq += 1
                    if out.bytes > 4_000_000:
                        yield out.take()
        for window in packer.rest():
            full = sum(len(p[2]) for p in window) == 4 * size
            out.put(window, base + seq if full else -1 - base)  # below 0: a leftover of this partition
            seq += full
        yield out.take()

    first = written(map_arrow(src, run, ROW, _forget), "packed")
    left = first.filter("sequence_id < 0").withColumn("grp", F.expr(f"(-1 - sequence_id) div {ROOM * GROUP}"))

    def merge(key, table):
        part = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")]).to_pylist()
        packer, out = Packer(size, 1), _Rows()
        seq = MERGED + key[0].as_py() * ROOM
        windows = [w for r in part for w in packer.add((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))]
        for window in [*windows, *(p for w in packer.rest() for p in powers(w, size))]:
            out.put(window, seq)
            seq += 1
        return pa.Table.from_batches([out.take()])

    return first.filter("sequence_id >= 0").unionByName(left.groupBy("grp").applyInArrow(merge, ROW))
