"""Operator 5: BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of the partition are laid out as one linked row of symbols. An index
maps every rank that occurs (a mergeable pair) to all positions of its pair; ranks are taken from
a heap in ascending order, all positions of a rank are merged at once, and only the neighbours of
a merged position enter new pairs into the index. Word codes are kept in a bounded cache, so each
distinct word is encoded about once per Python worker.

Defined results: a null or empty text has no ids and decodes to ""; strings of the file's special
tokens in a text become their ids, as in the library; a null id passes through; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import map_arrow
from chorus.llm.wordsplit import WordCodes, WordSplitter, byte_chars, slices


class PairIndexBpe:
    """Vocabulary and merge ranks of one tokenizer file, with the indexed merge loop."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        model = self.splitter.spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max([*vocab.values(), *self.splitter.special.values()]) + 1
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + end] for c in chars]
        self.rules, self.rank = [], {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b, new = vocab[a], vocab[b], vocab[a + b]
            self.rules.append((a, b, new))
            self.rank.setdefault(a * self.size + b, r)
        self.sorted_keys = np.array(sorted(self.rank), np.int64)
        self.sorted_ranks = np.array([self.rank[k] for k in self.sorted_keys.tolist()], np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every (non-empty) word as little-endian unsigned 32-bit bytes."""
        size, get, rules = self.size, self.rank.get, self.rules
        sym: list[int] = []
        starts: list[int] = []
        inner, final = self.inner, self.final
        for w in words:
            raw = w.encode()
            starts.append(len(sym))
            sym.extend([inner[b] for b in raw[:-1]])
            sym.append(final[raw[-1]])
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[starts] = -1
        after[np.array(starts[1:] + [n] if n else [], np.int64) - 1] = -1
        index = self._first_index(np.array(sym, np.int64), after)
        after, before = after.tolist(), before.tolist()
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            hits = index.pop(r)
            a, b, new = rules[r]
            if a == b:
                hits.sort()  # of overlapping positions the leftmost goes first
            for done, i in enumerate(hits, 1):
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # one of the two was merged meanwhile
                k, p = after[j], before[i]
                sym[i], sym[j], after[i] = new, -1, k
                lower = False
                if k >= 0:
                    before[k] = i
                    if (q := get(new * size + sym[k])) is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heappush(heap, q)
                            lower = q < r
                if p >= 0 and (q := get(sym[p] * size + new)) is not None:
                    if q in index:
                        index[q].append(p)
                    else:
                        index[q] = [p]
                        heappush(heap, q)
                        lower = lower or q < r
                if lower and done < len(hits):  # a lower rank became active: it goes first
                    index[r] = sorted(hits[done:])
                    heappush(heap, r)
                    break
        codes, ends = [], []
        for i in starts:
            while i >= 0:
                codes.append(sym[i])
                i = after[i]
            ends.append(4 * len(codes))
        raw = np.array(codes, "<u4").tobytes()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]

    def _first_index(self, sym: np.ndarray, after: np.ndarray) -> dict[int, list[int]]:
        """rank -> positions of its pair in the untouched symbols, in ascending order."""
        at = np.flatnonzero(after >= 0)
        keys = sym[at] * self.size + sym[at + 1]
        slot = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        known = self.sorted_keys[slot] == keys
        at, rank = at[known], self.sorted_ranks[slot[known]]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        return {int(rank[c]): part.tolist() for c, part in zip(cuts, np.split(at, cuts[1:]))}


@functools.lru_cache(maxsize=2)
def coder(path: str) -> tuple[PairIndexBpe, WordCodes]:
    """Per Python worker: the loaded file and the codes of the words met so far."""
    bpe = PairIndexBpe(path)
    return bpe, WordCodes(bpe.splitter, bpe.encode_words)


@functools.lru_cache(maxsize=2)
def token_texts(path: str) -> list[str]:
    """id -> token as the file spells it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row; one pass, no shuffle."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        _, cache = coder(path)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts):
                flat, ends = cache.encode(texts.slice(lo, hi - lo))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), ids], names=[id_col, "ids"])

    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded) from ``encode``'s rows; null ids decode to "".

    The file names no decoder, so tokens are joined by one blank, special ones included.
    """
    src = encoded.select(id_col, "ids")

    def run(batches):
        text_of = token_texts(path).__getitem__
        for batch in batches:
            ids = batch.column(1)
            for lo in range(0, len(ids), 256):
                part = ids.slice(lo, 256)
                text = [" ".join(map(text_of, x or [])) for x in part.to_pylist()]
                yield pa.record_batch([batch.column(0).slice(lo, 256), part, pa.array(text, pa.string())],
                                      names=[id_col, "ids", "decoded"])

    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, run, f"`{id_col}` {kind}, ids array<int>, decoded string")
