"""Hashed counts of character 3-grams, as a Spark ML stage.

The same vectors as splitting the lower-cased text into characters, ``NGram(3)`` and ``HashingTF`` make, without
an object for each character and 3-gram: a function over Arrow batches hashes all 3-grams of many texts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(num_features: int):
    """The function texts -> sparse vectors. All it needs is inside, so that workers need not have this package."""
    most_chars, most_texts = 400_000, max(1, (1 << 20) // num_features)  # worked on at a time

    def mix(k):
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    def mixed(h, k):
        h = h ^ mix(k)
        return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)

    def ended(h, size):
        h = h ^ size
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        return h ^ h >> np.uint32(16)

    def plain(a, b, c):
        """Murmur3 of "a b c" for ASCII characters: one block of four bytes and one byte more."""
        h = mixed(np.full(len(a), 42, np.uint32), a | b << np.uint32(16) | np.uint32(0x20002000))
        return ended(h ^ mix(c), np.uint32(5))

    def any_(*grams):
        """Murmur3 of "a b c" for any characters, from their bytes in UTF-8."""
        n = len(grams[0])
        raw, at, row = np.zeros((n, 16), np.uint8), np.zeros(n, np.int64), np.arange(n)
        for i, c in enumerate(grams):
            size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]
            for j in range(4):
                has = size > j
                rest = c[has] >> (6 * (size[has] - 1 - j)).astype(np.uint32)
                raw[row[has], at[has] + j] = (rest | lead[has]) if j == 0 else (rest & np.uint32(0x3F) | np.uint32(0x80))
            at = at + size
            if i < 2:
                raw[row, at] = 0x20
                at = at + 1
        block, h = raw.view("<u4"), np.full(n, 42, np.uint32)
        for i in range(4):
            k = block[:, i].astype(np.uint32)
            h = np.where(at // 4 > i, mixed(h, k), np.where(at // 4 == i, h ^ mix(k), h))
        return ended(h, at.astype(np.uint32))

    def some(texts):
        """(features of the texts, how often, how many of each text)."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        grams = np.maximum(size - 2, 0)
        owner = np.repeat(np.arange(len(texts)), grams)
        first = np.arange(len(owner)) + np.repeat(np.cumsum(size) - size - (np.cumsum(grams) - grams), grams)
        a, b, c = chars[first], chars[first + 1], chars[first + 2]
        ascii_ = (a | b | c) < 0x80
        if ascii_.all():
            h = plain(a, b, c)
        else:
            h = np.empty(len(a), np.uint32)
            h[ascii_] = plain(a[ascii_], b[ascii_], c[ascii_])
            h[~ascii_] = any_(a[~ascii_], b[~ascii_], c[~ascii_])
        feature = np.mod(h.view(np.int32).astype(np.int64), num_features)
        n = np.bincount(owner * num_features + feature, minlength=len(texts) * num_features)
        found = np.flatnonzero(n)
        return (found % num_features).astype(np.int32), n[found].astype(np.float64), np.bincount(found // num_features, minlength=len(texts))

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        parts, lo = [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and hi - lo < most_texts and (hi == lo or chars + len(texts[hi]) <= most_chars):
                chars += len(texts[hi])
                hi += 1
            parts.append(some(texts[lo:hi]))
            lo = hi
        feature, n, size = (np.concatenate([p[i] for p in parts] or [np.empty(0, t)]) for i, t in enumerate((np.int32, np.float64, np.int64)))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), num_features, np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(feature)), pa.ListArray.from_arrays(ends, pa.array(n))],
            names=["type", "size", "indices", "values"])

    return run


class CharGrams(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Text -> counts of its lower-cased 3-grams of characters, hashed as ``HashingTF`` does; a NULL text is an empty one."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 4096):
        super().__init__()
        self._setDefault(numFeatures=4096)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = F.arrow_udf(_counts(self.getNumFeatures()), VectorUDT())
        return dataset.withColumn(self.getOutputCol(), counts(F.lower(F.coalesce(F.col(self.getInputCol()), F.lit("")))))
