"""Operator 4: language identification by averaged hashed subword embeddings.

A text is lower-cased; what is not a letter becomes a blank. Its subwords are the 2-, 3- and
4-grams of letters within words, word edges included. Each is hashed to one of ``BUCKETS``
embeddings; the text is their average, followed by a linear softmax. Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows: about ``per_lang`` rows of
each language, picked by a hash of the id, reduced to bucket counts by the tasks that read them.

The softmax has one class more than there are languages, for text of none of them. Its examples are
made from the sample's own texts: their letters in random order, or as many subwords drawn evenly from
all buckets, which stand for scripts and languages never seen. So a score can be low however few
languages are learned, also with one.

A fifth of the sample is kept from training to calibrate: one temperature (least log loss), and a
score below which a prediction is rejected: the ``reject_share`` quantile of its scores in the learned
languages, half at most: what is more likely of a learned language than not is never rejected.

Prediction multiplies the two layers out once (``BUCKETS`` x classes) and adds up rows of that
table; whole texts, no shuffle.

Defined results: null text or one without a letter is ``und`` with score 0, rejected; ties go to the
language first in order; without labelled rows every text is ``und``; repeated rows get equal
results; only the named columns are read, whatever others are called; no rows give no rows.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import give_back, map_arrow
from chorus.llm.wordsplit import slices

BUCKETS, DIM = 1 << 14, 16
ORDERS = (2, 3, 4)
MOST_STRANGE = 4000  # letters or subwords of a made-up example


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """code point -> itself in lower case if a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0]) if low else c
    return out


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every subword, its text's number, whether each text has a letter)."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    chars = _fold()[np.frombuffer((" ".join(["", *texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [*(size + 1), 1])  # a text owns the blank before it
    letter = chars != 32
    has = np.zeros(len(texts) + 1, bool)
    has[owner[letter]] = True
    hashes, owners = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        inside = letter[1:1 + m] if n < 3 else letter[1:1 + m] & letter[n - 2:n - 2 + m]
        if n == 2:
            inside = letter[:m] | letter[1:1 + m]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint32)
        for i in range(n):
            h = (h ^ chars[at + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        hashes.append(((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners), has[:len(texts)]


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their counts) of every text."""
    bucket, owner, _ = subwords(texts)
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return [np.unique(x, return_counts=True) for x in np.split(bucket[order], cut)]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the smallest type that holds them; its size in bytes comes first."""
    size = 1 if (most := int(x.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def strange(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A bag of no language, made from a text: its letters in random order, or subwords drawn evenly."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    rng = np.random.default_rng(seed)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = np.flatnonzero(_fold()[chars] != 32)
    if seed % 2:
        return np.unique(rng.integers(0, BUCKETS, min(3 * len(letter) + 1, MOST_STRANGE)), return_counts=True)
    chars[letter] = rng.permutation(chars[letter])
    return _bags([chars[:MOST_STRANGE].tobytes().decode("utf-32-le", "surrogatepass")])[0]


def held_out(doc_id: Column) -> Column:
    """The rows kept away from learning: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages, the multiplied-out table of scores, temperature and rejection score."""

    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.temperature, self.reject = langs, table, temperature, reject

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities of the languages and of none of them, has a letter) of every text."""
        bucket, owner, has = subwords(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts) + 1)[:len(texts)], 1)
        logit = np.stack([np.bincount(owner, self.table[bucket, k], len(texts) + 1)[:len(texts)] / n
                          for k in range(self.table.shape[1])], 1)
        return _softmax(logit / self.temperature), has


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (bucket, count) in enumerate(rows):
        x[i, bucket] = count / count.sum()
    return x


def sgd(rows: list, labels: np.ndarray, n_langs: int, steps: int = 800, batch: int = 32, rate: float = 20.0, seed: int = 7):
    """(embeddings, softmax weights) by plain stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, n_langs), np.float32)
    order = np.empty(0, np.int64)
    for step in range(steps):
        if len(order) < batch:  # an epoch is over
            order = rng.permutation(len(rows))
        pick, order = order[:batch], order[batch:]
        x = _dense([rows[i] for i in pick])
        h = x @ emb
        g = _softmax(h @ out)
        g[np.arange(len(pick)), labels[pick]] -= 1
        g /= len(pick)
        now = rate * (1 - step / steps)
        back = g @ out.T
        out -= 0.05 * now * (h.T @ g)
        emb -= now * (x.T @ back)
    return emb, out


def train(docs: DataFrame, per_lang: int = 500, reject_share: float = 0.001, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled rows that are not held out."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang")) \
        .filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = dict(src.groupBy("lang").count().collect())  # a row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), 400_000):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                packed = [pa.array([_packed(x) for x in column], pa.binary())
                          for made in (_bags(texts), [strange(t) for t in texts]) for column in zip(*made)]
                yield pa.record_batch([part.column(0), part.column(2), *packed], names=["doc_id", "lang", "bucket", "n", "bucket0", "n0"]) \
                    .filter(pa.array(subwords(texts)[2]))

    kind = src.schema["doc_id"].dataType.simpleString()
    sample = map_arrow(src.filter(drawn), run, f"doc_id {kind}, lang string, bucket binary, n binary, bucket0 binary, n0 binary", give_back).collect()
    named = lambda r: (str(r[0]), r[1])
    sample.sort(key=named)
    sample = [r for _, same in itertools.groupby(sample, named) for r in sorted(same, key=lambda r: _unpacked(r[2]).astype("<i4").tobytes())]
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    bag = lambda b, n: (_unpacked(b), _unpacked(n).astype(np.float32))
    none = sample[::max(1, len(langs) // 2)]  # no more than twice as many as a language has
    rows = [bag(r[2], r[3]) for r in sample] + [bag(r[4], r[5]) for r in none]
    labels = np.array([langs.index(r[1]) for r in sample] + [len(langs)] * len(none))
    check = np.concatenate([np.arange(len(sample)) % 5 == 4, np.arange(len(none)) % 5 == 4])
    del sample, none
    give_back()  # the driver stays on
    fit = np.flatnonzero(~check)
    emb, out = sgd([rows[i] for i in fit], labels[fit], len(langs) + 1)
    table = (emb @ out).astype(np.float32)
    at = np.flatnonzero(check) if check.any() else fit
    logit = np.stack([(table[b] * n[:, None]).sum(0) / n.sum() for b, n in (rows[i] for i in at)])
    grid = 2.0 ** np.arange(-4, 4.01, 0.25)
    loss = [-np.log(np.maximum(_softmax(logit / t)[np.arange(len(at)), labels[at]], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    sure = _softmax(logit / best)[labels[at] < len(langs), :len(langs)].max(1)
    return Model(langs, table, best, float(min(0.5, np.quantile(sure, reject_share))) if len(sure) else 0.5)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; reads the text and, to name the row, the id."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = np.array([*model.langs, "und"])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), 400_000):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                if model.langs:
                    p, has = model.scores(texts)
                    p = p[:, :len(model.langs)]
                    best, score = np.where(has, p.argmax(1), len(model.langs)), np.where(has, p.max(1), 0.0)
                else:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score),
                                       pa.array((best == len(model.langs)) | (score < model.reject))],
                                      names=[id_col, "lang_pred", "score", "rejected"])

    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean", give_back)
