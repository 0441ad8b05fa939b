"""Operator 1: near-duplicate classes by HyperMinHash.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes). One permutation
   splits the hash range into ``REGISTERS`` buckets; a register keeps the bucket's minimum as its
   leading-zero count and ``MANTISSA`` further bits (0: no shingle fell there).
2. Rows with equal sets collapse to the smallest id.
3. Banding over the compressed registers: ``BANDS`` x ``ROWS``; empty registers borrow a filled one.
   At a similarity of 0.75 a pair shares no key with probability 1e-8.
4. Stars: in every bucket each member is paired with one hub (the set with most exact copies); the
   collision-corrected estimate picks each member's best hub; that link is confirmed on full sets.
5. The exact rest: in buckets that still hold several components, members (pairs with the hub are
   known from the star) are compared by register estimate, in blocks of bounded size spread over tasks. A block returns a forest of what may be
   linked, so at most one row per member. Components over these rows are candidate clusters: any
   two documents that may be linked lie in one.
6. In each cluster, documents outside its largest component meet all others with their full sets,
   again in blocks; a block returns a forest of confirmed links.
7. Components over all confirmed links.

So a group of many thousand near copies costs one link per copy, no step returns pairs by the square
of a group, and all-against-all work is left for those only that no star could join.

Defined results: null text, empty text and text without words have no shingles and are linked with
nothing; fewer than five words count as one shingle; repeated rows (same id and text) get equal
results; rows sharing an id but not the text are one node with the links of both; a null id takes
no part in links but joins the class of equal sets; other columns are not read, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import give_back, map_arrow, ship, small_or_plain, written
from chorus.llm.graph import components
from chorus.llm.wordsplit import slices

REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 48, 4
#: Standard errors below the threshold at which an estimate rules a pair out (3e-6 one-sided).
MARGIN = 4.5
#: Rows of a block and of a task, about: compared by registers, and by full sets.
BLOCK, TASK_ROWS = 1024, 20_000
SET_BLOCK, SET_TASK_ROWS = 256, 2_000
#: Bytes of text whose words are held at a time (one text at least).
SLICE = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                dtype=np.uint64)


class _WordHash(dict):
    """word -> 64-bit hash, kept for at most 150,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def _forget() -> None:
    """At the end of a task: the words, and the memory they took."""
    _words.clear()
    give_back()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (A-Z lower-cased, ASCII white space splits)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    short = len(w) < width
    n = 1 if short else len(w) - width + 1
    h = np.full(n, len(w) if short else 0, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(min(width, len(w))):
        h += w[i:i + n] * _MIX[i]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of sorted distinct hashes."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = hashes[first] << np.uint64(8)
        _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))  # exact: 53 bits
        zeros = np.where(rest == 0, 56, 53 - exponent).astype(np.uint64)
        after = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16) + np.uint16(1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: The order in which each banded register looks for a bucket to borrow from.
_PROBES = np.argsort(_mixed(np.arange(1, BANDS * ROWS * REGISTERS + 1, dtype=np.uint64) * _MIX[0]).reshape(BANDS * ROWS, REGISTERS), axis=1)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """``BANDS`` 64-bit keys (int64) of a set's registers.

    An empty register borrows the first filled one of its own probing order, so each of a band's
    registers agrees with the similarity as its chance, however small the sets are. Without that,
    two short texts sharing one line would share a bucket.
    """
    there = regs != 0
    if not there.any():
        return np.empty(0, np.int64)
    source = np.arange(BANDS * ROWS)
    gap = np.flatnonzero(~there[:BANDS * ROWS])
    source[gap] = _PROBES[gap, there[_PROBES[gap]].argmax(1)]
    value = (source.astype(np.uint64) << np.uint64(16) | regs[source].astype(np.uint64)).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4]
    for i in range(ROWS):
        key = _mixed(key + value[:, i] * _MIX[i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard, registers it rests on) of register rows ``a`` and ``b``.

    Two different minima agree in all stored bits with probability about
    0.17 * 2^-MANTISSA * 4x / (1 + x)^2, x the ratio of the set sizes.
    """
    there = (a != 0) | (b != 0)
    used = np.maximum(there.sum(-1), 1)
    same = ((a == b) & there).sum(-1) / used
    x = na / np.maximum(nb, 1)
    chance = 0.169919487159739 * 2.0 ** -MANTISSA * 4 * x / (1 + x) ** 2
    return (same - chance) / (1 - chance), used


def possible(value: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair with this estimate may meet the threshold.

    The registers are a sample, without replacement, of the union a pair at the threshold has.
    """
    union = np.maximum((na + nb) / (1 + threshold), used)
    spread = np.sqrt(threshold * (1 - threshold) / used * (1 - used / union))
    return value >= threshold - MARGIN * spread - 1.5 / used


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, keys) of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts, SLICE):
                sets = [shingle_set(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                regs = [registers(s) for s in sets]
                yield pa.record_batch([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([band_keys(r) for r in regs], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "sig", "keys"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>", _forget)


def _with_sides(pairs: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """pairs (a, b) with ``cols`` of both ends; only rows that some pair names are moved."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ends")
    values = values.join(small_or_plain(named), "doc_id", "left_semi")
    side = lambda e: values.select(F.col("doc_id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in cols])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est) of the pairs whose estimate can belong to the threshold."""

    def run(batches):
        for batch in batches:
            a, b, sa, sb, na, nb = (batch.column(i) for i in range(6))
            rows = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS)
            value, used = estimate(rows(sa), rows(sb), na.to_numpy(), nb.to_numpy())
            keep = pa.array(possible(value, used, na.to_numpy(), nb.to_numpy(), threshold))
            yield pa.record_batch([a, b, pa.array(value)], names=["a", "b", "est"]).filter(keep)

    sized = _with_sides(pairs, reps, ["n_shingles"])  # sets of too different sizes need no registers
    sized = written(sized.filter(F.least("n_shingles_a", "n_shingles_b") >= threshold * F.greatest("n_shingles_a", "n_shingles_b"))
                    .select("a", "b"), "sized-pairs")
    sides = _with_sides(sized, reps, ["sig", "n_shingles"]).select("a", "b", "sig_a", "sig_b", "n_shingles_a", "n_shingles_b")
    return map_arrow(sides, run, "a long, b long, est double", give_back)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The rows with ``text`` replaced by ``shingles``, the sorted set."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts, SLICE):
                sets = [shingle_set(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.record_batch([*[batch.column(c).slice(lo, hi - lo) for c in rest],
                                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[*rest, "shingles"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return map_arrow(docs.select(*rest, "text"), run, f"{kinds}, shingles array<long>", _forget)


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold (in whole hundredths, exactly)."""
    named = written(pairs.select("a", "b"), "pairs")
    ends = written(named.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ends")
    sets = written(shingle_sets(docs.join(small_or_plain(ends), "doc_id", "left_semi")), "pair-sets")
    side = lambda e: sets.select(F.col("doc_id").alias(e), F.col("shingles").alias(f"s{e}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return named.join(side("a"), "a").join(side("b"), "b") \
        .filter(100 * both >= round(100 * threshold) * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _cells(table: pa.Table):
    """The rows of each cell of a task, as index arrays."""
    cell = table["cell"].to_numpy()
    order = np.argsort(cell, kind="stable")
    return [at for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(at) > 1]


def _edges(a: list, b: list) -> pa.Table:
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def maybe_linked(members: DataFrame, likely: DataFrame, labels: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) rows over which every pair of different components that shares a bucket and may meet
    the threshold is connected, together with the components.

    Pairs with a bucket's hub have been estimated before: ``likely`` has those that may meet it.
    The other members of a bucket are compared here, once for all buckets with the same members. A
    bucket of n members becomes blocks of about ``BLOCK``; each pair of blocks is a cell, and cells
    are dealt to tasks by hash.
    """
    label_of = lambda e: labels.select(F.col("node").alias(e), F.col("label").alias(f"label_{e}"))
    hubs = likely.select("a", "b").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left") \
        .filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    tagged = members.filter("rep <> hub").join(label_of("rep"), "rep", "left") \
        .select("key", "rep", F.coalesce("label_rep", "rep").alias("label"))
    tagged = written(tagged, "bucket-labels")
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"),
                                      F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")) \
        .filter("lo <> hi").groupBy("same", "size", "lo", "hi").agg(F.min("key").alias("key")) \
        .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = tagged.join(written(mixed, "mixed-buckets"), "key")
    rows = rows.withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.select("key", "rep", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = written(rows.select("rep", "label", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")), "cells")
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.join(reps.select(F.col("doc_id").alias("rep"), "sig", F.col("n_shingles").alias("n")), "rep") \
        .withColumn("task", F.expr(f"pmod(cell, {tasks})"))

    def run(table: pa.Table) -> pa.Table:
        rep, label, n = (table[c].to_numpy() for c in ("rep", "label", "n"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        a, b = [], []
        for at in _cells(table):
            group = label[at].copy()  # documents known to lie in one cluster share a number
            for x, i in enumerate(at):
                near = np.flatnonzero(group != group[x])
                near = near[np.minimum(n[at[near]], n[i]) >= threshold * np.maximum(n[at[near]], n[i])]
                if len(near):
                    j = at[near]
                    value, used = estimate(sig[i][None], sig[j], n[i], n[j])
                    near = near[possible(value, used, n[i], n[j], threshold)]
                    _, first = np.unique(group[near], return_index=True)  # one row for each cluster joined
                    for y in near[first]:
                        a.append(rep[i])
                        b.append(rep[at[y]])
                    group[np.isin(group, group[near])] = group[x]
        return _edges(a, b)

    ship(members.sparkSession)
    return rows.groupBy("task").applyInArrow(run, "a long, b long").unionByName(hubs).distinct()


def rest_links(maybe: DataFrame, labels: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest, block by block, of the confirmed links between components of one cluster."""
    cluster = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(maybe)) \
        .withColumnRenamed("label", "cluster")
    open_ = maybe.select(F.col("a").alias("node")).join(cluster, "node").select("cluster").distinct()
    nodes = cluster.join(open_, "cluster", "left_semi").join(labels, "node", "left") \
        .select("cluster", F.col("node").alias("doc_id"), F.coalesce("label", "node").alias("label"))
    nodes = written(nodes, "cluster-nodes")
    sizes = nodes.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster") \
        .agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")) \
        .select("cluster", F.col("main.label").alias("main"), F.ceil(F.col("n") / SET_BLOCK).cast("int").alias("wide"),
                F.ceil((F.col("n") - F.col("main.n")) / SET_BLOCK).cast("int").alias("tall"))
    nodes = nodes.join(written(sizes, "clusters"), "cluster")
    nodes = nodes.select("doc_id", "label", "cluster", "main", "wide", "tall",
                         F.expr("cast(pmod(xxhash64(doc_id), wide) as int)").alias("x"),
                         F.expr("cast(pmod(xxhash64(doc_id, 1), tall) as int)").alias("y"))
    cell = lambda y, x: F.xxhash64("cluster", y.cast("long"), x.cast("long"))
    right = nodes.select("doc_id", "label", F.lit(False).alias("asks"), F.explode(
        F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda y: cell(y, F.col("x")))).alias("cell"))
    left = nodes.filter("label <> main").select("doc_id", "label", F.lit(True).alias("asks"), F.explode(
        F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda x: cell(F.col("y"), x))).alias("cell"))
    dealt = written(right.unionByName(left), "set-cells")
    tasks = max(1, -(-dealt.count() // SET_TASK_ROWS))
    ids = written(dealt.select("doc_id").distinct(), "set-ids")
    sets = shingle_sets(docs.join(small_or_plain(ids), "doc_id", "left_semi"))
    rows = dealt.join(sets, "doc_id").withColumn("task", F.expr(f"pmod(cell, {tasks})"))
    least = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, label, asks = (table[c].to_numpy() for c in ("doc_id", "label", "asks"))
        shingles = table["shingles"].combine_chunks()
        ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(np.uint64)
        of = [flat[ends[i]:ends[i + 1]] for i in range(len(doc))]
        n = np.diff(ends)
        a, b = [], []
        for at in _cells(table):
            sig = {i: registers(of[i]) for i in at}
            group = label[at].copy()
            for x in np.flatnonzero(asks[at]):
                i = at[x]
                near = np.flatnonzero((group != group[x]) & ~asks[at])
                near = near[np.minimum(n[at[near]], n[i]) >= threshold * np.maximum(n[at[near]], n[i])]
                if not len(near):
                    continue
                value, used = estimate(sig[i][None], np.stack([sig[j] for j in at[near]]), n[i], n[at[near]])
                fits = possible(value, used, n[i], n[at[near]], threshold)
                for y in near[fits][np.argsort(-value[fits], kind="stable")]:
                    if group[y] != group[x]:  # not joined meanwhile
                        both = np.isin(of[i], of[at[y]], assume_unique=True).sum()
                        if 100 * both >= least * (n[i] + n[at[y]] - both):
                            a.append(doc[i])
                            b.append(doc[at[y]])
                            group[group == group[y]] = group[x]
        return _edges(a, b)

    ship(docs.sparkSession)
    return rows.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = written(features(docs), "shingle-features")
    same = written(feats.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                   .filter("copies > 1"), "equal-sets")
    feats_rep = feats.join(small_or_plain(same, 500_000), "digest", "left")  # a digest and two longs a row
    own = feats_rep.filter("n_shingles > 0 and doc_id is not null") \
        .select("doc_id", "n_shingles", "sig", "keys", F.coalesce("copies", F.lit(1)).alias("copies"), "rep")
    # only rows whose set is repeated can be repeated rows
    reps = written(own.filter("rep is null").unionByName(own.filter("rep = doc_id").dropDuplicates(["doc_id", "sig"])).drop("rep"), "distinct-sets")
    # most keys are one document's alone: the keys are counted by themselves, and only shared ones go on with their documents
    shared = written(reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), "shared-keys")
    rows = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), "copies")
    rows = written(rows.join(small_or_plain(shared), "key", "left_semi"), "bucket-rows")
    hubs = rows.groupBy("key").agg(F.max(F.struct("copies", F.xxhash64("rep", "key").alias("h"), "rep")).alias("hub"),
                                   F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", F.col("hub.rep").alias("hub"))
    members = written(rows.join(hubs, "key").select("key", "rep", "hub"), "bucket-members")
    stars = written(members.filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "rep")
                    .distinct(), "stars")
    likely = written(estimated(stars.select("a", "b").distinct(), reps, threshold), "likely")
    best = likely.join(stars, ["a", "b"]).groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("est", F.xxhash64("a", "b"))).alias("p")) \
        .select("p.a", "p.b").distinct()
    links = written(confirmed(best, docs, threshold), "star-links")
    labels = components(links)
    maybe = written(maybe_linked(members, likely, labels, reps, threshold), "maybe-linked")
    more = None if maybe.isEmpty() else written(rest_links(maybe, labels, docs, threshold), "rest-links")
    if more is not None and not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    out = feats_rep.drop("sig", "keys").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    out = out.withColumn("rep", F.coalesce("rep", "doc_id")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.withColumn("component_id", F.coalesce("label", "rep"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
