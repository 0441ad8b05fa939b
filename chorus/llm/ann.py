"""Operator 2: nearest neighbours by multi-index hashing over learned binary codes.

Codes: vectors are normalised and centred, rotated to principal axes and then by rotations learned so
that signs lose little (iterative quantisation); one bit per axis, several rotations until
``bits`` are there. The rotations are fitted on a bounded sample (about ``sample`` vectors, picked by a
hash of the id); every vector is coded and indexed.

Index: shards of rows, dealt by a hash of the id. Within a shard a code's 16-bit substrings are
indexed one by one (value -> rows). A query probes every substring index for values at distance
0, 1, 2, ...; after distance r all codes within Hamming distance m * (r + 1) - 1 have been met, by
the pigeonhole principle. Those are ranked by cosine on the original vectors in double precision.
Probing ends when the radius covers what any vector not yet ranked could have if it were as near as the
k-th found. The codes see centred, projected vectors, so the angle is theirs: the k-th cosine c bounds
the distance of the normalised vectors (d * d = 2 - 2 * c), and that with the lengths of the coded
parts, and of the parts left out, bounds the angle t between the coded parts. For t a code of b bits
differs in b * t / pi bits on average; ``z`` standard deviations are added.

Queries are taken in blocks against all shards, and the shards' nearest are merged exactly. Copies of
one vector in a shard are ranked once, by their smallest ids, so a very common vector costs one row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do vectors of another length than most (ties: the shorter); of rows that share an id the
smallest vector counts; null ids take no part; fewer than k candidates give fewer rows; equal
cosines go to the smaller id; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import ship, written

SUB = 16
#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 512

_ONES = np.array([bin(i).count("1") for i in range(1 << 8)], np.uint8)
_ONES = (_ONES[:, None] + _ONES[None, :]).reshape(-1)  # set bits of every 16-bit value


def learn(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection) fitted to sample vectors: principal axes, then rotations for their signs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
    axes = axes[:bits]
    low = (x - centre) @ axes.T
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ v).T
        parts.append(axes.T @ turn)
    return centre, np.hstack(parts)[:, :bits]


def substrings(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The code of every row as 16-bit substrings (rows x m)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = (x - centre) @ projection > 0
    on = np.pad(on, ((0, 0), (0, -on.shape[1] % SUB)))
    return np.packbits(on, axis=1).view(np.uint16)


def lengths(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(length of the part of every centred row that is coded, and of the part left out), rows x 2."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True) - centre
    axes, size, _ = np.linalg.svd(projection, full_matrices=False)
    inside = x @ axes[:, size > 1e-9 * size[0]]
    coded, whole = (inside * inside).sum(1), (x * x).sum(1)
    return np.sqrt(np.stack([coded, np.maximum(whole - coded, 0.0)], axis=1))


def widest(cosine: float, size: np.ndarray, query_size: np.ndarray) -> float:
    """The widest angle of coded parts that a row of these lengths can have at this cosine or a better one."""
    far = 2 - 2 * cosine - (size[:, 1] - query_size[1]) ** 2  # squared distance of the coded parts, at most
    both = 2 * size[:, 0] * query_size[0]
    near = size[:, 0] ** 2 + query_size[0] ** 2 - far
    return float(np.arccos(np.clip(np.divide(near, both, out=np.full(len(size), -1.0), where=both > 1e-12), -1, 1).min()))


def covered(radius: int, angle: float, bits: int, z: float) -> bool:
    p = angle / np.pi
    return radius >= bits * p + z * np.sqrt(bits * p * (1 - p))


class MultiIndex:
    """The substring indexes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            value, first = np.unique(column[order], return_index=True)
            self.tables.append((value, np.append(first, len(order)), order))

    def probe(self, query: np.ndarray):
        """Yields (radius met completely, new rows, their Hamming distances), radius by radius."""
        met = np.zeros(len(self.codes), bool)
        away = [_ONES[value ^ q] for (value, _, _), q in zip(self.tables, query)]
        for r in range(SUB + 1):
            found = []
            for (_, first, order), d in zip(self.tables, away):
                at = np.flatnonzero(d == r)
                n = first[at + 1] - first[at]
                found.append(order[np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)])
            rows = np.concatenate(found)
            rows = np.unique(rows[~met[rows]])
            met[rows] = True
            yield len(query) * (r + 1) - 1, rows, _ONES[self.codes[rows] ^ query].sum(1, dtype=np.int64)


def search(index: MultiIndex, ids: list[np.ndarray], x: np.ndarray, norm: np.ndarray, query_id: int, query: np.ndarray,
           code: np.ndarray, k: int, bits: int, z: float, sizes: np.ndarray, query_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the k nearest rows of the shard, best first; ``ids`` lists each vector's ids,
    ``sizes`` its ``lengths``."""
    left = np.ones(len(x), bool)
    size = np.sqrt((query * query).sum())
    wait_rows, wait_far = np.empty(0, np.int64), np.empty(0, np.int64)
    best_id, best = np.empty(0, np.int64), np.empty(0)
    for radius, rows, far in index.probe(code):
        rows, far = np.concatenate([wait_rows, rows]), np.concatenate([wait_far, far])
        now = far <= radius
        wait_rows, wait_far = rows[~now], far[~now]
        if now.any():
            rows = rows[now]
            left[rows] = False
            cosine = (x[rows] * query).sum(1) / (norm[rows] * size)
            if len(rows) > k:  # more rows than can count: the k nearest, ties and the query itself kept
                least = np.partition(cosine, -k - 1)[-k - 1]
                rows, cosine = rows[cosine >= least], cosine[cosine >= least]
            n = [len(ids[i]) for i in rows]
            new_id = np.concatenate([ids[i] for i in rows])
            new = np.repeat(cosine, n)
            other = new_id != query_id
            best_id, best = np.concatenate([best_id, new_id[other]]), np.concatenate([best, new[other]])
            order = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[order], best[order]
        if radius >= bits or not left.any():
            break
        if len(best) == k:
            one = left.argmax()  # most often one row's bound already tells that probing goes on
            if covered(radius, widest(best[-1], sizes[one:one + 1], query_size), bits, z) \
                    and covered(radius, widest(best[-1], sizes[left], query_size), bits, z):
                break
    return best_id, best


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: F.coalesce(v != 0, F.lit(False))), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = 128, z: float = 2.0, sample: int = 4096,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on the column ``id``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")) \
        .filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    rows = written(rows.select("id", F.col("v").cast("array<double>").alias("v")), "ann-vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == usual[0])
    total = usual[1]
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, sample / total) * (1 << 30)) if total > sample else rows
    fit = sorted(drawn.collect())
    if not fit:
        fit = sorted(rows.limit(sample).collect())
    centre, projection = learn(np.array([r[1] for r in fit]), bits)
    queries = rows.filter(is_query)
    n_queries = queries.count()
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-n_queries // BLOCK))
    # both sides' keys must have the same types, or a cell's halves are dealt to different tasks
    data = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"),
                           F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(blocks)).cast("int").alias("b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.stack(t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
            x, vec_id = matrix(left), left["id"].to_numpy()
            order = np.argsort(vec_id)
            _, first, same = np.unique(x[order], axis=0, return_index=True, return_inverse=True)
            by_vector = np.argsort(same.reshape(-1), kind="stable")
            groups = np.split(vec_id[order][by_vector], np.cumsum(np.bincount(same.reshape(-1)))[:-1])
            ids = [g[:k + 1] for g in groups]  # one may be the query itself
            x = x[order][first]
            norm = np.sqrt((x * x).sum(1))
            index = MultiIndex(substrings(x, centre, projection))
            q = matrix(right)
            codes = substrings(q, centre, projection)
            sizes = lengths(x, centre, projection)
            for query_id, query, code, size in zip(right["id"].to_pylist(), q, codes, lengths(q, centre, projection)):
                found, score = search(index, ids, x, norm, query_id, query, code, k, bits, z, sizes, size)
                out += zip([query_id] * len(found), found.tolist(), score.tolist())
        cols = list(zip(*out)) or [()] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    ship(vectors.sparkSession)
    local = data.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
