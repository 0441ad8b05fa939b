"""Operator 12: hard negatives by largest inner product, from cover trees over norm-augmented candidates.

Vectors are integers here: every component x becomes floor(scale * x). A candidate gets one more
component, sqrt(M * M - |x| * |x|) with M the longest candidate's length, so that all lie on one sphere. For
an anchor q the squared distance to a candidate is then |q| ** 2 + M ** 2 - 2 <q, x>: near means a large
inner product, and a ball (centre, covering radius) bounds the products of everything in it, from above and below.

Index: candidates are dealt to cells, by the nearest of some pivots fitted to a bounded sample, cells larger than
``SHARD`` rows further by a hash of the id. Each shard is a cover tree, built in a task and written with its ball: a
level's centres lie further apart than the level's radius, which shrinks by ``BASE`` a level, and every node keeps the
exact radius that covers what is below it. Of equal vectors with one label only the smallest ids that could
ever be returned are indexed.

Search: an anchor looks for products in windows [low, high]. Cells whose ball reaches none of its windows are left
out before anything is shuffled; within a shard nodes are taken best first, by the upper bound; a node is skipped if it lies
outside every window or below the window's k-th so far; a leaf's rows are multiplied exactly. A shard's tree
is sent to a task once for a block of anchors, which stream past it. Shards' answers are merged exactly.

Mining takes two searches: the positives (same label, one window without ends), then, with windows
[least percent of the positive's score, the positive's score], the negatives (other labels).

Defined results: rows with a null id or label, a null or empty vector, null or non-finite components, or
components beyond 2 ** 22 after scaling (percentages of their scores might not fit a long) take no part, nor do vectors of another length than most (ties: the shorter); of
rows that share an id the one with the smallest label, then vector, counts; a positive with a negative score has no
negatives; equal scores go to the smaller id; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import map_arrow, shuffle_parts, written

#: Rows of a shard and anchors of a block, about; rows of a leaf and of the smallest node; how much a level's radius shrinks; most pivots; rows of the sample.
SHARD, BLOCK, LEAF, SMALL, BASE, PIVOTS, SAMPLE = 8192, 4096, 64, 32, 1.3, 256, 4096
LARGEST = 1 << 22


def augmented(x: np.ndarray, longest2: float) -> np.ndarray:
    """Rows with one more component that gives them all the same length."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(longest2 - (x * x).sum(1), 0.0))[:, None]])


class CoverTree:
    """Arrays of a tree: nodes in breadth-first order, points depth first, so that a node's lie together.

    Node i has its ``centre`` (a point), covering ``radius``, the child nodes ``first[i]`` to ``last[i]``, and points of its
    own, ``begin[i]`` to ``end[i]``: a leaf's rows, or those of children so small that multiplying them costs less than a
    node does.
    """

    FIELDS = ("x", "ids", "labels", "centre", "radius", "first", "last", "begin", "end")

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, longest2: float, leaf: int = LEAF, small: int = SMALL):
        points = augmented(x, longest2)
        away = lambda rows, c: np.sqrt(((points[rows] - points[c]) ** 2).sum(1))
        everything = np.arange(len(x))
        nodes = [(0, everything, away(everything, 0))]  # (centre, members, their distances); members become own points
        centre, radius, first, last = [], [], [], []
        i = 0
        while i < len(nodes):
            c, members, far = nodes[i]
            reach = far.max()
            centre.append(c)
            radius.append(reach)
            first.append(len(nodes))
            if len(members) > leaf and reach > 0:
                level = reach / BASE
                left, far_left, at, alone = members, far, c, []
                while len(left):
                    near = far_left <= level
                    below = left[near]
                    if len(below) > small:
                        nodes.append((at, below, far_left[near]))
                    else:
                        alone.append(below)
                    left = left[~near]
                    if len(left):  # the next centre is further than the level from all before it
                        at = left[0]
                        far_left = away(left, at)
                members = np.concatenate(alone) if alone else left
            nodes[i] = (c, members, None)
            last.append(len(nodes))
            i += 1
        begin, end = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        order, n, stack = [], 0, [0]
        while stack:
            i = stack.pop()
            begin[i], n = n, n + len(nodes[i][1])
            end[i] = n
            order.append(nodes[i][1])
            stack += range(last[i] - 1, first[i] - 1, -1)
        order = np.concatenate(order)
        place = np.empty(len(order), np.int64)
        place[order] = everything
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.centre, self.radius, self.begin, self.end = place[np.array(centre)], np.array(radius), begin, end
        self.first, self.last = np.array(first), np.array(last)
        self._ready()

    def _ready(self) -> None:
        self.top, self.double = float(np.abs(self.x).max()), self.x.astype(np.float64)

    def dump(self) -> tuple[bytes, int]:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return pa.compress(out.getvalue(), "zstd", asbytes=True), len(out.getvalue())

    @classmethod
    def load(cls, raw: bytes, size: int) -> CoverTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(pa.decompress(raw, size, "zstd", asbytes=True))) as held:
            for f in cls.FIELDS:
                setattr(self, f, held[f])
        self._ready()
        return self

    def products(self, rows: slice | np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: in doubles while these hold every sum, in longs otherwise (``q`` is of the kind to use)."""
        return (self.double[rows] @ q).astype(np.int64) if q.dtype == np.float64 else self.x[rows] @ q

    def search(self, q_id: int, q_label: int, q: np.ndarray, windows: list[tuple[int, int]], same: bool, k: int,
               longest2: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each window the first k (ids, scores) among rows of the same label (not the anchor) or of others."""
        q_double = q.astype(np.float64)
        whole = float((q_double * q_double).sum()) + longest2  # |q|^2 + M^2
        slack = 1e-9 * (whole + 1)  # the bounds are computed in doubles
        if self.top * float(np.abs(q).max()) * len(q) < 2 ** 53:
            q = q_double
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        least, highest = [low for low, _ in windows], max(high for _, high in windows)  # what a row must have to count

        def bounds(score, radius):
            far = np.sqrt(np.maximum(whole - 2.0 * score, 0.0))
            return (whole - np.maximum(far - radius, 0.0) ** 2) / 2 + slack, (whole - (far + radius) ** 2) / 2 - slack

        root = self.products(self.centre[:1], q)
        upper, lower = bounds(root, self.radius[:1])
        heap = [(-upper[0], 0, lower[0])]
        while heap:
            up, i, lower = heapq.heappop(heap)
            if -up < min(least):
                break
            if not any(-up >= floor and lower <= high for floor, (_, high) in zip(least, windows)):
                continue
            lo, hi = self.first[i], self.last[i]
            if lo < hi:
                scores = self.products(self.centre[lo:hi], q)
                upper, lower = bounds(scores, self.radius[lo:hi])
                for j in np.flatnonzero(upper >= min(least)).tolist():
                    heapq.heappush(heap, (-upper[j], lo + j, lower[j]))
            rows = slice(self.begin[i], self.end[i])
            if rows.start == rows.stop:
                continue
            scores = self.products(rows, q)
            fit = (self.labels[rows] == q_label) & (self.ids[rows] != q_id) if same else self.labels[rows] != q_label
            fit = np.flatnonzero(fit & (scores >= min(least)) & (scores <= highest))
            if not len(fit):
                continue
            ids, scores = self.ids[rows][fit], scores[fit]
            for w, (_, high) in enumerate(windows):
                new = np.flatnonzero((scores >= least[w]) & (scores <= high))
                if len(new) > 64:  # the k best and all that tie with the last of them
                    new = new[scores[new] >= np.partition(scores[new], -min(k, len(new)))[-min(k, len(new))]]
                if len(new):
                    all_ids, best = np.concatenate([found[w][0], ids[new]]), np.concatenate([found[w][1], scores[new]])
                    order = np.lexsort((all_ids, -best))[:k]
                    found[w] = all_ids[order], best[order]
                    if len(order) == k:
                        least[w] = max(least[w], int(best[order[-1]]))
        return found


def _farthest(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before it; fewer if the rest are copies."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


_WINDOWS = "array<struct<low:bigint,high:bigint>>"


class Index:
    """Cover trees of candidates (id, label, v), written below the shared folder, and the balls of their cells."""

    def __init__(self, rows: DataFrame, width: int, k: int):
        self.width = width
        copies = Window.partitionBy("v", "label").orderBy("id")
        held = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
        held = written(held.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), "ct-rows")
        n, longest2 = held.agg(F.count(F.lit(1)), F.max("length2")).first()
        self.longest2 = longest2 = longest2 or 0.0
        cells = max(1, min(PIVOTS, -(-n // SHARD)))
        drawn = held.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 30)) if cells > 1 else held.limit(1)
        sample = np.array([r[0] for r in drawn.select("v", "id").orderBy("id").collect()], np.int64).reshape(-1, width)
        points = _farthest(augmented(sample, longest2), cells) if len(sample) else np.zeros((1, width + 1))

        def deal(batches):
            for batch in batches:
                x = augmented(_matrix(batch.column("v"), width), longest2)
                cell = (x @ points.T * 2 - (points * points).sum(1)).argmax(1)
                far = np.sqrt(((x - points[cell]) ** 2).sum(1))
                yield pa.record_batch([pa.array(cell.astype(np.int64)), pa.array(far), *[batch.column(c) for c in ("id", "label", "v")]],
                                      names=["cell", "far", "id", "label", "v"])

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            raw, size = CoverTree(_matrix(table["v"].combine_chunks(), width), table["id"].to_numpy(), table["label"].to_numpy(), longest2).dump()
            return pa.table({"s": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([size], pa.int64()), "tree": pa.array([raw], pa.binary())})

        dealt = written(map_arrow(held.select("id", "label", "v"), deal, "cell long, far double, id long, label long, v array<int>"), "ct-cells")
        balls = dealt.groupBy("cell").agg(F.max("far"), F.ceil(F.count(F.lit(1)) / SHARD)).orderBy("cell").collect()  # at most PIVOTS rows
        self.cells = np.array([r[0] for r in balls], np.int64)
        self.centres, self.radii = points[self.cells] if balls else points[:0], np.array([r[1] for r in balls])
        self.parts = np.array([r[2] for r in balls], np.int64)
        parts = np.zeros(len(points), np.int64)
        parts[self.cells] = self.parts
        of_cell = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell").cast("int") + 1)
        shard = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), of_cell)
        self.trees = written(dealt.select(shard.alias("s"), "id", "label", "v").groupBy("s")
                             .applyInArrow(build, "s long, size long, tree binary"), "ct-trees")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, low, high, found, score, rank): the first k rows of each window of each anchor, over all shards.

        ``anchors``: (id, label, v, windows), windows an array of (low, high).
        """
        width, longest2, centres, radii = self.width, self.longest2, self.centres, self.radii
        cells, parts = self.cells, self.parts
        lengths = (centres * centres).sum(1)
        blocks = max(1, -(-anchors.count() // BLOCK))
        block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("long")

        def route(batches):
            """A row for every shard of the cells that an anchor's windows reach."""
            for batch in batches:
                q = _matrix(batch.column("v"), width).astype(np.float64)
                own = (q * q).sum(1)[:, None]
                far = np.sqrt(np.maximum(own + lengths - 2 * (q @ centres[:, :-1].T), 0.0))
                slack = 1e-9 * (own + longest2 + 1)
                upper = (own + longest2 - np.maximum(far - radii, 0.0) ** 2) / 2 + slack
                lower = (own + longest2 - (far + radii) ** 2) / 2 - slack
                windows = batch.column("windows")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(windows).to_numpy())
                ends = windows.flatten()
                low, high = (ends.field(i).to_numpy() for i in (0, 1))
                reach = np.zeros(upper.shape, bool)
                np.logical_or.at(reach, owner, (upper[owner] >= low[:, None]) & (lower[owner] <= high[:, None]))
                row, cell = np.nonzero(reach)
                n = parts[cell]
                row, shard = np.repeat(row, n), np.repeat(cells[cell] << 32, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for at in range(0, len(row), 4096):
                    part = batch.take(pa.array(row[at:at + 4096]))
                    yield pa.record_batch([pa.array(shard[at:at + 4096]), *part.columns], names=["s", *part.schema.names])

        def meet(batches):
            """A shard's tree comes first, then the anchors of one block."""
            tree = None
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    if batch.column("id")[i].as_py() is None:
                        tree = CoverTree.load(batch.column("tree")[i].as_py(), batch.column("size")[i].as_py())
                        continue
                    q_id, label, windows = (batch.column(c)[i].as_py() for c in ("id", "label", "windows"))
                    windows = [(w["low"], w["high"]) for w in windows]
                    q = batch.column("v")[i].values.to_numpy().astype(np.int64)
                    for (low, high), (ids, scores) in zip(windows, tree.search(q_id, label, q, windows, same, k, longest2)):
                        n = len(ids)
                        out.append((np.full(n, q_id), np.full(n, low), np.full(n, high), ids, scores))
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["id", "low", "high", "found", "score"])

        asked = map_arrow(anchors.select("id", "label", "v", "windows", block.alias("b")), route,
                          f"s long, id long, label long, v array<int>, windows {_WINDOWS}, b long")
        trees = self.trees.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
        both = trees.unionByName(asked, allowMissingColumns=True)
        local = map_arrow(both.repartition(shuffle_parts(both.sparkSession), "s", "b").sortWithinPartitions("s", "b", F.col("id").asc_nulls_first()),
                          meet, "id long, low long, high long, found long, score long")
        best = Window.partitionBy("id", "low", "high").orderBy(F.desc("score"), "found")
        return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> tuple[DataFrame, int] | None:
    """((id, label, v) of the rows that take part, written; their width), or None without any."""
    x = F.col("x")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c * scale) <= LARGEST, F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine & (F.size(x) > 0), F.lit(False)))
    rows = rows.select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v")) \
        .groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    rows = written(rows, "ct-integers")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.filter(F.size("v") == usual[0]), usual[0]) if usual else None


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``, ``label`` a column of ``vectors``; ``least``: the percentage of the positive's score that a
    negative must have.
    """
    held = integers(vectors, id_col, vector_col, label, scale)
    if held is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, width = held
    index = Index(rows, width, max(positives, negatives))
    anchors = rows.filter(is_anchor)
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    open_end = F.array(window(F.lit(-(1 << 61)), F.lit(1 << 61)))
    found = written(index.search(anchors.withColumn("windows", open_end), True, positives)
                    .select("id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "ct-positives")
    own = F.col("positive_score")
    windows = found.filter(own >= 0).groupBy("id").agg(F.collect_set(window(F.expr(f"(positive_score * {least} + 99) div 100"), own)).alias("windows"))
    hard = index.search(written(anchors.join(windows, "id"), "ct-windows"), False, negatives)
    hard = hard.select("id", F.col("high").alias("positive_score"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(hard, ["id", "positive_score"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
