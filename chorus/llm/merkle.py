"""Operator 13: a Merkle manifest of a dataset, with inclusion proofs for its rows.

Rows become leaves, the leaves of a source a tree, the sources' roots one tree above. A node is the
sha256 of its children's hex digests, three children a node, fewer in the last run of a level.

Store: one record for every inner node, digest -> children, addressed by content alone. Records lie in
pages: a page holds the subtree of one node down to ``HEIGHT`` levels below (3 ** HEIGHT nodes at
most), named by that node's digest. So a tree of n leaves is built by one shuffle a tier of HEIGHT levels,
and no task sees more than one page at a time, whatever a source's share of the rows is.

Proofs: leaf requests descend from the root. At each record the digit of the rank, base three, picks the
child to go to, and the children not picked are collected; a page's requests go down together, and pages
above the lowest are asked once for each page below, not for each leaf. The path from the root is a list of
segments; reversed it is the proof. A segment is the run's digests with ``*`` in place of the picked one, so a proof
needs nothing else to be folded: ``fold`` puts the digest in, hashes and goes on.

Ranks: leaves are dealt by range of (source, key, digest, row), counted by part, and numbered within parts
from the parts' offsets; no window runs over a source.

Defined results: a null field is ``-``, an empty one ``0:``; keys that are null come first, rows with
equal keys stand by leaf digest; repeated rows are leaves of their own; no rows give no tree and no
proofs; other columns are not read unless named as fields.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import ship, shuffle_parts, written

FAN, HEIGHT = 3, 8


def field(c: Column) -> Column:
    """``-`` for a null, else the number of bytes, a colon and the value as text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    """The leaf of a row: hex sha256 of its fields."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, run: F.sha2(F.replace(run, F.lit("*"), below), 256))


def siblings(proof: Column) -> Column:
    """The collected digests one after another, from the leaf's level to the root's."""
    return F.replace(F.array_join(proof, ""), F.lit("*"), F.lit(""))


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def _group(source: Column) -> Column:
    """A text that is never null and orders as the sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a written table with ``g``) with ``rank`` (from 0) and ``n`` of each group ``g``."""
    placed = written(rows.repartitionByRange(shuffle_parts(rows.sparkSession), "g", *order)
                     .withColumn("part", F.spark_partition_id()), "merkle-placed")
    group, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size")) \
        .select("g", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(group).alias("n"))
    inside = Window.partitionBy("g", "part").orderBy(*order)
    return placed.withColumn("inside", F.row_number().over(inside) - 1).join(written(parts, "merkle-parts"), ["g", "part"]) \
        .withColumn("rank", F.col("start") + F.col("inside")).drop("part", "start", "inside")


def _at(tier: int) -> Column:
    """Nodes of the group at this tier."""
    size = FAN ** (HEIGHT * tier)
    return F.expr(f"(n + {size - 1}L) div {size}L")


class Forest:
    """The trees of all groups: ``records`` (page, digest, children) and ``roots`` (g, n, digest)."""

    def __init__(self, nodes: DataFrame):
        """nodes: (g, rank, n, digest)."""

        span = HEIGHT

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            group, number, here, n = (k.as_py() for k in key)
            level = table.sort_by("rank")["digest"].to_pylist()
            made: list[tuple[str, list[str] | None]] = []
            for _ in range(min(span, height(here))):
                runs = [level[i:i + FAN] for i in range(0, len(level), FAN)]
                level = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
                made += zip(level, runs)
            made.append((level[0], None))  # the page's own root, a node of the next tier
            same = lambda v, t: pa.array([v] * len(made), t)
            return pa.table({"g": same(group, pa.string()), "rank": same(number, pa.int64()), "n": same(n, pa.int64()),
                             "page": same(level[0], pa.string()), "digest": pa.array([d for d, _ in made], pa.string()),
                             "children": pa.array([c for _, c in made], pa.list_(pa.string()))})

        ship(nodes.sparkSession)
        self.tiers, self.roots, records = 0, nodes.filter("n = 1").select("g", "n", "digest"), None
        most = nodes.agg(F.max("n")).first()[0] or 0
        now = nodes
        while most > FAN ** (HEIGHT * self.tiers):
            here = now.select("g", "rank", "n", "digest").filter(_at(self.tiers) > 1)
            made = written(here.groupBy("g", F.expr(f"rank div {FAN ** HEIGHT}L").alias("number"), _at(self.tiers).alias("size"), "n")
                           .applyInArrow(build, "g string, rank long, n long, page string, digest string, children array<string>"), "merkle-pages")
            now = made.filter("children is null")
            new = made.filter("children is not null").select("page", "digest", "children")
            records = new if records is None else records.unionByName(new)
            self.tiers += 1
            self.roots = self.roots.unionByName(now.filter(_at(self.tiers) == 1).select("g", "n", "digest"))
        schema = "page string, digest string, children array<string>"
        #: Equal subtrees have equal pages, which are kept once.
        self.records = nodes.sparkSession.createDataFrame([], schema) if records is None else \
            written(records.dropDuplicates(["page", "digest"]), "merkle-records")

    def descend(self, requests: DataFrame, start: DataFrame) -> DataFrame:
        """``requests`` (g, rank, ...) with the ``tree`` they lie in, its ``n``, the ``found`` digest and the ``path`` from the root.

        ``start``: (g, n, digest, path): the roots to start from and the segments above them.
        """
        front = start.select("g", "n", F.lit(0).cast("long").alias("number"), "digest", F.col("digest").alias("tree"), "path")
        for tier in range(self.tiers - 1, -1, -1):
            step = FAN ** (HEIGHT * tier)
            inner, rest = front.filter(_at(tier) > 1), front.filter(_at(tier) <= 1)
            wanted = requests.select("g", F.expr(f"rank div {step}L").alias("rank")).distinct() if tier else requests
            front = self._pages(wanted, inner, _at(tier))
            if tier:
                front = front.select("g", "n", F.col("rank").alias("number"), F.col("found").alias("digest"), "tree", "path")
                front = written(front.unionByName(rest), "merkle-front")
        alone = requests.join(rest if self.tiers else front, "g").withColumnRenamed("digest", "found").drop("number")
        return front.unionByName(alone) if self.tiers else alone

    def _pages(self, wanted: DataFrame, front: DataFrame, size: Column) -> DataFrame:
        """One tier down: every page's requests meet the page's records and the path to the page."""
        own, span = wanted.columns, HEIGHT
        front = front.select(*[F.col(c).alias(c) for c in front.columns])  # both sides may stem from one table
        paths = front.select("g", "number", "n", size.alias("size"), "digest", F.col("path").alias("children"), "tree")
        records = front.select("g", "number", F.col("digest").alias("page")).join(self.records, "page").select(
            "g", "number", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("size"), "digest", "children",
            F.lit(None).cast("string").alias("tree"))

        def run(asked: pa.Table, page: pa.Table) -> pa.Table:
            if not asked.num_rows or not page.num_rows:
                return pa.table({f.name: pa.array([], f.type) for f in asked.schema if f.name in own} | {
                    "n": pa.array([], pa.int64()), "tree": pa.array([], pa.string()), "found": pa.array([], pa.string()),
                    "path": pa.array([], pa.list_(pa.string()))})
            top = next(r for r in page.filter(pc.is_valid(page["tree"])).to_pylist())
            below = page.filter(pc.is_null(page["tree"]))
            children = dict(zip(below["digest"].to_pylist(), below["children"].to_pylist()))
            place = asked["rank"].to_numpy() % FAN ** span
            levels = min(span, height(top["size"]))
            node, names = {0: top["digest"]}, list(top["children"])
            steps = [np.tile(np.arange(len(names)), (len(place), 1))]
            for h in range(levels - 1, -1, -1):  # digit by digit, the root's first
                at = place // FAN ** h
                went, where = {}, {}
                for i in np.unique(at).tolist():
                    run_ = children[node[i // FAN]]
                    went[i] = run_[i % FAN]
                    where[i] = len(names)
                    names.append("".join(run_[:i % FAN]) + "*" + "".join(run_[i % FAN + 1:]))
                node = went
                steps.append(np.array([where[i] for i in at.tolist()])[:, None])
            segments = np.hstack(steps)
            flat = pa.array(names, pa.string()).take(pa.array(segments.reshape(-1)))
            path = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * segments.shape[1], pa.int32()), flat)
            out = {c: asked[c] for c in own}
            return pa.table(out | {"n": pa.array([top["n"]] * len(place), pa.int64()), "tree": pa.array([top["tree"]] * len(place), pa.string()),
                                   "found": pa.array([node[i] for i in place.tolist()], pa.string()), "path": path})

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
        return wanted.withColumn("number", F.expr(f"rank div {FAN ** HEIGHT}L")).groupBy("g", "number") \
            .cogroup(paths.unionByName(records).groupBy("g", "number")) \
            .applyInArrow(run, f"{types}, n long, tree string, found string, path array<string>")


class Manifest:
    """The manifest of rows (source, key, leaf, ...): trees of the sources, a tree above them, one root.

    ``leaves``: (g, rank, n, digest, row): the rows, whole, with their rank in the source and its size;
    ``root`` is None without rows.
    """

    def __init__(self, rows: DataFrame, source: str = "source", key: str = "doc_id", leaf: str = "leaf"):
        kept = rows.select(_group(F.col(source)).alias("g"), F.col(key).alias("key"), F.col(leaf).alias("digest"),
                           F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("line"))
        self.leaves = written(ranked(written(kept, "merkle-leaves"), ["key", "digest", "line"])
                              .select("g", "rank", "n", "digest", "row"), "merkle-ranked")
        self.sources = Forest(self.leaves)
        tops = self.sources.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("n").alias("rows"), "digest")
        self.tops = written(ranked(written(tops, "merkle-subroots"), ["name"]), "merkle-tops")
        self.above = Forest(self.tops)
        top = self.above.roots.first()
        self.root = top["digest"] if top else None

    def prove(self, requests: DataFrame) -> DataFrame:
        """Some or all rows of ``leaves``, each once: their columns with ``subroot``, ``root`` and ``proof``."""
        start = self.above.roots.select("g", "n", "digest", F.array().cast("array<string>").alias("path"))
        upper = self.above.descend(self.tops.select("g", "rank", "name", "rows"), start)
        upper = written(upper.select(F.col("name").alias("g"), F.col("rows").alias("n"), F.col("found").alias("digest"), "path"), "merkle-upper")
        found = self.sources.descend(requests.select("g", "rank", "row"), upper)
        return found.select("row.*", F.col("tree").alias("subroot"), F.lit(self.root).alias("root"), F.reverse("path").alias("proof"))
