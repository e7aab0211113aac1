"""Connected components of a link table, by contraction of written tables.

Each round, every node takes its smallest neighbour as parent, pointer jumping finds the roots of
that forest, and the links are rewritten between roots; the rounds end when no link is left. Each
partition first replaces its own links by a spanning forest, so that dense groups shrink before
anything is shuffled. Joins read written tables on both sides, which lets Spark split the
partitions of a node with very many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestream.scratch import Workspace, materialize

#: Links that one local forest takes in before it is given out.
_CHUNK = 1 << 19


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(tree: UnionFind) -> pa.RecordBatch:
        nodes = list(tree.parent)
        return pa.RecordBatch.from_arrays([pa.array([tree.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    tree, held = UnionFind(), 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tree.link(x, y)
        held += b.num_rows
        if held >= _CHUNK:
            yield flush(tree)
            tree, held = UnionFind(), 0
    if held:
        yield flush(tree)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Nulls and self-links are left out. The result is a written table; the tables of the rounds go.
    """
    with Workspace(links.sparkSession) as made:
        pairs = links.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
        edges = made.table(pairs.mapInArrow(_forest, "a bigint, b bigint").where("a <> b").distinct(), "cc-edges")
        labels = None
        while True:
            parents = above = made.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "cc-parents")
            while True:
                up = parents.select(F.col("node").alias("component"), F.col("component").alias("above"))
                jumped = made.table(parents.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")), "cc-parents")
                moved = jumped.where("moved").limit(1).count()
                made.drop(above)
                parents, above = jumped.drop("moved"), jumped
                if not moved:
                    break
            if labels is None:
                labels = parents
            else:
                up = parents.select(F.col("node").alias("component"), F.col("component").alias("above"))
                moved_up = labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
                labels = made.table(moved_up.unionByName(parents.join(labels, "node", "left_anti")), "cc-labels")
            root_a = parents.select(F.col("node").alias("a"), F.col("component").alias("root_a"))
            root_b = parents.select(F.col("node").alias("b"), F.col("component").alias("root_b"))
            met = edges.join(root_a, "a", "left").join(root_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
            met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            contracted = made.table(met, "cc-edges")
            made.drop(edges)
            edges = contracted
            if edges.limit(1).count() == 0:
                break
        roots = labels.select(F.col("component").alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        return materialize(labels.unionByName(roots), "cc-done")
