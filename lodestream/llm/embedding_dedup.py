"""Near-duplicate vectors by lattice hashing.

Vectors are scaled to length 1. Each of some random projections maps them to 16 dimensions or more,
read as points of 8; decoding each to the nearest point of the lattice E8 gives the vector's
cell in the table. A vector is filed under its own cell and looks into the neighbouring cells: those
whose nearest point changes when the projection moves a little towards the next best lattice point.
Pairs that meet in some cell are verified by their cosine in double precision.

Equal vectors are one class first, so copies cost nothing. A cell with company is worked on in blocks
of about ``BLOCK`` members; each pair of blocks is a part of its own, and a matrix product verifies
its pairs, so a large cell spreads over tasks of bounded size. A part gives out each member's number
of links and a spanning forest, never its pairs. A pair that meets in several cells counts in the
first one only, which the members' cells tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm import kernel
from lodestream.llm.components import UnionFind, connected_components
from lodestream.scratch import Workspace, drop_table

class Shape(NamedTuple):
    """Tables, lattice points that a table's cell is made of (8 projected dimensions each), and neighbouring cells probed for each table."""

    tables: int
    points: int
    probes: int


#: By the number of distinct vectors up to which a shape serves. More points make cells smaller, more
#: tables and probes keep the share of pairs at cosine 0.95 that meet: 0.993, 0.996 and 0.992 measured.
SHAPES = {10**7: Shape(6, 2, 4), 2 * 10**9: Shape(12, 3, 8), 10**12: Shape(24, 4, 8)}
#: Members of a cell that one matrix product takes on each side.
BLOCK = 1024
#: The projected distance of two vectors at the threshold, in units where E8's packing radius is 0.71.
REACH = 0.45
_SEED = 20240611


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of 8 numbers, doubled to integers.

    E8 is D8 together with D8 shifted by one half in every place; D8 has the integer points of even
    sum, and its nearest point is rounding, with the worst rounded place turned around if the sum is odd.
    """
    best = distance = None
    for shift in (0.0, 0.5):
        y = x - shift
        point = np.rint(y)
        rest = y - point
        odd = np.flatnonzero(point.sum(axis=1) % 2)
        worst = np.abs(rest[odd]).argmax(axis=1)
        point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        point += shift
        d = ((x - point) ** 2).sum(axis=1)
        if best is None:
            best, distance = point, d
        else:
            closer = d < distance
            best = np.where(closer[:, None], point, best)
    return np.rint(2 * best).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest points of E8, as real coordinates."""
    pairs = [v for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    halves = [[0.5 if m >> k & 1 else -0.5 for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(pairs + halves, float)


def shape_for(vectors: int) -> Shape:
    """The shape whose cells stay small for so many distinct vectors."""
    return next((shape for most, shape in SHAPES.items() if vectors <= most), SHAPES[max(SHAPES)])


class Lattice:
    """Cells and probes of unit vectors of one dimension at one threshold."""

    def __init__(self, dims: int, least: float, shape: Shape = SHAPES[10**7]):
        rng = np.random.default_rng(_SEED + dims)
        self.shape = shape
        width = 8 * shape.points
        scale = REACH / np.sqrt(2 - 2 * least) * np.sqrt(dims / 8)
        self.maps = rng.standard_normal((shape.tables, dims, width)) / np.sqrt(dims) * scale
        self.shifts = rng.uniform(0, 2, (shape.tables, width))
        self.roots = _roots()

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each vector and table, and the probed ones: hashes (n, tables) and (n, tables, probes)."""
        n, (n_tables, n_points, n_probes) = len(unit), self.shape
        own, probes = np.empty((n, n_tables), np.int64), np.empty((n, n_tables, n_probes), np.int64)
        for t in range(n_tables):
            x = (unit @ self.maps[t] + self.shifts[t]).reshape(n, n_points, 8)
            points = [nearest_e8(x[:, p]) for p in range(n_points)]
            own[:, t] = self._hash(t, points)
            # how much farther each neighbouring point is than the nearest one: the Voronoi walls
            costs, steps = [], []
            for p in range(n_points):
                rest = x[:, p] - points[p] / 2
                gap = 1 - rest @ self.roots.T  # half of |root|^2 less the projection on the root
                near = np.argpartition(gap, n_probes, axis=1)[:, :n_probes]
                costs.append(np.take_along_axis(gap, near, axis=1))
                steps.append(near)
            cost, step = np.concatenate(costs, axis=1), np.concatenate(steps, axis=1)
            side = np.repeat(np.arange(n_points), n_probes)
            for k, column in enumerate(np.argsort(cost, axis=1)[:, :n_probes].T):
                which = side[column]
                root = np.rint(2 * self.roots[step[np.arange(n), column]]).astype(np.int64)
                moved = [points[p] + root * (which == p)[:, None] for p in range(n_points)]
                probes[:, t, k] = self._hash(t, moved)
        return own, probes

    @staticmethod
    def _hash(table: int, points: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.full(len(points[0]), np.uint64(table + 1))
            for column in np.concatenate(points, axis=1).T:
                out = kernel.mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        return out.view(np.int64)


def usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None for a null, an empty or zero vector and null or non-finite components."""
    out: list[np.ndarray | None] = [None] * len(column)
    offsets = column.offsets.to_numpy()
    values = column.values
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        row = flat[s:e]
        if valid[i] and nulls[e] == nulls[s] and e > s and np.isfinite(row).all() and row.any():
            out[i] = row + 0.0  # no negative zeros
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, digest, vector) from (vec, embedding); nulls where a vector links with nothing."""
    for b in batches:
        data = [None if x is None else x.tobytes() for x in usable(b.column(1))]
        digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], names=["vec", "digest", "vector"])


def unit(rows: list[bytes]) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1; large and small components don't overflow."""
    out = np.frombuffer(b"".join(rows)).reshape(len(rows), -1)
    out = out / np.abs(out).max(axis=1)[:, None]
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _file(least: float, shape: Shape):
    """(rep, cells): for each table a class's own cell and those it probes, as int64 (tables, 1 + probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for b in batches:
            vectors, out = b.column(1).to_pylist(), [b""] * b.num_rows
            sizes = np.array([len(v) // 8 for v in vectors])
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                own, probes = lattices.setdefault(int(dims), Lattice(int(dims), least, shape)).cells(unit([vectors[i] for i in at]))
                cells = np.concatenate([own[:, :, None], probes], axis=2) ^ int(dims)
                for i, x in zip(at, cells, strict=True):
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, kernel.binaries(out)], names=[*b.schema.names, "cells"])

    return run


def _listed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, rep, home) of every cell that a class is in; its own cells are home."""
        home = np.tile(np.arange(1 + shape.probes) == 0, shape.tables)
        for b in batches:
            cells = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), len(home))), pa.array(np.tile(home, b.num_rows))], names=["cell", "rep", "home"])

    return run


class _Side:
    """The members of one block of a cell: ids, copies, unit vectors and cells by table."""

    def __init__(self, rows: list[tuple], shape: Shape):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.unit = unit([r[2] for r in rows])
        self.cells = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), shape.tables, 1 + shape.probes)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell in which pairs of rows (n, tables, 1 + probes) are counted: in the first table where
    they meet, the smaller of the home cells that both are in; the greatest number where there is none."""
    top = np.iinfo(np.int64).max
    out, left = np.full(len(a), top), np.ones(len(a), bool)
    for t in range(a.shape[1]):
        one = np.where((b[:, t] == a[:, t, :1]).any(axis=1), a[:, t, 0], top)
        two = np.where((a[:, t] == b[:, t, :1]).any(axis=1), b[:, t, 0], top)
        cell = np.minimum(one, two)
        met = left & (cell != top)
        out[met], left = cell[met], left & ~met
    return out


def _links(cell: int, one: _Side, two: _Side | None, least: float) -> tuple[dict[int, int], UnionFind]:
    """What the pairs of two blocks, or within one, add to their members' link counts, and a forest of them."""
    other = one if two is None else two
    counts, tree = np.zeros(len(one.ids), np.int64), UnionFind()
    counts_other = counts if two is None else np.zeros(len(other.ids), np.int64)
    for s in range(0, len(one.ids), 256):
        near = one.unit[s : s + 256] @ other.unit.T >= least - 1e-9
        i, j = np.nonzero(near)
        i += s
        ok = one.ids[i] < other.ids[j] if two is None else one.ids[i] != other.ids[j]
        i, j = i[ok], j[ok]
        ok = (np.einsum("ij,ij->i", one.unit[i], other.unit[j]) >= least) & (_first_meeting(one.cells[i], other.cells[j]) == cell)
        i, j = i[ok], j[ok]
        np.add.at(counts, i, other.copies[j])
        np.add.at(counts_other, j, one.copies[i])
        for x, y in zip(one.ids[i].tolist(), other.ids[j].tolist(), strict=True):
            tree.link(x, y)
    total: dict[int, int] = {}
    for ids, c in ((one.ids, counts), *(() if two is None else ((other.ids, counts_other),))):
        for x, n in zip(ids.tolist(), c.tolist(), strict=True):
            if n:
                total[x] = total.get(x, 0) + n
    return total, tree


def _meet(least: float, shape: Shape):
    """(a, b, n) from sorted rows (cell, low, high, block, dims, rep, copies, vector, cells): link counts
    (a, null, n) and a forest of links (a, b, null). Holds the two blocks of one part of a cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, {}

        def flush() -> pa.RecordBatch:
            cell, low, high, _ = key
            one, two = (_Side(blocks[k], shape) if k in blocks else None for k in (low, high))
            total, tree = ({}, UnionFind()) if one is None or two is None else _links(cell, one, None if low == high else two, least)
            nodes = list(tree.parent)
            a = [*total, *(tree.root(x) for x in nodes)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(total) + nodes, pa.int64()), pa.array([*total.values(), *[None] * len(nodes)], pa.int64())], names=["a", "b", "n"])

        for b in batches:
            for cell, low, high, block, dims, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (cell, low, high, dims) != key:
                    if key is not None:
                        yield flush()
                    key, blocks = (cell, low, high, dims), {}
                blocks.setdefault(block, []).append(tuple(member))
        if key is not None:
            yield flush()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row for each row of ``vectors``: id_col, n_links, component_id, kept.

    Vectors whose cosine is ``least`` or more are linked, if they meet in a cell of some table; none
    below it. n_links counts other vectors linked directly, copies included. Defined results: a null
    or empty vector, one of zeros and one with a null or non-finite component has no links and is a
    component of its own; vectors of different lengths never link; a row with a null id has no
    links, a null component and is kept; rows that repeat id and vector are one vector; rows that
    share an id but not the vector are one node, whose links add up; other columns play no part; an
    empty table gives an empty one.
    """
    with Workspace(vectors.sparkSession) as made:
        plain = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(vector_col).cast("array<double>").alias("embedding"))
        rows = made.table(plain.mapInArrow(_prepare, "vec bigint, digest binary, vector binary"), "ed-rows")
        usable_rows = rows.where("vec is not null and digest is not null")
        copies = usable_rows.select("digest", "vec").distinct().groupBy("digest").agg(F.count("*").alias("copies"))
        classes = usable_rows.groupBy("digest").agg(F.min(F.struct("vec", "vector")).alias("first"))
        classes = made.table(classes.join(copies, "digest").select("digest", F.col("first.vec").alias("rep"), F.col("first.vector").alias("vector"), "copies"), "ed-distinct")
        shape = shape_for(classes.count())
        filed = classes.select("rep", "vector", "digest", "copies").mapInArrow(_file(least, shape), "rep bigint, vector binary, digest binary, copies bigint, cells binary")
        filed = made.table(filed, "ed-classes")
        made.drop(classes)
        listed = made.table(filed.select("rep", "cells").mapInArrow(_listed(shape), "cell bigint, rep bigint, home boolean").distinct(), "ed-cells")
        full = listed.groupBy("cell").agg(F.count("*").alias("members"), F.max("home").alias("home")).where("members > 1 and home")
        full = made.table(full.select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "ed-full")
        met = made.table(listed.join(full, "cell").select("cell", "rep", "blocks").distinct(), "ed-met")
        made.drop(listed, full)
        parts = met.withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = parts.select("cell", "rep", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        joined = parts.join(filed.select("rep", "copies", "vector", "cells"), "rep").withColumn("dims", F.octet_length("vector"))
        laid = joined.select("cell", "low", "high", "block", "dims", "rep", "copies", "vector", "cells").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "dims")
        found = made.table(laid.mapInArrow(_meet(least, shape), "a bigint, b bigint, n bigint"), "ed-links")
        components = connected_components(found.where("b is not null").select("a", "b"))
        counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        known = filed.select("digest", "rep", "copies").join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
        known = known.where("copies > 1 or n is not null or component is not null")
        known = made.table(known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "ed-known")
        drop_table(vectors.sparkSession, components)
        made.keep(rows, known)
    out = rows.select("vec", F.when(F.col("vec").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.when(F.col("vec").isNotNull(), F.coalesce("component", "vec"))
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
), walk AS (
  WITH RECURSIVE w(node, root) AS (
    SELECT node, root FROM reach
    UNION
    SELECT l.b, w.root FROM w JOIN links l ON l.a = w.node WHERE w.root < l.b
  )
  SELECT node, min(root) AS root FROM w GROUP BY node
)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, walk.root AS component_id, walk.root = e.vec_id AS kept
FROM embeddings e JOIN walk ON walk.node = e.vec_id LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
"""
