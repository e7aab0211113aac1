"""Exact nearest neighbours without reading all vectors.

Vectors are dealt into k-means cells and written in order of (cell, distance to the cell's centre).
By the triangle inequality a row of a cell whose centre is ``d`` away from the query is at least
``|d - r|`` away, ``r`` being the row's distance to the centre. So a query first reads the nearest
cells until they hold k rows, whose k-th distance ``t`` is a bound, and then the rows of every cell
with ``d - t <= r <= d + t``: conditions on (cell, r) that Parquet answers by row groups and pages.

A set of queries does the same in blocks: vectors lie packed in blocks of one cell, queries are sent
to the blocks that can hold one of their k nearest, and each meeting is a matrix product. A
similarity join sends blocks to groups of blocks. Neither side passes through the driver; it sees the
cells alone, at most ``MAX_CELLS``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lodestream.functions import vector
from lodestream.operators.retrieval import DIGITS, filtered
from lodestream.scratch import Workspace, drop_path, shared_dir

#: Cells at most, and vectors that the centres are learnt from: a hash sample of about so many. Every vector is in the index.
MAX_CELLS, SAMPLE = 4096, 50_000
#: Vectors, and queries, of one block.
BLOCK = 1024
#: Vectors of one group of a similarity join at most, about; smaller tables have about so many groups.
GROUP, GROUPS = 32 * BLOCK, 16
#: What a distance may be off by, relative and absolute.
SLACK = 1e-9, 1e-7


@dataclass(frozen=True)
class Cells:
    """Centres, numbers of rows and radii by cell number."""

    centres: np.ndarray
    n: np.ndarray
    radius: np.ndarray

    def distances(self, queries: np.ndarray) -> np.ndarray:
        squares = (queries * queries).sum(axis=1)[:, None] + (self.centres * self.centres).sum(axis=1) - 2 * queries @ self.centres.T
        return np.sqrt(np.maximum(squares, 0))


@dataclass(frozen=True)
class DenseIndex:
    """``rows``: the chunks with cell and r; ``blocks`` (cell, part, low, high, ids, vectors): the same vectors, packed."""

    rows: DataFrame
    blocks: DataFrame
    cells: Cells
    id_col: str
    vector_col: str


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length and without nulls."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                held = _matrix(part.column(0))
                squares = (held * held).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * held @ centres.T
                cell = squares.argmin(axis=1)
                r = np.sqrt(((held - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(r), *part.columns[1:]], ["cell", "r", *part.schema.names[1:]])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (cell, r, id, vector) that come in order of (cell, r)."""
    names, at, number = ["cell", "part", "low", "high", "ids", "vectors"], TaskContext.get().partitionId() << 32, 0
    for b in batches:
        cell, r = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        ends = np.unique(np.concatenate([cuts, [len(cell)], *(np.arange(s, e, BLOCK) for s, e in zip([0, *cuts], [*cuts, len(cell)], strict=True))])).astype(int)
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            held = _matrix(b.column(3).slice(s, e - s))
            ids = pa.array([b.column(2).slice(s, e - s)], pa.list_(b.schema.types[2]))
            yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + 1]), pa.array([at + number]), pa.array(r[s : s + 1]), pa.array(r[e - 1 : e]), ids, pa.array([held.tobytes()], pa.binary())], names)
            number += 1


def _centres(vectors: DataFrame, n: int, cells: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, SAMPLE / n)
    some = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
    model = KMeans(k=cells, maxIter=8, seed=7, featuresCol="f").fit(some.select(array_to_vector("v").alias("f")))
    return np.array(model.clusterCenters(), float)


def build(chunks: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding", cells: int | None = None) -> DenseIndex:
    """Write the index of ``chunks`` below ``path``: about the square root of their number of cells, or ``cells``.

    Null vectors, and such with null or non-finite components, stay out. All others have one length.
    """
    spark = chunks.sparkSession
    finite = F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = chunks.where(finite)
    with Workspace(spark) as made:
        plain = made.table(usable.withColumn("__vector", F.col(vector_col).cast("array<double>")), "dense-rows", "lz4")
        n = plain.count()
        if not n:
            raise ValueError("no vectors to build an index of")
        centres = _centres(plain.select(F.col("__vector").alias("v")), n, cells or int(min(MAX_CELLS, max(1, n**0.5))))
        others = [f for f in plain.schema.fields if f.name != "__vector"]
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType()), *others])
        dealt = made.table(plain.select("__vector", *(f.name for f in others)).mapInArrow(_assigned(centres), schema), "dense-dealt", "lz4")
        dealt.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.parquet(f"{path}/rows")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    kind = plain.schema[id_col].dataType
    packed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType())])
    in_order = rows.select("cell", "r", id_col, F.col(vector_col).cast("array<double>").alias("v")).repartitionByRange("cell", "r").sortWithinPartitions("cell", "r")
    in_order.mapInArrow(_packed, packed).write.parquet(f"{path}/blocks")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius"))
    listed = [(float(x), *map(float, c)) for x, c in enumerate(centres)]
    spark.createDataFrame([(int(i), list(c)) for i, *c in listed], "cell int, centre array<double>").join(sizes, "cell", "left").write.parquet(f"{path}/cells")
    return load(spark, path, id_col, vector_col)


def load(spark: SparkSession, path: str, id_col: str = "chunk_id", vector_col: str = "embedding") -> DenseIndex:
    held = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS at most
    cells = Cells(np.array([r.centre for r in held], float), np.array([r.n or 0 for r in held]), np.array([-1.0 if r.radius is None else r.radius for r in held]))
    return DenseIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), cells, id_col, vector_col)


def _within(t: float | np.ndarray):
    return t * (1 + SLACK[0]) + SLACK[1]


def ranges(index: DenseIndex, query: list[float], k: int, where: dict | None = None) -> list[tuple[int, float, float]]:
    """(cell, least r, greatest r) of what has to be read for the k nearest rows under a filter."""
    cells, q = index.cells, np.array(query, float)
    away = cells.distances(q[None])[0]
    order = [int(c) for c in np.argsort(away) if cells.n[c]]
    held, some, bound = 0, 0, np.inf
    distance = vector.squared_l2(F.col(index.vector_col), vector.literal(query))
    while some < len(order) and not np.isfinite(bound):
        wanted = max(k, 2 * held)  # under a filter, twice as many each time
        while some < len(order) and held < wanted:
            held += int(cells.n[order[some]])
            some += 1
        if some < len(order):
            first = filtered(index.rows.where(F.col("cell").isin(order[:some])), where).select(distance.alias("d")).orderBy("d").limit(k).collect()
            if len(first) == k:
                bound = float(first[-1].d) ** 0.5
    reach = _within(bound)
    return [(c, max(0.0, away[c] - reach), away[c] + reach) for c in order if away[c] - reach <= cells.radius[c]]


def dense_topk(index: DenseIndex, query: list[float], k: int, where: dict | None = None) -> DataFrame:
    """The k nearest chunks by squared L2 distance, as ``retrieval.dense_topk`` gives them, from the ranges that can hold them."""
    rows = index.rows
    if k < 1:
        keep = F.lit(False)
    else:
        found = ranges(index, query, k, where)
        in_range: Column = F.lit(False)
        for cell, low, high in found:
            in_range = in_range | ((F.col("cell") == cell) & F.col("r").between(float(low), float(high)))
        keep = F.col("cell").isin([c for c, *_ in found]) & in_range
    distance = F.round(vector.squared_l2(F.col(index.vector_col), vector.literal(query)), DIGITS)
    out = filtered(rows.where(keep), where).withColumn("distance", distance).orderBy("distance", index.id_col).limit(max(0, k))
    return out.withColumn("score", vector.score_of(F.col("distance"))).drop(index.vector_col, "cell", "r")


def _sent(cells: Cells, k: int | None):
    """Queries (query_id, query_vector, t) beside the cells that they have to see, with the range of r.

    With ``k``, these are the nearest cells that hold k rows; else all that ``t`` doesn't rule out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                queries = _matrix(part.column(1))
                away = cells.distances(queries)
                if k is None:
                    reach = _within(part.column(2).to_numpy())[:, None]
                    query, cell = np.nonzero((away - reach <= cells.radius) & (cells.n > 0))
                    middle, reach = away[query, cell], reach[query, 0]
                    low, high = middle - reach, middle + reach
                else:
                    order = np.argsort(np.where(cells.n > 0, away, np.inf), axis=1)
                    before = np.cumsum(cells.n[order], axis=1) - cells.n[order]
                    query, place = np.nonzero((before < k) & (cells.n[order] > 0))
                    cell = order[query, place]
                    low = high = away[query, cell]
                taken = pa.array(query)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(low), pa.array(high), part.column(0).take(taken), part.column(1).take(taken)], ["cell", "low", "high", "query_id", "query_vector"])

    return run


def _best(k: int, kinds: list[pa.DataType]):
    """Of each row (ids, vectors, query_ids, query_vectors): the k nearest vectors of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, query_ids = b.column(0)[i].values, b.column(2)[i].values
                rows, queries = np.frombuffer(b.column(1)[i].as_py()).reshape(len(ids), -1), np.array(b.column(3)[i].as_py(), float)
                quick = (rows * rows).sum(axis=1) + (queries * queries).sum(axis=1)[:, None] - 2 * queries @ rows.T
                most = min(k, len(ids))
                limit = np.partition(quick, most - 1, axis=1)[:, most - 1] + 1e-7 * (1 + (queries * queries).sum(axis=1))
                query, row = np.nonzero(quick <= limit[:, None])
                distance = np.round(((rows[row] - queries[query]) ** 2).sum(axis=1), DIGITS)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)).cast(kinds[0]), ids.take(pa.array(row)).cast(kinds[1]), pa.array(distance)], ["query_id", "id", "distance"])

    return run


def _meetings(index: DenseIndex, sent: DataFrame, made: Workspace) -> DataFrame:
    """(ids, vectors, query_ids, query_vectors): each block with about a block of the queries that are sent to it.

    Packed vectors are small as files, so Spark would broadcast them through the driver; hints rule that out.
    """
    sent = made.table(sent, "dense-sent", "lz4")
    ranges_ = made.table(index.blocks.select("cell", "part", F.col("low").alias("b_low"), F.col("high").alias("b_high")), "dense-ranges")
    pairs = sent.join(ranges_.hint("merge"), "cell").where((F.col("low") <= F.col("b_high")) & (F.col("high") >= F.col("b_low")))
    pairs = made.table(pairs.select("part", "query_id", "query_vector"), "dense-pairs", "lz4")
    times = pairs.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("times"))
    dealt = pairs.join(times.hint("merge"), "part").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.col("times")))
    asked = dealt.groupBy("part", "deal").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query_vector").alias("query_vectors"))
    return asked.join(index.blocks.select("part", "ids", "vectors").hint("merge"), "part").select("ids", "vectors", "query_ids", "query_vectors")


def _met(index: DenseIndex, sent: DataFrame, k: int, made: Workspace) -> DataFrame:
    """(query_id, id, distance, rank): for each query, its k nearest of the blocks that it meets."""
    from pyspark.sql.pandas.types import to_arrow_type

    both = _meetings(index, sent, made)
    query_kind, id_kind = (both.schema[c].dataType.elementType for c in ("query_ids", "ids"))
    found = both.mapInArrow(_best(k, [to_arrow_type(query_kind), to_arrow_type(id_kind)]), T.StructType([T.StructField("query_id", query_kind), T.StructField("id", id_kind), T.StructField("distance", T.DoubleType())]))
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _sent_schema(id_kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("query_id", id_kind), T.StructField("query_vector", T.ArrayType(T.DoubleType()))])


def dense_batch_topk(index: DenseIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance) for each of ``queries`` (query_id, query_vector), as ``retrieval.dense_batch_topk`` gives them.

    A query's bound is the k-th distance among the rows of the nearest cells that lie as far from the
    centre as it does; where these blocks hold fewer than k rows, there is no bound and it meets all blocks.
    """
    with Workspace(index.rows.sparkSession) as made:
        plain = queries.where(F.col("query_vector").isNotNull()).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        schema = _sent_schema(queries.schema["query_id"].dataType)
        bounds = _met(index, plain.mapInArrow(_sent(index.cells, k), schema), k, made).where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("t"))
        bounds = made.table(bounds, "dense-bounds")
        bounded = plain.join(bounds, "query_id", "left").select("query_id", "query_vector", F.coalesce("t", F.lit(float("inf"))).alias("t"))
        out = made.table(_met(index, bounded.mapInArrow(_sent(index.cells, None), schema), k, made), "dense-batch")
        made.keep(out)
    return out.select("query_id", "rank", F.col("id").alias(index.id_col), "distance")


def _groups(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """By cell: its first group and their number. Neighbouring small cells share one, a large cell has several."""
    room = min(GROUP, max(BLOCK, -(-int(cells.n.sum()) // GROUPS)))
    first, times, group, held = np.zeros(len(cells.n), int), np.maximum(1, -(-cells.n // room)), 0, 0
    middle = cells.centres - cells.centres.mean(axis=0)
    for c in np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable").tolist():
        if held and held + cells.n[c] > room:
            group, held = group + 1, 0
        first[c] = group
        group, held = (group + int(times[c]), 0) if times[c] > 1 else (group, held + int(cells.n[c]))
    return first, times


def _dealt(cells: Cells, far: float):
    """Blocks (cell, part, low, high, ids, vectors) beside their group and the groups that a distance lets them meet."""
    first, times = _groups(cells)
    of_cell = [np.arange(f, f + t) for f, t in zip(first.tolist(), times.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, part, low, high = (b.column(i).to_numpy() for i in range(4))
            own = first[cell] + (part % 1_000_003) % times[cell]
            away = cells.distances(cells.centres[cell]) - cells.radius
            near = (away - high[:, None] <= far) & (low[:, None] - away - 2 * cells.radius <= far) & (cells.n > 0)
            others = [np.unique(np.concatenate([of_cell[c] for c in np.flatnonzero(x)])) for x in near]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(others, pa.list_(pa.int32())), *b.columns], ["own", "others", *b.schema.names])

    return run


def _alike(threshold: float, centres: np.ndarray, far: float):
    """(a, b, weight) of rows (left, right, own, cell, low, high, ids, vectors) that come in order of their first three columns.

    The blocks of a pair's left group are held, those of the right one follow and meet them.
    """

    def meeting(x: tuple, y: tuple) -> Iterator[pa.RecordBatch]:
        between = float(np.sqrt(((centres[x[0]] - centres[y[0]]) ** 2).sum()))
        if max(between - x[2] - y[2], x[1] - between - y[2], y[1] - between - x[2]) > far:
            return
        cosine = (x[4] @ y[4].T).ravel()
        at = np.flatnonzero(cosine >= threshold)
        i, j = np.divmod(at, len(y[4]))
        if x is y:
            at, i, j = at[i < j], i[i < j], j[i < j]
        if len(at):
            yield pa.RecordBatch.from_arrays([x[3].take(pa.array(i)), y[3].take(pa.array(j)), pa.array(cosine[at])], ["a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for b in batches:
            lefts, rights, owns, cells, lows, highs = (b.column(i).to_pylist() for i in range(6))
            for i in range(b.num_rows):
                if pair != (lefts[i], rights[i]):
                    pair, held = (lefts[i], rights[i]), []
                ids = b.column(6)[i].values
                ids = ids.take(pa.array(np.arange(len(ids))))  # a copy, which doesn't keep its batch
                block = cells[i], lows[i], highs[i], ids, np.frombuffer(b.column(7)[i].as_py()).reshape(len(ids), -1)
                if owns[i] == lefts[i]:
                    held.append(block)
                if owns[i] == rights[i]:
                    for x in held:
                        yield from meeting(x, block)

    return run


def similar_pairs(chunks: DataFrame, threshold: float, id_col: str = "chunk_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """(src, dst, weight): all pairs, src < dst, with a cosine of ``threshold``, above 0, or more.

    Unit vectors with such a cosine are no farther apart than the square root of 2 - 2 * threshold.
    Blocks are dealt to pairs of groups of neighbouring cells, each only to the groups that lie that
    near, and inside a pair only blocks whose shells do are multiplied. So a vector is sent once for
    each group, whatever bounds leave, and no pair of a vector with a block is a row. Pairs are made
    where they are used; the index they come from stays in the shared folder.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed")
    spark = chunks.sparkSession
    norm = vector.norm(F.col("v"))
    rows = chunks.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit = F.get(F.transform(F.array(norm), lambda n: F.transform("v", lambda x: x / n)), F.lit(0))  # one norm a vector, not one a component
    units = rows.where(norm > 0).select("id", unit.alias("v"))
    with Workspace(spark) as made:
        units = made.table(units, "dense-units", "lz4")
        kind = units.schema["id"].dataType
        if not units.limit(1).count():
            return spark.createDataFrame([], T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("weight", T.DoubleType())]))
        path = f"{shared_dir(spark)}/lodestream/dense-{uuid.uuid4().hex}"
        index = build(units, path, "id", "v", cells)
        drop_path(spark, f"{path}/rows")
    far = float(_within(np.sqrt(max(0.0, 2 - 2 * threshold))))
    kinds = {f.name: f for f in index.blocks.schema.fields}
    blocks = index.blocks.select("cell", "part", "low", "high", "ids", "vectors")
    beside = T.StructType([T.StructField("own", T.IntegerType()), T.StructField("others", T.ArrayType(T.IntegerType())), *(kinds[c] for c in blocks.columns)])
    sent = blocks.mapInArrow(_dealt(index.cells, far), beside).withColumn("other", F.explode("others"))
    pairs = sent.select(F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "cell", "low", "high", "ids", "vectors")
    first, times = _groups(index.cells)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * int((first + times).max()))  # a number, or few bytes would be taken for little work
    dealt = pairs.repartition(tasks, "left", "right").sortWithinPartitions("left", "right", "own")
    found = dealt.mapInArrow(_alike(threshold, index.cells.centres, far), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("weight", T.DoubleType())]))
    return found.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")


def share_met(index: DenseIndex, far: float) -> float:
    """Of all meetings of a vector with a block, the share that a distance leaves; for vectors of the index itself."""
    spans = index.blocks.select("cell", "low", "high").collect()  # a row for about a thousand vectors
    away = np.sqrt(np.maximum(((index.cells.centres[:, None] - index.cells.centres[None]) ** 2).sum(axis=2), 0))
    met = total = 0
    for x in spans:
        for y in spans:
            # the least distance between a point of a shell around one centre and a point of a shell around another
            gap = max(away[x.cell, y.cell] - x.high - y.high, x.low - away[x.cell, y.cell] - y.high, y.low - away[x.cell, y.cell] - x.high)
            met += gap <= far
            total += 1
    return met / total
