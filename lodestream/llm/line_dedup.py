"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without white space at its ends and with A-Z lower-cased. The *exact
reference table* has one row for each key and document that holds it; from it come, for each key,
the number of references and the owner, which is the smallest document id. The *filters* hold the
keys with two documents or more, one filter a shard. A line is looked up in its shard's filter
first, and only what the filter lets through meets the exact table, so false positives cost a join
row and never a line. Once an index changes, its three tables are laid out in ``PARTS`` folders by key;
inserting or deleting documents reads and writes only the folders that their keys lie in, and the
filters change by the keys whose state changed.

No step gathers a key's documents in one task: references are aggregated with map-side partials,
lookups of a hot shard are dealt out over salts in proportion to its rows, and the join with the
exact table is a plain equi-join whose skewed partitions Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestream.llm import kernel
from lodestream.llm.cuckoo import CuckooFilter, FilterFull
from lodestream.scratch import drop_table, materialize, rows_written, write_table

#: Shards at least; enough of them that shuffle partitions fill evenly.
MIN_SHARDS = 2048
#: Keys that one shard's filter is meant to hold.
SHARD_KEYS = 1 << 18
#: Shards at most, so that the table of salts stays below a megabyte when it is broadcast.
MAX_SHARDS = 1 << 16

#: Folders that the tables of a changing index are laid out in; fewer than shards.
PARTS = 1024

_KEYS = "k1 bigint, k2 bigint"


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and ``first`` of the lines between \n; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    order = np.sort(np.concatenate([2 * breaks + 1, 2 * offsets[1:]]))
    ends = order // 2
    last = np.flatnonzero(order % 2 == 0)
    first = np.concatenate([[0], last + 1])
    starts = np.empty(len(ends), np.int64)
    starts[1:] = ends[:-1] + order[:-1] % 2
    starts[:1] = 0
    return starts, ends, first


class LineKeys:
    """Keys of all lines of a pass: two independent 64-bit hashes and the length in code points."""

    def __init__(self):
        self.hashes = kernel.SpanHash(0), kernel.SpanHash(1)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        data = kernel.lower_ascii(raw[offsets[0] : offsets[-1]])
        starts, ends, first = split_lines(data, offsets - offsets[0])
        black = np.flatnonzero(~kernel.SPACE[data])
        a, b = np.searchsorted(black, starts), np.searchsorted(black, ends)
        some = b > a
        left, right = starts.copy(), starts.copy()
        left[some], right[some] = black[a[some]], black[b[some] - 1] + 1
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        k1, k2 = (h(data, left, right).view(np.int64) for h in self.hashes)
        return k1, k2, points[right] - points[left], first


def _key_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = LineKeys()
        for b in batches:
            raw, offsets = kernel.buffers(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in kernel.passes(offsets, kernel.SMALL_PASS):
                k1, k2, n, first = keys(raw, offsets[i : j + 1])
                row = np.repeat(np.arange(i, j), np.diff(first))
                keep = n >= min_chars
                k1, k2, row = k1[keep], k2[keep], row[keep]
                order = np.lexsort((k2, k1, row))
                k1, k2, row = k1[order], k2[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(k2[new]), pa.array(ids[row[new]])], ["k1", "k2", "doc"])

    return run


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(k1, k2, doc): each key of ``min_chars`` code points or more and each document holding it."""
    pairs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(kernel.tidied(_key_rows(min_chars)), f"{_KEYS}, doc bigint")


def _shared(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_refs, owner) of the keys that two documents or more hold."""
    counted = refs.groupBy("k1", "k2").agg(F.count("*").alias("n_refs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))
    return counted.where(F.col("owner") < F.col("last")).drop("last")


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("k2", 16), F.lit(shards)).cast("int").alias("shard")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True) if len(values) else iter(())


_FILTERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("filter", T.BinaryType())])
_FILTERS_ARROW = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])


def _filters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each run of equal shards in sorted rows; holds one shard's keys at a time."""
    at, parts = None, []

    def flush():
        blob = CuckooFilter.of(np.concatenate(parts)).to_bytes()
        return kernel.batch({"shard": [at], "filter": [blob]}, _FILTERS_ARROW)

    for b in batches:
        shard, k1 = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, j in _runs(shard):
            if at is not None and shard[i] != at:
                yield flush()
                parts = []
            at = int(shard[i])
            parts.append(k1[i:j].view(np.uint64).copy())
    if at is not None:
        yield flush()


def _build_filters(shared: DataFrame, shards: int) -> DataFrame:
    keyed = shared.select(_shard(shards), "k1")
    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(kernel.tidied(_filters_of), _FILTERS)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a shard's filter comes before the keys to look up in it."""
    at, current = None, None
    for b in batches:
        shard, k1 = b.column("shard").to_numpy(), b.column("k1")
        is_filter = k1.is_null().to_numpy(zero_copy_only=False)
        keys = k1.fill_null(0).to_numpy()
        keep = np.zeros(len(shard), bool)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, np.flatnonzero(is_filter), [len(shard)]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if is_filter[i]:
                at, current = shard[i], CuckooFilter.from_bytes(b.column("filter")[int(i)].as_py())
                i = i + 1
            if i < j and current is not None and at == shard[i]:
                keep[i:j] = current.contains(keys[i:j].view(np.uint64))
        yield b.select(["k1", "k2", "doc"]).filter(pa.array(keep))


class Parts:
    """A table in folders by part of its key, of which a change writes anew only those that it touches."""

    def __init__(self, spark: SparkSession, schema: T.StructType, folders: dict[int, str]):
        self.spark, self.schema, self.folders = spark, schema, folders

    def rows(self, only: list[int] | None = None) -> DataFrame:
        paths = [f"{folder}/part={p}" for p, folder in self.folders.items() if only is None or p in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def changed(self, rows: DataFrame, part: Column, touched: list[int] | None = None) -> Parts:
        """``rows`` are all rows of the touched parts from now on, or of all parts."""
        path = write_table(rows.withColumn("part", part).hint("rebalance", "part"), "line-parts", by="part")
        held = {r["part"] for r in self.spark.read.parquet(path).select("part").distinct().collect()} if rows_written(self.spark, path) else set()
        kept = {} if touched is None else {p: f for p, f in self.folders.items() if p not in set(touched)}
        return Parts(self.spark, self.schema, kept | dict.fromkeys(held, path))


@dataclass(frozen=True)
class LineIndex:
    """The state: the exact reference table, the shared keys and one filter a shard; ``laid`` has them in parts once they have changed."""

    refs: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int
    laid: tuple[Parts, Parts, Parts] | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> LineIndex:
        return cls.over(materialize(references(docs, id_col, text_col, min_chars), "line-refs"))

    @classmethod
    def over(cls, refs: DataFrame) -> LineIndex:
        shared = materialize(_shared(refs), "line-shared")
        shards = min(MAX_SHARDS, max(MIN_SHARDS, -(-shared.count() // SHARD_KEYS)))
        return cls(refs, shared, materialize(_build_filters(shared, shards), "line-filters"), shards)

    def _part(self, shard: Column | None = None) -> Column:
        return F.pmod(_shard(self.shards) if shard is None else shard, F.lit(PARTS)).cast("int")

    def _laid_out(self) -> tuple[Parts, Parts, Parts]:
        if self.laid:
            return self.laid
        spark = self.refs.sparkSession
        tables = ((self.refs.select("k1", "k2", "doc"), None), (self.shared, None), (self.filters.select("shard", "filter"), F.col("shard")))
        return tuple(Parts(spark, t.schema, {}).changed(t, self._part(shard)) for t, shard in tables)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> LineIndex:
        """The index with more documents; ids must be new to it."""
        new = materialize(references(docs, id_col, text_col, min_chars), "line-refs-new")
        return self._changed(new, True)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents in the column ``doc`` of ``ids``; their references are looked for in all parts."""
        ids = ids.select(F.col("doc").cast("bigint")).distinct()
        return self._changed(materialize(self.refs.select("k1", "k2", "doc").join(ids, "doc", "left_semi").select("k1", "k2", "doc"), "line-refs-gone"), False)

    def delete_documents(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> LineIndex:
        """The index without these documents, whose texts tell the parts they are in."""
        return self._changed(materialize(references(docs, id_col, text_col, min_chars), "line-refs-gone"), False)

    def _changed(self, rows: DataFrame, came: bool) -> LineIndex:
        """Counts anew the keys that the references ``rows``, which come or go, name; the filters take over the difference."""
        refs, shared, filters = self._laid_out()
        keys = materialize(rows.select("k1", "k2").distinct(), "line-touched")
        touched = [r["part"] for r in keys.select(self._part().alias("part")).distinct().collect()]  # PARTS rows at most
        old = refs.rows(touched)
        refs = refs.changed(old.unionByName(rows.select("k1", "k2", "doc")) if came else old.join(rows, ["k1", "k2", "doc"], "left_anti"), self._part(), touched)
        now = materialize(_shared(refs.rows(touched).join(keys, ["k1", "k2"], "left_semi")), "line-now")
        before = shared.rows(touched)
        was = before.join(keys, ["k1", "k2"], "left_semi")
        added = now.join(before, ["k1", "k2"], "left_anti").select(_shard(self.shards), "k1", F.lit(True).alias("add"))
        removed = was.join(now, ["k1", "k2"], "left_anti").select(_shard(self.shards), "k1", F.lit(False).alias("add"))
        changes = materialize(added.unionByName(removed), "line-changes")
        shared = shared.changed(before.join(keys, ["k1", "k2"], "left_anti").unionByName(now), self._part(), touched)
        blobs = filters.rows(touched).select("shard", F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("boolean").alias("add"), "filter")
        laid = blobs.unionByName(changes.withColumn("filter", F.lit(None).cast("binary")))
        updated = laid.repartition("shard").sortWithinPartitions("shard", F.col("k1").isNotNull(), "add").mapInArrow(_update_filters, "shard int, filter binary, full boolean")
        updated = materialize(updated, "line-filters")
        full = updated.where("full").select("shard")
        rebuilt = shared.rows(touched).join(F.broadcast(full), _shard(self.shards) == full["shard"], "left_semi")
        whole = updated.where("not full").select("shard", "filter").unionByName(_build_filters(rebuilt, self.shards))
        filters = filters.changed(whole, self._part(F.col("shard")), touched)
        for table in (keys, now, changes, updated, rows):
            drop_table(rows.sparkSession, table)
        return LineIndex(refs.rows(), shared.rows(), filters.rows(), self.shards, (refs, shared, filters))

    def lookups(self) -> DataFrame:
        """Reference rows that pass their shard's filter: every shared key, and few others."""
        keyed = self.refs.select(_shard(self.shards), "k1", "k2", "doc")
        counts = keyed.groupBy("shard").count()
        mean = counts.agg(F.avg("count")).first()[0] or 1.0
        salts = materialize(counts.select("shard", F.ceil(F.col("count") / F.lit(2 * mean)).cast("int").alias("salts")), "line-salts")
        dealt = keyed.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).withColumn("filter", F.lit(None).cast("binary"))
        blobs = self.filters.join(F.broadcast(salts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")
        blobs = blobs.select("shard", "salt", F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"), F.lit(None).cast("bigint").alias("doc"), "filter")
        rows = dealt.select("shard", "salt", "k1", "k2", "doc", "filter").unionByName(blobs)
        return rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("k1").isNotNull()).mapInArrow(kernel.tidied(_probe), f"{_KEYS}, doc bigint")

    def drop(self) -> None:
        """Remove the tables of an index that hasn't changed."""
        for table in (self.refs, self.shared, self.filters):
            drop_table(self.refs.sparkSession, table)

    def drops(self) -> DataFrame:
        """(doc, keys): the keys that each document loses, as 16-byte strings one after another."""
        passed = materialize(self.lookups(), "line-lookups")
        lost = passed.join(self.shared.select("k1", "k2", "owner"), ["k1", "k2"]).where(F.col("doc") != F.col("owner"))
        key = F.struct("k1", "k2")
        out = materialize(lost.groupBy("doc").agg(F.collect_set(key).alias("keys")), "line-lost")
        drop_table(self.refs.sparkSession, passed)
        return out


def _update_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, filter, full) from rows (shard, k1, add, filter) by shard, its filter first; keys change in one call a run."""
    schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("full", pa.bool_())])
    at, current, full = None, None, False

    def flush():
        return kernel.batch({"shard": [at], "filter": [current.to_bytes()], "full": [full]}, schema)

    for b in batches:
        shard, k1, add = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy().view(np.uint64), b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        blob = b.column(3).is_valid().to_numpy(zero_copy_only=False)
        for i, j in _runs(shard.astype(np.int64) * 4 + blob * 2 + add):
            if shard[i] != at:
                if at is not None:
                    yield flush()
                at, current, full = int(shard[i]), CuckooFilter(4), False
            if blob[i]:
                current = CuckooFilter.from_bytes(b.column(3)[i].as_py())
                continue
            try:
                current.insert(k1[i:j]) if add[i] else current.delete(k1[i:j])
            except FilterFull:
                full = True
    if at is not None:
        yield flush()


def _rebuild(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = LineKeys()
        for b in batches:
            column, lost = b.column(text_at), b.column(b.num_columns - 1)
            raw, offsets = kernel.buffers(column)
            kept, n_lines, n_dropped = column.to_pylist(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            has = lost.is_valid().to_numpy(zero_copy_only=False)
            for i, j in kernel.passes(offsets, kernel.SMALL_PASS):
                if not has[i:j].any():
                    breaks = np.concatenate([[0], np.cumsum(raw[offsets[i] : offsets[j]] == 10)])
                    n_lines[i:j] = np.diff(breaks[offsets[i : j + 1] - offsets[i]]) + 1
                    continue
                k1, k2, _, first = hashes(raw, offsets[i : j + 1])
                n_lines[i:j] = np.diff(first)
                for r in np.flatnonzero(has[i:j]) + i:
                    keys = {(x["k1"], x["k2"]) for x in lost[int(r)].as_py()}
                    s, e = first[r - i], first[r - i + 1]
                    stay = [line for line, key in zip(kept[r].split("\n"), zip(k1[s:e].tolist(), k2[s:e].tolist(), strict=True), strict=True) if key not in keys]
                    n_dropped[r] = n_lines[r] - len(stay)
                    kept[r] = "\n".join(stay)
            columns = b.columns[:-1]
            columns[text_at] = pa.array(kept, type=column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], names=[*b.schema.names[:-1], "__n_lines", "__n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    r"""``docs`` with repeated lines gone, and the columns ``__n_lines`` and ``__n_dropped``.

    Lines are what \n separates. Keys of at least ``min_chars`` code points that two documents or
    more hold lose all their lines, but for those in the smallest document id. Defined results: a
    null or empty text is one empty line, and a null text stays null; whole texts count however
    long, each one row of a task; a document that loses all
    its lines gets an empty text; repeated rows of one id count as one document; rows with a null
    id keep their lines and hold none against others; columns of the two new names are replaced, all
    others pass through; an empty table gives an empty one.
    """
    docs = docs.drop("__n_lines", "__n_dropped")
    index = LineIndex.build(docs, id_col, text_col, min_chars)
    lost = index.drops().withColumnsRenamed({"doc": "__lodestream_doc", "keys": "__lodestream_keys"})
    index.drop()
    joined = docs.join(lost, F.col(id_col).cast("bigint") == F.col("__lodestream_doc"), "left").drop("__lodestream_doc")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    return joined.mapInArrow(kernel.tidied(_rebuild(docs.columns.index(text_col))), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``dedup_lines``: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, len(parts) AS n_lines, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, n_lines, line, pos,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) < max(doc_id)
), judged AS (
  SELECT k.doc_id, k.n_lines, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.owner AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, CAST(max(n_lines) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
