"""Benchmark decontamination by winnowing.

A *window* is ``window`` consecutive words of an item, or the whole of a shorter item. Winnowing
keeps, in every run of ``window - gram + 1`` consecutive word grams, the one with the smallest hash.
The choice depends on the run's grams alone, so two texts that share ``window`` words keep a common
fingerprint there. Fingerprints of the documents are looked up among those of the items, and each
hit is extended word by word in both directions, which settles the windows exactly.

Items shorter than a window give every one of their grams as a fingerprint and are looked up among
all grams of the documents of the same length, since winnowing promises nothing for them.

The items are a stated query set: they are taken in blocks of ``BLOCK_WORDS`` words, and each block
is sent to the tasks once, whatever the number of documents. Documents are never shuffled for the
search; hits of several blocks meet in an aggregation by document.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestream.llm import kernel
from lodestream.scratch import materialize

#: Words of benchmark items that are sent to the tasks at once: about 40 bytes each.
BLOCK_WORDS = 1_000_000
GRAM = 5

_U = np.uint64


def winnow(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest hash of each ``run`` consecutive grams; the rightmost of equals."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, run):
        other = grams[j : n + j]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    keep = np.zeros(len(grams), bool)
    keep[at] = True
    return np.flatnonzero(keep)


class Items:
    """The fingerprints of a block of items, ready for lookups."""

    def __init__(self, ids: list, texts: list, window: int):
        self.ids, self.window = ids, window
        words = kernel.Words(kernel.ALNUM)
        raw, offsets = kernel.buffers(pa.array(texts, pa.large_string()))
        hashes, first = [], [0]
        for i, j in kernel.passes(offsets):
            w, f = words(raw, offsets[i : j + 1])
            first.extend((f[1:] + first[-1]).tolist())
            hashes.append(w)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.first = np.array(first)
        length = np.diff(self.first)
        prints, places = [], []
        for i in np.flatnonzero(length >= window):
            grams = kernel.grams(self.words[self.first[i] : self.first[i + 1]], GRAM)
            at = winnow(grams, window - GRAM + 1)
            prints.append(grams[at])
            places.append(at + self.first[i])
        self.prints, self.places = self._sorted(prints, places)
        #: length of a short item -> sorted hashes of whole items and their numbers
        self.short = {}
        for m in sorted({int(x) for x in length if 0 < x < window}):
            at = np.flatnonzero(length == m)
            self.short[m] = self._sorted([kernel.grams(self.words[self.first[i] : self.first[i + 1]], m) for i in at], [np.array([i]) for i in at])
        self.item_of = np.repeat(np.arange(len(length)), length)

    @staticmethod
    def _sorted(keys: list, values: list) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]


def _lookup(queries: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions in ``queries`` that are among the sorted ``keys``."""
    if not len(keys) or not len(queries):
        return np.zeros(0, np.int64)
    at = np.searchsorted(keys, queries)
    at[at == len(keys)] = 0
    return np.flatnonzero(keys[at] == queries)


def _row_grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all rows at their first word's place, and which of them lie within one row."""
    grams = kernel.grams(words, k)
    inside = np.ones(len(grams), bool)
    for b in first[1:-1]:
        inside[max(0, b - k + 1) : b] = False
    return grams, inside


def _extend(words: np.ndarray, lo: int, hi: int, at: int, items: Items, place: int) -> tuple[int, int]:
    """The longest common run of words around word ``at`` of a row [lo, hi) and word ``place`` of an item."""
    i = items.item_of[place]
    left = min(at - lo, place - items.first[i])
    right = min(hi - at, items.first[i + 1] - place)
    back = np.flatnonzero(words[at - left : at][::-1] != items.words[place - left : place][::-1])
    ahead = np.flatnonzero(words[at : at + right] != items.words[place : place + right])
    return at - (int(back[0]) if len(back) else left), at + (int(ahead[0]) if len(ahead) else right)


def find_hits(words: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, end word, item number) of each occurrence of a window, rows' words from 0."""
    run = items.window - GRAM + 1
    if len(items.prints) and len(words) >= items.window:
        grams, inside = _row_grams(words, first, GRAM)
        done: dict[int, int] = {}  # offset between a row's words and the items' -> end of the run extended last
        for at in _lookup(grams, items.prints).tolist():
            if not inside[at]:
                continue
            # of the grams known from items, only those that winnowing keeps in some run here
            row = int(np.searchsorted(first, at, side="right")) - 1
            lo, hi = int(first[row]), int(first[row + 1])
            s, e = max(lo, at - run + 1), min(hi - GRAM + 1, at + run)
            near = grams[s:e]
            here = at - s
            left = np.flatnonzero(near[:here] < near[here])
            right = np.flatnonzero(near[here + 1 :] <= near[here])
            room = (right[0] if len(right) else len(near) - here - 1) + (here - left[-1] - 1 if len(left) else here) + 1
            if room < run:
                continue
            lower = np.searchsorted(items.prints, grams[at], side="left")
            upper = np.searchsorted(items.prints, grams[at], side="right")
            for place in items.places[lower:upper].tolist():
                if done.get(at - place, -1) > at:
                    continue
                a, b = _extend(words, lo, hi, at, items, place)
                done[at - place] = b
                if b - a >= items.window:
                    yield row, a - lo, b - lo, int(items.item_of[place])
    for m, (keys, numbers) in items.short.items():
        if len(words) < m:
            continue
        grams, inside = _row_grams(words, first, m)
        for at in _lookup(grams, keys):
            if inside[at]:
                row = int(np.searchsorted(first, at, side="right")) - 1
                for i in numbers[np.searchsorted(keys, grams[at], side="left") : np.searchsorted(keys, grams[at], side="right")]:
                    if (words[at : at + m] == items.words[items.first[i] : items.first[i + 1]]).all():
                        yield row, int(at - first[row]), int(at - first[row] + m), int(i)


def merged(hits: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, end word, item number) with each row's and item's overlapping ranges made one."""
    last = None
    for row, item, s, e in sorted({(row, item, s, e) for row, s, e, item in hits}):
        if last is not None and last[:2] == (row, item) and s <= last[3]:
            last = (row, item, last[2], max(last[3], e))
            continue
        if last is not None:
            yield last[0], last[2], last[3], last[1]
        last = (row, item, s, e)
    if last is not None:
        yield last[0], last[2], last[3], last[1]


_HITS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("item", T.StringType())]))


def _search(items: Items, text_at: int):
    hits_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kernel.Words(kernel.ALNUM)
        for b in batches:
            raw, offsets = kernel.buffers(b.column(text_at))
            n_words, hits = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for i, j in kernel.passes(offsets):
                words, first = make(raw, offsets[i : j + 1])
                n_words[i:j] = np.diff(first)
                for row, s, e, item in merged(find_hits(words, first, items)):
                    hits[i + row].append({"s": s, "e": e, "item": items.ids[item]})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words), pa.array(hits, hits_type)], names=[*b.schema.names, "__n_words", "__hits"])

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, block by block; the driver holds one block at a time."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids, texts, held = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        held += len(r["text"]) // 2 + 1
        if held >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def mark_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with ``__n_words`` and ``__hits``: word ranges [s, e) that occurrences of an item's windows cover, with the item.

    Words are runs outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F after A-Z are lower-cased. Defined
    results: null and empty texts have no words and no hits; an item without words, or with a null
    id, has no window; items that repeat each count under their own id; several hits may overlap;
    without items there are no hits; whole texts count however long, each one row of a task; an empty
    table gives an empty one; columns of the two new names are replaced, others pass through.
    """
    spark, docs = docs.sparkSession, docs.drop("__n_words", "__hits")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__hits", _HITS)])
    text_at = docs.columns.index(text_col)
    blocks = _blocks(items, item_id_col, item_text_col)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_search_block(spark.sparkContext.broadcast(first), window, text_at), schema)
    # several blocks: texts are written once, and each block adds its hits only
    rows = materialize(docs.withColumn("__lodestream_row", F.monotonically_increasing_id()), "dc-rows")
    found_schema = T.StructType([T.StructField("__lodestream_row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("__n_words", T.LongType()), T.StructField("__hits", _HITS)])
    keyed, hits = rows.select("__lodestream_row", F.col(text_col).alias("text")), None
    for block in itertools.chain((first, second), blocks):
        found = keyed.mapInArrow(_search_block(spark.sparkContext.broadcast(block), window, 1), found_schema)
        found = materialize(found.where(F.size("__hits") > 0).select("__lodestream_row", "__hits"), "dc-hits")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("__lodestream_row").agg(F.flatten(F.collect_list("__hits")).alias("__lodestream_hits"))  # as many as items have in one text
    joined = rows.join(hits, "__lodestream_row", "left").select(*docs.columns, "__lodestream_hits")
    counted_schema = T.StructType([*joined.schema.fields, *schema.fields[-2:]])
    counted = joined.mapInArrow(_search(Items([], [], window), text_at), counted_schema)
    return counted.select(*docs.columns, "__n_words", F.coalesce("__lodestream_hits", "__hits").alias("__hits"))


_ITEMS: dict[str, Items] = {}


def _search_block(block, window: int, text_at: int):
    """The search for one block of items, which a worker builds once for all its tasks."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ITEMS:
            _ITEMS.clear()
            _ITEMS[name] = Items(*block.value, window)
        yield from _search(_ITEMS[name], text_at)(batches)

    return run


def _covered(hits):
    """Words covered by the ranges: the ranges by start, each adding what lies beyond those before it."""
    ordered = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e")))))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, h: F.struct(F.greatest(acc["end"], h["e"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0).cast("bigint"), h["e"] - F.greatest(acc["end"], h["s"]))).alias("sum"))
    return F.aggregate(ordered, start, step, lambda acc: acc["sum"])


def judge(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``mark_contamination``."""
    items = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["item"])))
    out = marked.select(id_col, F.col("__n_words").alias("n_words"), _covered(F.col("__hits")).alias("n_hit"), items.alias("__items"))
    return out.select(
        id_col, "n_words", "n_hit", F.size("__items").cast("bigint").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which under a twentieth of the words lie in benchmark windows."""
    marked = mark_contamination(docs, items, text_col, **options)
    hit = _covered(F.col("__hits"))
    return marked.where(~((hit > 0) & (20 * hit >= F.col("__n_words")))).drop("__n_words", "__hits")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP10_SQL = r"""
WITH parts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT id AS item_id, w, least(len(w), 13) AS m FROM parts WHERE side = 'b' AND len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM items)
), docs AS (
  SELECT id AS doc_id, w FROM parts WHERE side = 'd'
), sizes AS (
  SELECT DISTINCT m FROM windows
), grams AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)
), hits AS (
  SELECT g.doc_id, g.i, g.m, x.item_id FROM grams g JOIN windows x ON g.m = x.m AND g.win = x.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
