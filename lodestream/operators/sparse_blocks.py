"""BM25 top-k that skips what can't be among the best: postings in blocks with their largest weights.

Chunks are numbered in order of their ids, and every ``block`` of them are a range. A term's postings
in a range are one row, with the largest weight that any of them has. For a query, the sum of its
terms' largest weights bounds every score of a range. The ranges with the largest bounds are scored
first; the k-th best score so far then rules out all ranges whose bound is below it, and only the
others' postings are read. Bounds are read from three columns, postings from the rest of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestream.functions import text
from lodestream.operators.numbering import numbered
from lodestream.operators.retrieval import DIGITS, SparseIndex, _listed, _rows, _sizes, idf, term_weight
from lodestream.scratch import Workspace

#: Chunks of one range.
BLOCK = 4096
#: Ranges that are scored first, and ranges that a condition names; more of them are joined.
FIRST, NAMED = 8, 500
_SLACK = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    """``blocks`` (term, range, most, n, postings), ``terms`` (term, df) and one row of ``sizes`` (n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    sizes: DataFrame


def build(index: SparseIndex, path: str, block: int = BLOCK) -> BlockIndex:
    """Write the block index of a sparse index below ``path``.

    A row holds at most ``block`` postings. Terms that a large part of the chunks holds are many rows,
    laid out by range over (term, range).
    """
    numbers = _ranges(index.rows.select("id").distinct(), block)
    return _written(index.rows.join(numbers, "id"), index.statistics(), path)


def build_from(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", block: int = BLOCK) -> BlockIndex:
    """The same from chunks that have no sparse index: ranges are given to whole chunks, so each posting is sent once."""
    with Workspace(chunks.sparkSession) as made:
        listed = made.table(_listed(chunks, id_col, text_col), "sparse-terms", "lz4")
        with_terms = listed.where(F.size("p") > 0)
        numbers = _ranges(with_terms.select("id").distinct(), block)
        sizes = SparseIndex(listed, _sizes(listed)).statistics()
        return _written(_rows(with_terms.join(numbers, "id"), "range"), sizes, path)


def _ranges(ids: DataFrame, block: int) -> DataFrame:
    return numbered(ids, ["id"]).select("id", F.expr(f"number div {block}").alias("range"))


def _written(rows: DataFrame, sizes: DataFrame, path: str) -> BlockIndex:
    """The block index of postings (id, term, tf, dl, range). They are dealt by range over (term, range) and grouped where they lie."""
    spark = rows.sparkSession
    sizes.coalesce(1).write.parquet(f"{path}/sizes")
    average = F.broadcast(spark.read.parquet(f"{path}/sizes").select("avgdl"))  # one row
    part = term_weight(F.lit(1.0), F.col("tf"), F.col("dl"), F.col("avgdl"))
    dealt = rows.select("term", "range", "id", "tf", "dl").repartitionByRange("term", "range").crossJoin(average)
    grouped = dealt.groupBy("term", "range").agg(F.max(part).alias("most"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("postings"))
    grouped.sortWithinPartitions("term", "range").write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "sizes")))


def _asked(index: BlockIndex, query: str) -> tuple[dict[str, int], DataFrame]:
    """How often the query holds each of its terms, and (term, factor): idf times that number."""
    wanted = text.tokens_of(query)
    times = {t: wanted.count(t) for t in wanted}
    mine = index.terms.where(F.col("term").isin(*times)).crossJoin(F.broadcast(index.sizes))
    count = F.element_at(F.create_map(*(F.lit(x) for pair in times.items() for x in pair)), F.col("term"))
    return times, mine.select("term", idf(F.col("n"), F.col("df")).alias("idf"), count.alias("times"))


def _scores(index: BlockIndex, asked: DataFrame, terms: list[str], where: Column | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """(id, score) of the chunks of some ranges that hold a term."""
    rows = index.blocks.where(F.col("term").isin(*terms))
    rows = rows if where is None else rows.where(where)
    rows = rows if ranges is None else rows.join(ranges, "range", "left_semi")
    each = rows.select("term", F.explode("postings").alias("p")).select("term", "p.*").join(F.broadcast(asked), "term").crossJoin(F.broadcast(index.sizes.select("avgdl")))  # a query's terms, one row
    weight = F.col("times") * term_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return each.groupBy("id").agg(F.round(F.sum(weight), DIGITS).alias("score"))


def _bounds(index: BlockIndex, asked: DataFrame, terms: list[str]) -> DataFrame:
    """(range, bound): no chunk of the range has a higher score."""
    rows = index.blocks.where(F.col("term").isin(*terms)).select("term", "range", "most").join(F.broadcast(asked), "term")
    return rows.groupBy("range").agg(F.sum(F.col("times") * F.col("idf") * F.col("most")).alias("bound"))


def _least(index: BlockIndex, asked: DataFrame, terms: list[str], bounds: DataFrame, k: int) -> float | None:
    """The k-th best score of the ranges with the largest bounds; None where fewer than k chunks hold a term."""
    first, last = FIRST, -1
    while True:
        best = [r.range for r in bounds.orderBy(F.desc("bound"), "range").limit(first).collect()]
        scores = _scores(index, asked, terms, F.col("range").isin(best)).orderBy(F.desc("score")).limit(k).collect() if best else []
        if len(scores) == k:
            return scores[-1].score
        if len(best) < first or first > NAMED or len(best) == last:
            return None
        first, last = first * 8, len(best)


def plan(index: BlockIndex, query: str, k: int) -> DataFrame:
    """(term, range, n, read): whether a top-k search has to read each block of the query's terms."""
    times, asked = _asked(index, query)
    bounds = _bounds(index, asked, list(times))
    least = _least(index, asked, list(times), bounds, k)
    read = F.lit(True) if least is None else F.col("bound") >= least - _SLACK
    return index.blocks.where(F.col("term").isin(*times)).select("term", "range", "n").join(bounds.select("range", read.alias("read")), "range").select("term", "range", "n", "read")


def bm25_topk(index: BlockIndex, query: str, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(id_col, score) of the k best chunks; scores above 0 only, equal ones by id."""
    times, asked = _asked(index, query)
    terms = list(times)
    if not terms or k < 1:
        return index.blocks.select(F.explode("postings").alias("p")).select(F.col("p.id").alias(id_col), F.lit(0.0).alias("score")).where("false")
    bounds = _bounds(index, asked, terms)
    least = _least(index, asked, terms, bounds, k)
    scores = _scores(index, asked, terms)
    if least is not None:
        left = bounds.where(F.col("bound") >= least - _SLACK).select("range")
        named = [r.range for r in left.limit(NAMED + 1).collect()]
        scores = _scores(index, asked, terms, F.col("range").isin(named)) if len(named) <= NAMED else _scores(index, asked, terms, ranges=left)
    return scores.where("score > 0").orderBy(F.desc("score"), "id").limit(k).select(F.col("id").alias(id_col), "score")
