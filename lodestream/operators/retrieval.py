"""Dense, sparse and hybrid retrieval over chunk tables (chunk_id, text, embedding, metadata).

A query is a constant in the plan, so one query is a scan, a projection and a top-k. A set of queries
is a table sent to the tasks in blocks; Spark keeps each task's best rows of a query before it
shuffles them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestream.functions import text, vector
from lodestream.operators.policy import SearchSettings, fetch_pool, scaled_threshold
from lodestream.scratch import Workspace, materialize

DIGITS = 9
log = logging.getLogger(__name__)
#: Query vectors that are sent to the tasks at once.
QUERY_BLOCK = 2048
K1, B = 1.5, 0.75
RRF_K = 60
#: Texts that a scoring model sees at once.
SCORE_BATCH = 32
#: Chunks whose postings are grouped at once.
PACKED = 4096


def where_column(where: dict | None) -> Column | None:
    """A metadata filter as a condition: {key: value}, operators $eq to $nin, and $and, $or."""
    if where is None:
        return None
    if not isinstance(where, dict) or not where:
        raise ValueError("a filter is an object with one key or more")
    compare = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    }
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [where_column(x) for x in value]
            joined = inner[0]
            for x in inner[1:]:
                joined = joined & x if key == "$and" else joined | x
            parts.append(joined)
        elif isinstance(value, dict):
            for op, v in value.items():
                if op not in compare:
                    raise ValueError(f"unknown operator {op}")
                parts.append(compare[op](F.col(key), v))
        else:
            parts.append(F.col(key) == value)
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out


def filtered(chunks: DataFrame, where: dict | None) -> DataFrame:
    condition = where_column(where)
    return chunks if condition is None else chunks.where(condition)


def dense_topk(chunks: DataFrame, query: list[float], k: int, where: dict | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest chunks by squared L2 distance: all columns but the vector, distance and score."""
    distance = F.round(vector.squared_l2(F.col(vector_col), vector.literal(query)), DIGITS)
    found = filtered(chunks, where).withColumn("distance", distance).orderBy("distance", id_col).limit(max(0, k))
    return found.withColumn("score", vector.score_of(F.col("distance"))).drop(vector_col)


def _batch_best(ids: list, queries: np.ndarray, k: int):
    """(query_id, id, distance): of each Arrow batch, the k nearest rows of every query.

    A matrix product ranks the rows; the distances of those that are near enough are then summed
    up from differences, as for a single query.
    """
    lengths = (queries * queries).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid = b.filter(b.column(1).is_valid())
            if not valid.num_rows:
                continue
            rows = np.array(valid.column(1).to_pylist(), float)
            keys, squares, most = valid.column(0).to_numpy(zero_copy_only=False), (rows * rows).sum(axis=1)[:, None], min(k, len(rows))
            for s in range(0, len(queries), 64):
                part = queries[s : s + 64]
                quick = squares + lengths[s : s + 64] - 2 * rows @ part.T
                limit = np.partition(quick, most - 1, axis=0)[most - 1] + 1e-7 * (1 + lengths[s : s + 64])
                row, query = np.nonzero(quick <= limit)
                distance = np.round(((rows[row] - part[query]) ** 2).sum(axis=1), DIGITS)
                order = np.lexsort((keys[row], distance, query))
                row, query, distance = row[order], query[order], distance[order]
                first = np.searchsorted(query, np.arange(len(part)))
                kept = np.arange(len(query)) - first[query] < k
                names = [ids[s + i] for i in query[kept].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names), valid.column(0).take(pa.array(row[kept])), pa.array(distance[kept])], names=["query_id", "id", "distance"])

    return run


def dense_batch_topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, distance) for each of ``queries`` (query_id, query_vector).

    Queries, a stated set, come to the driver in blocks of ``QUERY_BLOCK`` and go to the tasks from
    there. Each batch of chunks gives out its k nearest rows only, so what is shuffled doesn't grow
    with the vectors but with the batches. The vectors have one length.
    """
    kinds = dict(chunks.dtypes) | dict(queries.dtypes)
    best, out, block = Window.partitionBy("query_id").orderBy("distance", "id"), None, []
    rows = queries.where(F.col("query_vector").isNotNull()).select("query_id", "query_vector").toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        near = _batch_best([r["query_id"] for r in block], np.array([r["query_vector"] for r in block], float), k)
        found = chunks.select(id_col, vector_col).mapInArrow(near, f"query_id {kinds['query_id']}, id {kinds[id_col]}, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return chunks.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, rank int, {id_col} {kinds[id_col]}, distance double")
    ranked_ = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked_.select("query_id", "rank", F.col("id").alias(id_col), "distance")


@dataclass(frozen=True)
class SparseIndex:
    """What BM25 needs of a collection: ``rows`` (term, id, tf, dl), and ``sizes`` with n and tokens, a row a part."""

    rows: DataFrame
    sizes: DataFrame

    def statistics(self) -> DataFrame:
        """One row: chunks and mean number of tokens."""
        return self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))


def _counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token list: sorted once, then cut where the term changes."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    cut = lambda s, at: F.transform(at, lambda x, i: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - x).cast("bigint").alias("tf")))
    of_sorted = F.transform(F.array(F.sort_array(tokens)), lambda s: F.transform(F.array(starts(s)), lambda at: cut(s, at)))
    return F.when(F.size(tokens) > 0, F.get(F.get(of_sorted, F.lit(0)), F.lit(0))).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def _listed(chunks: DataFrame, id_col: str, text_col: str, by: str | None = None, terms: list[str] | None = None) -> DataFrame:
    """(id, dl, p, by): each chunk's length and its terms, or those of ``terms``, with their counts."""
    beside = [by] if by else []
    tokens = chunks.select(F.col(id_col).alias("id"), *beside, text.tokens(F.col(text_col)).alias("tokens"))
    asked = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(*terms))
    return tokens.select("id", F.size("tokens").cast("bigint").alias("dl"), _counted(asked).alias("p"), *beside)


def _rows(listed: DataFrame, by: str | None = None) -> DataFrame:
    beside = [by] if by else []
    return listed.select("id", "dl", *beside, F.explode("p").alias("p")).select("id", "p.term", "p.tf", "dl", *beside)


def _sizes(listed: DataFrame, by: str | None = None) -> DataFrame:
    return listed.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl) of all chunks, without a shuffle."""
    return _rows(_listed(chunks, id_col, text_col))


def _packed(id_kind: pa.DataType, by_kind: pa.DataType | None):
    """Postings of about ``PACKED`` chunks at a time, grouped by term: (term, ids, tfs, dls, n, tokens, by) of (id, tokens, by).

    Rows without a term have n and tokens: what these chunks add to the sizes.
    """
    long, text_ = pa.int64(), pa.string()

    def grouped(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, coded = b.column(1), b.column(2).dictionary_encode("encode") if by_kind else None
        dl = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        part, kinds = (coded.indices.to_numpy(), coded.dictionary) if by_kind else (np.zeros(b.num_rows, int), None)
        names = ["term", "ids", "tfs", "dls", "n", "tokens", *(["by"] if by_kind else [])]
        some = np.unique(part)
        n, tokens = np.bincount(part)[some], np.array([dl[part == x].sum() for x in some])
        empty = lambda kind: pa.array([[]] * len(some), pa.list_(kind))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), text_), empty(id_kind), empty(long), empty(long), pa.array(n, long), pa.array(tokens, long), *([kinds.take(pa.array(some)).cast(by_kind)] if by_kind else [])], names)
        held = lists.flatten()
        if not len(held):
            return
        row, terms = np.repeat(np.arange(b.num_rows), dl), held.dictionary_encode()
        code = part[row].astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
        both, tf = np.unique(code * b.num_rows + row, return_counts=True)
        code, row = np.divmod(both, b.num_rows)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = pa.array(np.append(starts, len(code)), pa.int32())
        listed = lambda values: pa.ListArray.from_arrays(ends, values)
        of = code[starts]
        nothing = pa.array(np.zeros(len(starts), np.int64))
        yield pa.RecordBatch.from_arrays([
            terms.dictionary.take(pa.array(of % len(terms.dictionary))).cast(text_), listed(b.column(0).take(pa.array(row)).cast(id_kind)), listed(pa.array(tf, long)), listed(pa.array(dl[row])),
            nothing, nothing, *([kinds.take(pa.array(of // len(terms.dictionary))).cast(by_kind)] if by_kind else []),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PACKED):
                yield from grouped(b.slice(i, PACKED))

    return run


def unpacked(packed: DataFrame) -> DataFrame:
    """(id, term, tf, dl) and other columns of packed postings; a condition on the term is met before."""
    others = [c for c in packed.columns if c not in ("term", "ids", "tfs", "dls")]
    each = packed.select("term", *others, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    return each.select(F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), *others)


def build_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", by: str | None = None) -> SparseIndex:
    """Write the sparse index of ``chunks`` below ``path``: a query then reads only the row groups of its terms.

    Texts are read once. Each task groups the postings of some thousand chunks by term; these groups, far
    fewer than the postings, are laid out by range over (term, first id), so a term that a large part of the
    chunks holds spreads over several files. A column ``by`` stays beside its postings and sizes.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = chunks.sparkSession
    with Workspace(spark) as made:
        listed = chunks.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("tokens"), *([by] if by else []))
        kind, by_kind = listed.schema["id"].dataType, listed.schema[by].dataType if by else None
        schema = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(c, T.ArrayType(k)) for c, k in (("ids", kind), ("tfs", T.LongType()), ("dls", T.LongType()))), T.StructField("n", T.LongType()), T.StructField("tokens", T.LongType()), *([T.StructField("by", by_kind)] if by else [])])
        packed = made.table(listed.mapInArrow(_packed(to_arrow_type(kind), to_arrow_type(by_kind) if by else None), schema), "sparse-terms", "lz4")
        beside = [F.col("by").alias(by)] if by else []
        rows = packed.where("term IS NOT NULL").select("term", "ids", "tfs", "dls", *beside)
        sizes = packed.where("term IS NULL").select("n", "tokens", *beside)
        sizes = sizes.groupBy(*([by] if by else [])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        first = F.get("ids", F.lit(0))
        rows.repartitionByRange(F.col("term"), first).sortWithinPartitions(F.col("term"), first).write.parquet(f"{path}/packed")
        sizes.write.parquet(f"{path}/sizes")
    return SparseIndex(unpacked(spark.read.schema(rows.schema).parquet(f"{path}/packed")), spark.read.schema(sizes.schema).parquet(f"{path}/sizes"))


def index_for(chunks: DataFrame, terms: list[str] | None = None, id_col: str = "chunk_id", text_col: str = "text") -> SparseIndex:
    """The index of chunks that have none, or the part of it that some terms need, from one pass over the texts."""
    listed = materialize(_listed(chunks, id_col, text_col, terms=terms), "sparse-hits", "lz4")
    return SparseIndex(_rows(listed), _sizes(listed))


def term_statistics(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", floored: bool = False) -> DataFrame:
    """(term, df, idf): documents that hold a term, and ln(1 + (N - df + 0.5) / (df + 0.5)), or the floored form."""
    n = chunks.select(F.count("*").alias("n"))
    df = chunks.select(F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if floored:
        return idf_floored(df.crossJoin(F.broadcast(n))).select("term", "df", F.round("idf", DIGITS).alias("idf"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))


def corpus_statistics(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents and mean number of tokens."""
    return chunks.select(F.size(text.tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1.0 + (n - df + 0.5) / (df + 0.5))


def idf_floored(stats: DataFrame) -> DataFrame:
    """The other common form, for (term, df, n): ln(n - df + 0.5) - ln(df + 0.5), where negative values
    become a quarter of the mean over all terms."""
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    rows = stats.withColumn("idf", raw)
    mean = rows.agg(F.avg("idf").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf"))).drop("mean")


def term_weight(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    length = F.when(avgdl == 0, 1.0).otherwise(avgdl)
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / length))


def _weighted(index: SparseIndex, hits: DataFrame) -> DataFrame:
    """``hits``, the postings of some terms, with each one's weight."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    both = hits.join(df, "term").crossJoin(F.broadcast(index.statistics()))
    return both.withColumn("weight", term_weight(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl")))


def bm25_batch(chunks: DataFrame | SparseIndex, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id_col, score) for each of ``queries`` (query_id, query_text) over chunks or their index.

    Only terms that some query holds are joined; terms that a query repeats count again. Scores
    above 0 only; equal ones by id.
    """
    index = chunks if isinstance(chunks, SparseIndex) else index_for(chunks, None, id_col, text_col)
    terms = queries.select("query_id", F.explode(text.tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = _weighted(index, index.rows.join(terms.select("term").distinct(), "term", "left_semi"))
    scored = weighted.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("qtf")), DIGITS).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def bm25_scores(chunks: DataFrame | SparseIndex, query: str, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of the chunks that hold a term of the query, by the statistics of all of them.

    An index gives only its rows of the query's terms; without one, one pass over the texts does.
    """
    wanted = text.tokens_of(query)
    terms = list(dict.fromkeys(wanted))
    index = chunks if isinstance(chunks, SparseIndex) else index_for(chunks, terms, id_col, text_col)
    weighted = _weighted(index, index.rows.where(F.col("term").isin(*terms)))
    times = F.element_at(F.create_map(*(F.lit(x) for t in terms for x in (t, wanted.count(t)))), F.col("term"))
    return weighted.groupBy(F.col("id").alias(id_col)).agg(F.round(F.sum(times * F.col("weight")), DIGITS).alias("score")).where("score > 0")


def bm25_topk(chunks: DataFrame, query: str, k: int, where: dict | None = None, id_col: str = "chunk_id", text_col: str = "text", index: SparseIndex | None = None) -> DataFrame:
    """The k best chunks of one query by BM25: all columns and ``score``; equal scores by id.

    Statistics are those of all chunks; a filter follows the scores. Without tokens or with k below 1
    there are no rows.
    """
    rows = filtered(chunks, where)
    if not text.tokens_of(query) or k < 1:
        return rows.where("false").withColumn("score", F.lit(0.0))
    scores = bm25_scores(index or chunks, query, id_col, text_col)
    if where is not None:
        scores = scores.join(rows.select(id_col), id_col, "left_semi")
    best = scores.orderBy(F.desc("score"), id_col).limit(k)
    return rows.join(F.broadcast(best), id_col).select(*rows.columns, "score")  # k rows are sent


_warned: set[str] = set()


def native_sparse(chunks: DataFrame, query: str, k: int, *args, **options) -> DataFrame:
    """Sparse vectors of a store aren't built: a warning once, and BM25."""
    if "native" not in _warned:
        _warned.add("native")
        log.warning("native sparse search isn't available; BM25 takes its place")
    return bm25_topk(chunks, query, k, *args, **options)


def ranked(rows: DataFrame, order: Iterable, name: str) -> DataFrame:
    """List positions from 1; for result lists, which a limit bounds."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of two bounded lists with ``dense_rank`` and ``sparse_rank``.

    Columns that both lists have come from the dense one first. Adds fused_score and fused_rank.
    """
    shared = [c for c in dense.columns if c in sparse.columns and c != id_col]
    s = sparse.select(id_col, "sparse_rank", *(F.col(c).alias(f"__s_{c}") for c in sparse.columns if c not in (id_col, "sparse_rank")))
    joined = dense.join(s, id_col, "full_outer")
    columns = [F.coalesce(F.col(c), F.col(f"__s_{c}")).alias(c) for c in shared] + [F.col(c) for c in dense.columns if c not in shared] + [F.col("sparse_rank")]
    term = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    fused = joined.select(*columns).withColumn("fused_score", F.round(term("dense_rank") + term("sparse_rank"), DIGITS + 3))
    order = [F.desc("fused_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")]
    return ranked(fused, order, "fused_rank")


def hybrid(chunks: DataFrame, query: str, query_vector: list[float], pool: int, where: dict | None = None, sparse_where: dict | None = None, id_col: str = "chunk_id", text_col: str = "text", vector_col: str = "embedding", index: SparseIndex | None = None) -> DataFrame:
    """Dense and sparse lists of ``pool`` rows each, fused, the best ``pool`` of them.

    ``where`` filters the dense list. The sparse one is filtered by ``sparse_where``: pass the same
    to filter both, or None to leave the sparse side open. ``index`` is that of ``chunks``, if there is one.
    """
    has_vector = chunks.where(F.col(vector_col).isNotNull())
    dense = ranked(dense_topk(has_vector, query_vector, pool, where, id_col, vector_col), ["distance", id_col], "dense_rank")
    sparse = bm25_topk(chunks.drop(vector_col), query, pool, sparse_where, id_col, text_col, index)
    sparse = ranked(sparse, [F.desc("score"), id_col], "sparse_rank")
    return fuse(dense, sparse, id_col=id_col).where(F.col("fused_rank") <= pool)


def scorer_of(score: Callable[[str, list[str]], Iterable[float]], query: str, text_col: str = "text", batch: int = SCORE_BATCH) -> Callable[[DataFrame], Column]:
    """A scorer for ``rerank`` from a model: a function from a query and some texts to logits.

    The model sees ``batch`` texts at a time; where it raises, the logits of that Arrow batch are null.
    """

    @F.pandas_udf("double")
    def logits(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(x) for i in range(0, len(texts), batch) for x in score(query, texts.iloc[i : i + batch].fillna("").tolist())])
        except Exception:
            return pd.Series([None] * len(texts), dtype="float64")

    return lambda rows: logits(F.col(text_col))


def rerank(rows: DataFrame, scorer: Callable[[DataFrame], Column], k: int) -> DataFrame:
    """The k best rows by the sigmoid of a scorer's logit; a scorer that fails leaves order and scores as they are.

    ``rows`` is a bounded list with a ``score``; the scorer gets it and returns a column. It fails by
    raising or by a logit that is null or not a number (see ``scorer_of`` for models).
    """
    try:
        logit = scorer(rows)
    except Exception:
        return rows.withColumn("reranked", F.lit(False)).limit(k)
    whole = Window.partitionBy()  # a bounded list
    scored = rows.withColumn("__logit", logit.cast("double"))
    scored = scored.withColumn("reranked", ~F.max(F.col("__logit").isNull() | F.isnan("__logit")).over(whole))
    scored = scored.withColumn("score", F.when(F.col("reranked"), F.round(vector.sigmoid(F.col("__logit")), DIGITS)).otherwise(F.col("score"))).drop("__logit")
    return scored.orderBy(F.desc("score")).limit(k)


def public(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Without the columns that only explain a result."""
    return rows.drop(id_col, "fused_score", "dense_rank", "sparse_rank", "fused_rank", "distance")


def search(chunks: DataFrame, query: str, query_vector: list[float], settings: SearchSettings, where: dict | None = None, scorer: Callable[[DataFrame], Column] | None = None, id_col: str = "chunk_id", diagnostics: bool = False, index: SparseIndex | None = None) -> DataFrame:
    """Pool, optional fusion and reranking, threshold, order and limit in one lazy plan."""
    use_rerank = settings.rerank and scorer is not None
    pool = fetch_pool(settings.top_k, use_rerank, None, settings.pool)
    if settings.hybrid:
        found = hybrid(chunks, query, query_vector, pool, where, where, id_col, index=index).withColumn("score", F.col("fused_score"))
    else:
        found = dense_topk(chunks, query_vector, pool, where, id_col)
    found = found.withColumn("reranked", F.lit(False))
    if use_rerank:
        found = rerank(found, scorer, pool)
    threshold = scaled_threshold(settings.threshold, use_rerank)
    if threshold > 0:
        found = found.where(F.col("score") >= threshold)
    best = found.orderBy(F.desc("score"), id_col).limit(settings.top_k)
    return best if diagnostics else public(best, id_col)
