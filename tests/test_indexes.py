"""The dense and the block-wise sparse index against whole scans."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import dense_index, docgraph, retrieval, sparse_blocks

# Dense.


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = 10 * rng.standard_normal((20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(8)).tolist(), f"l{i % 3}") for i in range(3000)]
    rows += [(3000 + i, rows[0][1], "copy") for i in range(1500)]  # a third of all rows is one vector
    rows += [(5000, None, "x"), (5001, [float("nan")] * 8, "x"), (5002, [None] + [0.0] * 7, "x"), (5003, [float("inf")] * 8, "x")]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label string").repartition(3)


@pytest.fixture(scope="module")
def dense(spark, clustered, tmp_path_factory):
    return dense_index.build(clustered, f"file://{tmp_path_factory.mktemp('dense')}/index", cells=24)


def listed(rows):
    return [tuple(r) for r in rows.collect()]


def test_dense_index_equals_the_scan(clustered, dense):
    usable = clustered.where("chunk_id < 5000")
    for query, k, where in (([0.5] * 8, 10, None), (usable.first().embedding, 5, None), (usable.first().embedding, 1700, None), ([0.0] * 8, 10, {"label": "l1"}), ([9.0] * 8, 3, {"label": "none"}), ([1.0] * 8, 10_000, None), ([1.0] * 8, 0, None)):
        assert listed(dense_index.dense_topk(dense, query, k, where)) == listed(retrieval.dense_topk(usable, query, k, where))


def test_dense_index_reads_a_share_only(clustered, dense):
    query = clustered.where("chunk_id = 7").first().embedding
    found = dense_index.ranges(dense, query, 10)
    read = dense.rows.where(" OR ".join(f"(cell = {c} AND r BETWEEN {low} AND {high})" for c, low, high in found)).count()
    assert len(found) < 6 and read < 400
    plan = dense_index.dense_topk(dense, query, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*cell", plan)


def test_dense_batch_equals_the_scan(spark, clustered, dense):
    usable = clustered.where("chunk_id < 5000")
    queries = usable.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    queries = queries.unionByName(spark.createDataFrame([(-1, [0.0] * 8), (-2, [1e3] * 8), (-3, None)], "query_id long, query_vector array<double>"))
    for k in (1, 7, 1600):
        assert sorted(listed(dense_index.dense_batch_topk(dense, queries, k))) == sorted(listed(retrieval.dense_batch_topk(usable, queries, k)))
    assert dense_index.dense_batch_topk(dense, queries.limit(0), 3).count() == 0


def test_blocks_hold_one_cell_each(dense):
    rows = dense.blocks.selectExpr("cell", "part", "low", "high", "size(ids) AS n", "length(vectors) AS bytes").collect()
    assert all(r.n <= dense_index.BLOCK and r.bytes == 64 * r.n and r.low <= r.high for r in rows) and len({r.part for r in rows}) == len(rows) and sum(r.n for r in rows) == 4500


def test_similar_pairs_equal_the_block_join(spark, clustered, dense):
    some = clustered.where("chunk_id < 600 OR chunk_id BETWEEN 3000 AND 3020").unionByName(spark.createDataFrame([(9000, [0.0] * 8, "zero")], clustered.schema))
    got = {(r.src, r.dst): r.weight for r in dense_index.similar_pairs(some, 0.99, cells=12).collect()}
    want = {(r.src, r.dst): r.weight for r in docgraph.similarity_edges(some, 0.99).collect()}
    assert got == pytest.approx(want, abs=1e-8) and len(got) > 1000
    assert dense_index.share_met(dense, 2.0) < 0.2
    assert dense_index.similar_pairs(some.limit(0), 0.9).count() == 0


def test_similar_pairs_meet_by_groups_of_blocks(spark, clustered, monkeypatch):
    """Small groups, one cell in several of them, and copies across groups; no row is a pair of a vector and a block."""
    some = clustered.where("chunk_id < 700 OR chunk_id BETWEEN 3000 AND 3100")
    monkeypatch.setattr(dense_index, "_meetings", None)
    for limit, cells in ((100, 9), (200, 2)):
        monkeypatch.setattr(dense_index, "BLOCK", limit)
        monkeypatch.setattr(dense_index, "GROUP", limit)
        got = {(r.src, r.dst): r.weight for r in dense_index.similar_pairs(some, 0.9, cells=cells).collect()}
        assert got == pytest.approx({(r.src, r.dst): r.weight for r in docgraph.similarity_edges(some, 0.9).collect()}, abs=1e-8)


def test_no_vectors_are_broadcast_to_meet(spark, clustered, dense):
    from lodestream.scratch import Workspace

    queries = clustered.where("chunk_id < 50").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    with Workspace(spark) as made:
        sent = queries.mapInArrow(dense_index._sent(dense.cells, 5), dense_index._sent_schema(queries.schema["query_id"].dataType))
        assert "Broadcast" not in dense_index._meetings(dense, sent, made)._jdf.queryExecution().executedPlan().toString()


# Sparse.


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 60)) + ["common"] * rng.randint(0, 3))) for i in range(3000)]
    rows += [(3000, None), (3001, ""), (3002, "the of and")] + [(4000 + i, "rare w50 w51") for i in range(5)]
    return spark.createDataFrame(rows, "chunk_id long, text string")


@pytest.fixture(scope="module")
def sparse(spark, texts, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('sparse')}"
    plain = retrieval.build_index(texts, f"{root}/plain")
    return plain, sparse_blocks.build(plain, f"{root}/blocks", block=64)


@pytest.mark.parametrize("query", ["rare common", "w0 w1 w2", "w50 w51 w50", "common", "w0 w59 rare", "nothing here", "the", "w3 w4 w5 w6 w7 w8 common common"])
@pytest.mark.parametrize("k", [1, 10, 4000])
def test_blocks_give_the_same_best_rows(texts, sparse, query, k):
    plain, blocks = sparse
    want = retrieval.bm25_scores(plain, query).orderBy(F.desc("score"), "chunk_id").limit(k)
    assert listed(sparse_blocks.bm25_topk(blocks, query, k)) == listed(want)


def test_index_stores_postings_by_term_not_one_by_one(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "PACKED", 100)
    chunks = texts.where("chunk_id < 400 OR chunk_id >= 3000").withColumn("part", F.when(F.col("chunk_id") % 5 > 0, F.col("chunk_id") % 5))
    index = retrieval.build_index(chunks, f"{tmp_path}/index", by="part")
    want = retrieval.postings(chunks).join(chunks.select(F.col("chunk_id").alias("id"), "part"), "id")
    rows = [sorted(map(str, x.select("term", "id", "tf", "dl", "part").collect())) for x in (index.rows, want)]
    assert rows[0] == rows[1] and spark.read.parquet(f"{tmp_path}/index/packed").count() < len(rows[0]) * 0.8
    sizes = chunks.groupBy("part").agg(F.count("*").alias("n")).collect()
    assert sorted((str(r.part), r.n) for r in index.sizes.collect()) == sorted((str(r.part), r.n) for r in sizes)
    assert index.statistics().first().avgdl == retrieval.corpus_statistics(chunks).first().avgdl
    assert retrieval.build_index(chunks.limit(0), f"{tmp_path}/none").rows.count() == 0


def test_blocks_of_a_frequent_term_are_skipped(sparse):
    _, blocks = sparse
    plan = sparse_blocks.plan(blocks, "rare w0 common", 5)
    of = collections.Counter(r.read for r in plan.collect())
    assert of[False] > 2 * of[True] > 0


def test_block_index_from_chunks_is_that_of_the_sparse_index(spark, tmp_path):
    texts = [None, "", "the", *(" ".join(f"w{(i * j) % 13}" for j in range(i % 9)) for i in range(60))]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    one = sparse_blocks.build(retrieval.build_index(chunks, f"{tmp_path}/sparse"), f"{tmp_path}/one", block=8)
    other = sparse_blocks.build_from(chunks, f"{tmp_path}/other", block=8)
    for name in ("blocks", "terms", "sizes"):
        rows = [sorted(map(str, getattr(x, name).collect())) for x in (one, other)]
        assert rows[0] == rows[1] and rows[0]
    assert other.blocks.select("term", "range").distinct().count() == other.blocks.count()
