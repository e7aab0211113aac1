"""Retrieval, graphs, evaluation, chunking, files, store and streaming on small inputs."""

from __future__ import annotations

import hashlib
import json
import math
import zipfile
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestream.operators import chunking, codegraph, docgraph, evaluate, numbering, retrieval
from lodestream.operators.policy import SearchSettings
from lodestream.sources import files
from lodestream.sources.store import ConcurrentWrite, DimensionMismatch, MissingCollection, Store
from lodestream.streaming import watch

CHUNKS = [(1, "python code about sorting lists", [1.0, 0.0], "a"), (2, "gardening with roses", [0.0, 1.0], "b"), (3, "sorting roses by colour", [0.9, 0.1], "a"), (4, "", [0.5, 0.5], "b"), (5, None, None, "a")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string, embedding array<float>, category string")


def ids(df, col="chunk_id"):
    return [r[col] for r in df.collect()]


def test_dense_topk_and_filters(spark, chunks):
    rows = chunks.where("embedding is not null")
    assert ids(retrieval.dense_topk(rows, [1.0, 0.0], 3)) == [1, 3, 4]
    assert ids(retrieval.dense_topk(rows, [1.0, 0.0], 3, {"category": "b"})) == [4, 2]
    assert retrieval.dense_topk(rows, [1.0, 0.0], 0).count() == 0
    plain = {r.chunk_id: r.score for r in retrieval.dense_topk(rows, [1.0, 0.0], 9).collect()}
    assert all(plain[r.chunk_id] == r.score for r in retrieval.dense_topk(rows, [1.0, 0.0], 9, {"category": "a"}).collect())
    queries = rows.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.dense_batch_topk(rows, queries, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (2, 1): 2, (2, 2): 4}
    for bad in ([], {}, "x", {"a": {"$no": 1}}):
        with pytest.raises(ValueError):
            retrieval.where_column(bad)
    assert ids(chunks.where(retrieval.where_column({"$or": [{"chunk_id": {"$lte": 1}}, {"category": {"$nin": ["a"]}}]})).orderBy("chunk_id")) == [1, 2, 4]


def bm25_brute(query):
    docs = [(i, [w for w in (t or "").lower().split() if w not in ("with", "by")]) for i, t, *_ in CHUNKS]
    avgdl = sum(len(d) for _, d in docs) / len(docs)
    out = {}
    for i, d in docs:
        score = 0
        for q in query.split():
            df = sum(q in x for _, x in docs)
            tf = d.count(q)
            if tf:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        if score:
            out[i] = score
    return out


def test_bm25_equals_its_formula(spark, chunks):
    for query in ("sorting roses", "roses roses code", "python"):
        want = bm25_brute(query)
        got = {r.chunk_id: r.score for r in retrieval.bm25_topk(chunks, query, 10).collect()}
        assert got == pytest.approx(want, abs=1e-8)
        queries = spark.createDataFrame([(7, query)], "query_id long, query_text string")
        assert {r.chunk_id: r.score for r in retrieval.bm25_batch(chunks, queries, 10).collect()} == pytest.approx(want, abs=1e-8)
    for query, k in (("the of", 5), ("", 5), ("python", 0), ("absent", 5)):
        assert retrieval.bm25_topk(chunks, query, k).count() == 0


def test_floored_idf(spark, chunks):
    got = {r.term: r.idf for r in retrieval.term_statistics(chunks, floored=True).collect()}
    raw = {t: math.log(5 - n + 0.5) - math.log(n + 0.5) for t, n in {"sorting": 2, "roses": 2, **dict.fromkeys(["python", "code", "about", "lists", "gardening", "colour"], 1)}.items()}
    assert got == pytest.approx(raw, abs=1e-8) and min(raw.values()) > 0
    common = spark.createDataFrame([("a", 9, 10), ("b", 1, 10)], "term string, df long, n long")
    low = math.log(1.5) - math.log(9.5)
    high = math.log(9.5) - math.log(1.5)
    assert {r.term: r.idf for r in retrieval.idf_floored(common).collect()} == pytest.approx({"a": 0.25 * (low + high) / 2, "b": high})


def test_fusion_of_two_lists(spark):
    dense = spark.createDataFrame([(i, r, f"d{i}") for r, i in enumerate([5, 6, 1, 7, 8], 1)], "chunk_id long, dense_rank int, text string")
    sparse = spark.createDataFrame([(i, r, f"s{i}") for r, i in enumerate([2, 9, 3, 4, 1], 1)], "chunk_id long, sparse_rank int, text string")
    got = {r.chunk_id: r for r in retrieval.fuse(dense, sparse).collect()}
    assert got[1].fused_score == pytest.approx(1 / 63 + 1 / 65) and got[5].fused_score == pytest.approx(1 / 61)
    assert got[1].text == "d1" and got[2].text == "s2" and got[1].fused_rank == 1
    assert (got[5].fused_rank, got[2].fused_rank) == (2, 3)  # equal scores: the dense list first
    only = retrieval.fuse(dense, sparse.limit(0)).orderBy("fused_rank")
    assert ids(only) == [5, 6, 1, 7, 8]


def test_search_reranks_and_survives_a_failing_scorer(spark, chunks):
    settings_ = SearchSettings(top_k=2, threshold=0.3, rerank=True, hybrid=True)
    score = lambda rows: F.col("chunk_id") - F.lit(3.0)
    found = retrieval.search(chunks, "sorting", [1.0, 0.0], settings_, scorer=score, diagnostics=True).collect()
    assert [r.chunk_id for r in found] == [4, 3] and all(r.reranked for r in found)
    assert "fused_rank" not in retrieval.search(chunks, "sorting", [1.0, 0.0], settings_, scorer=score).columns

    def fails(rows):
        raise RuntimeError("no model")

    def breaks(query, texts):
        if any("roses" in t for t in texts):
            raise RuntimeError("out of memory")
        return [len(t) for t in texts]

    pool = retrieval.dense_topk(chunks.where("embedding is not null"), [1.0, 0.0], 5)
    for score, worked in ((breaks, False), (lambda q, texts: [float(len(t)) for t in texts], True)):
        again = retrieval.rerank(pool, retrieval.scorer_of(score, "q"), 5).collect()
        assert [r.reranked for r in again] == [worked] * len(again)
        assert worked or [r.score for r in again] == [r.score for r in pool.collect()]

    plain = retrieval.search(chunks, "sorting", [1.0, 0.0], SearchSettings(top_k=3, rerank=True), scorer=fails, where={"category": "a"}, diagnostics=True).collect()
    assert not any(r.reranked for r in plain)
    assert retrieval.search(chunks.limit(0), "x", [1.0, 0.0], settings_).count() == 0


# Graphs.


def graph_nodes(spark):
    rows = [(1, "document/text", "x", ["k1", "k2"], "a", [1.0, 0.0]), (2, "document/text", "x", ["K3"], "a/b", [0.99, 0.1]), (3, "document/md", "", ["k2"], "a/b/c", [0.0, 1.0]), (4, "code/python", "x", ["k1"], "a/b", [1.0, 0.0]), (5, "document/md", None, None, "ab", [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id long, content_type string, category string, keywords array<string>, header_path string, embedding array<double>")


def test_pairs_of_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(docgraph, "BLOCK", 2)
    rows = [(i, f"c{i % 3}", "/".join("xyz"[: 1 + i % 3])) for i in range(20)] + [(3, "c1", "x/w")]
    nodes = spark.createDataFrame(rows, "chunk_id long, category string, header_path string")
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    category = docgraph.category_edges(nodes)
    assert pairs(category) == sorted((a, b) for a, x, _ in rows for b, y, _ in rows if x == y and a < b)
    assert pairs(docgraph.heading_edges(nodes)) == sorted({(a, b) for a, _, x in rows for b, _, y in rows if y.startswith(x + "/") and a != b})
    for edges in (category, docgraph.heading_edges(nodes.limit(20))):  # pairs are neither sorted nor sent
        assert "src" not in "".join(x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x or "Aggregate" in x)


def test_document_graph(spark, monkeypatch):
    nodes = docgraph.documents_only(graph_nodes(spark))
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pairs(docgraph.similarity_edges(nodes)) == [(1, 2)]
    monkeypatch.setattr(docgraph, "BLOCK", 2)
    assert pairs(docgraph.similarity_edges(nodes)) == [(1, 2)]
    assert pairs(docgraph.category_edges(nodes)) == [(1, 2)]
    assert [(r.src, r.dst, r.shared) for r in docgraph.keyword_edges(nodes).collect()] == [(1, 3, ["k2"])]
    assert pairs(docgraph.heading_edges(nodes)) == [(1, 2), (1, 3), (2, 3)]
    built = {(r.src, r.dst): r.relation for r in docgraph.build(graph_nodes(spark)).collect()}
    assert built == {(1, 2): "heading_child", (1, 3): "heading_child", (2, 3): "heading_child"}
    loose = spark.createDataFrame([(1, 2), (1, 99)], "src long, dst long")
    assert pairs(docgraph.attached(loose, nodes)) == [(1, 2)]
    members = nodes.withColumn("community", F.lit(0))
    assert [tuple(r) for r in docgraph.representative_category(members).collect()] == [(0, "x")]


def test_cross_links(spark):
    code = spark.createDataFrame([("src/auth/login.py", ["Session"]), ("main.py", ["Main"])], "path string, exports array<string>")
    docs = spark.createDataFrame([(1, "docs/login.md", "", []), (2, "docs/Session/x.md", "AUTH", None), (3, "readme.md", "", ["Auth"]), (4, None, None, None)], "chunk_id long, file_path string, category string, keywords array<string>")
    got = sorted(tuple(r) for r in docgraph.cross_links(code, docs).collect())
    assert got == [("src/auth/login.py", 1, "filename_match"), ("src/auth/login.py", 2, "keyword_overlap"), ("src/auth/login.py", 2, "symbol_match"), ("src/auth/login.py", 3, "keyword_overlap")]


SOURCES = [
    ("app/main.py", "python", "import app.util\nfrom app.models import User\nfrom .local import x\nclass Main(Base, Mixin[int]):\n    def run(self):\n        pass\n"),
    ("app/util.py", "python", "import os\nasync def helper():\n    pass\nclass Base:\n    pass\n"),
    ("app/models.py", "python", "from app.util import helper\nclass User(Base):\n    pass\n"),
    ("app/local.py", "python", "import app.models\nx = 1\n"),
    ("web/index.ts", "typescript", "import {a} from './lib'\nimport './style'\nconst b = require('../web/other')\nexport class View extends Panel {}\nexport const go = (x) => x\n"),
    ("web/lib/index.ts", "typescript", "export function a() {}\nclass Panel {}\n"),
    ("web/other.js", "javascript", "import {View} from './index'\nfunction plain() {}\nclass Sub extends View {}\n"),
    ("srv/Main.java", "java", "import srv.Helper;\npublic class Main extends Helper {\n}\n"),
    ("srv/Helper.java", "java", "public class Helper {\n}\n"),
]


def test_code_graph(spark):
    sources = spark.createDataFrame(SOURCES, "path string, language string, source string")
    found = {r.path: r for r in codegraph.extract(sources).collect()}
    main = found["app/main.py"]
    assert main.imports == ["app/util", "app/models", "/local"] and main.classes == ["Main"] and main.functions == ["run"] and main.exports == ["run", "Main"]
    assert [tuple(x) for x in main.inheritance] == [("Main", "Base"), ("Main", "Mixin")]
    view = found["web/index.ts"]
    assert view.imports == ["./lib", "./style", "../web/other"] and view.exports == ["View", "go"] and view.functions == ["go"]
    assert [tuple(x) for x in found["srv/Main.java"].inheritance] == [("Main", "Helper")] and found["srv/Main.java"].exports == []
    edges = {(r.src, r.dst, r.relation) for r in codegraph.build(sources).collect()}
    assert {("app/main.py", "app/util.py", "import"), ("app/main.py", "app/models.py", "import"), ("app/models.py", "app/util.py", "import"), ("app/local.py", "app/models.py", "import"), ("web/index.ts", "web/lib/index.ts", "import"), ("web/index.ts", "web/other.js", "import"), ("web/other.js", "web/index.ts", "import"), ("srv/Main.java", "srv/Helper.java", "inherits")} <= edges
    assert not any(s == d for s, d, _ in edges)


def test_hubs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    edges = spark.createDataFrame([(i, 0) for i in range(1, 8)] + [(i, 1) for i in range(2, 5)] + [(5, 2)], "src long, dst long")
    degrees = codegraph.in_degrees(nodes, edges)
    assert {r.node: r.in_degree for r in codegraph.hubs(degrees).collect()} == {0: 7, 1: 3, 2: 1}
    assert codegraph.hubs(codegraph.in_degrees(nodes, edges.limit(0))).count() == 0


def test_communities_and_bridges(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    edges = clique(range(5)) + clique(range(5, 10)) + [(4, 5)]
    assert len(set(codegraph.louvain(list(range(10)), edges).values())) == 2
    assert codegraph.louvain([1, 2, 3], [(1, 2)]) == {1: 0, 2: 0, 3: 0}
    line = codegraph.betweenness([0, 1, 2, 3, 4], [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert line == pytest.approx({0: 0, 1: 0.5, 2: 4 / 6, 3: 0.5, 4: 0})
    graphs = spark.createDataFrame([(7, a, b) for a, b in edges] + [(8, 1, 2), (8, 3, None)], "graph long, src long, dst long")
    members = codegraph.communities(graphs)
    assert {(r.graph, r.community) for r in members.collect()} == {(7, 0), (7, 1), (8, 0)}
    assert {(r.graph, r.node) for r in codegraph.bridges(graphs, members).collect()} == {(7, 4), (7, 5)}
    counts = codegraph.internal_edges(graphs.where("graph = 7").select("src", "dst"), members.where("graph = 7"))
    assert sorted(r.edge_count for r in counts.collect()) == [10, 10]


# Evaluation.


def test_metrics_of_one_query(spark):
    ranking = spark.createDataFrame([(1, r, d) for r, d in enumerate("xaybz", 1)], "query_id long, rank int, doc string")
    relevant = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "q", 1), (2, "w", 1)], "query_id long, doc string, grade int")
    m = {r.query_id: r for r in evaluate.hit_mrr_recall(ranking, relevant, 3).collect()}
    assert (m[1].hit, m[1].mrr) == (1, 0.5) and m[1].recall == pytest.approx(1 / 3) and (m[2].hit, m[2].mrr, m[2].recall) == (0, 0, 0)
    dcg = 3 / math.log2(3) + 1 / math.log2(5)
    ideal = 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert {r.query_id: r.ndcg for r in evaluate.ndcg(ranking, relevant, 5).collect()} == pytest.approx({1: dcg / ideal, 2: 0})
    nuggets = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 2, "q")], "query_id long, nugget_id int, doc string")
    assert evaluate.coverage(ranking, nuggets, 4).first().coverage == pytest.approx(2 / 3)
    assert evaluate.alpha_dcg(ranking, nuggets, 5).first().alpha_dcg == pytest.approx(1 / math.log2(3) + 1.5 / math.log2(5))
    assert evaluate.ideal_alpha_dcg(nuggets, 5).first().ideal == pytest.approx(2 + 1 / math.log2(3) + 0.5 / 2)
    gained = evaluate.contribution(ranking.where("doc <> 'b'"), ranking.where("doc <> 'a'"), relevant.select("query_id", "doc"), 5).first()
    assert (gained.gained, gained.lost) == (1, 1)


def test_paired_bootstrap(spark):
    one = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(60)], "query_id long, mrr double")
    other = spark.createDataFrame([(i, 0.5 + i % 3 + (i % 2) * 0.2) for i in range(50)], "query_id long, mrr double")
    got = evaluate.bootstrap_difference(one, other, "query_id", "mrr", resamples=2000).first()
    assert got.mean == pytest.approx(0.4) and 0.36 < got.low < 0.4 < got.high < 0.44


@pytest.mark.parametrize("values", [[], [0.25], [0.0, 1.0], [0.5, 0.0, 1.0, 0.5, 0.2], [float(i % 7) for i in range(40)]])
def test_bootstrap_equals_draws_one_by_one(spark, values):
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = evaluate.bootstrap_mean(table, "v", resamples=200, seed=5).first()
    ordered, n = sorted(values), len(values)
    draw = lambda b, j: ordered[int(hashlib.md5(f"5:{b}:{j}".encode()).hexdigest()[:15], 16) % n]
    means = sorted(sum(draw(b, j) for j in range(n)) / n for b in range(200)) if n else [0.0] * 200
    assert (got.mean, got.low, got.high) == pytest.approx((sum(values) / n if n else 0.0, means[5], means[195]))


def test_numbers_are_dense(spark):
    table = spark.createDataFrame([(i % 5, i) for i in range(200)], "a long, b long").repartition(7)
    rows = numbering.numbered(table, ["a", "b"]).collect()
    assert [r.number for r in sorted(rows, key=lambda r: (r.a, r.b))] == list(range(200))
    assert numbering.numbered(table.limit(0), ["a"]).count() == 0


def test_means_samples_and_intervals(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "kind string, hit double")
    assert {r.kind: r.hit for r in evaluate.grouped_means(rows, "kind", ["hit"]).collect()} == pytest.approx({"a": 0.5, "b": 1, "all": 2 / 3}, abs=1e-6)
    lat = evaluate.latency(spark.createDataFrame([(float(i),) for i in range(1, 21)], "ms double"), "ms").first()
    assert (lat.p50, lat.p95) == (10.5, 19.05)
    pool = spark.createDataFrame([(i, i % 4 == 0) for i in range(100)], "doc_id long, good boolean")
    sample = evaluate.stratified_sample(pool, F.col("good"), 21, 0.5, "doc_id").collect()
    assert len({r.doc_id for r in sample}) == 21 and sum(r.good for r in sample) == 10
    filled = evaluate.required_plus_distractors(pool, pool.where("doc_id < 5"), 20, "doc_id")
    assert filled.count() == 20 and filled.where("doc_id < 5").count() == 5
    ci = evaluate.bootstrap_mean(pool.withColumn("v", F.col("good").cast("double")), "v", 400).first()
    assert ci.mean == 0.25 and 0.12 < ci.low < 0.22 and 0.28 < ci.high < 0.4


# Chunks.


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c.", "?d", "e!?", "\n", ".", "f\n"]), max_size=90), st.integers(1, 12), st.integers(0, 6))
def test_sentence_chunks_keep_all_words(parts, size, overlap):
    text = " ".join(parts)
    chunks = chunking.split_sentences(text, size, overlap)
    assert all(0 < len(c.split()) <= size for c in chunks)
    words, at = text.split(), 0
    for c in chunks:  # each chunk goes on where the last one ended, or up to `overlap` words before
        w = c.split()
        step = next(k for k in range(min(overlap, at) + 1) if words[at - k : at - k + len(w)] == w)
        at = at - step + len(w)
    assert at == len(words)


def test_markdown_and_code_chunks(spark):
    assert chunking.split_headings("intro\n# A\nx\n## B\ny\n```\n# no\n```\n# C") == [("", "intro"), ("A", "# A\nx"), ("A/B", "## B\ny\n```\n# no\n```"), ("C", "# C")]
    source = "import a\n\ndef one():\n    pass\n\n\nclass Two:\n    def x(self):\n        pass\n" * 3
    assert "".join(chunking._code_blocks(source, 10)).replace("\n", "") == source.replace("\n", "") and len(chunking._code_blocks(source, 10)) > 1
    rows = spark.createDataFrame([("a.md", "document/markdown", "# H\n" + "w " * 30), ("b.py", "code/python", "def f():\n    pass"), ("c.yml", "config/yaml", "k: v\n"), ("d", None, "plain text. more"), ("e.txt", "document/text", None)], "file_path string, content_type string, text string")
    got = chunking.dispatch(rows)
    by_file = {r.file_path: r for r in got.collect()}
    assert by_file["a.md"].header_path == "H" and by_file["b.py"].chunk == "def f():\n    pass" and by_file["c.yml"].chunk == "k: v\n" and by_file["d"].chunk == "plain text. more" and "e.txt" not in by_file
    once = chunking.prepend_heading(F.col("chunk"), F.col("header_path"))
    twice = got.withColumn("chunk", once).select(chunking.prepend_heading(F.col("chunk"), F.col("header_path")).alias("c"), "file_path").where("file_path = 'a.md'")
    assert twice.first().c.startswith("[H] # H") and not twice.first().c.startswith("[H] [H]")


def test_tables_and_columns(spark):
    cells = spark.createDataFrame([(1, 0, 0, "h"), (1, 0, 1, "g"), (1, 1, 0, "x"), (1, 2, 1, "y")], "table_id long, row int, column int, value string")
    assert chunking.table_to_markdown(cells).first().markdown == "| h | g |\n| --- | --- |\n| x |  |\n|  | y |"
    groups = {r.row_group: r.markdown for r in chunking.table_to_markdown(cells, 2).collect()}
    assert groups == {0: "| h | g |\n| --- | --- |\n| x |  |", 1: "|  | y |\n| --- | --- |"}
    items = spark.createDataFrame([(1, 0, 10.0, 5.0), (1, 1, 90.0, 10.0), (2, 0, 80.0, 5.0), (2, 1, 1.0, 1.0), (3, 0, 50.0, 1.0)], "page long, position int, x double, width double")
    assert {r.page: r.column for r in chunking.column_label(items).collect()} == {1: "left", 2: "right", 3: "single"}


# Files and the store.


def test_files(spark, tmp_path):
    for name, body in {"a.txt": "one", "b.md": "# h", "c.bin": "x", "d.html": "<p>t &amp; u</p><script>no</script>", "e.csv": 'a,"b, c"\n', ".hidden.txt": "h", "f.pdf": "%PDF", "sub/g.txt": "two", "sub/node_modules/h.txt": "no"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    found = files.discover(spark, str(tmp_path / "in"))
    ok, skipped = files.split_supported(found)
    assert {p.rsplit("/", 1)[1] for p in ids(skipped, "path")} == {"c.bin"}
    texts = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(ok).collect()}
    assert texts["a.txt"].text == "one" and texts["d.html"].text == "t & u" and texts["e.csv"].text == "a, b, c" and texts["f.pdf"].error and texts["f.pdf"].text is None
    seen = spark.createDataFrame([("a/.h.txt",), ("a/~$b.docx",), ("a/c.tmp",), ("a/d.md",), ("e.exe",)], "path string")
    assert ids(seen.where(~files.ignored(F.col("path"))), "path") == ["a/d.md"]
    names = spark.createDataFrame([("src/a.PY",), ("x/logo.png",), ("README",), ("node_modules/a.js",), ("/".join("abcdefghijkl") + ".py",)], "path string")
    counts, entries = files.inventory(names)
    assert {r.content_type: r.n for r in counts.collect()} == {"code/python": 1, "binary/png": 1, "unknown/unknown": 1} and entries.count() == 3
    (tmp_path / "t.jsonl").write_text(json.dumps({"path": "a.py", "result": {"value": {"output": {"group": "code", "label": "python", "is_text": True}}}}) + "\nbroken\n")
    assert [tuple(r) for r in files.read_type_lines(spark, str(tmp_path / "t.jsonl")).collect()] == [("a.py", "code", "python", True)]
    assert len(files.content_hash(found).first().sha256) == 64


def office_file(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_office_files_and_pages(spark, tmp_path):
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    office_file(tmp_path / "a.docx", {"word/document.xml": f"<w:document {word}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>"})
    draw = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    office_file(tmp_path / "b.pptx", {f"ppt/slides/slide{i}.xml": f"<s {draw}><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></s>" for i in (10, 2)})
    (tmp_path / "c.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(files.discover(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "One two\nThree\tx" and got["c.docx"].error
    assert [(p.label, p.text) for p in got["b.pptx"].pages] == [("2", "Slide 2"), ("10", "Slide 10")]


def test_types_are_judged_below_the_root(spark, tmp_path):
    deep = tmp_path / "build" / "/".join("abcdefghijkl") / "in"
    (deep / "node_modules").mkdir(parents=True)
    for name in ("a.py", "node_modules/b.py"):
        (deep / name).write_text("x")
    found = files.discover(spark, str(deep))
    assert sorted(ids(found, "relative")) == ["a.py", "node_modules/b.py"]
    assert ids(files.detect_types(found, "relative"), "relative") == ["a.py"]
    types = files.detected(found, spark.createDataFrame([(p, "document", "text", True) for p in ids(found.where("relative = 'a.py'"), "path")], "path string, group string, label string, is_text boolean"))
    assert [(r.expected, r.found) for r in files.mismatches(types).collect()] == [("python", "text")]
    assert files.run_detector(spark, str(deep), ["no-such-command"]) is None
    lines = files.run_detector(spark, "", ["printf", '%s', '{"path": "q.py", "output": {"group": "code", "label": "python"}}'])
    assert [tuple(r) for r in lines.collect()] == [("q.py", "code", "python", True)]


def test_code_is_cut_by_language(spark):
    rust = "use a;\n" * 3 + "#[test]\npub fn one() {\n    x\n}\nstruct Two;\n"
    assert chunking._code_blocks(rust, 8, "rust") == ["use a;\nuse a;\nuse a;", "#[test]\npub fn one() {\n    x\n}", "struct Two;\n"]
    rows = spark.createDataFrame([("a.go", None, "func a() {}"), ("b.xyz", None, "plain. text"), ("c.css", "code/css", "p {}"), ("d.md", None, "# T\nx")], "file_path string, content_type string, text string")
    kinds = {r.file_path: r for r in chunking.dispatch(rows, fallback="code").collect()}
    assert len(kinds) == 4 and kinds["d.md"].header_path == "T"
    assert {r.file_path: r.language for r in rows.select("file_path", chunking.language_of(F.col("content_type"), F.col("file_path")).alias("language")).collect()} == {"a.go": "go", "b.xyz": None, "c.css": None, "d.md": None}


def test_store_survives_broken_writes_and_sees_each_change(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("c", {"profile": "p0"}, buckets=4)
    for i in (1, 2):
        store.merge_metadata("c", {"profile": f"p{i}"})
        assert store.metadata("c")["profile"] == f"p{i}"
    rows = lambda *xs: spark.createDataFrame([(str(i), t, [1.0, 0.0], p) for i, t, p in xs], "chunk_id string, text string, embedding array<float>, file_path string")
    store.upsert("c", rows(*((i, f"word{i} common", f"f{i}") for i in range(20))))
    (tmp_path / "store/c/data/left-over").mkdir()
    (tmp_path / "store/c/versions/000000000099").write_text("")  # a writer that broke off
    before = store._latest("c")["parts"]
    store.upsert("c", rows((100, "word3 new common", "f3")))
    after = store._latest("c")["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.count("c") == 20
    index = store.index("c")
    assert {r.chunk_id for r in retrieval.bm25_scores(index, "word3 new").collect()} == {"100"} and index.statistics().first().n == 20
    plain, indexed = ({r.chunk_id: r.score for r in retrieval.bm25_topk(store.chunks("c"), "common word5", 30, index=i).collect()} for i in (None, index))
    assert plain == pytest.approx(indexed) and len(plain) == 20
    state = store._begin("c")
    store.merge_metadata("c", {"x": "1"})
    with pytest.raises(ConcurrentWrite):
        store._commit("c", state)
    assert [len(ids(store.page("c", 7, o))) for o in (0, 7, 14, 21)] == [7, 7, 6, 0]
    assert store.vacuum("c", versions=1, hours=0) >= 1 and store.count("c") == 20 and not (tmp_path / "store/c/data/left-over").exists()
    store.delete("c", {"file_path": "f3"})
    assert not retrieval.bm25_scores(store.index("c"), "word3").count()


def test_store_contract(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.names() == [] and not store.exists("c") and store.count("c") == 0 and store.generation("c") == 0
    rows = lambda *xs: spark.createDataFrame([(str(i), t, [float(i), 1.0], p, c) for i, t, p, c in xs], "chunk_id string, text string, embedding array<float>, file_path string, category string")
    store.create("c", {"profile": "documents"})
    store.create("c")
    store.upsert("c", rows((1, "a", "f1", "AI"), (2, "b", "f1", "AI"), (3, "c", "f2", "Bio")))
    assert store.count("c") == 3 and store.generation("c") == 1 and store.metadata("c") == {"profile": "documents"}
    assert [store.count_where("c", {"category": x}) for x in ("AI", "Bio", "no")] == [2, 1, 0]
    new = rows((4, "d", "f1", "AI"))
    store.upsert("c", new)
    store.upsert("c", new)  # the same again changes nothing but the version
    assert sorted(ids(store.chunks("c"))) == ["3", "4"] and store.generation("c") == 3
    with pytest.raises(DimensionMismatch):
        store.upsert("c", new.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert store.preview_delete("c", path="f1") == 1 and store.preview_delete("c") == 2 and store.preview_delete("none") == 0
    with pytest.raises(ValueError):
        store.preview_delete("c", "f1", {"category": "AI"})
    assert store.delete("c", {"category": "no"}) == 0 and store.generation("c") == 3
    assert store.delete("c", {"category": "AI"}) == 1 and store.generation("c") == 4 and ids(store.chunks("c")) == ["3"]
    store.merge_metadata("c", {"x": "1"})
    assert store._latest("c")["metadata"] == {"profile": "documents", "x": "1"} and store.count("c") == 1
    assert [tuple(r) for r in store.statistics().collect()] == [("c", 1, 1)]
    for call in (lambda: store.delete("none", {"a": 1}), lambda: store.drop("none")):
        with pytest.raises(MissingCollection):
            call()
    store.drop("c")
    assert not store.exists("c")


# Streaming.


def events(spark, rows):
    return spark.createDataFrame([(t, p, k, h) for t, p, k, h in rows], "second long, path string, kind string, sha256 string").select(F.timestamp_seconds("second").alias("ts"), "path", "kind", "sha256")


def test_bursts_and_content_changes(spark):
    e = events(spark, [(0, "a", "created", "1"), (1, "a", "modified", "2"), (10, "a", "modified", "2"), (20, "a", "deleted", None), (30, "a", "created", "2"), (0, "b", "created", "9")])
    bursts = watch.debounced(e)
    assert {(r.path, r.n_events, r.kind) for r in bursts.collect()} == {("a", 2, "modified"), ("a", 1, "modified"), ("a", 1, "deleted"), ("a", 1, "created"), ("b", 1, "created")}
    assert {(r.path, r.kind, r.started.second) for r in watch.content_changes(bursts).collect()} == {("a", "modified", 0), ("a", "deleted", 20), ("a", "created", 30), ("b", "created", 0)}


def test_stream_gives_the_batch_result(spark, tmp_path):
    random.seed(1)
    rows = [(random.randint(0, 500), random.choice("abc"), "modified", str(random.randint(0, 3))) for _ in range(120)] + [(5000, "z", "created", "0")]
    events(spark, rows).repartition(3).write.parquet(f"{tmp_path}/events")
    applied, gone = [], []
    sink = watch.WatchSink(spark, f"file://{tmp_path}/state", lambda df: applied.extend(map(tuple, df.collect())), lambda df: gone.extend(map(tuple, df.collect())))
    stream = spark.readStream.schema("ts timestamp, path string, kind string, sha256 string").parquet(f"{tmp_path}/events")
    query = watch.watch(stream, sink, f"{tmp_path}/cp", trigger={"availableNow": True})
    query.awaitTermination(120)
    last = {r.path: r.sha256 for r in watch.debounced(events(spark, rows)).groupBy("path").agg(F.max_by("sha256", "ended").alias("sha256")).collect() if r.path != "z"}
    assert dict(applied) == last and not gone  # z's burst is still open
    sink(watch.debounced(events(spark, [(9000, p, "modified", h) for p, h in last.items()] + [(9000, "q", "deleted", None)])), 99)
    assert len(applied) == len(last) and gone == [("q",)]  # known content isn't applied again
    sink(watch.debounced(events(spark, [(9100, "a", "modified", "new")])), 99)
    assert len(applied) == len(last)  # a batch that comes again is done already
    assert watch.shut_down(query)

    def fails(_):
        raise ConnectionError

    sink.upsert, sink.most = fails, 1
    for n in (1, 2):
        with pytest.raises(ConnectionError):
            sink(watch.debounced(events(spark, [(9200, "b", "modified", "new")])), 100)
        assert sink.errors == n
    sink.upsert = lambda df: None
    sink(watch.debounced(events(spark, [(9200, "b", "modified", "new")])), 100)
    assert sink.errors == 0 and [r.path for r in sink._state(101).collect()] == ["b"]


def test_watcher_hands_on_changes_and_follows_no_link_out(spark, tmp_path):
    root, outside = tmp_path / "in", tmp_path / "secret.txt"
    root.mkdir()
    outside.write_text("not yours")
    (root / "a.txt").write_text("one")
    (root / "b.md").write_text("two")
    (root / "skip.tmp").write_text("x")
    (root / "link.txt").symlink_to(outside)
    done = []
    sink = watch.WatchSink(spark, f"file://{tmp_path}/state", lambda rows: done.append(("up", sorted(p.rsplit("/", 1)[1] for p in ids(rows, "path")))), lambda rows: done.append(("gone", sorted(p.rsplit("/", 1)[1] for p in ids(rows, "path")))))
    watcher = watch.Watcher(spark, str(root), sink, most=1)
    assert [watcher.look() for _ in range(3)] == [1, 1, 0] and sorted(x for kind, x in done if kind == "up" and x) == [["a.txt"], ["b.md"]]
    (root / "a.txt").write_text("one more")
    (root / "b.md").unlink()
    done.clear()
    stops = iter([False] * 3 + [True])
    watcher.run(lambda: next(stops), 0)
    assert ("up", ["a.txt"]) in done and ("gone", ["b.md"]) in done


def test_listing_differences(spark):
    a, b = events(spark, [(0, "x", "", "1"), (0, "y", "", "1")]), events(spark, [(5, "y", "", "2"), (5, "z", "", "3")])
    assert {(r.path, r.kind) for r in watch.listing_events(a, b).collect()} == {("x", "deleted"), ("y", "modified"), ("z", "created")}


def test_relevance_by_group_is_that_of_its_pairs(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice([0, 1, 2, None]) if i else 9, n, i % 3) for i in range(60) for n in rng.sample(range(4), rng.choice([1, 2]))]
    table = spark.createDataFrame(docs, "doc long, `group` int, nugget_id int, grade int")
    queries = table.where("doc % 5 = 0").select(F.col("doc").alias("query_id"), "group").distinct()
    by_group = evaluate.Grouped(queries, table)
    pairs = queries.join(table, "group").where("query_id <> doc")
    ranking = spark.createDataFrame([(q, r, d) for q in range(0, 60, 5) for r, d in enumerate(rng.sample(range(60), 20), 1)], "query_id long, rank int, doc long")
    once = table.dropDuplicates(["doc"])
    graded = evaluate.Grouped(queries, once), queries.join(once, "group").where("query_id <> doc")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for k in (1, 3, 10):
        assert rows(evaluate.hit_mrr_recall(ranking, by_group, k)) == rows(evaluate.hit_mrr_recall(ranking, pairs, k))
        assert rows(evaluate.coverage(ranking, by_group, k)) == rows(evaluate.coverage(ranking, pairs, k))
        assert rows(evaluate.alpha_dcg(ranking, by_group, k)) == rows(evaluate.alpha_dcg(ranking, pairs, k))
        assert rows(evaluate.ideal_alpha_dcg(by_group, k)) == rows(evaluate.ideal_alpha_dcg(pairs, k))
        assert rows(evaluate.ndcg(ranking, graded[0], k)) == rows(evaluate.ndcg(ranking, graded[1], k))
        assert rows(evaluate.contribution(ranking, ranking.withColumn("rank", 21 - F.col("rank")), by_group, k)) == rows(evaluate.contribution(ranking, ranking.withColumn("rank", 21 - F.col("rank")), pairs, k))


def test_alpha_ndcg_is_a_share_of_the_ideal(spark):
    ranking = spark.createDataFrame([(q, r, d) for q in (1, 2, 3) for r, d in enumerate("xaybz", 1)], "query_id long, rank int, doc string")
    nuggets = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 2, "q"), (2, 1, "w"), (3, None, "x")], "query_id long, nugget_id int, doc string")
    got = {r.query_id: r.alpha_ndcg for r in evaluate.alpha_ndcg(ranking, nuggets, 5).collect()}
    ideal = 2 + 0.5 / math.log2(3) + 0.5 / math.log2(4)
    assert got == {1: pytest.approx((1 / math.log2(3) + 1.5 / math.log2(5)) / ideal), 2: 0, 3: 0}
    best = spark.createDataFrame([(1, r, d) for r, d in enumerate("baq", 1)], "query_id long, rank int, doc string")
    assert {r.query_id: r.alpha_ndcg for r in evaluate.alpha_ndcg(best, nuggets, 5).collect()} == {1: 1, 2: 0, 3: 0}
