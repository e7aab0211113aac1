"""The public calls end to end on a small folder."""

from __future__ import annotations

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.api import Engine
from lodestream.operators import embedding, metadata
from lodestream.operators.policy import resolve_profile
from lodestream.operators.registry import CHUNKING, EMBEDDING, METADATA, PDF, RETRIEVAL
from lodestream.plans import codemap, ingest
from lodestream.sources import files, pdf


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "python.txt").write_text("Python is a language. Its compiler emits bytecode.")
    (docs / "roses.md").write_text("# Roses\n\nRoses grow in gardens.\n\n## Care\n\nWater the roses.")
    (docs / "broken.csv").write_bytes(b"\xff\xfe\x00bad")
    (docs / "image.png").write_bytes(b"x")
    return docs


def test_ingest_search_list_delete(spark, engine, folder):
    report = engine.ingest_documents(str(folder))
    assert (report["status"], report["files_indexed"], report["files_failed"], report["files_skipped"]) == ("ok", 2, 1, 1)
    assert json.loads(ingest.report_text(report, str(folder), True))["summary"]["indexed"] == 2
    assert "| indexed | 2 |" in ingest.report_text(report, str(folder), False)
    again = engine.ingest_documents(str(folder))
    assert again["chunks_removed"] == again["chunks_created"] == report["chunks_created"]
    best = engine.search_documents("water roses", top_k=1, hybrid=True, diagnostics=True).first()
    assert best.file_name == "roses.md" and best.header_path == "Roses/Care" and best.rerank_reason
    dense = engine.search_documents("python bytecode compiler", top_k=1, rerank=False).first()
    assert dense.file_name == "python.txt" and dense.category == "Programming" and "fused_score" not in dense.asDict()
    assert engine.search_documents("anything", collection="none").count() == 0
    assert engine.search_documents("x", metadata_filter={"a": {"$no": 1}})["error_type"] == "validation"
    assert engine.search_documents("x", metadata_filter={"no_such_column": 1})["error_type"] == "retrieval"
    sources = [r.source.rsplit("/", 1)[1] for r in engine.list_indexed_documents().collect()]
    assert sources == ["python.txt", "roses.md"] and engine.list_collections().first().sources == 2
    path = [r.source for r in engine.list_indexed_documents().collect()][1]
    assert engine.delete_documents(path=path, dry_run=True)["chunks"] == 2
    assert engine.delete_documents(path=path) == {"status": "ok", "mode": "path", "chunks_removed": 2}
    assert engine.delete_documents(metadata_filter={})["error_type"] == "validation"
    assert engine.delete_documents()["chunks_removed"] == 1 and engine.delete_documents()["status"] == "error"


def test_interrupted_ingestion_writes_nothing(engine, folder):
    assert engine.ingest_documents(str(folder), stopped=lambda: True)["status"] == "interrupted" and not engine.store.exists("documents")


@pytest.mark.parametrize("asked", [1, 2, 3])
def test_ingestion_stops_at_each_step(engine, folder, asked):
    answers = iter([False] * (asked - 1) + [True])
    report = engine.ingest_documents(str(folder), stopped=lambda: next(answers))
    assert report["status"] == "interrupted" and not engine.store.exists("documents") and next(answers, None) is None
    assert (report["file_details"].count() > 0) == (asked == 3)


def test_no_file_goes_unreported(engine, tmp_path):
    root = tmp_path / "build" / "/".join("abcdefghijkl")
    for name in ("x.md", "node_modules/y.txt", "/".join("abcdefghijklmn") + "/z.txt", "w.exe"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("some words")
    report = engine.ingest_documents(str(root))
    assert (report["files_indexed"], report["files_skipped"], report["files_failed"]) == (3, 1, 0)
    assert engine.ingest_documents(str(root / "none"))["error_type"] == "file"
    assert "Unsupported file extension: .exe" in engine.ingest_documents(str(root / "w.exe"))["message"]
    assert engine.ingest_documents(str(root / "x.md"))["files_indexed"] == 1


def test_profiles(engine):
    engine.store.create("c")
    preview = engine.change_collection_profile("c", "codebase")
    assert preview["status"] == "preview" and engine.store.metadata("c") == {}
    assert engine.change_collection_profile("c", "codebase", confirm=True)["status"] == "ok" and engine.store.metadata("c") == {"profile": "codebase"}
    assert engine.change_collection_profile("c", "hybrid")["error_type"] == "validation"


def test_codebase_map(spark, engine, tmp_path):
    project = tmp_path / "project"
    (project / "app").mkdir(parents=True)
    for i in range(6):
        (project / "app" / f"m{i}.py").write_text("import app.m0\n" if i else "class Base:\n    pass\n")
    subprocess.run("git init -q . && git add -A && git -c user.name=t -c user.email=t@t commit -qm x", shell=True, cwd=project, check=True)
    text = engine.get_codebase_map(str(project), root=str(tmp_path))
    assert "code/python: 6" in text and "app/m0.py (imported by 5)" in text and "6 files, 5 edges" in text
    cache = project / ".lodestream" / codemap.CACHE
    cache.write_text(json.dumps({"commit": codemap.commit_of(project), "map": {"types": {"held": 1}, "communities": [], "hubs": [], "cross_links": []}}))
    assert "held: 1" in engine.get_codebase_map(str(project), root=str(tmp_path))
    cache.write_text("{broken")
    assert "held" not in engine.get_codebase_map(str(project), root=str(tmp_path))
    assert engine.get_codebase_map("/", root=str(tmp_path))["error_type"] == "validation"


def test_map_of_types_binaries_and_topics(spark):
    sources = spark.createDataFrame([("a/x.py", "import a.y"), ("a/r.md", ""), ("a/s.markdown", ""), ("a/pic.png", None), ("a/odd.txt", "x"), *((f"b/{i:02d}.exe", None) for i in range(12)), ("a/plain", "y")], "path string, source string")
    documents = spark.createDataFrame([(i, "document/text", "roses" if i < 6 else "", [], "d/x.md") for i in range(9)], "chunk_id long, content_type string, category string, keywords array<string>, file_path string")
    edges = spark.createDataFrame([(i, j) for g in (range(6), range(6, 9)) for i in g for j in g if i < j], "src long, dst long")
    text = codemap.render(codemap.build(sources, documents, doc_edges=edges))
    assert "document/markdown: 2 (*.markdown, *.md)" in text and "- a/pic.png (png)" in text and "- b/08.exe (exe)\n- and 3 more" in text
    assert "- roses (6 chunks)\n- Topic 2 (3 chunks)" in text and "ending says" not in text
    types = spark.createDataFrame([("a/odd.txt", "code", "rust", True), ("a/x.py", "binary", "elf", False)], "path string, group string, label string, is_text boolean")
    text = codemap.render(codemap.build(sources, types=types))
    assert "### Not what the ending says\n- a/odd.txt: rust" in text and "- a/x.py (elf)" in text and "code/rust: 1 (*.txt)" in text


def test_detected_binaries_are_skipped(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.md", "d.exe"):
        (tmp_path / name).write_text("some words")
    found = files.discover(spark, str(tmp_path))
    path = {r.relative: r.path for r in found.select("relative", "path").collect()}
    types = spark.createDataFrame([(path["a.txt"], "binary", "elf", False), (path["c.md"], "document", "markdown", True)], "path string, group string, label string, is_text boolean")
    chunks, details = ingest.chunk_files(found, resolve_profile(None), types=types)
    got = {r.path: (r.status, r.chunks, r.error) for r in details.collect()}
    assert got == {path["a.txt"]: ("skipped", 0, "binary file"), path["b.txt"]: ("indexed", 1, None), path["c.md"]: ("indexed", 1, None), path["d.exe"]: ("skipped", 0, "unsupported extension .exe")}
    assert {r.file_path for r in chunks.collect()} == {path["b.txt"], path["c.md"]}


def test_model_metadata_retries_and_falls_back(spark):
    docs = spark.createDataFrame([("a good text",), ("a bad text",), (None,)], "text string")

    def client(question):
        if "bad" in question:
            raise ConnectionError
        return '```json\n{"category": "New Things", "keywords": ["A", "b"], "summary": "s"}\n```'

    got = {r.text: (r.category, r.keywords, r.summary) for r in metadata.by_model(docs, client=client, categories=["ai"], wait=0).collect()}
    assert got["a good text"] == ("new_things", "a, b", "s") and got["a bad text"] == ("uncategorised", "", "")
    assert "ai" in metadata.prompt("x" * 9000, ["ai"]) and len(metadata.prompt("x" * 9000, [])) < 3300
    with pytest.raises(ValueError):
        metadata.by_model(docs)
    assert metadata.categories_of(metadata.by_keywords(docs)) == []


def test_each_word_is_hashed_once(monkeypatch):
    import xxhash

    calls, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: calls.append(x) or digest(x))
    monkeypatch.setattr(embedding, "KEPT", 3)
    texts = ["quince quince medlar", "medlar quince sorb damson quince", "the"]
    got = embedding.hashing(texts, 32)
    want = np.zeros((3, 32))
    for row, t in zip(want, texts, strict=True):
        for w in [w for w in t.split() if w != "the"]:
            for weight, part in [(1.0, w), *((0.3, f"^{w}$"[i : i + 3]) for i in range(len(w)))]:
                row[digest(part) % 32] += weight if digest(part) >> 63 else -weight
    want[:2] /= np.linalg.norm(want[:2], axis=1)[:, None]
    assert got == pytest.approx(want, abs=1e-6) and calls.count("medlar") == 1 and calls.count("sorb") == 1


def test_embedders(spark):
    a, b, c, none = embedding.hashing(["red roses", "roses red", "compilers", ""])
    assert a @ b > 0.99 > 0.3 > a @ c and not none.any()
    calls = []
    q = embedding.QueryEmbedder(lambda t: calls.append(t) or np.ones((1, 2)), "m")
    assert q("x") == q("x") == [1.0, 1.0] and len(calls) == 1
    q = embedding.QueryEmbedder(lambda t: calls.append(t) or np.ones((1, 2)), None)
    q("x"), q("x")
    assert len(calls) == 3
    rows = embedding.embed(spark.createDataFrame([("x",), (None,)], "text string"), "text", batch=1)
    assert rows.select(F.size("embedding")).distinct().first()[0] == embedding.DIMENSIONS
    assert embedding.benchmark(embedding.hashing, ["a"] * 5, 2)["texts"] == 5


def test_registries_and_readers():
    assert CHUNKING.get("markdown").__name__ == "markdown" and EMBEDDING.get("hashing") is embedding.hashing
    assert "bm25" in RETRIEVAL.available() and METADATA.get("disabled") is metadata.disabled and PDF.get("pypdf") is pdf.pypdf
    METADATA.register("own", lambda rows, **_: rows)
    assert "own" in METADATA.available()
    with pytest.raises(ValueError):
        CHUNKING.get("none")
    assert pdf.choose("auto", lambda n: n == "pypdf" or None) == "pypdf" and pdf.choose("pypdfium2") == "pypdfium2"
    with pytest.raises(ValueError):
        pdf.choose("other")
    assert pdf.choose("auto", lambda n: None) == "builtin" and PDF.get("builtin") is pdf.builtin
