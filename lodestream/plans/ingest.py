"""Ingestion as one plan: discover, type, read, classify, chunk, embed, replace.

A file that can't be read is a row with an error and doesn't stop the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.operators import chunking, embedding
from lodestream.operators.policy import Profile, resolve_profile
from lodestream.operators.registry import METADATA
from lodestream.scratch import drop_table, materialize
from lodestream.sources import files
from lodestream.sources.store import Store


class Interrupted(Exception):
    """Ingestion was asked to stop."""


def chunk_files(found: DataFrame, profile: Profile, mode: str = "keyword", embedder: Callable[[list[str]], np.ndarray] = embedding.hashing, types: DataFrame | None = None, stopped: Callable[[], bool] = lambda: False, **options) -> tuple[DataFrame, DataFrame]:
    """Chunks in the store's columns, and (path, status, chunks, error) of every file of ``found``.

    ``types`` (path, group, label, is_text) are a detector's; files that it doesn't name, or all
    without one, go by ending. Files of binary types are skipped, whatever their ending. Files outside
    the scan's scope have no type and are cut by the fallback. ``stopped`` is asked when the texts are
    read, before they are classified, cut and embedded.
    """
    supported, skipped = files.split_supported(found)
    kinds = files.with_types(supported) if types is None else files.detected(supported, types).join(supported.select("path", "relative"), "path")
    kinds = kinds.select("path", F.when(files.in_scope(F.col("relative")), F.col("content_type")).alias("content_type"))
    binary = kinds.where(F.startswith("content_type", F.lit("binary"))).select("path", F.lit("skipped").alias("status"), F.lit("binary file").alias("reason"))
    skipped = skipped.select("path", "status", "reason").unionByName(binary)
    supported = supported.join(binary, "path", "left_anti")
    texts = materialize(files.read_texts(supported), "ingest-texts")
    if stopped():
        drop_table(texts.sparkSession, texts)
        raise Interrupted
    typed = texts.where("error is null").join(kinds, "path", "left").withColumnRenamed("path", "file_path")
    known = METADATA.get(mode if mode in METADATA.available() else "keyword")(typed, text_col="text", **options)
    if profile.taxonomy == "file_type":
        known = known.withColumn("category", F.coalesce(F.nullif(F.split_part("content_type", F.lit("/"), F.lit(2)), F.lit("")), F.col("category")))
    pages = known.drop("text").withColumn("page", F.explode("pages")).withColumn("text", F.col("page.text")).withColumn("page_label", F.col("page.label"))
    cut = chunking.dispatch(pages.drop("page", "pages"), fallback=profile.chunk_fallback)
    number = F.concat_ws("-", F.sha2("file_path", 256), "page_label", F.col("chunk_index").cast("string"))
    named = cut.select(
        number.alias("chunk_id"), F.col("chunk").alias("text"),
        "file_path", files.file_name(F.col("file_path")).alias("file_name"), "content_type", "category", "keywords", "header_path", "page_label",
    )
    chunks = materialize(embedding.embed(named.where(F.trim("text") != ""), "text", embedder=embedder), "ingest-chunks")
    sizes = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"))
    status = F.when(F.col("error").isNull(), "indexed").otherwise("failed")
    read = materialize(texts.select("path", status.alias("status"), "error"), "ingest-status")
    drop_table(texts.sparkSession, texts)
    details = read.join(sizes, "path", "left").select("path", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")
    return chunks, details.unionByName(skipped.select("path", "status", F.lit(0).cast("bigint").alias("chunks"), F.col("reason").alias("error")))


def validate(spark: SparkSession, path: str) -> str | None:
    """Why ``path`` can't be ingested: there is nothing, or it is a file of another kind."""
    if files.qualified(spark, path) is None:
        return f"Path not found: {path}"
    end = "." + path.rpartition(".")[2].lower()
    if not files.is_folder(spark, path) and end not in files.SUPPORTED:
        return f"Unsupported file extension: {end}. Supported: {', '.join(sorted(files.SUPPORTED))}"
    return None


def ingest(spark: SparkSession, store: Store, path: str, collection: str = "documents", stopped: Callable[[], bool] = lambda: False, **options) -> dict:
    """Ingest the files below ``path`` into a collection and return the report, with details as a DataFrame.

    ``stopped`` is asked before the files are read, before their texts are cut and embedded, and before
    the collection is written: an interrupted run leaves it as it was.
    """
    nothing = spark.createDataFrame([], "path string, status string, chunks bigint, error string")
    interrupted = {"status": "interrupted", "collection": collection, "files_indexed": 0, "chunks_created": 0, "chunks_removed": 0}
    if (reason := validate(spark, path)) is not None:
        return {"status": "error", "error_type": "file", "message": reason, "collection": collection, "chunks_removed": 0, "file_details": nothing}
    tag = store.metadata(collection).get("profile") if store.exists(collection) else None
    found = files.discover(spark, path)
    try:
        if stopped():
            raise Interrupted
        chunks, details = chunk_files(found, resolve_profile(tag), stopped=stopped, **options)
    except Interrupted:
        return interrupted | {"file_details": nothing}
    before = store.count(collection)
    created = chunks.count()
    if stopped():
        return interrupted | {"file_details": details}
    if created:
        store.upsert(collection, chunks)
    counts = files.report_counts(details).first()
    return {"status": "ok", "collection": collection, "files_indexed": counts.indexed, "files_skipped": counts.skipped, "files_failed": counts.failed, "chunks_created": created, "chunks_removed": before + created - store.count(collection) if created else 0, "file_details": details}


def report_text(report: dict, path: str, as_json: bool) -> str:
    """The report as JSON or as Markdown tables."""
    rows = [r.asDict() for r in report["file_details"].orderBy("path").collect()]  # a report that is read by people
    summary = {"total": len(rows), **{s: sum(r["status"] == s for r in rows) for s in ("indexed", "failed", "skipped")}, "chunks": report["chunks_created"]}
    stamp = datetime.now(timezone.utc).isoformat()
    if as_json:
        return json.dumps({"timestamp": stamp, "input_path": path, "summary": summary, "files": rows}, indent=2) + "\n"
    table = lambda head, body: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(x if x is not None else "") for x in r) + " |" for r in body), ""]
    lines = ["# Ingestion report", "", f"{stamp}, `{path}`", "", *table(["Metric", "Value"], summary.items()), *table(["File", "Status", "Chunks", "Error"], [(r["path"], r["status"], r["chunks"], r["error"]) for r in rows])]
    return "\n".join(lines)
