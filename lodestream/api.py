"""The engine's public calls. They return DataFrames or plain values, and errors as values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestream.operators import retrieval
from lodestream.operators.embedding import QueryEmbedder
from lodestream.operators.policy import PROFILES, SearchSettings, profile_change, rerank_decision, resolve_profile
from lodestream.plans import codemap, ingest as ingestion
from lodestream.sources.store import MissingCollection, Store, list_sources


def _error(kind: str, e: Exception) -> dict:
    return {"status": "error", "error_type": kind, "message": f"{type(e).__name__}: {e}"}


def _guarded(f: Callable) -> Callable:
    def run(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except (ValueError, MissingCollection) as e:
            return _error("validation", e)
        except (AnalysisException, PySparkException) as e:
            return _error("retrieval", e)
        except Exception as e:
            return _error("internal", e)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


class Engine:
    """Collections below one root folder, and what can be asked of them."""

    def __init__(self, spark: SparkSession, root: str, query_embedder: Callable[[str], list[float]] | None = None, scorer: Callable[[DataFrame], Column] | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.embed_query, self.scorer = query_embedder or QueryEmbedder(), scorer

    @_guarded
    def ingest_documents(self, path: str, collection: str = "documents", **options) -> dict:
        """Index a file or folder; returns the report."""
        return ingestion.ingest(self.spark, self.store, path, collection, **options)

    @_guarded
    def search_documents(self, query: str, top_k: int | None = None, similarity_threshold: float = 0.0, rerank: bool | None = None, hybrid: bool | None = None, collection: str = "documents", metadata_filter: dict | None = None, diagnostics: bool = False) -> DataFrame:
        """The best chunks for a query; unset arguments come from the collection's profile."""
        tag = self.store.metadata(collection).get("profile") if self.store.exists(collection) else None
        profile = resolve_profile(tag)
        decided, reason = rerank_decision(query, rerank, profile)
        settings = SearchSettings(top_k=profile.top_k if top_k is None else top_k, threshold=similarity_threshold, rerank=decided, hybrid=profile.hybrid if hybrid is None else hybrid)
        chunks = self.store.chunks(collection)
        found = retrieval.search(chunks, query, self.embed_query(query), settings, metadata_filter, self.scorer, diagnostics=diagnostics, index=self.store.index(collection) if settings.hybrid else None)
        return found.withColumn("rerank_reason", F.lit(reason)) if diagnostics else found

    @_guarded
    def list_indexed_documents(self, collection: str = "documents") -> DataFrame:
        return list_sources(self.store.chunks(collection)).orderBy("source")

    @_guarded
    def list_collections(self) -> DataFrame:
        return self.store.statistics().orderBy("collection")

    @_guarded
    def delete_documents(self, path: str | None = None, metadata_filter: dict | None = None, collection: str = "documents", dry_run: bool = False) -> dict:
        """Delete by path, by filter, or the whole collection; a dry run only counts."""
        if metadata_filter is not None and not metadata_filter:
            raise ValueError("a filter has one key or more")
        if dry_run:
            return {"status": "preview", "chunks": self.store.preview_delete(collection, path, metadata_filter)}
        where = {"file_path": path} if path is not None else metadata_filter
        if where is None:
            removed = self.store.count(collection)
            self.store.drop(collection)
            return {"status": "ok", "mode": "collection", "chunks_removed": removed}
        return {"status": "ok", "mode": "path" if path is not None else "metadata", "chunks_removed": self.store.delete(collection, where)}

    @_guarded
    def get_codebase_map(self, path: str = ".", refresh: bool = False, root: str = ".") -> str:
        """The map of a project, with links to the collection ``documents`` if there is one."""
        chunks = self.store.chunks("documents")
        documents = chunks.select("chunk_id", "file_path", "category", F.split("keywords", ", ").alias("keywords")) if self.store.exists("documents") else None
        return codemap.map_of(self.spark, path, root, refresh, documents)

    @_guarded
    def change_collection_profile(self, collection: str, profile: str, confirm: bool = False) -> dict:
        """Preview what a profile changes, or apply it; stored chunks stay as they are."""
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}; there are {', '.join(PROFILES)}")
        old = resolve_profile(self.store.metadata(collection).get("profile"))
        changes = profile_change(old, replace(PROFILES[profile]))
        if not confirm:
            return {"status": "preview", "changes": changes, "confirm_required": True}
        self.store.merge_metadata(collection, {"profile": profile})
        return {"status": "ok", "collection": collection, "profile": profile, "changes": changes}
