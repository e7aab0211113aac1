"""Search policy: plain decisions made before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from lodestream.functions import text

RERANK_POOL = 100
TECHNICAL_CUTOFF = 0.3


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 10
    threshold: float = 0.0
    rerank: bool = False
    hybrid: bool = False
    pool: int | None = None


@dataclass(frozen=True)
class Profile:
    """The levers that a collection's profile sets."""

    name: str
    top_k: int
    rerank: bool
    hybrid: bool
    chunk_fallback: str
    taxonomy: str


PROFILES = {
    "documents": Profile("documents", 10, True, False, "sentence", "content"),
    "codebase": Profile("codebase", 10, False, True, "code", "file_type"),
}


def resolve_profile(tag: str | None, default: str = "documents") -> Profile:
    """A collection's profile; untagged ones inherit the default, and hybrid is a selector, not a tag."""
    name = tag or default
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}")
    return PROFILES[name]


def profile_change(old: Profile, new: Profile) -> list[dict]:
    """Each lever that differs, and whether documents have to be ingested again for it."""
    reindex = {"chunk_fallback", "taxonomy"}
    levers = ("top_k", "rerank", "hybrid", "chunk_fallback", "taxonomy")
    return [{"lever": x, "old": getattr(old, x), "new": getattr(new, x), "reindex": x in reindex} for x in levers if getattr(old, x) != getattr(new, x)]


def scaled_threshold(threshold: float, rerank: bool) -> float:
    """Reranked scores are smaller: 0 stays off, else a thirtieth with reranking."""
    return 0.0 if threshold <= 0 else threshold / 30 if rerank else threshold


def fetch_pool(top_k: int, rerank: bool, count: int | None = None, override: int | None = None) -> int:
    """Rows to fetch: the override, else max(100, 3 k) with reranking or k; within the collection; 1 at least."""
    wanted = override if override is not None else max(RERANK_POOL, 3 * top_k) if rerank else top_k
    return max(1, wanted if count is None else min(wanted, count))


def technical_fraction(query: str) -> float:
    """Share of technical tokens of a query, by the rules of ``functions.text``."""
    parts = query.split()
    return sum(map(text.is_technical_token, parts)) / len(parts) if parts else 0.0


def rerank_decision(query: str, explicit: bool | None = None, profile: Profile | None = None, everywhere: bool = False, semantic: bool = True, cutoff: float = TECHNICAL_CUTOFF) -> tuple[bool, str]:
    """Whether to rerank, and why: explicit choice, profile, global flag, then the kind of query."""
    if explicit is not None:
        return explicit, "explicit"
    if profile is not None and not profile.rerank:
        return False, f"profile {profile.name}"
    if everywhere:
        return True, "global flag"
    if not semantic:
        return False, "semantic reranking off"
    fraction = technical_fraction(query)
    return (False, f"technical query ({fraction:.2f})") if fraction >= cutoff else (True, f"semantic query ({fraction:.2f})")


def reranked(query: Column, cutoff: float = TECHNICAL_CUTOFF) -> Column:
    """The decision by the kind of query, the last of ``rerank_decision``'s, for a table of queries."""
    return text.technical_fraction(query) < cutoff


def pool(top_k: Column, rerank: Column, count: Column) -> Column:
    """``fetch_pool`` without an override, for a table of requests."""
    wanted = F.when(rerank, F.greatest(F.lit(RERANK_POOL), 3 * top_k)).otherwise(top_k)
    return F.greatest(F.lit(1), F.least(wanted, count))


def model_files(model: str, machine: str) -> list[str]:
    """Files of a scoring model to try, best first: quantised ones where they run on this machine."""
    name = model.lower()
    if "modernbert" in name or "gte-reranker" in name:
        kinds = ["_quantized", "_int8", "_fp16", ""]
    elif machine.lower() in ("arm64", "aarch64"):
        kinds = ["_qint8_arm64", ""]
    else:
        kinds = [""]
    return [f"onnx/model{k}.onnx" for k in kinds]
