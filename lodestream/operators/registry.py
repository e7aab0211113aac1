"""Named strategies that callers can add to: chunking, metadata, embedding, reading and scoring."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module


class Registry:
    """Names for callables, given as such or as 'module:attribute' to be imported when asked for."""

    def __init__(self, kind: str, **initial: Callable | str):
        self.kind, self._items = kind, dict(initial)

    def register(self, name: str, item: Callable | str) -> None:
        self._items[name] = item

    def available(self) -> list[str]:
        return sorted(self._items)

    def get(self, name: str) -> Callable:
        if name not in self._items:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(self.available())}")
        item = self._items[name]
        if isinstance(item, str):
            module, _, attribute = item.partition(":")
            item = self._items[name] = getattr(import_module(module), attribute)
        return item


CHUNKING = Registry("chunking strategy", **{n: f"lodestream.operators.chunking:{n}" for n in ("sentence", "markdown", "code", "config")})
RETRIEVAL = Registry("retrieval strategy", dense="lodestream.operators.retrieval:dense_topk", bm25="lodestream.operators.retrieval:bm25_topk", native_sparse="lodestream.operators.retrieval:native_sparse", fusion="lodestream.operators.retrieval:hybrid", reranker="lodestream.operators.retrieval:rerank")
METADATA = Registry("metadata strategy", keyword="lodestream.operators.metadata:by_keywords", llm="lodestream.operators.metadata:by_model", disabled="lodestream.operators.metadata:disabled")
EMBEDDING = Registry("embedder", hashing="lodestream.operators.embedding:hashing")
PDF = Registry("PDF reader", liteparse="lodestream.sources.pdf:liteparse", pypdfium2="lodestream.sources.pdf:pypdfium2", pypdf="lodestream.sources.pdf:pypdf", builtin="lodestream.sources.pdf:builtin")
