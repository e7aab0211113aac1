"""Metadata of documents: by keyword rules, by a model that a caller supplies, or none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestream.functions import text

PROMPT_CHARS, ATTEMPTS = 3000, 3


def disabled(rows: DataFrame, text_col: str = "text", **_) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.withColumns({"category": none, "keywords": none, "summary": none})


def by_keywords(rows: DataFrame, text_col: str = "text", rules_json: str | None = None, **_) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.withColumns({"category": text.keyword_category(F.col(text_col), text.load_rules(rules_json)), "keywords": none, "summary": none})


def prompt(document: str, categories: list[str]) -> str:
    """What the model is asked: the known categories and the document's first characters."""
    known = ", ".join(sorted(categories)) or "none yet"
    return f"Classify the document. Known categories: {known}. Answer with a JSON object with the keys category, keywords and summary.\n\n{document[:PROMPT_CHARS]}"


def by_model(rows: DataFrame, text_col: str = "text", client: Callable[[str], str] | None = None, categories: list[str] | None = None, attempts: int = ATTEMPTS, wait: float = 1.0, **_) -> DataFrame:
    """Ask ``client`` for each document and parse its answer; after ``attempts`` failures the answer is empty.

    Waits double after each failure. Lists of keywords are joined for storage.
    """
    if client is None:
        raise ValueError("this strategy needs a client: a function from a prompt to the model's answer")
    known = [c for c in categories or [] if c != text.UNCATEGORISED]

    def answer(document: str) -> str:
        for attempt in range(attempts):
            try:
                return client(prompt(document or "", known))
            except Exception:
                if attempt + 1 < attempts:
                    time.sleep(wait * 2**attempt)
        return ""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for documents in batches:
            yield documents.map(answer)

    parsed = rows.withColumn("__answer", answers(F.col(text_col))).withColumn("__parsed", text.parse_response(F.col("__answer")))
    return parsed.withColumns({"category": F.col("__parsed.category"), "keywords": F.array_join("__parsed.keywords", ", "), "summary": F.col("__parsed.summary")}).drop("__answer", "__parsed")


def first_nonempty(rows: DataFrame, group_col: str, position_col: str, columns: list[str]) -> DataFrame:
    """For each group and column the first value in position order that isn't blank, trimmed; null if all are."""
    value = lambda c: F.trim(F.col(c).cast("string"))
    filled = lambda c: F.coalesce(value(c), F.lit("")) != ""
    return rows.groupBy(group_col).agg(*(F.min_by(F.when(filled(c), value(c)), F.when(filled(c), F.col(position_col))).alias(c) for c in columns))


def categories_of(*chunk_tables: DataFrame) -> list[str]:
    """Distinct valid categories of all tables, in order."""
    found: set[str] = set()
    for chunks in chunk_tables:
        valid = chunks.select(text.normalise_category(F.col("category")).alias("c")).distinct()
        found |= {r.c for r in valid.collect()}  # a taxonomy, not a corpus
    return sorted(found - {text.UNCATEGORISED})
