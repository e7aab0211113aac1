"""The corpus pipeline over ``documents``: which ones stay, what is left of them, and their tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm import decontaminate, language, line_dedup, near_dedup, pieces
from lodestream.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learnt language explains go; ``lang`` of the others becomes their own language.

    The mixture decides: uniform trigrams stand among the languages, and a document of which they
    explain three quarters or more is in none of them. Null texts and texts without a letter go, too. Where
    nothing is labelled, so nothing is learnt, texts with a letter stay as they are. Repeated rows and
    ids, and null ids, are judged row by row; an empty table gives an empty one.
    """
    model = language.fit_labelled(docs)
    if not model.names:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    found = language.identify(docs, model, uniform=True).where(F.col("__lang") != language.UNKNOWN)
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, from the smallest id on; n_chars is counted anew.

    Every document stays, also one that has no line left (its text is empty) or whose text was null;
    rows that share an id are one document, rows with a null id lose nothing.
    """
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, the one with the smallest id of each group stays.

    Links are transitive. Null, empty and blank texts are nobody's copy and stay, and so do rows with
    a null id; rows that share an id stay or go together.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in windows of benchmark items go.

    Texts without words stay; rows that share an id are judged row by row; without items all stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and lang of every text that is left; a null text is an empty one."""
    return pieces.digest(docs, keep=("lang",))


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokens),
]

#: Mixture inference and merge-type encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
