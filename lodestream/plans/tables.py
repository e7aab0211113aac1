"""Driver tables in the roles of the engine's inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import text
from lodestream.operators import dense_index, retrieval, sparse_blocks
from lodestream.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the file, the language the category."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("file_path"), F.lit(None).cast("string").alias("file_name"), F.lit("document/text").alias("content_type"), F.col("lang").alias("category"), "n_chars")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vector of the same number; chunks without one stay for the sparse side."""
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id", "left")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first stored vector, as a query: one row to the driver."""
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"])


def query_text(spark: SparkSession, sf_dir: str) -> str:
    """The first benchmark item, as a query: one row to the driver."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()["text"]


_INDEXES: dict[tuple, object] = {}


def _once(spark: SparkSession, table_: DataFrame, tag: str, build: Callable[[str], object]):
    """What ``build`` makes in a folder of its own, once a session for a table's files as they are."""
    stamps = table_.select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()  # a row a file
    key = (spark.sparkContext.applicationId, tag, *sorted(map(tuple, stamps)))
    if key not in _INDEXES:
        _INDEXES[key] = build(f"{shared_dir(spark)}/lodestream/{tag}-{uuid.uuid4().hex}")
    return _INDEXES[key]


def sparse_index(spark: SparkSession, sf_dir: str) -> retrieval.SparseIndex:
    """The sparse index of the documents."""
    return _once(spark, table(spark, sf_dir, "documents"), "sparse", lambda path: retrieval.build_index(chunks(spark, sf_dir), path))


def block_index(spark: SparkSession, sf_dir: str) -> sparse_blocks.BlockIndex:
    """The sparse index of the documents in blocks with their largest weights."""
    return _once(spark, table(spark, sf_dir, "documents"), "blocks", lambda path: sparse_blocks.build_from(chunks(spark, sf_dir), path))


def dense_cells(spark: SparkSession, sf_dir: str) -> dense_index.DenseIndex:
    """The dense index of the vectors."""
    return _once(spark, table(spark, sf_dir, "embeddings"), "dense", lambda path: dense_index.build(vectors(spark, sf_dir), path))


def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the metadata that the document graph joins on: long words are the keywords."""
    docs = table(spark, sf_dir, "documents")
    long_words = F.sort_array(F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) >= 16)))
    path = F.when(F.col("n_chars") < 300, F.col("lang")).when(F.col("n_chars") < 900, F.concat_ws("/", "lang", "source")).otherwise(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.lit("document/text").alias("content_type"), F.concat_ws("/", "lang", "source").alias("category"), long_words.alias("keywords"), path.alias("header_path"), F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".md")).alias("file_path"))
