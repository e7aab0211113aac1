"""Registered queries that run the store, files, text functions, code graph and watch sink themselves.

Sources and paths that the driver tables don't have are made from their ids, by rule, on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import text
from lodestream.operators import chunking, codegraph, docgraph, embedding, evaluate, metadata, policy, retrieval
from lodestream.plans import catalogue, tables
from lodestream.plans.catalogue import query
from lodestream.scratch import shared_dir
from lodestream.sources import files
from lodestream.sources.store import Store
from lodestream.streaming import watch


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestream/{tag}-{uuid.uuid4().hex}"


# Text functions.

_NAME = "source || ' ' || lang"


@query(f"SELECT doc_id, {_NAME} AS cleaned FROM documents")
def strip_label(spark, sf_dir):
    """Names behind labels, bold marks, quotes and before a second paragraph."""
    name, kind = F.concat_ws(" ", "source", "lang"), F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Title: "), name)).when(kind == 1, F.concat(F.lit("**Keywords:** "), name)).when(kind == 2, F.concat(name, F.lit("\n\nmore"))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.strip_label(raw).alias("cleaned"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '```' || {_NAME} ELSE {_NAME} END AS inner_text FROM documents")
def strip_fence(spark, sf_dir):
    name, kind = F.concat_ws(" ", "source", "lang"), F.col("doc_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), name, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("\n"), name, F.lit(" "))).otherwise(F.concat(F.lit("```"), name))
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.strip_fence(raw).alias("inner_text"))


@query("SELECT doc_id, lower(source) || ',' || lang || ',x' AS keywords FROM documents")
def parse_keywords(spark, sf_dir):
    raw = F.concat(F.lit("Keywords: "), F.upper("source"), F.lit(" , "), F.col("lang"), F.lit("\n,X"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.parse_keywords(raw), ",").alias("keywords"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source || '_' || lang END AS category FROM documents")
def derive_category(spark, sf_dir):
    """The first valid keyword, else the first two words of the title."""
    keywords = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("!!"), F.upper("lang"), "source")).otherwise(F.array(F.lit("4 5")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.derive_category(keywords, F.concat_ws(" ", "source", "lang", "source")).alias("category"))


_LONG = "CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END"


@query(rf"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), 1, 10), ' ') AS keywords, {_LONG} AS summary FROM documents")
def truncate_metadata(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.truncate_keywords(text.words(F.col("text"))), " ").alias("keywords"), text.truncate_summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, source AS plain, lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-' || left(sha1(source || doc_id), 12) AS short_id FROM documents")
def labels_and_ids(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    coloured = F.concat(F.lit("\x1b[31m"), F.col("source"), F.lit("\x1b[0m"))
    return docs.select("doc_id", text.strip_ansi(coloured).alias("plain"), text.short_id(F.col("doc_id"), F.concat("source", F.col("doc_id").cast("string"))).alias("short_id"))


_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(
    f"WITH n AS (SELECT doc_id, {_NORMAL.format('text')} AS whole, {_NORMAL.format('CASE doc_id % 3 WHEN 0 THEN left(text, 60) WHEN 1 THEN left(text, 60) || repeat(chr(35), 50) ELSE chr(35) || left(text, 60) END')} AS part FROM documents) "
    "SELECT doc_id, CAST(CASE WHEN part = '' THEN 0 WHEN contains(whole, part) THEN 2 WHEN contains(whole, left(part, greatest(1, length(part) // 2))) THEN 1 ELSE 0 END AS INTEGER) AS grade FROM n"
)
def evidence_grade(spark, sf_dir):
    docs, begin, kind = tables.table(spark, sf_dir, "documents"), F.left("text", F.lit(60)), F.col("doc_id") % 3
    snippet = F.when(kind == 0, begin).when(kind == 1, F.concat(begin, F.lit("#" * 50))).otherwise(F.concat(F.lit("#"), begin))
    return docs.select("doc_id", text.evidence_grade(F.col("text"), snippet).cast("int").alias("grade"))


@query(r"SELECT doc_id, 'snake_' || source || ',all_x' AS snake, 'v1.' || (doc_id % 7) AS version, 'camelCase' AS camel FROM documents")
def identifiers(spark, sf_dir):
    line = F.concat(F.lit("use snake_"), F.col("source"), F.lit(" and all_x or camelCase of v1."), (F.col("doc_id") % 7).cast("string"), F.lit(", snake_"), F.col("source"))
    found = lambda name: F.array_join(text.identifiers(line, name), ",")
    return tables.table(spark, sf_dir, "documents").select("doc_id", found("snake_case").alias("snake"), found("version_string").alias("version"), found("camel_case").alias("camel"))


@query(
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'deep_' || lang WHEN 1 THEN lang ELSE 'uncategorised' END AS category, CASE doc_id % 3 WHEN 0 THEN 'a,' || source ELSE '' END AS keywords, "
    "CASE doc_id % 3 WHEN 0 THEN 's' ELSE '' END AS summary FROM documents"
)
def model_responses(spark, sf_dir):
    """JSON objects, fenced ones with a wrong kind of keywords, and plain text."""
    kind = F.col("doc_id") % 3
    whole = F.concat(F.lit('{"category": "Deep '), F.col("lang"), F.lit('", "keywords": [" A ", "'), F.col("source"), F.lit('", ""], "summary": " s "}'))
    fenced = F.concat(F.lit('```json\n{"category": "'), F.col("lang"), F.lit('", "keywords": "no"}\n```'))
    raw = F.when(kind == 0, whole).when(kind == 1, fenced).otherwise(F.concat(F.lit("some plain text of "), F.col("source")))
    parsed = tables.table(spark, sf_dir, "documents").select("doc_id", text.parse_response(raw).alias("p"))
    return parsed.select("doc_id", "p.category", F.array_join("p.keywords", ",").alias("keywords"), "p.summary")


@query("SELECT conv_id, min_by(trim(text), turn) FILTER (WHERE trim(coalesce(text, '')) <> '') AS text, min_by(trim(role), turn) FILTER (WHERE trim(coalesce(role, '')) <> '') AS role FROM conversations GROUP BY conv_id")
def first_values(spark, sf_dir):
    """The first text and role of each conversation that aren't blank."""
    return metadata.first_nonempty(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", ["text", "role"])


@query("SELECT conv_id, turn, f < 0.3 AS rerank FROM " + catalogue._FRACTION)
def rerank_decisions(spark, sf_dir):
    """The search policy's decision for every conversation turn as a query."""
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", policy.reranked(F.col("text")).alias("rerank"))


# Files.

_END = "list_extract(['.png', '.py', '.YML', '.exe', '.docx', '.md', '.tmp', ''], CAST(doc_id % 8 + 1 AS INTEGER))"
_KIND = "list_extract(['binary/png', 'code/python', 'config/yaml', 'binary/exe', 'document/docx', 'document/markdown', 'unknown/unknown', 'unknown/unknown'], CAST(doc_id % 8 + 1 AS INTEGER))"


def _paths(spark, sf_dir) -> DataFrame:
    end = F.element_at(F.array(*(F.lit(e) for e in (".png", ".py", ".YML", ".exe", ".docx", ".md", ".tmp", ""))), (F.col("doc_id") % 8 + 1).cast("int"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), end).alias("path"))


@query(f"SELECT doc_id, {_KIND} AS content_type, {_KIND} NOT LIKE 'binary/%' AS is_text, {_END} NOT IN ('.docx', '.md') AS ignored FROM documents")
def file_types(spark, sf_dir):
    return files.with_types(_paths(spark, sf_dir)).select("doc_id", "content_type", "is_text", files.ignored(F.col("path")).alias("ignored"))


@query("SELECT source || '/f' || doc_id || '.py' AS path, 'python' AS expected, 'markdown' AS found FROM documents WHERE doc_id % 8 = 1 AND doc_id % 3 = 0")
def type_mismatches(spark, sf_dir):
    """Files that a detector, which knows every third one, calls Markdown, against their endings."""
    paths = _paths(spark, sf_dir)
    found = paths.where("doc_id % 3 = 0 and doc_id % 8 < 2").select("path", F.lit("document").alias("group"), F.lit("markdown").alias("label"), (F.col("doc_id") % 8 == 1).alias("is_text"))
    return files.mismatches(files.detected(paths, found))


_DEEP = "repeat('d/', CAST(doc_id % 14 AS INTEGER)) || CASE WHEN doc_id % 5 = 0 THEN 'build/' ELSE '' END || 'f' || doc_id || '.py'"


@query(f"SELECT {_DEEP} AS path FROM documents WHERE doc_id % 14 <= 10 AND doc_id % 5 <> 0")
def scan_scope(spark, sf_dir):
    """Paths that are neither too deep nor in folders that scans leave out."""
    path = F.concat(F.repeat(F.lit("d/"), (F.col("doc_id") % 14).cast("int")), F.when(F.col("doc_id") % 5 == 0, "build/").otherwise(""), F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return files.detect_types(tables.table(spark, sf_dir, "documents").select(path.alias("path"))).select("path")


@query("SELECT item_id, CAST(length(text) + 1 AS BIGINT) AS n_chars, sha256(text || chr(10)) AS sha256, 'document/text' AS content_type FROM benchmark WHERE text IS NOT NULL")
def read_files(spark, sf_dir):
    """Items written as text files, found and read again."""
    root = _folder(spark, "items")
    tables.table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(root)
    found = files.discover(spark, root)
    supported, _ = files.split_supported(found)
    hashed = files.with_types(files.content_hash(supported)).select("path", "relative", "sha256", "content_type")
    return hashed.join(files.read_texts(supported), "path").select(F.regexp_extract("relative", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.char_length("text").cast("long").alias("n_chars"), "sha256", "content_type")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def content_hash_dedup(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.content_hash(docs).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "sha256", "copies")


# The store.


def _stored(spark, sf_dir) -> Store:
    """A store with one collection of the documents, their sources, languages and vectors."""
    store = Store(spark, _folder(spark, "store"))
    rows = tables.embedded_chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", "embedding", "file_path", "category")
    store.create("c", {"profile": "documents"}, buckets=8)
    store.upsert("c", rows)
    return store


def _one(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


@query("SELECT source AS file_path, CAST(count(*) AS BIGINT) AS chunks, CAST(count(vec_id) AS BIGINT) AS vectors FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE source <> 'src2' OR lang = 'en' GROUP BY 1")
def store_upsert(spark, sf_dir):
    """A source comes again with its English chunks only; the others stay as they are."""
    store = _stored(spark, sf_dir)
    again = store.chunks("c").where("file_path = 'src2' and category = 'en'")
    store.upsert("c", again)
    return store.chunks("c").groupBy("file_path").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))


@query("SELECT count(*) FILTER (WHERE source = 'src3') AS by_path, count(*) FILTER (WHERE lang IN ('de', 'fr')) AS by_filter, count(*) AS all_chunks, count(*) FILTER (WHERE lang = 'none') AS of_none FROM documents")
def preview_delete(spark, sf_dir):
    store = _stored(spark, sf_dir)
    return _one(spark, by_path=store.preview_delete("c", path="src3"), by_filter=store.preview_delete("c", where={"category": {"$in": ["de", "fr"]}}), all_chunks=store.preview_delete("c"), of_none=store.count_where("c", {"category": "none"}))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE source <> 'src3'")
def delete_by_source(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.delete("c", {"file_path": "src3"})
    return store.chunks("c").select("chunk_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE NOT (lang IN ('de', 'fr') AND source >= 'src1')")
def delete_by_filter(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.delete("c", {"category": {"$in": ["de", "fr"]}, "file_path": {"$gte": "src1"}})
    return store.chunks("c").select("chunk_id")


@query("SELECT 'p2' AS profile, 'y' AS other, CAST(2 AS BIGINT) AS generation, true AS known, false AS unknown")
def store_metadata(spark, sf_dir):
    """Metadata merged twice, and what writes make of the generation."""
    store = _stored(spark, sf_dir)
    for i in (1, 2):
        store.merge_metadata("c", {"profile": f"p{i}"} | ({"other": "y"} if i == 1 else {}))
    store.delete("c", {"category": "none"})
    store.upsert("c", store.chunks("c").where("file_path = 'src1'"))
    found = store.metadata("c")
    return _one(spark, profile=found["profile"], other=found["other"], generation=store.generation("c"), known=store.exists("c"), unknown=store.exists("none"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 50 OFFSET 25")
def store_page(spark, sf_dir):
    return _stored(spark, sf_dir).page("c", 50, 25).select("chunk_id")


@query("SELECT 'c' AS collection, count(*) AS chunks, count(DISTINCT source) AS sources FROM documents")
def store_statistics(spark, sf_dir):
    return _stored(spark, sf_dir).statistics()


@query(f"WITH t AS (SELECT {catalogue._TOKENS.format('text')} AS toks FROM documents) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(len(toks)), 9) AS avgdl, CAST(sum(len(list_distinct(toks))) AS BIGINT) AS postings FROM t")
def sparse_index(spark, sf_dir):
    """The index that a store's writes keep."""
    index = _stored(spark, sf_dir).index("c")
    return index.statistics().select("n", F.round("avgdl", 9).alias("avgdl")).crossJoin(index.rows.agg(F.count("*").alias("postings")))


@query(f"WITH t AS (SELECT {catalogue._TOKENS.format('text')} AS toks FROM documents) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(len(toks)), 9) AS avgdl, CAST(sum(len(list_distinct(toks))) AS BIGINT) AS postings FROM t")
def build_sparse_index(spark, sf_dir):
    """The index of all documents, built anew: what the BM25 and hybrid queries read."""
    index = retrieval.build_index(tables.chunks(spark, sf_dir), _folder(spark, "sparse"))
    return index.statistics().select("n", F.round("avgdl", 9).alias("avgdl")).crossJoin(index.rows.agg(F.count("*").alias("postings")))


_RAW_IDF = "ln(n - df + 0.5) - ln(df + 0.5)"


@query(f"WITH {catalogue._CORPUS}, raw AS (SELECT term, df, {_RAW_IDF} AS idf FROM df, st), m AS (SELECT avg(idf) AS mean FROM raw) SELECT term, CAST(df AS BIGINT) AS df, round(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END, 9) AS idf FROM raw, m")
def floored_idf(spark, sf_dir):
    return retrieval.term_statistics(tables.chunks(spark, sf_dir), floored=True)


@query("WITH " + catalogue._QUERY + f", d AS (SELECT vec_id, label, {catalogue._L2.format('embedding', 'qv')} AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10) SELECT label, round(1 / (1 + distance), 9) AS score FROM d")
def public_columns(spark, sf_dir):
    found = retrieval.dense_topk(tables.vectors(spark, sf_dir), tables.query_vector(spark, sf_dir), 10)
    return retrieval.public(found).withColumn("score", F.round("score", 9))


# Chunks and vectors.


@query("SELECT doc_id AS chunk_id, CAST(0 AS INTEGER) AS chunk_index, text AS chunk FROM documents WHERE text IS NOT NULL")
def chunk_config(spark, sf_dir):
    """Configuration files are one chunk each, however long."""
    rows = tables.chunks(spark, sf_dir).select("chunk_id", F.lit("config/yaml").alias("content_type"), F.lit("a.yml").alias("file_path"), "text")
    return chunking.dispatch(rows).select("chunk_id", "chunk_index", "chunk")


@query(
    "SELECT doc_id AS chunk_id, CAST(0 AS INTEGER) AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'A ' || source ELSE NULL END AS header_path, "
    "CASE doc_id % 3 WHEN 0 THEN '# A ' || source WHEN 1 THEN 'def f' || doc_id || '(): pass' ELSE 'One. Two ' || lang || '.' END AS chunk FROM documents"
)
def chunk_dispatch(spark, sf_dir):
    """Headings, code and sentences by type or ending, each below the size of a chunk."""
    kind, number = F.col("chunk_id") % 3, F.col("chunk_id").cast("string")
    body = F.when(kind == 0, F.concat(F.lit("# A "), F.col("file_path"))).when(kind == 1, F.concat(F.lit("def f"), number, F.lit("(): pass"))).otherwise(F.concat(F.lit("One. Two "), F.col("category"), F.lit(".")))
    path = F.concat(number, F.when(kind == 0, ".md").when(kind == 1, ".py").otherwise(".txt"))
    content_type = F.when(kind == 0, "document/markdown").when(kind == 2, "document/text")
    rows = tables.chunks(spark, sf_dir).select("chunk_id", content_type.alias("content_type"), path.alias("file_path"), body.alias("text"))
    return chunking.dispatch(rows, fallback="code").select("chunk_id", "chunk_index", "header_path", "chunk")


@query(
    "WITH t AS (SELECT 'r' || n_regionkey AS file_path, '| ' || n_name || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) "
    "SELECT 'c' || conv_id AS file_path, 'document/layout' AS content_type, coalesce(role, '') AS header_path, text FROM conversations WHERE coalesce(text, '') <> '' "
    "UNION ALL SELECT file_path, 'table', NULL, min_by(line, r) || chr(10) || '| --- |' || string_agg(chr(10) || line, '' ORDER BY r) FILTER (WHERE r > 1) FROM t GROUP BY file_path "
    "UNION ALL SELECT 'raw', 'document/layout', NULL, 'whole'"
)
def layout_documents(spark, sf_dir):
    """Turns as paragraphs with roles, nations as one table a region, and a file that has only its content."""
    from pyspark.sql import Window

    turns = tables.table(spark, sf_dir, "conversations")
    paragraphs = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_path"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    cells = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file_path"), F.lit(0).alias("table_id"), (F.row_number().over(order) - 1).alias("row"), F.lit(0).alias("column"), F.col("n_name").alias("value"))
    contents = spark.createDataFrame([("raw", "whole"), ("r0", "no")], "file_path string, content string")
    return chunking.layout_documents(paragraphs, cells, contents).select("file_path", "content_type", "header_path", "text")


@query(f"SELECT doc_id, CAST(256 AS INTEGER) AS dimensions, CASE WHEN len({catalogue._TOKENS.format('text')}) > 0 THEN 1.0 ELSE 0.0 END AS length FROM documents")
def embed_documents(spark, sf_dir):
    made = embedding.embed(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(square), 3).alias("length"))


@query("SELECT quality = 1 AS inside, CAST(least(30, count(*)) AS INTEGER) AS n FROM labels GROUP BY 1")
def sample_sizes(spark, sf_dir):
    picked = evaluate.stratified_sample(tables.table(spark, sf_dir, "labels"), F.col("quality") == 1, 60, 0.5, "doc_id")
    return picked.groupBy((F.col("quality") == 1).alias("inside")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS required, CAST(least(greatest(100 - count(*) FILTER (WHERE toxic = 1), 0), count(*) FILTER (WHERE toxic IS DISTINCT FROM 1)) AS BIGINT) AS distractors FROM labels")
def distractor_sizes(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels")
    picked = evaluate.required_plus_distractors(labels, labels.where("toxic = 1"), 100, "doc_id")
    return picked.agg(F.count_if(F.col("toxic") == 1).alias("required"), F.count_if(F.coalesce(F.col("toxic") != 1, F.lit(True))).alias("distractors"))


# Graphs.

_SRC = "CASE WHEN doc_id % 2 = 0 THEN 'pkg' || (doc_id % 7) || '/m' || doc_id || '.py' ELSE 'pkg' || (doc_id % 7) || '/t' || doc_id || '.ts' END"


def _sources(spark, sf_dir) -> DataFrame:
    """A source file for each document, by rule: even numbers are Python modules, odd ones scripts."""
    i = F.col("doc_id")
    at = lambda k: (i + k).cast("string")
    folder = lambda k: F.concat(F.lit("pkg"), ((i + k) % 7).cast("string"))
    python = F.concat(
        F.lit("import os\nimport "), folder(2), F.lit(".m"), at(2), F.lit("\nfrom .m"), at(14), F.lit(" import x\nclass C"), at(0), F.lit("(C"), at(4), F.lit(", Base[int]):\n    async def run"), at(0), F.lit("(self):\n        pass\n")
    )
    script = F.concat(
        F.lit("import {a} from './t"), at(14), F.lit("'\nexport class T"), at(0), F.lit(" extends T"), at(2), F.lit(" {}\nexport function go"), at(0), F.lit("() {}\nexport const f"), at(0), F.lit(" = (x) => x\n")
    )
    even = i % 2 == 0
    path = F.concat(folder(0), F.when(even, "/m").otherwise("/t"), at(0), F.when(even, ".py").otherwise(".ts"))
    return tables.table(spark, sf_dir, "documents").select(path.alias("path"), F.when(even, "python").otherwise("typescript").alias("language"), F.when(even, python).otherwise(script).alias("source"))


@query(
    f"SELECT {_SRC} AS path, CASE WHEN doc_id % 2 = 0 THEN 'os,pkg' || ((doc_id + 2) % 7) || '/m' || (doc_id + 2) || ',/m' || (doc_id + 14) ELSE './t' || (doc_id + 14) END AS imports, "
    "CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id ELSE 'T' || doc_id END AS classes, CASE WHEN doc_id % 2 = 0 THEN 'C' || (doc_id + 4) || ',Base' ELSE 'T' || (doc_id + 2) END AS parents, "
    "CASE WHEN doc_id % 2 = 0 THEN 'run' || doc_id ELSE 'go' || doc_id || ',f' || doc_id END AS functions, "
    "CASE WHEN doc_id % 2 = 0 THEN 'run' || doc_id || ',C' || doc_id ELSE 'T' || doc_id || ',go' || doc_id || ',f' || doc_id END AS exports FROM documents"
)
def source_symbols(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",")
    return codegraph.extract(_sources(spark, sf_dir)).select("path", joined("imports").alias("imports"), joined("classes").alias("classes"), joined(F.col("inheritance.parent")).alias("parents"), joined("functions").alias("functions"), joined("exports").alias("exports"))


_STEP = "s AS (SELECT doc_id, " + _SRC + " AS path FROM documents), e AS (SELECT a.path AS src, b.path AS dst FROM s a JOIN s b ON (a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 2) OR b.doc_id = a.doc_id + 14)"


@query(f"WITH {_STEP} SELECT src, dst FROM e")
def source_imports(spark, sf_dir):
    return codegraph.import_edges(codegraph.extract(_sources(spark, sf_dir)))


@query(f"WITH {_STEP} SELECT src, dst, 'import' AS relation FROM e UNION ALL SELECT a.path, b.path, 'inherits' FROM s a JOIN s b ON b.doc_id = a.doc_id + CASE WHEN a.doc_id % 2 = 0 THEN 4 ELSE 2 END")
def source_graph(spark, sf_dir):
    return codegraph.build(_sources(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier)), c AS (SELECT DISTINCT s_suppkey % 10 AS community FROM supplier) SELECT community, count(src) AS edge_count FROM c LEFT JOIN e ON src % 10 = community AND dst % 10 = community GROUP BY 1")
def internal_edges(spark, sf_dir):
    suppliers = tables.table(spark, sf_dir, "supplier").select("s_suppkey")
    edges = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    edges = edges.join(suppliers.withColumnRenamed("s_suppkey", "dst"), "dst", "left_semi")
    return codegraph.internal_edges(edges, suppliers.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 10).alias("community")))


@query("SELECT source AS community, lang AS category FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents WHERE lang <> '' GROUP BY source, lang) WHERE r = 1")
def representative_category(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docgraph.representative_category(docs.select(F.col("source").alias("community"), F.col("lang").alias("category"), F.col("doc_id").alias("chunk_id")))


@query(f"WITH {catalogue._NODES}, e AS ({catalogue._KEY}), k AS (SELECT doc_id FROM documents WHERE n_chars > 1000) SELECT src, dst FROM e WHERE src IN (SELECT doc_id FROM k) AND dst IN (SELECT doc_id FROM k)")
def attached_edges(spark, sf_dir):
    """Keyword edges without those that lead to texts of up to 1,000 characters."""
    kept = tables.table(spark, sf_dir, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("chunk_id"))
    return docgraph.attached_keyword_edges(tables.graph_chunks(spark, sf_dir), kept).select("src", "dst")


# The watch loop.

_BATCHES = "b AS (SELECT user_id, event_id % 4 AS batch, max_by(event_type, event_id) AS h FROM events GROUP BY ALL), first AS (SELECT min(event_type) AS gone FROM events), l AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY batch) AS was, lag(batch) OVER (PARTITION BY user_id ORDER BY batch) AS at FROM b)"


def _sink_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, watch.WatchSink]:
    """(path, batch) of upserts and of deletes that the sink makes of four batches; events of the first type delete."""
    events, root = tables.table(spark, sf_dir, "events"), _folder(spark, "watch")
    gone = events.agg(F.min("event_type").alias("gone"))
    made = {"upsert": [], "delete": []}

    def keep(kind: str, batch: int):
        def run(rows: DataFrame) -> None:
            path = f"{root}/{kind}-{batch}"
            rows.select("path", F.lit(batch).alias("batch")).write.parquet(path)
            made[kind].append(path)

        return run

    rows = events.join(F.broadcast(gone)).select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == F.col("gone"), "deleted").otherwise("modified").alias("kind"), F.col("event_type").alias("sha256"), F.col("event_id").alias("ended"))
    for batch in range(4):
        sink = watch.WatchSink(spark, f"{root}/state", keep("upsert", batch), keep("delete", batch))
        part = rows.where(F.col("ended") % 4 == batch)
        sink(part, batch)
        sink(part, batch)  # delivered again
    return spark.read.parquet(*made["upsert"]), spark.read.parquet(*made["delete"]), sink


@query(f"WITH {_BATCHES} SELECT CAST(user_id AS VARCHAR) AS path, CAST(batch AS INTEGER) AS batch FROM l, first WHERE h <> gone AND (was IS NULL OR was = gone OR was <> h)")
def watch_upserts(spark, sf_dir):
    """What the sink ingests: files whose content isn't the last one known."""
    return _sink_runs(spark, sf_dir)[0]


@query(f"WITH {_BATCHES} SELECT CAST(user_id AS VARCHAR) AS path, CAST(batch AS INTEGER) AS batch FROM l, first WHERE h = gone")
def watch_deletes(spark, sf_dir):
    return _sink_runs(spark, sf_dir)[1]


@query("WITH l AS (SELECT user_id, event_id % 4 AS batch, max_by(event_type, event_id) AS h FROM events GROUP BY ALL), z AS (SELECT user_id, max_by(h, batch) AS h FROM l GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS path, h AS sha256 FROM z WHERE h <> (SELECT min(event_type) FROM events)")
def watch_state(spark, sf_dir):
    """The last hashes that the sink knows after all batches."""
    return _sink_runs(spark, sf_dir)[2]._state(4).select("path", "sha256")


@query("SELECT source || '/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'created' ELSE 'modified' END AS kind FROM documents WHERE doc_id % 4 < 3")
def watch_listing(spark, sf_dir):
    """Events from two listings of a folder: a quarter each is gone, new, changed and as it was."""
    docs = tables.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit(0).cast("timestamp").alias("ts"), F.col("doc_id"))
    before = docs.where("doc_id % 4 <> 1").select("path", "ts", F.lit("a").alias("sha256"))
    after = docs.where("doc_id % 4 <> 0").select("path", "ts", F.when(F.col("doc_id") % 4 == 2, "b").otherwise("a").alias("sha256"))
    return watch.listing_events(before, after).select("path", "kind")


# Policy.


@query("SELECT source AS collection, chunks, lever, before, after, reindex AND chunks > 0 AS reindex FROM (SELECT source, count(*) AS chunks FROM documents GROUP BY 1), (VALUES ('rerank', 'True', 'False', false), ('hybrid', 'False', 'True', false), ('chunk_fallback', 'sentence', 'code', true), ('taxonomy', 'content', 'file_type', true)) v(lever, before, after, reindex)")
def profile_change(spark, sf_dir):
    """What another profile changes for each source as a collection, and which of its chunks have to be made again."""
    changes = policy.profile_change(policy.PROFILES["documents"], policy.PROFILES["codebase"])
    levers = F.array(*(F.struct(F.lit(c["lever"]).alias("lever"), F.lit(str(c["old"])).alias("before"), F.lit(str(c["new"])).alias("after"), F.lit(c["reindex"]).alias("reindex")) for c in changes))
    sizes = tables.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("chunks"))
    rows = sizes.select("collection", "chunks", F.explode(levers).alias("x")).select("collection", "chunks", "x.*")
    return rows.withColumn("reindex", F.col("reindex") & (F.col("chunks") > 0))
