"""Files: discovery, type detection by ending or by a detector, and readers of text, office and PDF formats."""

from __future__ import annotations

import csv
import html
import io
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestream.operators.registry import PDF
from lodestream.sources import pdf

# Endings that ingestion reads.
SUPPORTED = [".pdf", ".docx", ".txt", ".pptx", ".html", ".md", ".csv"]
# Folders that scans leave out.
EXCLUDED_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache"]
# Type label by ending, for each type group.
TYPES = {
    "code": {
        ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript",
        ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go",
        ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "bash",
        ".bash": "bash", ".zsh": "bash", ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css",
    },
    "document": {
        ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".txt": "text", ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".pptx": "pptx",
        ".csv": "csv",
    },
    "config": {
        ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".xml": "xml", ".env": "env",
    },
}
# Endings of binary files.
BINARY = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".tiff", ".tif", ".heic", ".heif", ".zip", ".tar", ".gz", ".bz2", ".7z",
    ".rar", ".xz", ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flv", ".mkv", ".woff", ".woff2",
    ".ttf", ".otf", ".eot", ".pyc", ".pyo", ".class", ".jar",
]
MAX_FILES, MAX_DEPTH = 5000, 10
MAX_HASHED = 500 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last ending of the file name in lower case; empty for hidden names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def ignored(path: Column) -> Column:
    """Hidden, temporary and partial files, and endings that ingestion doesn't read."""
    name = file_name(path)
    return F.regexp_like(name, F.lit(r"^\.|^~\$|\.tmp$|\.part$")) | ~suffix(path).isin(*SUPPORTED)


def qualified(spark: SparkSession, root: str) -> str | None:
    """The full URI of a path as Spark's readers write it; None if there is no such file or folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(path).getPath().toString() if fs.exists(path) else None


def is_folder(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, modified, size, content) of the files below ``root`` but hidden ones; content is read only if used.

    ``relative`` is the path below ``root``; where ``root`` is a file, its name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = (qualified(spark, root) or root).rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(full)), F.substr("path", F.lit(len(full) + 1))).otherwise(file_name(F.col("path")))
    return found.select("path", relative.alias("relative"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def split_supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that ingestion reads, and the others as (path, status, reason)."""
    ok = suffix(F.col("path")).isin(*SUPPORTED)
    skipped = files.where(~ok).select("path", F.lit("skipped").alias("status"), F.concat(F.lit("unsupported extension "), suffix(F.col("path"))).alias("reason"))
    return files.where(ok), skipped


def kind_of(path: Column) -> Column:
    """A path's content type (group/label) by its ending."""
    kinds = F.create_map(*(F.lit(x) for group, labels in TYPES.items() for end, label in labels.items() for x in (end, f"{group}/{label}")))
    end = suffix(path)
    binary = F.concat(F.lit("binary/"), F.substr(end, F.lit(2)))
    return F.when(end.isin(*BINARY), binary).otherwise(F.coalesce(F.element_at(kinds, end), F.lit("unknown/unknown")))


def with_types(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with content_type (group/label) and is_text by ending; no file goes."""
    return files.withColumn("content_type", kind_of(F.col(path_col))).withColumn("is_text", ~F.startswith("content_type", F.lit("binary/")))


def in_scope(relative: Column) -> Column:
    """Whether a path below the scanned root is no deeper than the limit and outside excluded folders."""
    folders = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    return (F.size(folders) <= MAX_DEPTH) & ~F.arrays_overlap(folders, F.array(*(F.lit(d) for d in EXCLUDED_DIRS)))


def detect_types(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``with_types`` of the files in scope; ``path_col`` has paths below the scanned root."""
    return with_types(files.where(in_scope(F.col(path_col))), path_col)


def inventory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type counts over all entries, and the entries cut to ``MAX_FILES`` in path order."""
    typed = detect_types(files)
    return typed.groupBy("content_type").agg(F.count("*").alias("n")), typed.orderBy("path").limit(MAX_FILES)


def detected(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, content_type, is_text) by a detector's (path, group, label, is_text); by ending for the files it doesn't name."""
    by_end = with_types(files).select("path", F.col("content_type").alias("by_end"), F.col("is_text").alias("text_by_end"))
    joined = by_end.join(found.select("path", F.concat_ws("/", "group", "label").alias("found"), F.col("is_text").alias("text_found")), "path", "left")
    return joined.select("path", F.coalesce("found", "by_end").alias("content_type"), F.coalesce("text_found", "text_by_end").alias("is_text"))


def mismatches(types: DataFrame) -> DataFrame:
    """(path, expected, found) of text files whose detected label isn't their ending's; endings without a label have none."""
    known = {end: label for labels in TYPES.values() for end, label in labels.items()}
    expected = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), suffix(F.col("path")))
    rows = types.where("is_text").select("path", expected.alias("expected"), F.element_at(F.split("content_type", "/"), -1).alias("found"))
    return rows.where(F.col("expected") != F.col("found"))


def content_hash(files: DataFrame) -> DataFrame:
    """``files`` with the SHA-256 of their content; none beyond the size limit."""
    return files.withColumn("sha256", F.when(F.octet_length("content") <= MAX_HASHED, F.sha2("content", 256)))


def strip_tags(page: str) -> str:
    page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", page))).strip()


def _csv_text(text: str) -> str:
    return "\n".join(", ".join(row) for row in csv.reader(io.StringIO(text)))


def _paragraphs(part: bytes, paragraph: str, run: str) -> list[str]:
    """Texts of the elements named ``paragraph``, joined from those named ``run`` inside them, tabs and breaks kept."""
    out = []
    for p in ElementTree.fromstring(part).iter():
        if p.tag.endswith("}" + paragraph):
            text = "".join((e.text or "") if e.tag.endswith("}" + run) else "\t" if e.tag.endswith("}tab") else "\n" if e.tag.endswith("}br") else "" for e in p.iter())
            if text.strip():
                out.append(text)
    return out


def read_docx(content: bytes) -> list[tuple[str | None, str]]:
    """One page: the document's paragraphs, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(None, "\n".join(_paragraphs(z.read("word/document.xml"), "p", "t")))]


def read_pptx(content: bytes) -> list[tuple[str | None, str]]:
    """A page for each slide, in order, its paragraphs a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return [(str(i), "\n".join(_paragraphs(z.read(n), "p", "t"))) for i, n in slides]


def read_pdf(content: bytes) -> list[tuple[str | None, str]]:
    """The pages that the first installed PDF reader gives, the engine's own if there is none."""
    return [(str(i), text) for i, text in PDF.get(pdf.choose())(content)]


def _whole(read: Callable[[str], str]) -> Callable[[bytes], list[tuple[str | None, str]]]:
    return lambda content: [(None, read(content.decode("utf-8")))]


#: Readers by ending: from a file's bytes to (page label, text) pairs.
READERS = {".txt": _whole(str), ".md": _whole(str), ".html": _whole(strip_tags), ".csv": _whole(_csv_text), ".docx": read_docx, ".pptx": read_pptx, ".pdf": read_pdf}
_PAGES = "array<struct<label: string, text: string>>"


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text, pages, error) of (path, content); a file that fails has an error and neither text nor pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                pages, error = None, None
                try:
                    end = "." + path.rpartition(".")[2].lower()
                    if end not in READERS:
                        raise ValueError(f"no reader for {end}")
                    pages = READERS[end](bytes(content))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                text = None if pages is None else "\n".join(t for _, t in pages)
                out.append((path, text, None if pages is None else [{"label": n, "text": t} for n, t in pages], error))
            yield pd.DataFrame(out, columns=["path", "text", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, text string, pages {_PAGES}, error string")


def run_detector(spark: SparkSession, root: str, command: list[str], timeout: int = 30) -> DataFrame | None:
    """(path, group, label, is_text) of the files below a local folder by a detector's command that writes JSON lines.

    None if the command is missing, fails or takes too long: types then go by ending.
    """
    try:
        done = subprocess.run([*command, root], capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    lines = spark.createDataFrame([(x,) for x in done.stdout.splitlines() if x.strip()], "value string")
    return type_lines(lines)


def type_lines(rows: DataFrame) -> DataFrame:
    """(path, group, label, is_text) from a type detector's JSON lines; lines that don't parse are left out."""
    output = "struct<`group`: string, label: string, is_text: boolean>"
    parsed = rows.select(F.from_json("value", f"path string, output {output}, result struct<value: struct<output: {output}>>", {"mode": "PERMISSIVE"}).alias("r"))
    found = parsed.where("r.path is not null").select("r.path", F.coalesce("r.output", "r.result.value.output").alias("o"))
    out = found.select("path", F.coalesce("o.group", F.lit("unknown")).alias("group"), F.coalesce("o.label", F.lit("unknown")).alias("label"), F.coalesce("o.is_text", F.lit(True)).alias("is_text"))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(d) for d in EXCLUDED_DIRS))))


def read_type_lines(spark: SparkSession, path: str) -> DataFrame:
    """``type_lines`` of stored files."""
    return type_lines(spark.read.text(path))


def report_counts(details: DataFrame) -> DataFrame:
    """One row: indexed, skipped and failed files of (path, status)."""
    return details.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "failed")))
