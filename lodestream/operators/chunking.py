"""Chunkers: rows (file_path, text, ...) become rows with chunk_index, chunk and header_path.

Strategies are registered by name; each is a function from a DataFrame to a DataFrame.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestream.sources.files import kind_of

CHUNK_SIZE, CHUNK_OVERLAP, MARKDOWN_SIZE = 512, 100, 1024
_CHARS_PER_TOKEN = 4
#: White space is that of ASCII.
_SPACE = " \t\n\v\f\r"
_WORD = re.compile(r"(\S+)(\s*)", re.ASCII)
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$", re.ASCII)
_PIECE = T.ArrayType(T.StructType([T.StructField("chunk", T.StringType()), T.StructField("header_path", T.StringType())]))


def split_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole sentences of ``size`` words at most; each begins with up to ``overlap`` words of the one before.

    Sentences end with a full stop, question or exclamation mark, or a line. A sentence longer than a
    chunk is cut at words, and a word of more than eight characters for each word of a chunk at
    characters.
    """
    most = size * _CHARS_PER_TOKEN * 2
    units, sentence = [], []
    for word, space in _WORD.findall(text):
        sentence += [word[i : i + most] for i in range(0, len(word), most)]
        if word[-1] in ".!?" or "\n" in space:
            units += [sentence[i : i + size] for i in range(0, len(sentence), size)]
            sentence = []
    units += [sentence[i : i + size] for i in range(0, len(sentence), size)]
    chunks, current, carried = [], [], 0
    for unit in units:
        if current and len(current) + len(unit) > size:
            chunks.append(" ".join(current))
            keep = min(overlap, size - len(unit), len(current))
            current, carried = current[len(current) - keep :] if keep > 0 else [], max(keep, 0)
        current = current + unit
    if current and (len(current) > carried or not chunks):
        chunks.append(" ".join(current))
    return chunks


def split_headings(text: str) -> list[tuple[str, str]]:
    """(header path, section) for each heading's section, the heading line included; fenced code has no headings."""
    sections, path, lines, fenced = [], [], [], False

    def close() -> None:
        body = "\n".join(lines).strip(_SPACE)
        if body:
            sections.append(("/".join(t for _, t in path), body))
        lines.clear()

    for line in text.split("\n"):
        if line.lstrip(_SPACE).startswith("```"):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line)
        if m:
            close()
            level = len(m[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, m[2]))
        lines.append(line)
    close()
    return sections


_FENCE = r"^\s*+```"
_TITLE = r"(?s)^(#{1,6})\s+(.*?)\s*#*\s*$"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _int(value: Column) -> Column:
    return value.cast("int")


def sentence_chunks(text: Column, size: int, overlap: int) -> Column:
    """``split_sentences`` as an expression, packed by a fold over the sentences' numbers of words.

    White space becomes one line end where a sentence ends and one space elsewhere, since both split fast.
    """
    most = size * _CHARS_PER_TOKEN * 2
    cut = lambda w: F.transform(F.sequence(F.lit(0), _int((F.char_length(w) - 1) / most)), lambda i: F.substr(w, i * most + 1, F.lit(most)))
    words = lambda s: _let(F.split(s, " ", -1), lambda ws: F.when(F.char_length(s) <= most, ws).otherwise(F.flatten(F.transform(ws, cut))))
    lengths = lambda n: F.transform(F.sequence(F.lit(0), _int((n - 1) / size)), lambda i: F.least(F.lit(size), n - i * size))

    def step(state: Column, n: Column) -> Column:
        held = state["to"] - state["from"]
        kept = F.greatest(F.least(F.lit(overlap), F.lit(size) - n, held), F.lit(0))
        full = F.struct((state["to"] - kept).alias("from"), (state["to"] + n).alias("to"), kept.alias("carried"), F.array_append(state["out"], F.struct(state["from"].alias("from"), state["to"].alias("to"))).alias("out"))
        more = F.struct(state["from"].alias("from"), (state["to"] + n).alias("to"), state["carried"].alias("carried"), state["out"].alias("out"))
        return F.when((held > 0) & (held + n > size), full).otherwise(more)

    def last(state: Column) -> Column:
        held = state["to"] - state["from"]
        own = (held > 0) & ((held > state["carried"]) | (F.size(state["out"]) == 0))
        return F.when(own, F.array_append(state["out"], F.struct(state["from"].alias("from"), state["to"].alias("to")))).otherwise(state["out"])

    start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("carried"), F.array().cast("array<struct<from: int, to: int>>").alias("out"))
    packed = lambda u: F.aggregate(F.flatten(F.transform(u, lambda x: lengths(F.size(x)))), start, step, last)
    joined = lambda u: _let(F.flatten(u), lambda ws: F.transform(packed(u), lambda x: F.array_join(F.slice(ws, x["from"] + 1, x["to"] - x["from"]), " ")))
    lines = F.btrim(F.regexp_replace(text, r"(?<=[.!?])\s++|[^\S\n]*+\n\s*+", "\n"), F.lit(_SPACE))
    odd = lambda t: functools.reduce(operator.or_, (F.contains(t, F.lit(x)) for x in ("  ", "\t", "\v", "\f", "\r")))
    whole = _let(lines, lambda t: F.when(odd(t), F.regexp_replace(t, r"[^\S\n]++", " ")).otherwise(t))
    of = lambda t: _let(F.transform(F.split(t, "\n", -1), words), joined)
    return _let(whole, lambda t: F.when(F.length(t) > 0, of(t)).otherwise(F.array().cast("array<string>")))


def heading_sections(text: Column) -> Column:
    """``split_headings`` as an expression, array<struct<header, body>>: a fold over the lines with the stack of open headings."""

    def closed(state: Column, to: Column) -> Column:
        section = F.struct(F.array_join(F.transform(state["path"], lambda h: h["title"]), "/").alias("header"), state["from"].alias("from"), to.alias("to"))
        return F.array_append(state["out"], section)

    def step(state: Column, line: Column) -> Column:
        fenced = F.when(F.regexp_like(line["text"], F.lit(_FENCE)), ~state["fenced"]).otherwise(state["fenced"])
        level = F.length(F.regexp_extract(line["text"], _TITLE, 1))
        title = F.struct(level.alias("level"), F.regexp_extract(line["text"], _TITLE, 2).alias("title"))
        path = F.array_append(F.filter(state["path"], lambda h: h["level"] < level), title)
        opened = F.struct(path.alias("path"), fenced.alias("fenced"), line["at"].alias("from"), closed(state, line["at"]).alias("out"))
        same = F.struct(state["path"].alias("path"), fenced.alias("fenced"), state["from"].alias("from"), state["out"].alias("out"))
        return F.when(~fenced & (level > 0), opened).otherwise(same)

    start = F.struct(F.array().cast("array<struct<level: int, title: string>>").alias("path"), F.lit(False).alias("fenced"), F.lit(0).alias("from"), F.array().cast("array<struct<header: string, from: int, to: int>>").alias("out"))

    def sections(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("at")))
        cut = F.aggregate(numbered, start, step, lambda state: closed(state, F.size(lines)))
        body = lambda x: F.regexp_replace(F.array_join(F.slice(lines, x["from"] + 1, x["to"] - x["from"]), "\n"), r"^\s++|\s++\z", "")
        return F.filter(F.transform(cut, lambda x: F.struct(x["header"].alias("header"), body(x).alias("body"))), lambda x: x["body"] != "")

    return _let(F.split(text, "\n", -1), sections)


def _cut(rows: DataFrame, pieces: Column) -> DataFrame:
    # an inner explode would get a filter that works the pieces out a second time
    cut = rows.select("*", F.posexplode_outer(pieces).alias("chunk_index", "__piece")).where("chunk_index IS NOT NULL")
    return cut.select(*rows.columns, "chunk_index", "__piece.chunk", "__piece.header_path")


def sentence(rows: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text_col: str = "text") -> DataFrame:
    """Whole sentences up to the size, as ``split_sentences`` cuts them; all of it in the JVM."""
    piece = lambda c: F.struct(c.alias("chunk"), F.lit(None).cast("string").alias("header_path"))
    return _cut(rows, F.transform(sentence_chunks(F.coalesce(text_col, F.lit("")), size, overlap), piece))


def markdown(rows: DataFrame, size: int = MARKDOWN_SIZE, overlap: int = CHUNK_OVERLAP, text_col: str = "text") -> DataFrame:
    """Sections by heading first, then sentences, so that no chunk exceeds the size; all of it in the JVM."""
    of = lambda x: F.transform(sentence_chunks(x["body"], size, overlap), lambda c: F.struct(c.alias("chunk"), x["header"].alias("header_path")))
    return _cut(rows, F.flatten(F.transform(heading_sections(F.coalesce(text_col, F.lit(""))), of)))


#: How a definition at the outermost level begins, by family of languages.
_BEGINS = {
    "python": r"(?:async\s+def|def|class)\b|@",
    "script": r"(?:export\s+|default\s+|declare\s+|async\s+|abstract\s+)*(?:function|class|interface|enum|namespace|type|const|let)\b|@",
    "managed": r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|case|override|partial|async|virtual)\s+)*(?:class|interface|enum|record|object|trait|struct|namespace|fun|def|func|function|extension|protocol)\b|@|\[",
    "native": r"(?:template|struct|class|enum|union|namespace|typedef)\b|[A-Za-z_][\w\s*&:<>,~]*\([^;]*$",
    "go": r"(?:func|type|var|const)\b",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|impl|mod|macro_rules!)|#\[",
    "ruby": r"(?:def|class|module)\b",
    "shell": r"function\s+\w+|\w+\s*\(\)",
}
#: Languages that have a splitter, with its family; files of others are cut at sentences.
LANGUAGES = {
    "python": "python", "javascript": "script", "jsx": "script", "typescript": "script", "tsx": "script", "java": "managed", "csharp": "managed", "kotlin": "managed",
    "scala": "managed", "swift": "managed", "php": "managed", "c": "native", "cpp": "native", "go": "go", "rust": "rust", "ruby": "ruby", "bash": "shell",
}


_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_LONG = r'"{3}(?:\\.|[^\\])*?(?:"{3}|\Z)'
#: Comments and literals, in which brackets and definitions don't count, by family.
_LITERALS = {
    "python": rf"{_LONG}|'{{3}}(?:\\.|[^\\])*?(?:'{{3}}|\Z)|{_QUOTED}|#[^\n]*",
    "script": rf"{_C}|{_QUOTED}|`(?:\\.|[^`\\])*(?:`|\Z)",
    "managed": rf'{_C}|{_LONG}|@"(?:""|[^"])*"|{_QUOTED}',
    "native": rf'{_C}|R"(?P<mark>[^(\s]*)\(.*?\)(?P=mark)"|{_QUOTED}',
    "go": rf"{_C}|{_QUOTED}|`[^`]*(?:`|\Z)",
    "rust": rf'{_C}|r(?P<mark>#*)".*?"(?P=mark)|"(?:\\.|[^"\\])*"|\'(?:\\[^\n]+?|[^\'\\\n])\'',
    "ruby": r'(?m:(?:^|(?<=\s))#[^\n]*)|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
    "shell": r'(?m:(?:^|(?<=\s))#[^\n]*)|"(?:\\.|[^"\\])*"|\'[^\']*\'',
}
#: Families whose nesting shows in the indentation; in the others brackets tell.
_INDENTED = {"python", "ruby", "shell"}


def _nesting(text: str, lines: list[str], family: str) -> list[int | None]:
    """How deep each line begins; None for one that begins inside a literal, a comment or, where indentation tells, brackets."""
    starts = list(itertools.accumulate((len(x) + 1 for x in lines), initial=0))[:-1]
    depths: list[int | None] = []
    depth = 0
    for m in re.finditer(rf"{_LITERALS[family]}|[(){{}}\[\]]", text, re.S):
        while len(depths) < len(starts) and starts[len(depths)] <= m.start():
            depths.append(depth)
        if len(m[0]) == 1 and m[0] in "([{":
            depth += 1
        elif len(m[0]) == 1 and m[0] in ")]}":
            depth = max(0, depth - 1)
        while len(depths) < len(starts) and starts[len(depths)] < m.end():
            depths.append(None)
    depths += [depth] * (len(starts) - len(depths))
    if family in _INDENTED:
        return [len(x) - len(x.lstrip()) if d == 0 else None for x, d in zip(lines, depths, strict=True)]
    return depths


def _code_blocks(text: str, size: int, language: str = "python") -> list[str]:
    """Definitions of one level together until half the size is reached; decorators stay with theirs.

    What is beyond twice the size is cut at the definitions inside it, and so on. A definition inside
    a literal, a comment or an argument list is none.
    """
    family, lines = LANGUAGES[language], text.split("\n")
    begins, depth = re.compile(_BEGINS[family]), _nesting(text, lines, family)
    found = [i for i, x in enumerate(lines) if depth[i] is not None and begins.match(x.lstrip())]
    near = lambda a, b: depth[a] == depth[b] and lines[a].lstrip()[0] in "@[#" and all(depth[i] is None for i in range(a + 1, b))
    found = [b for a, b in zip([None, *found], found) if a is None or not near(a, b)]  # noqa: B905
    ends = list(itertools.accumulate((len(x) + 1 for x in lines), initial=0))
    enough, most = size * _CHARS_PER_TOKEN // 2, 2 * size * _CHARS_PER_TOKEN

    def cut(first: int, last: int, inside: bool) -> Iterator[tuple[int, int]]:
        inner = [i for i in found if first + inside <= i < last]
        marks = [i for i in inner if depth[i] == min(depth[j] for j in inner)] if inner else []
        begun = first
        for start, end in itertools.pairwise([first, *(i for i in marks if i > first), last]):
            if start > begun and ends[start] - ends[begun] > enough:
                yield begun, start
                begun = start
            if ends[end] - ends[start] > most and (marks or not inside):
                deeper = list(cut(start, end, True)) if start in found or inside else [(start, end)]
                if len(deeper) > 1:
                    if begun < start:
                        yield begun, start
                    yield from deeper
                    begun = end
        if begun < last:
            yield begun, last

    return [b for s, e in cut(0, len(lines), False) if (b := "\n".join(lines[s:e])).strip()]


def language_of(content_type: Column, file_path: Column) -> Column:
    """A code file's language with a splitter: its type's label, or for a file without a type that of its ending; else null."""
    label = F.when(content_type.isNull(), F.split_part(kind_of(file_path), F.lit("/"), F.lit(2))).when(F.startswith(content_type, F.lit("code/")), F.split_part(content_type, F.lit("/"), F.lit(2)))
    return F.when(label.isin(*LANGUAGES), label)


def code(rows: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text_col: str = "text") -> DataFrame:
    """Blocks of definitions by the file's language; a block that stays beyond twice the size, or another language, falls back to sentences."""

    def split(text: str, language: str | None) -> list[str]:
        most = 2 * size * _CHARS_PER_TOKEN
        if language not in LANGUAGES:
            return split_sentences(text, size, overlap)
        return [c for b in _code_blocks(text, size, language) for c in ([b] if len(b) <= most else split_sentences(b, size, overlap))]

    @F.pandas_udf(_PIECE)
    def pieces(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk": c, "header_path": None} for c in split(t or "", n)] for t, n in zip(texts, languages, strict=True)], dtype=object)

    cut = rows.select("*", F.posexplode(pieces(F.col(text_col), language_of(F.col("content_type"), F.col("file_path")))).alias("chunk_index", "__piece"))
    return cut.select(*rows.columns, "chunk_index", "__piece.chunk", "__piece.header_path")


def config(rows: DataFrame, text_col: str = "text", **_) -> DataFrame:
    """A whole file is one chunk."""
    return rows.where(F.col(text_col).isNotNull()).select("*", F.lit(0).alias("chunk_index"), F.col(text_col).alias("chunk"), F.lit(None).cast("string").alias("header_path"))


STRATEGIES = {"sentence": sentence, "markdown": markdown, "code": code, "config": config}


def dispatch(rows: DataFrame, fallback: str = "sentence", text_col: str = "text", **options) -> DataFrame:
    """Each file by its ``content_type`` (group/label): code, config, markdown, else sentences.

    Files without a type go by ``fallback``: ``code`` takes those whose ending is of a language with
    a splitter. Markdown goes by headings whether its type or its ending tells.
    """
    kind = F.coalesce("content_type", F.lit(""))
    known = language_of(F.col("content_type"), F.col("file_path")).isNotNull()
    is_markdown = (kind == "document/markdown") | F.endswith(F.lower("file_path"), F.lit(".md"))
    name = F.when(F.startswith(kind, F.lit("config/")), "config").when(F.startswith(kind, F.lit("code/")), F.when(known, "code").otherwise("sentence")).when(is_markdown, "markdown")
    name = name.when(kind == "", F.when(known & (F.lit(fallback) == "code"), "code").otherwise("sentence" if fallback == "code" else fallback)).otherwise("sentence")
    marked = rows.withColumn("__strategy", name)
    out = None
    for strategy, run in STRATEGIES.items():
        part = run(marked.where(F.col("__strategy") == strategy).drop("__strategy"), text_col=text_col, **options)
        out = part if out is None else out.unionByName(part)
    return out


def prepend_heading(chunk: Column, header_path: Column) -> Column:
    """The header path in brackets before a chunk, once."""
    prefix = F.concat(F.lit("["), header_path, F.lit("] "))
    return F.when((F.coalesce(header_path, F.lit("")) != "") & ~F.startswith(chunk, prefix), F.concat(prefix, chunk)).otherwise(chunk)


def drop_small(chunks: DataFrame, size: int, fraction: float, chunk_col: str = "chunk") -> DataFrame:
    """Chunks of int(size * 4 * fraction) characters or more; everything if the fraction isn't above 0."""
    return chunks if fraction <= 0 else chunks.where(F.char_length(chunk_col) >= int(size * _CHARS_PER_TOKEN * fraction))


def table_to_markdown(cells: DataFrame, group_rows: int = 50) -> DataFrame:
    """(table_id, row_group, markdown) of ``cells`` (table_id, row, column, value).

    Missing cells are empty; tables of more than ``group_rows`` rows are cut into groups, each with
    its own first row as header.
    """
    width = cells.groupBy("table_id").agg((F.max("column") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    by_row = cells.groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("values"))
    grid = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.element_at("values", c), F.lit("")))
    line = F.concat(F.lit("| "), F.array_join(grid, " | "), F.lit(" |"))
    rows = by_row.join(width, "table_id").select("table_id", F.when(F.col("height") > group_rows, F.floor(F.col("row") / group_rows)).otherwise(0).cast("int").alias("row_group"), "row", line.alias("line"), F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda _: F.lit("---")), " | "), F.lit(" |")).alias("rule"))
    ordered = rows.groupBy("table_id", "row_group").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("lines"), F.first("rule").alias("rule"))
    lines = F.col("lines.line")
    return ordered.select("table_id", "row_group", F.array_join(F.concat(F.slice(lines, 1, 1), F.array("rule"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n").alias("markdown"))


def layout_documents(paragraphs: DataFrame, cells: DataFrame, contents: DataFrame | None = None, group_rows: int = 50) -> DataFrame:
    """(file_path, content_type, header_path, table_index, row_group, text) of a layout analysis.

    ``paragraphs`` (file_path, position, role, content) are a document each, their role its header
    path; ``cells`` (file_path, table_id, row, column, value) become Markdown tables, long ones in row
    groups. Files of ``contents`` (file_path, content) that have neither give their content.
    """
    none = F.lit(None).cast("int")
    texts = paragraphs.where(F.coalesce("content", F.lit("")) != "").select("file_path", F.lit("document/layout").alias("content_type"), F.coalesce("role", F.lit("")).alias("header_path"), none.alias("table_index"), none.alias("row_group"), F.col("content").alias("text"))
    keyed = cells.withColumn("__key", F.struct("file_path", "table_id"))
    made = table_to_markdown(keyed.select(F.col("__key").alias("table_id"), "row", "column", "value"), group_rows)
    height = cells.groupBy("file_path", "table_id").agg((F.max("row") + 1 > group_rows).alias("long"))
    tables = made.select(F.col("table_id.file_path").alias("file_path"), F.col("table_id.table_id").alias("table_index"), "row_group", "markdown").join(height.withColumnRenamed("table_id", "table_index"), ["file_path", "table_index"])
    tables = tables.select("file_path", F.lit("table").alias("content_type"), F.lit(None).cast("string").alias("header_path"), F.col("table_index").cast("int").alias("table_index"), F.when(F.col("long"), F.col("row_group")).alias("row_group"), F.col("markdown").alias("text"))
    out = texts.unionByName(tables)
    if contents is None:
        return out
    rest = contents.where(F.coalesce("content", F.lit("")) != "").join(out.select("file_path").distinct(), "file_path", "left_anti")
    return out.unionByName(rest.select("file_path", F.lit("document/layout").alias("content_type"), F.lit(None).cast("string").alias("header_path"), none.alias("table_index"), none.alias("row_group"), F.col("content").alias("text")))


def column_label(items: DataFrame) -> DataFrame:
    """(page, column) of ``items`` (page, position, x, width): left or right by the first item if text stands on both sides of 0.45 of the widest extent, else single."""
    per_page = items.groupBy("page").agg(F.max(F.col("x") + F.col("width")).alias("extent"), F.min_by("x", "position").alias("first"), F.min("x").alias("least"), F.max("x").alias("most"))
    middle = F.col("extent") * 0.45
    both = (F.col("least") < middle) & (F.col("most") >= middle)
    return per_page.select("page", F.when(both, F.when(F.col("first") < middle, "left").otherwise("right")).otherwise("single").alias("column"))
