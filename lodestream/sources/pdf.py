"""PDF readers by name: from a file's bytes to its pages.

The last one is the engine's own and always there; the others need packages. ``read_pages`` gives
pages with their place on the sheet: items are read file by file, and what holds for a page is aggregated.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from collections.abc import Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestream.sources import pdf_items

#: Readers that need a package, probed in this order, and the one that needs none.
ORDER = ["liteparse", "pypdfium2", "pypdf"]
OWN = "builtin"
#: Version of the bounding boxes' layout: left, top, right, bottom from the page's left upper corner.
BBOX_VERSION = 1
#: Runs of text that are handed on at once, and what one file has beyond that.
ITEMS = 10_000


def available(probe: Callable[[str], object] = find_spec) -> list[str]:
    return [*(name for name in ORDER if probe(name) is not None), OWN]


def choose(name: str = "auto", probe: Callable[[str], object] = find_spec) -> str:
    """A reader's name; ``auto`` takes the first whose package is installed, else the engine's own."""
    if name != "auto":
        if name not in (*ORDER, OWN):
            raise ValueError(f"unknown PDF reader {name!r}")
        return name
    return available(probe)[0]


def builtin(content: bytes) -> list[tuple[int, str]]:
    """Non-blank pages, a line for each run of text."""
    pages: dict[int, list[str]] = {}
    for item in pdf_items.items(content):
        pages.setdefault(item.page, []).append(item.text)
    return [(i, text) for i, lines in pages.items() if (text := "\n".join(lines)).strip()]


def read_items(files: DataFrame) -> DataFrame:
    """(path, page, position, x, y, width, height, text, error) of (path, content).

    A file that can't be read is one row with an error; one without text has no row.
    """
    schema = "path string, page int, position int, x double, y double, width double, height double, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    out += [(path, *item, None) for item in pdf_items.items(bytes(content))]
                except Exception as e:  # whatever a damaged file leads to is that file's error
                    out.append((path, *[None] * 7, f"{type(e).__name__}: {e}"))
                if len(out) >= ITEMS:
                    yield pd.DataFrame(out, columns=names).astype({"page": "Int32", "position": "Int32"})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"page": "Int32", "position": "Int32"})

    return files.select("path", "content").mapInPandas(run, schema)


def page_layout(items: DataFrame) -> DataFrame:
    """(path, page, text, column, section_bbox, bbox_schema_version, pdf_reader) of each page that isn't blank.

    ``column`` is left or right, by the first run, if runs begin on both sides of 0.45 of the widest
    extent, else single; ``section_bbox`` is a JSON list that holds all runs.
    """
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda i: i["text"])
    pages = items.where("error IS NULL").groupBy("path", "page").agg(
        F.array_join(lines, "\n").alias("text"), F.min("x").alias("left"), F.min("y").alias("top"), F.max(right).alias("right"), F.max(bottom).alias("bottom"),
        F.min_by("x", "position").alias("first"), F.max("x").alias("most"),
    )
    middle = F.col("right") * 0.45
    side = F.when(F.col("first") < middle, "left").otherwise("right")
    column = F.when((F.col("left") < middle) & (F.col("most") >= middle), side).otherwise("single")
    box = F.to_json(F.transform(F.array("left", "top", "right", "bottom"), lambda v: F.round(v, 3)))
    return pages.where(F.regexp_like("text", F.lit(r"\S"))).select("path", "page", "text", column.alias("column"), box.alias("section_bbox"), F.lit(BBOX_VERSION).alias("bbox_schema_version"), F.lit(OWN).alias("pdf_reader"))


def read_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages as ``page_layout`` gives them, (path, error) of the files that failed) of (path, content)."""
    found = read_items(files)
    return page_layout(found), found.where("error IS NOT NULL").select("path", "error")


def pypdf(content: bytes) -> list[tuple[int, str]]:
    from pypdf import PdfReader

    pages = ((i, page.extract_text() or "") for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    return [(i, t) for i, t in pages if t.strip()]


def pypdfium2(content: bytes) -> list[tuple[int, str]]:
    import pypdfium2 as pdfium

    pages = ((i, page.get_textpage().get_text_range()) for i, page in enumerate(pdfium.PdfDocument(content), 1))
    return [(i, t) for i, t in pages if t.strip()]


def liteparse(content: bytes) -> list[tuple[int, str]]:
    from liteparse import LiteParse

    pages = ((p.page_num, p.text) for p in LiteParse().parse(content).pages)
    return [(i, t) for i, t in pages if t.strip()]
