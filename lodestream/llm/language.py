"""Language proportions of whole texts by expectation-maximisation over n-gram likelihoods.

A language is a distribution over hashed byte trigrams of words. A text is a mixture: each of its
words comes from one language, whose probability for the word is the product over its trigrams.
Expectation-maximisation estimates the proportions of all languages; then languages are dropped,
smallest proportion first, as long as the penalised likelihood (half the logarithm of the number
of words for each free proportion) rises. The largest proportion names the text. For filters, a
uniform distribution over trigrams can stand among the languages: what it explains better than all
of them is in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestream.llm import kernel

#: Labelled documents of each language that are learnt from, in expectation; chosen by hash.
SAMPLE_PER_LANGUAGE = 5000
BUCKETS = 1 << 16
UNKNOWN = "und"
#: The part of a text that uniform trigrams explain from which on the text is in no language; short
#: texts with a key or a number among their words stay below it.
NO_LANGUAGE = 0.75

_U = np.uint64
#: a-z after lower-casing and every byte of a non-ASCII character.
_LETTER = kernel.byte_class(*range(97, 123), *range(128, 256))
_ASCII_LETTER = kernel.byte_class(*range(97, 123))


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words, with a space before and after each; word i has its length of them."""
    length = ends - starts
    first = np.cumsum(length + 2) - (length + 2)
    joined = np.full(int((length + 2).sum()), 32, np.uint8)
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(first + 1, length) + at] = data[np.repeat(starts, length) + at]
    code = joined.astype(np.uint32)
    gram = code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(16)
    return bucket[np.repeat(first, length) + at], length


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the trigrams in (lang, text) rows."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        raw, offsets = kernel.buffers(b.column(1))
        langs = b.column(0).to_pylist()
        for i, j in kernel.passes(offsets, kernel.SMALL_PASS):
            data = kernel.lower_ascii(raw[offsets[i] : offsets[j]])
            starts, ends, first = kernel.spans(data, offsets[i : j + 1] - offsets[i], _LETTER)
            for r in range(i, j):
                s, e = first[r - i], first[r - i + 1]
                if e > s:
                    bucket, _ = _trigrams(data, starts[s:e], ends[s:e])
                    if langs[r] not in counts:
                        counts[langs[r]] = np.zeros(BUCKETS, np.int64)
                    counts[langs[r]] += np.bincount(bucket, minlength=BUCKETS)
    for lang, n in counts.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used])], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    """Language names and the logarithm of each bucket's probability, a row a bucket."""

    names: list[str]
    logs: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
        """Learn from ``rows`` (id, lang, text): every document of a small language, else a hash sample."""
        rows = rows.where("lang is not null and text is not null")
        sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return cls([], np.zeros((BUCKETS, 0), np.float32))
        share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_language / n)))), F.col("lang"))
        unit = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
        counted = rows.where(unit < share).select("lang", "text").mapInArrow(kernel.tidied(_count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        table = counted.toArrow()  # as many rows as languages times buckets
        names = sorted(set(table.column("lang").to_pylist()))
        counts = np.zeros((BUCKETS, len(names)))
        which = np.array([names.index(x) for x in table.column("lang").to_pylist()], np.int64)
        counts[table.column("bucket").to_numpy(), which] = table.column("n").to_numpy()
        smooth = 0.1
        logs = np.log(counts + smooth) - np.log(counts.sum(axis=0) + smooth * BUCKETS)
        return cls(names, logs.astype(np.float32))


def _loglik_by_row(weighted: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *weighted.shape[1:])), np.cumsum(weighted, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _maximise(like: np.ndarray, row: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps, and the logarithm of each word's mixture summed by row."""
    n = np.maximum(np.diff(first), 1)[:, None]
    for _ in range(steps):
        part = like * share[row]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        fresh = (_loglik_by_row(part, first) / n).astype(np.float32)
        moved = np.abs(fresh - share).max() if len(share) else 0
        share = fresh
        if moved < 1e-3:
            break
    mixed = np.log(np.maximum((like * share[row]).sum(axis=1), 1e-30))
    return share, _loglik_by_row(mixed, first)


def mixtures(logs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of each row from its words' log-likelihoods; rows without words get zeros."""
    rows, names = len(first) - 1, logs.shape[1]
    like = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
    words = np.diff(first)
    share = np.full((rows, names), 1 / names, np.float32)
    share, fit = _maximise(like, np.repeat(np.arange(rows), words), first, share, 8)
    share[words == 0] = 0
    active = np.flatnonzero((words > 0) & ((share > 0).sum(axis=1) > 1))
    for turn in range(names):
        if not len(active):
            break
        # the first time all small proportions go at once, then the smallest one
        tried = share[active]
        if turn == 0:
            smallest = (tried < 0.1) & (tried < tried.max(axis=1, keepdims=True))
        else:
            smallest = np.zeros(tried.shape, bool)
            smallest[np.arange(len(active)), np.where(tried > 0, tried, 2).argmin(axis=1)] = True
        dropped = (smallest & (tried > 0)).sum(axis=1)
        tried = np.where(smallest, 0, tried)
        tried /= tried.sum(axis=1, keepdims=True)
        at = np.concatenate([[0], np.cumsum(words[active])])
        pick = np.repeat(first[active] - at[:-1], words[active]) + np.arange(at[-1])
        tried, new = _maximise(like[pick], np.repeat(np.arange(len(active)), words[active]), at, tried, 4)
        better = (new + dropped * 0.5 * np.log(np.maximum(words[active], 2)) >= fit[active]) & (dropped > 0)
        share[active[better]], fit[active[better]] = tried[better], new[better]
        go_on = better | (turn == 0)
        active = active[go_on & ((share[active] > 0).sum(axis=1) > 1)]
    return share


def _predict(model: LanguageModel, text_at: int, uniform: bool):
    given = [*model.names, UNKNOWN] if uniform else model.names
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kernel.SpanHash()
        for b in batches:
            texts = b.column(text_at)
            raw, offsets = kernel.buffers(texts)
            names, scores = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for i, j in kernel.passes(offsets, kernel.SMALL_PASS):
                if not model.names:
                    continue
                data, at = kernel.lower_ascii(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                starts, ends, first = kernel.spans(data, at, _LETTER)
                _, index, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
                bucket, length = _trigrams(data, starts[index], ends[index])
                sums = np.concatenate([np.zeros((1, len(model.names))), np.cumsum(model.logs[bucket], axis=0, dtype=np.float64)])
                stop = np.cumsum(length)
                logs = (sums[stop] - sums[stop - length]).astype(np.float32)
                if uniform:
                    logs = np.column_stack([logs, length * np.float32(-np.log(BUCKETS))])
                share = mixtures(logs[inverse], first)
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                lettered = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                for r in np.flatnonzero(~lettered):
                    lettered[r] = any(c.isalpha() for c in texts[i + int(r)].as_py() or "")
                best = share[:, : len(model.names)].argmax(axis=1)
                if uniform:
                    best[share[:, -1] >= NO_LANGUAGE] = len(model.names)
                names[i:j] = np.where(lettered, np.array(given, object)[best], UNKNOWN)
                scores[i:j] = np.where(lettered, np.clip(share[np.arange(j - i), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "__lang", "__score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", uniform: bool = False) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``: the language of the largest proportion, and that.

    Only the text is read. With ``uniform``, texts of which uniform trigrams explain ``NO_LANGUAGE``
    or more are ``und`` with that part as score. Defined results: null texts, texts without a letter and a model that has
    learnt nothing give ``und`` with 0; equal proportions give the first name in order; whole
    texts count however long; columns of the two new names are replaced, others pass through; an empty table gives an empty one.
    """
    docs = docs.drop("__lang", "__score")
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(kernel.tidied(_predict(model, docs.columns.index(text_col), uniform)), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_labelled(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """A model of the labelled documents that aren't held out."""
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return LanguageModel.fit(rows)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit_labelled(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
