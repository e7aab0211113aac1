"""Token ids as compressed binary files.

Texts are encoded with the tokenizers library, cut first at single spaces, where byte-level
pre-tokenisation always cuts; each worker keeps the ids of pieces met before. Ids are dealt into
shards by document id. Their counts over the whole corpus make the shared frequency table of at most
one entry a vocabulary id. A shard's documents then fill blocks in ascending order of their ids: a
block holds whole documents and everything needed to decode it but the table.

The container is Parquet, which executors can write wherever Spark can. Each row is a block: where
it was written, its shard and first document, ids in all, document ids, lengths, and its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestream.llm import kernel, rans
from lodestream.scratch import drop_table, materialize, shared_dir, write_table

#: Symbols from which a block is closed.
BLOCK = 1 << 18
#: Pieces that one worker process keeps at most, at about thirty bytes each.
CACHE_PIECES = 2_000_000
#: New pieces in one call's text, and documents counted at a time.
_TOGETHER, _ROWS = 200, 256
#: First bytes of white space characters but the space.
_BLANK_LEAD = kernel.byte_class(*range(9, 14), *range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Ids of whole texts as little-endian bytes of ``dtype``."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # an id's string starts with the mark of a space exactly where a piece starts
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(self.size)])
        self.units, self.table = kernel.SpaceUnits(), kernel.WordTable(self.dtype, CACHE_PIECES)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ' ' + piece for all pieces one after another, and their lengths; some hundred pieces a text."""
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        found = self._ids([" " + " ".join(g) for g in groups])
        flat = np.concatenate(found) if found else np.zeros(0, self.dtype)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) == len(pieces):
            return flat, np.diff(np.append(starts, len(flat)))
        found = self._ids([" " + p for p in pieces])
        return np.concatenate(found), np.array([len(x) for x in found])

    @staticmethod
    def _space_before_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows in which another white space character follows a space: they are cut elsewhere, too."""
        after = np.flatnonzero(data[:-1] == 0x20) + 1 if len(data) else np.zeros(0, np.int64)
        lead = after[_BLANK_LEAD[data[after]]]
        text = data.tobytes()
        found = [i for i in lead.tolist() if text[i : i + 3].decode("utf-8", "ignore")[:1].isspace()]
        rows = np.zeros(len(at) - 1, bool)
        rows[np.searchsorted(at, found, side="right") - 1] = True
        return rows

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts of one pass."""
        data, starts, ends, first, one, two, plain = self.units(raw, offsets)
        plain &= ~self._space_before_blank(data, offsets - offsets[0])
        heads = np.zeros(len(starts), bool)
        heads[first[:-1][plain]] = True
        one = np.where(heads, one ^ np.uint64(0x5CA1AB1E), one)

        def make(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            text = data.tobytes()
            spaced, alone = at[~heads[at]], at[heads[at]]
            pieces = [text[a:b].decode() for a, b in zip(starts[spaced].tolist(), ends[spaced].tolist(), strict=True)]
            flat, lengths = self._spaced(pieces)
            found = self._ids([text[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
            return np.concatenate([spaced, alone]), np.concatenate([flat, *found]), np.concatenate([lengths, [len(x) for x in found]]).astype(np.int64)

        values, stops = self.table.lookup(one, two, make)
        cuts = np.concatenate([[0], stops])[first].tolist()
        out = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(~plain & (np.diff(offsets) > 0)).tolist():
            out[i] = self._ids([raw[offsets[i] : offsets[i + 1]].tobytes().decode()])[0].tobytes()
        for i in np.flatnonzero(np.diff(offsets) == 0).tolist():
            out[i] = b""
        return out


@lru_cache(maxsize=2)
def encoder(file: str) -> ByteEncoder:
    """One encoder a worker process and file."""
    return ByteEncoder(file)


def _encode_rows(file: str, bounds: np.ndarray, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            shard = np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            raw, offsets = kernel.buffers(b.column(1))
            for i, j in kernel.passes(offsets):
                ids = [x + end for x in enc.encode(raw, offsets[i : j + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:j]), b.column(0).slice(i, j - i), kernel.binaries(ids)], names=["shard", "doc", "ids"])

    return run


def _count_ids(dtype: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                counts += np.bincount(np.frombuffer(b"".join(b.column(0).slice(i, _ROWS).to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["id", "n"])

    return run


_BLOCK_FIELDS = [("task", pa.int32()), ("number", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("block", pa.binary())]
_BLOCK_COLUMNS = "task int, number int, shard int, first bigint, n_tokens bigint, docs binary, lengths binary, block binary"
#: Stands for a null document id inside the files.
_NO_ID = -(1 << 63)


def _blocks(dtype: np.dtype, table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs = rans.FrequencyTable.from_bytes(table)
        task, number = TaskContext.get().partitionId(), 0
        at, docs, parts, held = None, [], [], 0

        def close() -> pa.RecordBatch:
            symbols = np.frombuffer(b"".join(parts), dtype)
            lengths = np.array([len(p) // dtype.itemsize for p in parts], "<i8")
            row = (task, number, at, docs[0], len(symbols), np.array(docs, "<i8").tobytes(), lengths.tobytes(), rans.encode(symbols, freqs))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, _BLOCK_FIELDS, strict=True)], names=[n for n, _ in _BLOCK_FIELDS])

        for b in batches:
            for shard, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if docs and (shard != at or held >= BLOCK):
                    yield close()
                    number, docs, parts, held = number + 1, [], [], 0
                at = shard
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // dtype.itemsize
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write the ids of all whole texts below ``path``: ``table`` (one row) and ``blocks``.

    Each text is followed by ``end_id``. The folders of ``blocks`` are ranges of ids in ascending order of
    their number, and so are the blocks in a folder's files. Defined results: a null or empty text is the end id alone;
    rows that repeat an id are written one after another; rows with a null id come before all
    others; an empty table writes no blocks; other columns play no part.
    """
    spark = docs.sparkSession
    file = tokenizer or default_tokenizer()
    enc = encoder(file)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID).cast("bigint")).alias("doc"), F.col(text_col).alias("text"))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc", [i / shards for i in range(1, shards)], 20 * shards).alias("q")).first()["q"] or []
    encoded = rows.mapInArrow(_encode_rows(file, np.unique(np.array(bounds, np.int64)), end_id), "shard int, doc bigint, ids binary")
    # shards are ranges of ids, and neighbouring ones lie in one partition
    laid = encoded.repartitionById(-(-shards // 4), F.floor(F.col("shard") / 4).cast("int")).sortWithinPartitions("shard", "doc")
    kept = write_table(laid, "token-ids")
    ids = spark.read.parquet(kept)
    counts = np.zeros(enc.size, np.int64)
    for id_, n in ids.select("ids").mapInArrow(_count_ids(enc.dtype, enc.size), "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():
        counts[id_] = n  # a row for each id of the vocabulary at most
    table = rans.FrequencyTable.of_counts(counts).to_bytes()
    spark.createDataFrame([(table, enc.dtype.str)], "freqs binary, dtype string").coalesce(1).write.parquet(f"{path}/table")
    # parts of a file keep its order, so each block holds consecutive documents of its shard
    ids.mapInArrow(_blocks(enc.dtype, table), _BLOCK_COLUMNS).write.partitionBy("shard").option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_table(spark, kept)


def _decode(table: bytes, each, names: list[str], types: list[pa.DataType]):
    """Rows (doc, start, *each(ids)) of every document of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs = rans.FrequencyTable.from_bytes(table)
        for b in batches:
            for docs, lengths, block, before in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                docs, ends = np.frombuffer(docs, "<i8"), np.cumsum(np.frombuffer(lengths, "<i8"))
                symbols, starts = rans.Block(block, freqs).symbols(), np.concatenate([[0], ends[:-1]])
                found = zip(*(each(symbols[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NO_ID), pa.array(starts + before), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=["doc_id", "start", *names])

    return run


def _read(spark: SparkSession, path: str, each, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    table = spark.read.parquet(f"{path}/table").first()["freqs"]  # as many entries as the vocabulary has ids
    blocks = spark.read.schema(_BLOCK_COLUMNS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # four rows a shuffle partition
    offsets = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("first", "task", "number")) - F.col("n_tokens")
    index = blocks.select("task", "number", "shard", inside.alias("inside")).join(F.broadcast(offsets), "shard")
    index = materialize(index.select("task", "number", (F.col("inside") + F.col("offset")).alias("before")), "token-index")
    rows = blocks.join(index, ["task", "number"]).select("docs", "lengths", "block", "before")
    return rows.mapInArrow(_decode(table, each, names, types), f"doc_id bigint, start bigint, {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files: start counts all ids of the documents before."""
    return _read(spark, path, lambda ids: (ids,), ["ids"], [pa.list_(pa.int32())], "ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' ids."""
    return _read(spark, path, lambda ids: (len(ids), rans.checksum(ids)), ["n_tokens", "ids_crc32"], [pa.int64(), pa.int64()], "n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lodestream/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)
