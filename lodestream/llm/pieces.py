"""Merge-type SentencePiece encoding by a prefix table.

For each prefix of a word there is exactly one token that its encoding ends with. The table stores
it: an automaton names the pieces that end at a place, and the right one is the piece that is
compatible with the last token of the prefix before it. Two tokens are compatible if encoding their
joined strings gives the two back, which undoing their merges decides without encoding. The ids come
from walking the table backwards. Time grows with the length of a word, whatever its merges.

No piece of a merge model trained on words has white space after another character, so words are
encoded apart; a cache of bounded size keeps the ids of words met before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestream.llm import kernel

#: Words that one worker process keeps at most, at about forty bytes each, and pairs of tokens.
CACHE_WORDS = 1_000_000
_PAIRS = 400_000
_MARK = "▁"
_MARK_BYTES = _MARK.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Encodes texts and passes of texts with one model."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = pb.ModelProto.FromString(blob)
        kinds, norm = pb.ModelProto.SentencePiece, model.normalizer_spec
        self.simple = (
            model.trainer_spec.model_type == pb.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
            and norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
            and all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
            and not any(_MARK in p.piece.lstrip(_MARK) for p in model.pieces)
        )
        if not self.simple:
            raise ValueError("the model isn't a merge model with byte fallback, identity normalisation and white space before words")
        self.end_id = self.library.eos_id()
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        pieces = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.ids = {piece: i for piece, i, _ in pieces}
        self.strings = {i: piece for piece, i, _ in pieces}
        ordered = sorted(pieces, key=lambda x: (-x[2], x[1]))
        self.rank = {i: r for r, (_, i, _) in enumerate(ordered)}
        self.known = {c for piece, _, _ in pieces for c in piece}
        self.split: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for piece, i, _ in pieces:
            if self._merges_to_itself(piece, i):
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        self.automaton = automaton
        self.compatible: dict[int, bool] = {}
        self.units, self.table = kernel.SpaceUnits(), kernel.WordTable(np.int32, CACHE_WORDS)
        width = len(str(len(model.pieces))) + 1
        self.decimals = np.array([f"{i} ".encode() for i in range(len(model.pieces))], f"S{width}").view(np.uint8).reshape(-1, width)

    def _merges_to_itself(self, piece: str, i: int) -> bool:
        """Merge the characters of a piece by rank; notes the two parts of its last merge."""
        parts = [self.ids.get(c) for c in piece]
        if None in parts:
            return False
        while len(parts) > 1:
            found = [(self.rank[j], k, j) for k in range(len(parts) - 1) if (j := self.ids.get(self.strings[parts[k]] + self.strings[parts[k + 1]])) is not None]
            if not found:
                return False
            _, k, j = min(found)
            if j == i:
                self.split[i] = (parts[k], parts[k + 1])
            parts[k : k + 2] = [j]
        return parts[0] == i

    def _fits(self, a: int, b: int) -> bool:
        """Whether encoding the joined strings of tokens a and b gives a and b.

        Merges are undone from the latest back, and at each state the two tokens at the border
        would have merged if their joined string were a piece of an earlier rank.
        """
        rank, ids, strings, split = self.rank, self.ids, self.strings, self.split
        limit, ties = len(rank), False  # the merge at the border must come before this one
        while True:
            joined = ids.get(strings[a] + strings[b])
            if joined is not None and (rank[joined] < limit or ties and rank[joined] == limit):
                return False
            left, right = split.get(a), split.get(b)
            if left is None and right is None:
                return True
            # of equal ranks the leftmost merges first, so the right one is undone first
            if right is None or left is not None and rank[a] > rank[b]:
                limit, ties, a = rank[a], False, left[1]
            else:
                limit, ties, b = rank[b], True, right[0]

    def _run(self, word: str) -> list[int]:
        """Ids of a string of known characters."""
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end] is not None:
                continue
            start = end - length
            if start:
                before = last[start]
                if before is None:
                    continue
                pair = before << 20 | token
                fits = compatible.get(pair)
                if fits is None:
                    if len(compatible) >= _PAIRS:
                        compatible.clear()
                    fits = compatible[pair] = self._fits(before, token)
                if not fits:
                    continue
            last[end] = token
        ids, at = [], n
        while at:
            token = last[at]
            ids.append(token)
            at -= len(self.strings[token])
        return ids[::-1]

    def word_ids(self, word: str) -> list[int]:
        if self.known.issuperset(word):
            return self._run(word)
        ids, start = [], 0
        for i, c in enumerate(word):
            if c not in self.known:
                if start < i:
                    ids += self._run(word[start:i])
                ids += [self.byte_ids[x] for x in c.encode()]
                start = i + 1
        return ids + (self._run(word[start:]) if start < len(word) else [])

    _words = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, word by word, and the end id."""
        if not text:
            return [self.end_id]
        words = self._words.findall(_MARK + text.replace(" ", _MARK))
        return [i for w in words for i in self.word_ids(w)] + [self.end_id]

    def encode_pass(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts of one pass, without end ids; new words are encoded once."""
        data, starts, ends, first, one, two, plain = self.units(raw, offsets)
        text = data.tobytes()
        if _MARK_BYTES in text:
            marked = [m.start() for m in re.finditer(_MARK_BYTES, text)]
            plain[np.searchsorted(offsets - offsets[0], marked, side="right") - 1] = False

        def make(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = [self.word_ids(_MARK + text[a:b].decode()) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            return at, np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

        values, stops = self.table.lookup(one, two, make)
        cuts = np.concatenate([[0], stops])[first].tolist()
        out = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = np.array(self.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode())[:-1], np.int32)
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """Each id in decimal and a space."""
        out = self.decimals[ids].ravel()
        return out[out != 0].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    """One encoder a worker process and model."""
    return PieceEncoder(model_file)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text, ended by the end id, in ``ids_col``.

    Defined results: a null or empty text has the end id alone; long texts are encoded whole;
    repeated rows each get their ids; an existing column ``ids_col`` is replaced and all others
    pass through; an empty table gives an empty one.
    """
    model_file = model_file or default_model()
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            raw, offsets = kernel.buffers(b.column(at))
            end = np.array([enc.end_id], np.int32)
            ids = [np.concatenate([x, end]) for i, j in kernel.passes(offsets) for x in enc.encode_pass(raw, offsets[i : j + 1])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_file: str | None = None) -> DataFrame:
    """``rows`` with the text that each list of ids stands for; null lists give empty texts."""
    model_file = model_file or default_model()
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            texts = [enc.decode(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def digest(docs: DataFrame, model_file: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, from one encoding and decoding; then the columns ``keep``."""
    model_file = model_file or default_model()
    made = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema = T.StructType([*made.fields, *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            raw, offsets = kernel.buffers(b.column(1))
            end = str(enc.end_id).encode()
            for i, j in kernel.passes(offsets):
                n, hashes, decoded = [], [], []
                for ids in enc.encode_pass(raw, offsets[i : j + 1]):
                    n.append(len(ids) + 1)
                    hashes.append(hashlib.sha256(enc.decimal(ids) + end).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode([*ids.tolist(), enc.end_id]).encode()).hexdigest())
                kept = [c.slice(i, j - i) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), *kept], names=schema.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
