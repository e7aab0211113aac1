"""Collections of chunks as versioned Parquet below one root folder.

Chunks are dealt over buckets by their source. A write makes new folders for the buckets it touches,
with the sparse index of each, and then one small version file that names the folders of all buckets,
so readers see the old version until the new one is whole, and other buckets stay as they are. The
version is the collection's generation; of two writers of one generation the second one fails.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestream.operators.retrieval import SparseIndex, build_index, unpacked, where_column

SCHEMA = "chunk_id string, text string, embedding array<float>, file_path string, file_name string, content_type string, category string, keywords string, header_path string, page_label string, extra map<string,string>"
_POSTINGS, _SIZES = "term string, id string, tf bigint, dl bigint", "n bigint, tokens bigint"
_PACKED = "term string, ids array<string>, tfs array<bigint>, dls array<bigint>"
#: Buckets of a collection, set when it is created.
BUCKETS = 64


class MissingCollection(KeyError):
    """No collection of that name."""


class DimensionMismatch(ValueError):
    """Vectors of another length than the collection's."""


class ConcurrentWrite(RuntimeError):
    """Another writer made this version first."""


def source_of(file_path: Column, file_name: Column) -> Column:
    """The file path, else the file name, else unknown; empty strings don't count."""
    return F.coalesce(F.nullif(file_path, F.lit("")), F.nullif(file_name, F.lit("")), F.lit("unknown"))


class Store:
    """Collections by name; paths may be on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs(path).listStatus(path)) if self._fs(path).exists(path) else []

    def _versions(self, name: str) -> list[str]:
        """Names of the version files, the newest first."""
        return sorted((f.getPath().getName() for f in self._children(f"{name}/versions")), reverse=True)

    def _read(self, name: str, version: str) -> dict | None:
        path = self._path(f"{name}/versions/{version}")
        stream = self._fs(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # its writer broke off
            return None
        finally:
            stream.close()

    def _latest(self, name: str) -> dict:
        for version in self._versions(name):
            if (state := self._read(name, version)) is not None:
                return state
        raise MissingCollection(name)

    def _commit(self, name: str, state: dict) -> None:
        taken = self._versions(name)
        number = int(taken[0]) + 1 if taken else 0
        if state.get("follows") is not None and state["follows"] != (taken[0] if taken else ""):
            raise ConcurrentWrite(name)
        path = self._path(f"{name}/versions/{number:012d}")
        try:
            stream = self._fs(path).create(path, False)
        except Py4JJavaError as e:
            raise ConcurrentWrite(name) from e
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()

    def _begin(self, name: str) -> dict:
        """The latest state, and the version file that a commit of it has to follow."""
        taken = self._versions(name)
        return self._latest(name) | {"follows": taken[0]}

    def create(self, name: str, metadata: dict[str, str] | None = None, buckets: int = BUCKETS) -> None:
        if not self.exists(name):
            self._commit(name, {"generation": 0, "dim": None, "buckets": buckets, "parts": {}, "metadata": metadata or {}, "follows": None})

    def exists(self, name: str) -> bool:
        try:
            return self._latest(name) is not None
        except MissingCollection:
            return False

    def names(self) -> list[str]:
        return sorted(n for n in (f.getPath().getName() for f in self._children("")) if self.exists(n))

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise MissingCollection(name)
        path = self._path(name)
        self._fs(path).delete(path, True)

    def metadata(self, name: str) -> dict[str, str]:
        return self._latest(name)["metadata"]

    def merge_metadata(self, name: str, values: dict[str, str]) -> None:
        state = self._begin(name)
        self._commit(name, state | {"metadata": state["metadata"] | values})

    def generation(self, name: str) -> int:
        return self._latest(name)["generation"] if self.exists(name) else 0

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("file_path", F.lit(""))), F.lit(buckets)).cast("int")

    def _folders(self, name: str, kind: str, only: set[int] | None = None) -> list[str]:
        parts = self._latest(name)["parts"] if self.exists(name) else {}
        return [f"{self.root}/{name}/data/{folder}/{kind}" + (f"/bucket={b}" if kind == "chunks" else "") for b, folder in parts.items() if only is None or int(b) in only]

    def _table(self, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def chunks(self, name: str) -> DataFrame:
        """All chunks; empty for a missing or new collection."""
        return self._table(SCHEMA, self._folders(name, "chunks"))

    def page(self, name: str, limit: int, offset: int = 0) -> DataFrame:
        """A page of the chunks in order of their ids."""
        return self.chunks(name).orderBy("chunk_id").offset(offset).limit(limit)

    def index(self, name: str) -> SparseIndex | None:
        """The sparse index that the writes have kept; None for an empty collection.

        A folder's postings may hold buckets that were written anew since; those chunks are left out.
        """
        state = self._latest(name) if self.exists(name) else {"parts": {}}
        if not state["parts"]:
            return None
        folders = {}
        for bucket, folder in state["parts"].items():
            folders.setdefault(folder, []).append(int(bucket))
        rows = sizes = None
        for folder, kept in folders.items():
            at = f"{self.root}/{name}/data/{folder}"
            packed = self._path(f"{name}/data/{folder}/packed")
            if self._fs(packed).exists(packed):
                part = unpacked(self.spark.read.schema(f"{_PACKED}, bucket int").parquet(f"{at}/packed").where(F.col("bucket").isin(*kept)).drop("bucket"))
            else:  # written before postings were packed
                part = self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{at}/postings").where(F.col("bucket").isin(*kept)).drop("bucket")
            size = self.spark.read.schema(f"{_SIZES}, bucket int").parquet(f"{at}/sizes").where(F.col("bucket").isin(*kept)).drop("bucket")
            rows, sizes = (part, size) if rows is None else (rows.unionByName(part), sizes.unionByName(size))
        return SparseIndex(rows, sizes)

    def _write(self, name: str, state: dict, rows: DataFrame, touched: set[int]) -> None:
        """``rows`` are all chunks of the touched buckets from now on."""
        folder = uuid.uuid4().hex
        at = f"{self.root}/{name}/data/{folder}"
        dealt = rows.withColumn("bucket", self._bucket(state["buckets"]))
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{at}/chunks")
        written = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{at}/chunks")
        build_index(written, at, by="bucket")
        held = {int(f.getPath().getName().partition("=")[2]) for f in self._children(f"{name}/data/{folder}/chunks") if "=" in f.getPath().getName()}
        parts = {b: f for b, f in state["parts"].items() if int(b) not in touched} | {str(b): folder for b in sorted(held)}
        self._commit(name, state | {"generation": state["generation"] + 1, "parts": parts})

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Replace the chunks of every source in ``rows`` and add the new ones; creates the collection.

        Only the buckets of these sources are read and written.
        """
        self.create(name)
        state = self._begin(name)
        dim = state["dim"]
        new = self.spark.createDataFrame([], SCHEMA).unionByName(rows, allowMissingColumns=True)
        length = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
        held = new.groupBy(self._bucket(state["buckets"]).alias("bucket")).agg(F.min(length).alias("least"), F.max(length).alias("most")).collect()  # as many as buckets
        sizes = sorted({d for r in held for d in (r["least"], r["most"]) if d is not None})
        if len(sizes) > 1 or dim is not None and sizes and sizes[0] != dim:
            raise DimensionMismatch(f"{name} has vectors of length {dim}, not {sizes}")
        touched = {r["bucket"] for r in held}
        old = self._table(SCHEMA, self._folders(name, "chunks", touched))
        self._write(name, state | {"dim": dim if dim is not None else sizes[0] if sizes else None}, replace_sources(old, new), touched)

    def delete(self, name: str, where: dict) -> int:
        """Remove the chunks that a filter matches and return their number; no version is made for none."""
        condition = where_column(where)
        if condition is None:
            raise ValueError("a filter is required")
        if not self.exists(name):
            raise MissingCollection(name)
        state = self._begin(name)
        hit = self.chunks(name).where(condition).groupBy(self._bucket(state["buckets"]).alias("bucket")).agg(F.count("*").alias("n")).collect()
        if hit:
            touched = {r["bucket"] for r in hit}
            old = self._table(SCHEMA, self._folders(name, "chunks", touched))
            self._write(name, state, old.where(~F.coalesce(condition, F.lit(False))), touched)
        return sum(r["n"] for r in hit)

    def vacuum(self, name: str, versions: int = 2, hours: float = 24) -> int:
        """Remove all but the newest version files, and folders older than ``hours`` that none of these names; the number of folders."""
        kept = self._versions(name)[:versions]
        named = {f for v in kept for f in (self._read(name, v) or {"parts": {}})["parts"].values()}
        for status in self._children(f"{name}/versions"):
            if status.getPath().getName() not in kept:
                self._fs(status.getPath()).delete(status.getPath(), False)
        old = [s.getPath() for s in self._children(f"{name}/data") if s.getPath().getName() not in named and s.getModificationTime() <= (time.time() - hours * 3600) * 1000]
        for path in old:
            self._fs(path).delete(path, True)
        return len(old)

    def count(self, name: str) -> int:
        return self.chunks(name).count()

    def count_where(self, name: str, where: dict) -> int:
        return self.chunks(name).where(where_column(where)).count() if self.exists(name) else 0

    def preview_delete(self, name: str, path: str | None = None, where: dict | None = None) -> int:
        """Chunks that deleting by path, by filter or of everything would remove."""
        if path is not None and where is not None:
            raise ValueError("either a path or a filter")
        if path is not None:
            where = {"file_path": path}
        return self.count_where(name, where) if where else self.count(name) if self.exists(name) else 0

    def statistics(self) -> DataFrame:
        """(collection, chunks, sources) of all collections."""
        out = None
        for name in self.names():
            part = collection_statistics(self.chunks(name).withColumn("collection", F.lit(name)))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "collection string, chunks bigint, sources bigint")


def replace_sources(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """``old`` without the sources that ``new`` holds, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def list_sources(chunks: DataFrame) -> DataFrame:
    """(source, chunks) by source."""
    return chunks.groupBy(source_of(F.col("file_path"), F.col("file_name")).alias("source")).agg(F.count("*").alias("chunks"))


def collection_statistics(chunks: DataFrame) -> DataFrame:
    """(collection, chunks, sources): sizes and exact distinct sources."""
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.countDistinct(source_of(F.col("file_path"), F.col("file_name"))).alias("sources"))


def sparse_coverage(chunks: DataFrame, flag: str = "has_sparse_vector") -> DataFrame:
    """One row: covered, total, and whether only a part is covered."""
    out = chunks.agg(F.count_if(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("covered"), F.count("*").alias("total"))
    return out.withColumn("partial", (F.col("covered") > 0) & (F.col("covered") < F.col("total")))
