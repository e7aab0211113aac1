"""Written intermediate tables: lineage cuts that every executor and the driver can read.

Tables go below ``spark.checkpoint.dir``. Only a local session that names no folder (tests,
notebooks) gets one of its own; on a cluster the setting has to name shared storage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a local session without one gets a fresh one."""
    named = spark.conf.get(_SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def write_table(df: DataFrame, tag: str, compression: str = "zstd", by: str | None = None) -> str:
    """Write ``df`` as Parquet in the shared folder, in folders by a column if one is named, and return its path."""
    path = f"{shared_dir(df.sparkSession)}/lodestream/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def rows_written(spark: SparkSession, path: str) -> bool:
    """Whether a table in folders has any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(f.isDirectory() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage of ``df``: write it once and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag, compression))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written by this module."""
    if "/lodestream/" in path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(spark: SparkSession, df_or_path) -> None:
    """Remove a table written by this module once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else df_or_path.inputFiles()
    for root in {p.rpartition("/")[0] if p.endswith(".parquet") else p for p in paths}:
        drop_path(spark, root)


class Workspace:
    """The written tables of one run of an operator; at its end all go but those that its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        for _, path in self.paths:
            drop_path(self.spark, path)

    def table(self, df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
        """``df`` written and read back."""
        path = write_table(df, tag, compression)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((made, path))
        return made

    def keep(self, *made: DataFrame) -> None:
        """These tables stay when the run ends."""
        self.paths = [(df, path) for df, path in self.paths if not any(df is x for x in made)]

    def drop(self, *made: DataFrame) -> None:
        """These tables go now."""
        for df, path in self.paths:
            if any(df is x for x in made):
                drop_path(self.spark, path)
        self.keep(*made)
