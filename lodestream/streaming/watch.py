"""The watch loop as Structured Streaming: file events are debounced, deduplicated by content and applied.

Events are (ts, path, kind, sha256), kind being created, modified or deleted. A file's events that
follow each other within the debounce gap are one change, settled by its last event.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestream.scratch import drop_table, materialize
from lodestream.sources import files

DEBOUNCE = "2 seconds"
#: Files that one look at a folder hands on at most; the others wait for the next one.
FILES_A_LOOK = 1000
#: Connection errors in a row from which on the log says that the model server may be gone.
MAX_ERRORS = 5
SHUTDOWN_SECONDS = 30

log = logging.getLogger(__name__)


def debounced(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(path, started, ended, n_events, kind, sha256), one row for each burst of a file's events.

    Streams need a watermark on ts. Batches and streams give the same rows once a burst is over.
    """
    burst = events.groupBy(F.session_window("ts", gap), "path").agg(F.count("*").alias("n_events"), F.max("ts").alias("last"), F.max_by("kind", "ts").alias("kind"), F.max_by("sha256", "ts").alias("sha256"))
    return burst.select("path", F.col("session_window.start").alias("started"), F.col("last").alias("ended"), "n_events", "kind", "sha256")


def content_changes(bursts: DataFrame) -> DataFrame:
    """Bursts that change a file's content: its hash differs from the burst before, or it goes.

    For batches; a deleted file's next burst always counts.
    """
    order = Window.partitionBy("path").orderBy("started")
    before = F.lag(F.when(F.col("kind") != "deleted", F.col("sha256"))).over(order)
    return bursts.withColumn("__before", before).where((F.col("kind") == "deleted") | ~F.col("sha256").eqNullSafe(F.col("__before"))).drop("__before")


class WatchSink:
    """Applies micro-batches of debounced changes: upserts first read the content, deletes remove it.

    The last hash of each file is a table of the sink, written as a new version by each batch; a
    batch that is delivered again finds its changes done and leaves everything as it is. With ``most``
    only so many files stay known, the ones changed longest ago going first; these count as new again.
    """

    def __init__(self, spark: SparkSession, state_path: str, upsert: Callable[[DataFrame], None], delete: Callable[[DataFrame], None], most: int | None = None):
        self.spark, self.path, self.upsert, self.delete = spark, state_path.rstrip("/"), upsert, delete
        self.errors = 0
        self.most = most

    def _written(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def last(self, before: int | None = None) -> int | None:
        """The last batch that is done, or done before another one."""
        return next((b for b in self._written() if (before is None or b < before) and self._exists(b)), None)

    def _state(self, before: int) -> DataFrame:
        known = self.last(before)
        return self.spark.createDataFrame([], "path string, sha256 string, changed bigint") if known is None else self.spark.read.parquet(f"{self.path}/{known:010d}")

    def _exists(self, batch: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch:010d}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def forget(self, batch: int) -> None:
        """A batch's tables go; only those of the last one are read again."""
        for name in (f"{batch:010d}", f"seen-{batch:010d}"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self._exists(batch):
            return
        latest = rows.groupBy("path").agg(F.max_by("kind", "ended").alias("kind"), F.max_by("sha256", "ended").alias("sha256"))
        known = self._state(batch)
        gone = latest.where("kind = 'deleted'").select("path")
        fresh = latest.where("kind <> 'deleted'").join(known, ["path", "sha256"], "left_anti").select("path", "sha256")
        try:
            self.delete(gone)
            self.upsert(fresh)
            self.errors = 0
        except ConnectionError:
            self.errors += 1
            log.log(logging.CRITICAL if self.errors >= MAX_ERRORS else logging.WARNING, "%d connection errors in a row", self.errors)
            raise
        except Exception:
            self.errors = 0
            raise
        changed = latest.select("path")
        now = latest.where("kind <> 'deleted'").select("path", "sha256", F.lit(batch).cast("bigint").alias("changed"))
        kept = known.join(changed, "path", "left_anti").unionByName(now)
        if self.most is not None:
            kept = kept.orderBy(F.desc("changed"), "path").limit(self.most)
        kept.write.mode("overwrite").parquet(f"{self.path}/{batch:010d}")


def watch(events: DataFrame, sink: WatchSink, checkpoint: str, gap: str = DEBOUNCE, delay: str | None = None, trigger: dict | None = None):
    """Start the loop on a stream of events; stop it with ``query.stop()``.

    A burst is settled once the watermark has passed its end: ``gap`` after its last event plus
    ``delay``, which is how late events may come and as long as the gap unless it is given.
    """
    bursts = debounced(events.withWatermark("ts", delay or gap), gap)
    writer = bursts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def shut_down(query, seconds: float = SHUTDOWN_SECONDS, forced: Callable[[], bool] = lambda: False) -> bool:
    """Stop a running loop: the batch in flight may end within the time, unless ``forced`` says so before; whether it did."""
    progress = lambda: p.batchId if (p := query.lastProgress) else None
    until, before, ended = time.monotonic() + seconds, progress(), False
    while not ended and time.monotonic() < until and not forced():
        ended = not query.isActive or not query.status["isTriggerActive"] or progress() != before
        time.sleep(0 if ended else 0.05)
    query.stop()
    return query.awaitTermination(seconds) is not False and ended


def run_until_signal(query, seconds: float = SHUTDOWN_SECONDS) -> bool:
    """Wait for the query's end; the first SIGINT or SIGTERM lets the batch in flight end, the second stops at once."""
    import signal

    seen: list[int] = []
    before = {s: signal.signal(s, lambda number, frame: seen.append(number)) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        while query.isActive and not seen:
            query.awaitTermination(0.2)
        return shut_down(query, seconds, lambda: len(seen) > 1) if seen else True
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def listing_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events from two listings (path, ts, sha256): the file source never reports deletions."""
    a, b = before.select("path", F.col("ts").alias("ts_a"), F.col("sha256").alias("sha_a")), after.select("path", F.col("ts").alias("ts_b"), F.col("sha256").alias("sha_b"))
    joined = a.join(b, "path", "full_outer")
    kind = F.when(F.col("ts_b").isNull(), "deleted").when(F.col("ts_a").isNull(), "created").when(~F.col("sha_a").eqNullSafe(F.col("sha_b")), "modified")
    return joined.withColumn("kind", kind).where("kind is not null").select(F.coalesce("ts_b", "ts_a").alias("ts"), "path", "kind", F.col("sha_b").alias("sha256"))


def below(path: Column, root: str) -> Column:
    """Whether a local path, its links followed, lies in ``root``; other file systems have no links."""
    base = os.path.realpath(root.removeprefix("file://").removeprefix("file:"))

    @F.pandas_udf("boolean")
    def inside(paths: pd.Series) -> pd.Series:
        local = paths.str.replace(r"^file:/+", "/", regex=True)
        return pd.Series([not p.startswith("/") or os.path.realpath(p).startswith(base + os.sep) for p in local], dtype=bool)

    return inside(path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, ts, sha256) of the files below ``root`` that ingestion reads and that no link leads out of it."""
    found = files.discover(spark, root)
    found = found.where(~files.ignored(F.col("path"))).where(below(F.col("path"), root))
    return files.content_hash(found).select("path", F.col("modified").alias("ts"), "sha256")


_SEEN = "path string, ts timestamp, size bigint, sha256 string"


class Watcher:
    """Looks at a folder again and again and hands what has changed to a sink, ``most`` files at a time.

    What was seen is a table beside the sink's, written before its batch and in force once that batch is
    done; batches are numbered on from the sink's last one. So a new watcher with the same sink goes on
    where the last one ended, whenever that was. Contents are hashed only where size or time differ.
    """

    def __init__(self, spark: SparkSession, root: str, sink: WatchSink, most: int = FILES_A_LOOK):
        self.spark, self.root, self.sink, self.most = spark, root, sink, most

    def _seen(self, batch: int | None) -> DataFrame:
        return self.spark.createDataFrame([], _SEEN) if batch is None else self.spark.read.schema(_SEEN).parquet(f"{self.sink.path}/seen-{batch:010d}")

    def look(self) -> int:
        """One look; the number of files whose changes were handed on."""
        last = self.sink.last()
        seen = self._seen(last)
        found = files.discover(self.spark, self.root)
        now = found.where(~files.ignored(F.col("path"))).where(below(F.col("path"), self.root)).select("path", F.col("modified").alias("ts_now"), F.col("size").alias("size_now"))
        both = seen.join(now, "path", "full_outer").where(~(F.col("ts").eqNullSafe(F.col("ts_now")) & F.col("size").eqNullSafe(F.col("size_now"))))
        some = materialize(both.orderBy(F.coalesce("ts_now", "ts"), "path").limit(self.most), "watch-events")
        number = some.count()
        if number:
            paths = [r.path for r in some.where("ts_now IS NOT NULL").select("path").collect()]  # no more than ``most``
            hashed = files.content_hash(self.spark.read.format("binaryFile").load(paths)).select("path", F.col("sha256").alias("sha_now")) if paths else self.spark.createDataFrame([], "path string, sha_now string")
            kind = F.when(F.col("ts_now").isNull(), "deleted").when(F.col("ts").isNull(), "created").otherwise("modified")
            changes = materialize(some.join(hashed, "path", "left").withColumn("kind", kind), "watch-changes")
            batch = 0 if last is None else last + 1
            kept = changes.where("kind <> 'deleted'").select("path", F.col("ts_now").alias("ts"), F.col("size_now").alias("size"), F.col("sha_now").alias("sha256"))
            seen.join(changes.select("path"), "path", "left_anti").unionByName(kept).write.mode("overwrite").parquet(f"{self.sink.path}/seen-{batch:010d}")
            self.sink(changes.select("path", "kind", F.col("sha_now").alias("sha256"), F.coalesce("ts_now", "ts").alias("ended")), batch)
            if last is not None:
                self.sink.forget(last)
            drop_table(self.spark, changes)
        drop_table(self.spark, some)
        return number

    def run(self, stopped: Callable[[], bool], seconds: float = 2.0) -> None:
        """Look until ``stopped`` says so; the look in flight ends first."""
        while not stopped():
            if not self.look():
                time.sleep(seconds)
