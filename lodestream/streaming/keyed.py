"""The watch loop with state by file: a folder source, and changes settled by timers.

Spark's state store keeps each file's last content and its open burst, so a restarted query goes on
where its checkpoint ends. The folder source numbers its listings; an offset is a listing's number,
so the events between two offsets are the difference of two stored listings, the same at each
replay, and what went while the query was stopped is in the next difference.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestream.sources import files
from lodestream.streaming import watch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, kind string, sha256 string, started timestamp, ended timestamp, n_events long"
EVENTS = "ts timestamp, path string, kind string, size long, modified long"
#: How long an unchanged file's last content is kept; later the same content counts as new once.
KEEP = "30 days"


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


class Settle(StatefulProcessor):
    """A file's events become changes: a burst when it has been quiet for the gap and its content is new, a deletion at once.

    State is what was last handed on and when (``last``), and the open burst. Events older than
    either are superseded and have no effect.
    """

    def __init__(self, gap: int, keep: int, event_time: bool):
        self.gap, self.keep, self.event_time = gap, keep, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sha256 string, ended long")
        self.open = handle.getValueState("open", "sha256 string, started long, ended long, n long")

    def _settled(self, path: str, burst: tuple, last: tuple | None) -> tuple[list[tuple], tuple]:
        sha, started, ended, n = burst
        changed = last is None or last[0] != sha
        return ([(path, "changed", sha, started, ended, n)] if changed else []), (sha, ended)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            rows = pd.DataFrame(out, columns=["path", "kind", "sha256", "started", "ended", "n_events"])
            yield rows.assign(started=pd.to_datetime(rows["started"], unit="ms"), ended=pd.to_datetime(rows["ended"], unit="ms"))

    def _store(self, last: tuple | None, burst: tuple | None, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for state, value in ((self.last, last), (self.open, burst)):
            if value is None:
                state.clear()
            else:
                state.update(value)
        if burst is not None:
            self.handle.registerTimer((burst[2] if self.event_time else now) + self.gap)
        elif last is not None:
            self.handle.registerTimer((last[1] if self.event_time else now) + self.keep)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        last = self.last.get() if self.last.exists() else None
        burst = self.open.get() if self.open.exists() else None
        events = pd.concat(list(rows))
        events = sorted(zip((events["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), (events["kind"] == "deleted").tolist(), events["sha256"].tolist(), strict=True), key=lambda e: e[:2])
        out = []
        for ts, deleted, sha in events:
            if (last is not None and ts < last[1]) or (burst is not None and ts <= burst[1] - self.gap):
                continue
            if burst is not None and ts >= burst[2] + self.gap:
                more, last = self._settled(path, burst, last)
                out, burst = out + more, None
            if deleted and (burst is None or ts >= burst[2]):
                out.append((path, "deleted", None, ts, ts, 1))
                last, burst = (None, ts), None
            elif not deleted:
                old = burst or (sha, ts, ts, 0)
                burst = (sha if ts >= old[2] else old[0], min(old[1], ts), max(old[2], ts), old[3] + 1)
        self._store(last, burst, self._now(timerValues))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        out = []
        if self.open.exists():
            out, last = self._settled(key[0], self.open.get(), last)
            self._store(last, None, self._now(timerValues))
        else:
            self._store(None, None, 0)
        yield from self._rows(out)

    def close(self) -> None:
        pass


def settled(events: DataFrame, gap: str = watch.DEBOUNCE, delay: str | None = None, keep: str = KEEP, event_time: bool = True) -> DataFrame:
    """(path, kind, sha256, started, ended, n_events) of a stream of (ts, path, kind, sha256): what has to be applied.

    ``kind`` is changed or deleted. By event time, a burst is settled when the watermark, ``delay``
    behind the latest event, passes its last event and the gap; else when the gap has gone by on the clock.
    """
    events.sparkSession.conf.set(_PROVIDER, _ROCKSDB)  # the only store with timers by key
    rows = events.select("ts", "path", "kind", "sha256")
    if event_time:
        rows = rows.withWatermark("ts", delay or gap)
    return rows.groupBy("path").transformWithStateInPandas(Settle(_ms(gap), _ms(keep), event_time), CHANGES, "Append", "EventTime" if event_time else "ProcessingTime")


class Folder(DataSource):
    """Events of the files below ``path`` that ingestion reads; listings are kept below ``listings``, a folder of this stream's own.

    Options: path, listings, most (files that one batch hands on at most; the others follow in the next).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestream_folder"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


class FolderReader(SimpleDataSourceStreamReader):
    """Differences between numbered listings, {path: [size, modified in microseconds]}."""

    def __init__(self, options: dict):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(options["path"])
        self.store, self.folder = arrow_fs.FileSystem.from_uri(options["listings"])
        self.most = int(options.get("most", watch.FILES_A_LOOK))
        self.scheme = options["path"][: len(options["path"]) - len(self.root)] if options["path"].endswith(self.root) else ""

    def _stored(self, number: int) -> dict:
        with self.store.open_input_stream(f"{self.folder}/{number:012d}.json") as f:
            return json.loads(f.read())

    def _write(self, number: int, listing: dict) -> None:
        self.store.create_dir(self.folder, recursive=True)
        with self.store.open_output_stream(f"{self.folder}/{number:012d}.part") as f:
            f.write(json.dumps(listing).encode())
        self.store.move(f"{self.folder}/{number:012d}.part", f"{self.folder}/{number:012d}.json")

    def _seen(self) -> dict[str, list[int]]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path: [f.size, f.mtime_ns // 1000] for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "~$")) and f.base_name.endswith(tuple(files.SUPPORTED))}

    @staticmethod
    def _changed(before: dict, after: dict) -> list[str]:
        return sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))

    def initialOffset(self) -> dict:
        self._write(0, {"at": 0, "files": {}})
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["listing"]
        before, after = self._stored(number)["files"], self._seen()
        some = self._changed(before, after)[: self.most]
        if not some:
            return iter(()), start
        gone = {p for p in some if p not in after}
        now = {p: v for p, v in before.items() if p not in gone} | {p: after[p] for p in some if p in after}
        self._write(number + 1, {"at": time.time_ns() // 1000, "files": now})
        end = {"listing": number + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._events(start, end)))  # Spark sends it on as it is

    def _events(self, start: dict, end: dict) -> Iterator[tuple]:
        for number in range(start["listing"], end["listing"]):
            before, after = self._stored(number)["files"], self._stored(number + 1)
            at = pd.Timestamp(after["at"], unit="us", tz="UTC").to_pydatetime()
            for p in self._changed(before, after["files"]):
                size, modified = after["files"].get(p, (None, None))
                kind = "deleted" if size is None else "modified" if p in before else "created"
                yield at, self.scheme + p, kind, size, modified

    def commit(self, end: dict) -> None:
        """Listings that no replay needs any more go, but for the last two."""
        for f in self.store.get_file_info(arrow_fs.FileSelector(self.folder, allow_not_found=True)):
            if f.base_name.endswith(".json") and int(f.base_name[:-5]) < end["listing"] - 1:
                self.store.delete_file(f.path)


def with_hashes(events: DataFrame, root: str) -> DataFrame:
    """(ts, path, kind, sha256): events with the content's hash, read where the event lies; a file that is gone again counts as deleted.

    Files that a link leads out of ``root`` are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shas, kinds = [], []
            for path, kind in zip(rows["path"], rows["kind"], strict=True):
                sha = None
                if kind != "deleted":
                    try:
                        fs, place = arrow_fs.FileSystem.from_uri(path)
                        digest = hashlib.sha256()
                        with fs.open_input_stream(place) as f:
                            while part := f.read(1 << 20):
                                digest.update(part)
                        sha = digest.hexdigest()
                    except FileNotFoundError:
                        kind = "deleted"
                shas.append(sha)
                kinds.append(kind)
            yield pd.DataFrame({"ts": rows["ts"], "path": rows["path"], "kind": kinds, "sha256": shas})

    inside = events.where((F.col("kind") == "deleted") | watch.below(F.col("path"), root))
    return inside.select("ts", "path", "kind").mapInPandas(run, "ts timestamp, path string, kind string, sha256 string")


def folder_events(spark: SparkSession, root: str, listings: str, most: int = watch.FILES_A_LOOK) -> DataFrame:
    """The stream (ts, path, kind, sha256) of a folder; ``root`` and ``listings`` are URIs that Arrow's file systems read."""
    spark.dataSource.register(Folder)
    events = spark.readStream.format("lodestream_folder").option("path", root).option("listings", listings).option("most", most).load()
    return with_hashes(events, root)
