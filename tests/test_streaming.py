"""The watch stream with state by file: replays, restarts, deletions; the folder source; shutdown."""

from __future__ import annotations

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import keyed, watch

GAP = 2000  # milliseconds
SCHEMA = "ts timestamp, path string, kind string, sha256 string"


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def settle_brute(events, until):
    """What events (ms, path, kind, sha256) in order of time lead to by the time ``until``."""
    out, last, burst = [], {}, {}
    for ms, path, kind, sha in sorted(events):
        for p, (s, start, end, n) in list(burst.items()):
            if p == path and ms >= end + GAP:
                if last.get(p) != s:
                    out.append((p, "changed", s, start, end, n))
                last[p] = s
                del burst[p]
        if kind == "deleted":
            out.append((path, "deleted", None, ms, ms, 1))
            last.pop(path, None)
            burst.pop(path, None)
        else:
            _, start, _, n = burst.get(path, (None, ms, None, 0))
            burst[path] = (sha, start, ms, n + 1)
    out += [(p, "changed", s, a, b, n) for p, (s, a, b, n) in burst.items() if b + GAP <= until and last.get(p) != s]
    return sorted(out, key=str)


def write_events(spark, rows, path):
    spark.createDataFrame([(at(ms), p, k, s) for ms, p, k, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, got, fail_at=None, delay="0 seconds"):
    """Run the stream over all files that are there, one a batch; changes go to ``got`` by batch."""

    def apply(rows, batch):
        if fail_at is not None and batch >= fail_at:
            raise RuntimeError("killed")
        got[batch] = [(r.path, r.kind, r.sha256, *(round((t - at(0)).total_seconds() * 1000) for t in (r.started, r.ended)), r.n_events) for r in rows.collect()]

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    out = keyed.settled(stream, gap="2 seconds", delay=delay)
    query = out.writeStream.foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        query.awaitTermination(100)
    except Exception as e:
        assert "killed" in str(e)


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_changes_survive_a_kill_in_the_middle(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(30_000), rng.choice("abcd"), rng.choices(["modified", "deleted"], [8, 1])[0], rng.choice("xyz")) for _ in range(160))
    rows = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]
    for k in range(0, len(rows), 60):
        write_events(spark, rows[k : k + 60], f"{tmp_path}/events")
    got = {}
    run(spark, tmp_path, got, fail_at=1)
    assert set(got) == {0}
    run(spark, tmp_path, got)  # goes on where the checkpoint ends
    assert sorted((r for batch in got.values() for r in batch), key=str) == settle_brute(rows, rows[-1][0])


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_late_and_superseded_events(spark, tmp_path):
    write_events(spark, [(10_000, "a", "modified", "new"), (9_000, "a", "modified", "old"), (2_000, "a", "modified", "older"), (10_000, "b", "deleted", None), (9_500, "b", "modified", "x")], f"{tmp_path}/events")
    time.sleep(1.1)
    write_events(spark, [(9_900, "b", "modified", "y"), (20_000, "c", "modified", "z")], f"{tmp_path}/events")
    got = {}
    run(spark, tmp_path, got, delay="5 seconds")
    assert sorted((r for batch in got.values() for r in batch), key=str) == [("a", "changed", "new", 9_000, 10_000, 2), ("a", "changed", "older", 2_000, 2_000, 1), ("b", "deleted", None, 10_000, 10_000, 1)]


def wait_for(condition, seconds=40):
    until = time.monotonic() + seconds
    while not condition() and time.monotonic() < until:
        time.sleep(0.2)
    assert condition()


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_folder_stream_goes_on_after_a_restart(spark, tmp_path):
    root = tmp_path / "in" / "docs"
    root.mkdir(parents=True)
    for name, body in {"a.txt": "one", "b.md": "two", "c.exe": "no", ".hidden.txt": "no"}.items():
        (root / name).write_text(body)
    (tmp_path / "outside.txt").write_text("not yours")
    (root / "link.txt").symlink_to(tmp_path / "outside.txt")
    got = []

    def start():
        events = keyed.folder_events(spark, f"file://{root}", f"file://{tmp_path}/listings", most=2)
        out = keyed.settled(events, gap="500 milliseconds", event_time=False)
        apply = lambda rows, batch: got.extend((r.path.rsplit("/", 1)[1], r.kind) for r in rows.collect())
        return out.writeStream.foreachBatch(apply).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()

    query = start()
    wait_for(lambda: sorted(got) == [("a.txt", "changed"), ("b.md", "changed")])
    (root / "a.txt").write_text("one more")
    wait_for(lambda: got.count(("a.txt", "changed")) == 2)
    assert watch.shut_down(query)
    got.clear()
    (root / "b.md").unlink()
    (root / "d.txt").write_text("new")
    os.utime(root / "a.txt")  # the same content
    query = start()
    wait_for(lambda: len(got) >= 2)
    time.sleep(2)
    watch.shut_down(query)
    assert sorted(got) == [("b.md", "deleted"), ("d.txt", "changed")]
    assert len(os.listdir(tmp_path / "listings")) <= 3


def test_folder_reader_replays_the_same_events(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    reader = keyed.FolderReader({"path": f"file://{root}", "listings": f"file://{tmp_path}/l", "most": 2})
    offset = reader.initialOffset()
    assert reader.read(offset)[1] == offset
    for name in "abc":
        (root / f"{name}.txt").write_text(name)
    events, first = reader.read(offset)
    events = list(events)
    assert [(e[1].rsplit("/", 1)[1], e[2]) for e in events] == [("a.txt", "created"), ("b.txt", "created")] and events[0][1].startswith("file:///")
    (root / "a.txt").unlink()
    assert list(reader.readBetweenOffsets(offset, first)) == events  # whatever the folder holds now
    more, second = reader.read(first)
    assert [(e[1].rsplit("/", 1)[1], e[2]) for e in more] == [("a.txt", "deleted"), ("c.txt", "created")]
    assert len(list(reader.readBetweenOffsets(offset, second))) == 4 and reader.read(second)[1] == second


def test_a_new_watcher_goes_on_where_the_last_one_ended(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "gone.txt").write_text("two")
    done = []
    note = lambda kind: lambda rows: done.extend((kind, r.path.rsplit("/", 1)[1]) for r in rows.collect())
    start = lambda: watch.Watcher(spark, str(root), watch.WatchSink(spark, f"file://{tmp_path}/state", note("up"), note("gone")))
    assert start().look() == 2
    (root / "b.txt").write_text("new")
    (root / "gone.txt").unlink()
    done.clear()
    watcher = start()
    assert watcher.look() == 2 and sorted(done) == [("gone", "gone.txt"), ("up", "b.txt")]
    assert start().look() == 0

    def fails(rows):
        raise ConnectionError("no server")

    (root / "b.txt").write_text("newer")
    with pytest.raises(ConnectionError):
        watch.Watcher(spark, str(root), watch.WatchSink(spark, f"file://{tmp_path}/state", fails, note("gone"))).look()
    done.clear()
    assert start().look() == 1 and done == [("up", "b.txt")] and start().look() == 0


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_shutdown_lets_the_batch_in_flight_end(spark, tmp_path):
    ended = []

    def slow(rows, batch):
        time.sleep(2)
        ended.append(batch)

    def start(name):
        return spark.readStream.format("rate").load().writeStream.foreachBatch(slow).option("checkpointLocation", f"{tmp_path}/{name}").start()

    query = start("a")
    wait_for(lambda: query.status["isTriggerActive"])
    assert watch.shut_down(query) and ended
    query = start("b")
    wait_for(lambda: query.status["isTriggerActive"])
    assert not watch.shut_down(query, forced=lambda: True)


def test_sink_keeps_every_file(spark, tmp_path):
    n, applied = 50_001, []
    rows = spark.range(n).select(F.col("id").cast("string").alias("path"), F.lit("modified").alias("kind"), F.lit("x").alias("sha256"), F.lit(0).alias("ended"))
    sink = watch.WatchSink(spark, f"file://{tmp_path}/state", lambda df: applied.append(df.count()), lambda df: None)
    sink(rows, 0)
    sink(rows, 1)  # all contents are known
    assert applied == [n, 0] and sink._state(2).count() == n
