"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each text becomes the set of its word shingles' 64-bit hashes; the k smallest are its sketch.
   Texts with the same set are one class, and the smallest id of a class stands for it.
2. Inverted lists: a class is listed under retained values. A small set is listed under each
   value, a larger one under pairs of neighbouring retained values, which unrelated texts with a
   common phrase seldom share. Two sets with Jaccard 0.8 share tens of such lists. Lists are laid
   out by range over (key, id), so one that a large part of the corpus is in spreads over several
   partitions. A list of up to ``SHORT_LIST`` classes gives all its pairs; from a longer one each
   member meets the list's first member and, in one of four lists, a member drawn anew for each
   list, so pairs grow in proportion to the members and a group is tied together through dozens
   of different lists.
3. The union of two sketches estimates the Jaccard similarity and filters the pairs.
4. Full sets decide. First each text meets its best partner; then, of the remaining pairs, only
   those whose ends are not yet connected, as no other link can change a component.
5. Then the long lists are searched in whole, and so are lists whose rows lie in several partitions:
   all their members that are not connected with each other meet, in parts of two blocks. Two texts
   in several common lists meet only in the one with the smallest key. The sketches tell which members
   of a part may link at all; only these get their texts, and the part compares their full sets where
   they lie and gives out a spanning forest of the links it finds. Blocks are dealt by component, and
   blocks of one component don't meet, so rows stay in proportion to the members where nearly all are
   connected; they grow with the square of a list only where its members stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestream.llm import kernel
from lodestream.llm.components import connected_components
from lodestream.scratch import Workspace, drop_table

SKETCH = 64
#: Sets up to this size are listed under single values, sets from ``PAIR_FROM`` under pairs. The
#: ranges overlap by more than the ratio of sizes that the threshold allows.
SINGLE_UP_TO, PAIR_FROM = 32, 20
#: From this size on, half of the neighbouring pairs do, chosen by hash.
THIN_FROM = 128
SHORT_LIST = 32
#: Members of a long list that meet in one task, on each side, and the values of all their sets.
BLOCK, BLOCK_VALUES = 2048, 1 << 21
#: Values, and pairs of texts, that a part is compared by at once.
VALUES, PAIRS = 4096, 16384
#: Seconds that comparing two sets takes, for each pair and for each value; and a multiplication and addition in a matrix product.
PAIR_COST, VALUE_COST, PRODUCT_COST = 2e-5, 3e-8, 1e-10
#: Standard deviations of the estimate that the filter stays below the threshold.
SLACK = 4

_U = np.uint64
_PAD = _U(0xFFFFFFFFFFFFFFFF)


class ShingleSets:
    """The distinct shingle hashes of each row, sorted; fewer words than a shingle are one."""

    def __init__(self, shingle: int):
        self.shingle, self.words = shingle, kernel.Words(~kernel.SPACE)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words, first = self.words(raw, offsets)
        grams = kernel.grams(words, self.shingle)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= self.shingle:
                yield np.unique(grams[s : e - self.shingle + 1])
            elif e > s:
                yield kernel.grams(words[s:e], e - s)
            else:
                yield grams[:0]


def sets_of(column: pa.Array, shingle: int) -> list[np.ndarray]:
    raw, offsets = kernel.buffers(column)
    make = ShingleSets(shingle)
    return [x for i, j in kernel.passes(offsets, kernel.SMALL_PASS) for x in make(raw, offsets[i : j + 1])]


def _sketches(shingle: int):
    names = ["doc", "n", "fp1", "fp2", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ShingleSets(shingle)
        for b in batches:
            raw, offsets = kernel.buffers(b.column(1))
            for i, j in kernel.passes(offsets, kernel.SMALL_PASS):
                n, one, two, sketch = [], [], [], []
                with np.errstate(over="ignore"):
                    for values in make(raw, offsets[i : j + 1]):
                        n.append(len(values))
                        one.append(values.sum(dtype=_U))
                        two.append(kernel.mix(values ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U))
                        sketch.append(values[:SKETCH].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(one, _U).view(np.int64)), pa.array(np.array(two, _U).view(np.int64)), kernel.binaries(sketch)], names)

    return run


def list_keys(values: np.ndarray, n: int) -> np.ndarray:
    """The inverted lists that a set of ``n`` values with the sketch ``values`` is in."""
    keys = []
    with np.errstate(over="ignore"):
        if n <= SINGLE_UP_TO:
            keys.append(kernel.mix(values ^ _U(0x51)))
        if n >= PAIR_FROM:
            pairs = kernel.mix(values[:-1] * _U(0x9E3779B97F4A7C15) + values[1:])
            keys.append(pairs[(values[:-1] & _U(32)) == 0] if n >= THIN_FROM else pairs)
    return np.concatenate(keys) if keys else values[:0]


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n").to_numpy()
        keys = [list_keys(np.frombuffer(x, _U), int(m)) for x, m in zip(b.column("sketch").to_pylist(), n, strict=True)]
        counts = [len(x) for x in keys]
        flat = np.concatenate(keys) if keys else np.zeros(0, _U)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), counts)), pa.array(np.repeat(n, counts))], ["key", "rep", "n"])


def _pairs_of_lists(percent: int):
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def close(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; a long list that goes on in the next batch is tied by its first member, a short one is carried over in whole. First members tie the parts of a list in several partitions."""
        head: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of the list that the last batch ended in
        opened = False
        for b in batches:
            if not b.num_rows:
                continue
            key, rep, n = (c.to_numpy() for c in b.columns)
            if head is not None and head[0][0] == key[0]:
                key, rep, n = (np.concatenate(x) for x in zip(head, (key, rep, n), strict=True))
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            size = ends - starts
            out_a, out_b = [], []
            for m in range(2, SHORT_LIST + 1):  # all lists of one length at once
                at = starts[size == m]
                if len(at):
                    x, y = np.triu_indices(m, 1)
                    out_a.append((at[:, None] + x).ravel())
                    out_b.append((at[:, None] + y).ravel())
            for s, e in zip(starts[size > SHORT_LIST].tolist(), ends[size > SHORT_LIST].tolist(), strict=True):
                members = np.arange(s + 1, e)
                out_a.append(np.full(e - s - 1, s))
                out_b.append(members)
                drawn = s + int(kernel.mix(key[s : s + 1].view(_U))[0] % _U(e - s))
                some = members[(kernel.mix(rep[members].view(_U) ^ key[s : s + 1].view(_U)) & _U(3)) == 0]
                out_a.append(np.full(len(some), drawn))
                out_b.append(some)
            first, second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
            keep = close(n, first, second) & (rep[first] != rep[second])
            a, z = rep[first[keep]], rep[second[keep]]
            pairs = np.unique(np.stack([np.minimum(a, z), np.maximum(a, z)], axis=1), axis=0)
            yield kernel.batch({"key": pa.nulls(len(pairs), pa.int64()), "a": pairs[:, 0], "b": pairs[:, 1]}, schema)
            if not opened:
                yield kernel.batch({"key": key[:1], "a": rep[:1], "b": n[:1]}, schema)
                opened = True
            last = slice(int(starts[-1]), None if size[-1] <= SHORT_LIST else int(starts[-1]) + 1)
            head = (key[last], rep[last], n[last])
        if head is not None:
            yield kernel.batch({"key": head[0][:1], "a": head[1][:1], "b": head[2][:1]}, schema)

    return run


def jaccard_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common values among the k smallest of each row's union; rows padded with the largest value."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    new = ~same & (both != _PAD)
    within = np.cumsum(new, axis=1) <= SKETCH
    return (same & within).sum(axis=1) / np.maximum((new & within).sum(axis=1), 1)


def _padded(sketches: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sketches), SKETCH), _PAD)
    for row, x in zip(out, sketches, strict=True):
        row[: len(x)] = x
    return out


def _sketch_column(column: pa.Array) -> np.ndarray:
    return _padded([np.frombuffer(x, _U) for x in column.to_pylist()])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(jaccard_estimates(_sketch_column(part.column("sketch_a")), _sketch_column(part.column("sketch_b"))))], ["a", "b", "estimate"])


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for k, (x, y) in enumerate(zip(sets_of(part.column("text_a"), shingle), sets_of(part.column("text_b"), shingle), strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(kernel.tidied(_verify(shingle, percent)), "a bigint, b bigint")


def _least(percent: int) -> float:
    """The estimate from which a pair is kept."""
    share = percent / 100
    return share - SLACK * (share * (1 - share) / SKETCH) ** 0.5


def candidate_pairs(rows: DataFrame, reps: DataFrame, percent: int, made: Workspace) -> tuple[DataFrame, DataFrame]:
    """(a, b, estimate) of the pairs that lists and sketches leave, and the keys of lists in several partitions; rows is the lists, reps has rep and sketch."""
    laid = rows.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    found = made.table(laid.mapInArrow(kernel.tidied(_pairs_of_lists(percent)), "key bigint, a bigint, b bigint"), "nd-found")
    # the first members of the parts of a list that lies in several partitions meet the very first
    parts = found.where("key is not null").select("key", F.col("a").alias("b"), F.col("b").alias("n")).distinct()
    firsts = made.table(parts.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("parts")).where("parts > 1"), "nd-split")
    tied = parts.join(firsts, "key").where("a <> b").select("a", "b")
    pairs = made.table(found.where("key is null").select("a", "b").unionByName(tied).distinct(), "nd-pairs")
    made.drop(found)
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    used = made.table(reps.select("rep", "sketch").join(ids, "rep", "left_semi"), "nd-used", "lz4")
    joined = pairs.join(used.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(used.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    out = made.table(joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(kernel.tidied(_estimate), "a bigint, b bigint, estimate double").where(F.col("estimate") >= _least(percent)), "nd-candidates")
    made.drop(used, pairs)
    return out, firsts.select("key")


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many values each set of ``a`` has in common with each set of ``b``, or of ``a``."""
    sides = [a] if b is None else [a, b]
    flat = np.concatenate([x for side in sides for x in side])
    _, slot, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1)
    slot = np.where(seen > 1, shared - 1, -1)[slot]
    out = np.zeros((len(a), len(sides[-1])), np.float32)
    entries, at = [], 0
    for side in sides:
        sizes = [len(x) for x in side]
        row, mine = np.repeat(np.arange(len(side)), sizes), slot[at : at + sum(sizes)]
        order = np.argsort(mine, kind="stable")
        entries.append((len(side), row[order], mine[order]))
        at += sum(sizes)
    for i in range(0, int(shared[-1]) if len(shared) else 0, VALUES):
        dense = []
        for n, row, mine in entries:
            s, e = np.searchsorted(mine, (i, i + VALUES))
            some = np.zeros((n, VALUES), np.float32)
            some[row[s:e], mine[s:e] - i] = 1
            dense.append(some)
        out += dense[0] @ dense[-1].T
    return out


class Part:
    """Two blocks of a list's members, or one with itself: ids, labels and sorted sets of each side."""

    def __init__(self, key: int, low: list[tuple], high: list[tuple] | None, percent: int):
        """Rows are (id, label, size of the set, its smallest values or all of them)."""
        self.key, self.one, self.percent = key, high is None, percent
        self.sides = [low] if high is None else [low, high]
        self.ids, self.labels, self.n = ([np.array([r[i] for r in side], np.int64) for side in self.sides] for i in range(3))

    def near(self) -> np.ndarray:
        """Which pairs of the two sides sketches can't rule out and have this as their first common list."""
        (n, m), (labels, others) = ((x[0], x[-1]) for x in (self.n, self.labels))
        near = (labels[:, None] != others) & (100 * np.minimum(n[:, None], m) >= self.percent * np.maximum(n[:, None], m))
        if self.one:
            near &= np.tri(len(n), k=-1, dtype=bool)
        if not near.any():
            return near
        sketches = [[r[3][:SKETCH] for r in side] for side in self.sides]
        # an estimate has the common values above and at least the larger sketch below
        least = _least(self.percent)
        near &= common_counts(*sketches) >= least * np.minimum(np.maximum(n[:, None], m), SKETCH) - 1e-3
        if near.any():
            lists = [[np.unique(k[k.view(np.int64) < self.key]) for k in (list_keys(x, int(size)) for x, size in zip(some, sizes, strict=True))] for some, sizes in zip(sketches, self.n, strict=True)]
            near &= common_counts(*lists) == 0
        rows = [_padded(x) for x in sketches]
        first, second = np.nonzero(near)
        for i in range(0, len(first), PAIRS):
            x, y = first[i : i + PAIRS], second[i : i + PAIRS]
            near[x, y] = jaccard_estimates(rows[0][x], rows[-1][y]) >= least
        return near

    def linked(self, near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Row by row, a test of which of the near members link."""
        low, high = ([r[3] for r in side] for side in (self.sides[0], self.sides[-1]))
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        values = self.n[0][rows].sum() + self.n[-1][columns].sum()
        pairs = int(near.sum())
        common = None
        if pairs * (PAIR_COST + VALUE_COST * values / (len(rows) + len(columns))) > PRODUCT_COST * len(rows) * len(columns) * values:
            common = common_counts([low[i] for i in rows], [high[i] for i in columns])
            place = np.searchsorted(columns, np.arange(len(high)))
        for k, x in enumerate(rows.tolist()):

            def test(some: np.ndarray, k=k, x=x) -> np.ndarray:
                if common is None:
                    met = np.array([len(np.intersect1d(low[x], high[y], assume_unique=True)) for y in some.tolist()], np.int64)
                else:
                    met = common[k, place[some]].astype(np.int64)
                return (met > 0) & (100 * met >= self.percent * (self.n[0][x] + self.n[-1][some] - met))

            yield x, test

    def forest(self) -> list[tuple[int, int]]:
        """Links that connect what the part's links connect, beyond the labels."""
        near = self.near()
        if not near.any():
            return []
        _, tree = np.unique(np.concatenate(self.labels), return_inverse=True)
        at = 0 if self.one else len(self.ids[0])
        out = []
        for x, test in self.linked(near):
            left = np.flatnonzero(near[x])
            while len(left := left[tree[at + left] != tree[x]]):
                some = left[:64]
                good = some[test(some)]
                for y in good.tolist():
                    if tree[at + y] != tree[x]:
                        out.append((int(self.ids[0][x]), int(self.ids[-1][y])))
                        tree[tree == tree[at + y]] = tree[x]
                left = left[len(some) :]
        return out


def _parts(batches: Iterator[tuple], percent: int) -> Iterator[tuple[tuple, Part]]:
    """Parts of batches of columns key, low, high, lower, and a member's rows, sorted by the first three; lower tells the side."""
    at, sides = None, {True: [], False: []}

    def part() -> Iterator[tuple[tuple, Part]]:
        if at is not None and sides[True] and (at[1] == at[2] or sides[False]):
            yield at, Part(at[0], sides[True], None if at[1] == at[2] else sides[False], percent)

    for columns in batches:
        for key, low, high, lower, *row in zip(*columns, strict=True):
            if (key, low, high) != at:
                yield from part()
                at, sides = (key, low, high), {True: [], False: []}
            sides[lower].append(row)
    yield from part()


def _suspects(percent: int):
    names = ["key", "low", "high", "lower", "rep", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each part that may link; rows (key, low, high, lower, rep, label, n, sketch)."""
        columns = ([*(c.to_pylist() for c in b.columns[:7]), [np.frombuffer(x, _U) for x in b.column(7).to_pylist()]] for b in batches)
        for (key, low, high), part in _parts(columns, percent):
            near = part.near()
            if near.any():
                ends = [near.any(axis=1) | near.any(axis=0)] if part.one else [near.any(axis=1), near.any(axis=0)]
                ids = np.concatenate([x[e] for x, e in zip(part.ids, ends, strict=True)])
                labels = np.concatenate([x[e] for x, e in zip(part.labels, ends, strict=True)])
                lower = np.repeat([True, False], [int(ends[0].sum()), len(ids) - int(ends[0].sum())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key, np.int64)), pa.array(np.full(len(ids), low, np.int32)), pa.array(np.full(len(ids), high, np.int32)), pa.array(lower), pa.array(ids), pa.array(labels)], names)

    return run


def _forests(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning forests of the links in each part; rows (key, low, high, lower, rep, label, text)."""

        def columns() -> Iterator[list]:
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    rows = b.slice(i, 1024)
                    sets = sets_of(rows.column(6), shingle)
                    yield [*(c.to_pylist() for c in rows.columns[:6]), [len(x) for x in sets], sets]

        for _, part in _parts(columns(), percent):
            links = part.forest()
            if links:
                a, b = (pa.array(x, pa.int64()) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def long_lists(rows: DataFrame, split: DataFrame, made: Workspace, done: DataFrame | None = None) -> DataFrame:
    """(key, rep, n) of the lists that don't give all their pairs: those of more than SHORT_LIST, and those in several partitions.

    A list whose members ``done`` (node, component) connects has nothing left to find and is left out.
    """
    known = rows.withColumn("label", F.col("rep"))
    if done is not None:
        label = done.select(F.col("node").alias("rep"), "component")
        known = made.table(rows.join(label, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label")), "nd-labels", "lz4")
    lists = known.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other")
    keys = lists.join(split.withColumn("split", F.lit(True)), "key", "left").where((F.col("size") > SHORT_LIST) | F.col("split"))
    out = made.table(known.join(made.table(keys.select("key"), "nd-long"), "key", "left_semi").select("key", "rep", "n"), "nd-in-long")
    if done is not None:
        made.drop(known)
    return out


def in_parts(known: DataFrame, made: Workspace) -> DataFrame:
    """(key, rep, n, label, own, others) of the members of lists with more than one label: their block, and the blocks that it has to meet.

    A label with half a block of members or more has blocks of its own, and blocks of one label don't
    meet; members of small labels share blocks, which meet all. So a list of which all but a few members
    are connected is sent once or twice, and one of two large components is sent once for each block of
    the other one. Only a list whose members stay apart meets in all pairs of blocks.
    """
    weight = F.greatest(F.col("members") / BLOCK, F.col("values") / BLOCK_VALUES)
    groups = known.groupBy("key", "label").agg(F.count("*").alias("members"), F.sum("n").alias("values"))
    groups = made.table(groups.withColumn("blocks", F.when(weight > 0.5, F.ceil(weight)).otherwise(0).cast("int")), "nd-groups")
    small = lambda c: F.coalesce(F.sum(F.when(F.col("blocks") == 0, F.col(c))), F.lit(0))
    shared = F.ceil(F.greatest(small("members") / BLOCK, small("values") / BLOCK_VALUES)).cast("int")
    sizes = groups.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.sum("blocks").cast("int").alias("pure"), shared.alias("shared")).where("one <> other")
    sizes = made.table(sizes.select("key", "pure", "shared"), "nd-sizes")
    before = F.sum("blocks").over(Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))  # a row for half a block of members at least
    large = made.table(groups.where("blocks > 0").join(sizes.select("key"), "key", "left_semi").select("key", "label", "blocks", F.coalesce(before, F.lit(0)).cast("int").alias("start")), "nd-large")
    dealt = known.join(sizes, "key").join(large, ["key", "label"], "left")
    place = lambda n: F.pmod(F.xxhash64("rep", "key"), n).cast("int")
    own = F.when(F.col("blocks").isNotNull(), F.col("start") + place(F.col("blocks"))).otherwise(F.col("pure") + place(F.greatest("shared", F.lit(1))))
    every = F.sequence(F.lit(0), F.col("pure") + F.col("shared") - 1)
    others = F.when(F.col("blocks").isNull(), every).otherwise(F.filter(every, lambda x: (x < F.col("start")) | (x >= F.col("start") + F.col("blocks"))))
    return dealt.select("key", "rep", "n", "label", own.alias("own"), others.alias("others"))


def search_long_lists(in_long: DataFrame, reps: DataFrame, texts: DataFrame, done: DataFrame, shingle: int, percent: int, made: Workspace) -> DataFrame:
    """(a, b): links that, with those known, connect whatever links of members of a long list connect.

    ``done`` has the components known so far (node, component), ``texts`` (id, text) of all members at
    least; those that sketches rule out aren't fetched.
    """
    label = done.select(F.col("node").alias("rep"), "component")
    known = made.table(in_long.join(label, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label")), "nd-labels")
    dealt = in_parts(known, made)
    with_sketch = made.table(dealt.join(reps.select("rep", "sketch"), "rep"), "nd-dealt", "lz4")
    met = with_sketch.withColumn("other", F.explode("others"))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("lower"), "rep", "label", "n", "sketch")
    laid = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    suspects = made.table(laid.mapInArrow(kernel.tidied(_suspects(percent)), "key bigint, low int, high int, lower boolean, rep bigint, label bigint"), "nd-suspects")
    made.drop(known, with_sketch)
    ids = made.table(suspects.select(F.col("rep").alias("id")).distinct(), "nd-suspect-ids")
    texts = made.table(texts.join(ids, "id", "left_semi"), "nd-suspect-texts")
    compared = suspects.join(texts.withColumnRenamed("id", "rep"), "rep").select("key", "low", "high", "lower", "rep", "label", "text")
    laid = compared.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return made.table(laid.mapInArrow(kernel.tidied(_forests(shingle, percent)), "a bigint, b bigint"), "nd-forests")


def _verified(pairs: DataFrame, texts: DataFrame, done: DataFrame | None, shingle: int, percent: int, made: Workspace) -> DataFrame:
    """The links among those pairs whose ends ``done`` doesn't connect."""
    if done is not None:
        comp_a = done.select(F.col("node").alias("a"), F.col("component").alias("comp_a"))
        comp_b = done.select(F.col("node").alias("b"), F.col("component").alias("comp_b"))
        pairs = pairs.join(comp_a, "a", "left").join(comp_b, "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
        pairs = made.table(pairs.select("a", "b"), "nd-rest")
    return made.table(_confirmed(pairs, texts, shingle, percent), "nd-links")


def _joined(done: DataFrame, links: DataFrame) -> DataFrame:
    """Components of those known and more links; the table of those known goes if there are any."""
    if not links.limit(1).count():
        return done
    joined = connected_components(done.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
    drop_table(done.sparkSession, done)
    return joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= percent * |union| of their sets of ``shingle``-word
    shingles are linked; component_id is the smallest id reachable. Words are runs without white
    space, A-Z lower-cased. Defined results: fewer words than a shingle are one shingle; null,
    empty and blank texts have an empty set and link with nothing; rows that share an id are one
    document, linked by any of its texts; a row with a null id is a component of its own with a
    null component_id, kept, and links with nothing; whole texts count however long, each one row of
    a task; other columns play no part; an empty table gives an empty one. The lists favour high
    similarities: ``percent`` is meant to be 70 or more.
    """
    with Workspace(docs.sparkSession) as made:
        plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
        sketched = made.table(plain.mapInArrow(kernel.tidied(_sketches(shingle)), "doc bigint, n bigint, fp1 bigint, fp2 bigint, sketch binary"), "nd-sketches", "lz4")
        classes = sketched.where("n > 0 and doc is not null").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc", "sketch")).alias("first"), F.max("doc").alias("last"))
        reps = made.table(classes.select("fp1", "fp2", "n", F.col("first.doc").alias("rep"), F.col("first.sketch").alias("sketch"), (F.col("last") != F.col("first.doc")).alias("copied")), "nd-reps", "lz4")
        rows = made.table(reps.select("rep", "n", "sketch").mapInArrow(kernel.tidied(_list_rows), "key bigint, rep bigint, n bigint"), "nd-lists")
        pairs, split = candidate_pairs(rows, reps, percent, made)
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        # a merge join whatever the size of ids: the cost stays in proportion to the texts
        whole = plain.where("doc is not null").withColumnRenamed("doc", "id")
        texts = made.table(whole.join(ids.hint("merge"), "id", "left_semi"), "nd-texts")
        # the best partner of each text, then what is not connected yet, then the long lists
        best = pairs.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), "b")
        done = connected_components(_verified(best, texts, None, shingle, percent, made))
        done = _joined(done, _verified(pairs.join(best, ["a", "b"], "left_anti"), texts, done, shingle, percent, made))
        made.drop(texts)
        in_long = long_lists(rows, split, made, done)
        made.drop(rows)
        done = _joined(done, search_long_lists(in_long, reps, whole, done, shingle, percent, made))
        known = reps.select("fp1", "fp2", "n", "rep", "copied").join(done, reps["rep"] == done["node"], "left")
        known = made.table(known.where("copied or component is not null").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component_id")), "nd-known")
        drop_table(docs.sparkSession, done)
        made.keep(sketched, known)
    out = sketched.select("doc", "n", "fp1", "fp2").join(known, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: one document of each component stays whole."""
    marks = near_duplicates(docs, id_col, text_col, shingle, percent)
    lost = marks.where("not kept").select(F.col(id_col).alias("__lodestream_lost")).distinct()
    # a merge join whatever the size of lost: the cost stays in proportion to the texts
    return docs.join(lost.hint("merge"), F.col(id_col).cast("bigint") == F.col("__lodestream_lost"), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w
), sh AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), one AS (
  SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)
), links AS (
  SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), walk AS (
  WITH RECURSIVE r(node, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT l.b, r.root FROM r JOIN links l ON l.a = r.node WHERE r.root < l.b
  )
  SELECT node, min(root) AS root FROM r GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, root = doc_id AS kept FROM sets JOIN walk ON node = doc_id
"""
