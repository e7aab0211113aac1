"""Operators on texts against brute force, with the cases that each one defines."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestream.llm import decontaminate, html_text, kernel, language, line_dedup, near_dedup, pieces, rans, token_files
from lodestream.scratch import Workspace
from lodestream.llm.cuckoo import CuckooFilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 40_000 + "end"
CASES = [None, "", " ", "\n", "One two.\nThree four five six.", "one two.\nThree four five six.", "ÉTÉ été\tx\x0by", "a", LONG, LONG, "中文 text 😀", "no-break\xa0space", "▁ mark  two", "<|endoftext|> <s>"]


def frame(spark, texts=CASES, extra=True):
    """Documents with repeated rows, a null id and extra columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "One two.\nThree four five six.")] if len(texts) > 4 else list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("doc", "keys", "n", "k1", "shard", "lang", "estimate")}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Kernels.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é中 \t\n09-", max_size=12), max_size=8))
def test_words_are_the_regular_expressions_words(texts):
    for inside, pattern in ((~kernel.SPACE, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        raw, offsets = kernel.buffers(pa.array(texts, pa.string()))
        hashes, first = kernel.Words(inside)(raw, offsets)
        expected = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        assert np.diff(first).tolist() == [len(x) for x in expected]
        flat = [w for x in expected for w in x]
        assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_buffers_of_slices_and_nulls():
    column = pa.array(["ab", None, "", "cdé"]).slice(1)
    raw, offsets = kernel.buffers(column)
    assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == ["", "", "cdé"]
    assert [x for x in kernel.passes(np.array([0, 5, 5, 30, 31]), 6)] == [(0, 2), (2, 3), (3, 4)]


def test_cuckoo_filter_inserts_deletes_and_grows():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.01
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.02


# Line dedup.


def line_brute(rows):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(h := holders.get(key(x), ())) > 1 and i != min(h))]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup_equals_brute_force(spark):
    random.seed(3)
    pool = ["The same line here", "  the SAME line here\t", "short", "ÜBER die gleiche Zeile", "über die gleiche Zeile", "another repeated line", ""]
    texts = CASES + ["\n".join(random.choice(pool + [f"own line number {i} {j}" for j in range(3)]) for _ in range(random.randint(1, 9))) for i in range(60)]
    df = frame(spark, texts)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    brute = line_brute([(r.doc_id, r.text) for r in df.collect()])
    for r in out.collect():
        assert (r["__n_lines"], r["__n_dropped"], r.text or "") == brute[r.doc_id]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_index_takes_insertions_and_deletions_back(spark):
    one = frame(spark, ["shared line of text\nfirst own line", "shared line of text", "third document"], False)
    two = spark.createDataFrame([(10, "third document\nshared line of text"), (11, "first own line")], "doc_id long, text string")
    index = line_dedup.LineIndex.build(one)
    before = {tuple(r) for r in index.shared.collect()}
    grown = index.insert(two)
    whole = line_dedup.LineIndex.build(one.unionByName(two))
    assert {tuple(r) for r in grown.shared.collect()} == {tuple(r) for r in whole.shared.collect()}
    drops = lambda i: {(r.doc, tuple(sorted(map(tuple, r["keys"])))) for r in i.drops().collect()}
    assert drops(grown) == drops(whole)
    back = grown.delete(two.select(F.col("doc_id").alias("doc")))
    assert {tuple(r) for r in back.shared.collect()} == before and drops(back) == drops(index)
    assert {r.doc for r in grown.delete(spark.createDataFrame([(0,)], "doc long")).drops().collect()} == {10}
    texts = grown.delete_documents(two)
    assert {tuple(r) for r in texts.shared.collect()} == before and drops(texts) == drops(index)


def test_a_change_writes_only_the_parts_of_its_keys(spark):
    random.seed(13)
    lines = [f"a line with the number {i}" for i in range(400)]
    docs = spark.createDataFrame([(i, "\n".join(random.choices(lines, k=6))) for i in range(200)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs).insert(spark.createDataFrame([(900, "one more line of text")], "doc_id long, text string"))
    grown = index.insert(spark.createDataFrame([(901, f"{lines[0]}\n{lines[1]}\nanother new line")], "doc_id long, text string"))
    for old, new in zip(index.laid, grown.laid, strict=True):
        assert sum(old.folders.get(p) != f for p, f in new.folders.items()) <= 3 < len(new.folders)
    whole = line_dedup.LineIndex.build(docs.unionByName(spark.createDataFrame([(900, "one more line of text"), (901, f"{lines[0]}\n{lines[1]}\nanother new line")], "doc_id long, text string")))
    assert {tuple(r) for r in grown.shared.collect()} == {tuple(r) for r in whole.shared.collect()}
    drops = lambda i: {(r.doc, tuple(sorted(map(tuple, r["keys"])))) for r in i.drops().collect()}
    assert drops(grown) == drops(whole)


# Near-dedup.


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(spark, k):
    random.seed(k)
    words = [f"w{i}" for i in range(300)]
    texts = list(CASES)
    for size in (3, 6, 9, 15, 30, 60, 150, 400):
        for _ in range(4):
            base = random.choices(words, k=size)
            texts.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(random.randint(0, max(1, size // (8 * k)))):
                    copy[random.randrange(size)] = random.choice(words)
                texts.append(" ".join(copy))
    star = random.choices(words, k=200)  # copies linked to one base, hardly to each other
    texts.append(" ".join(star))
    for i in range(40):
        copy = list(star)
        for j in random.sample(range(200), 16 if k == 2 else 5):
            copy[j] = f"x{i}_{j}"
        texts.append(" ".join(copy))
    texts += ["same text", "Same  text", "same text"]
    df = frame(spark, texts)
    got = near_dedup.near_duplicates(df, shingle=k)
    brute = near_brute([(r.doc_id, r.text) for r in df.collect()], k)
    for r in got.collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == brute[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    kept = near_dedup.drop_near_duplicates(df, shingle=k)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in brute.items() if i == c}
    assert near_dedup.near_duplicates(empty(spark), shingle=k).count() == 0


def changed(words, places, tag):
    out = list(words)
    for i in places:
        out[i] = f"{tag}_{i}"
    return out


def test_one_link_between_two_large_groups(spark):
    random.seed(3)
    base = [f"w{i}" for i in range(400)]
    # the two ends differ in 21 of 400 places, just above the threshold; all other pairs across are below it
    ends = changed(base, range(0, 40, 4), "a"), changed(base, range(42, 86, 4), "b")
    groups = [[changed(end, random.sample(range(100, 398, 3), 6), f"{g}{i}") for i in range(70)] for g, end in enumerate(ends)]
    texts = [" ".join(x) for x in (*groups[0], *groups[1], *ends)]
    random.shuffle(texts)
    df = frame(spark, texts)
    brute = near_brute([(r.doc_id, r.text) for r in df.collect()], 2)
    assert len({c for _, c in brute.values()}) == 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=2).collect() if r.doc_id is not None} == brute


def test_connected_long_lists_are_left_out(spark):
    lists = spark.createDataFrame([(k, i, 9) for k in (1, 2) for i in range(40)] + [(2, 77, 9), (3, 1, 9), (3, 99, 9), (4, 1, 9), (4, 99, 9)], "key bigint, rep bigint, n bigint")
    done = spark.createDataFrame([(i, 0) for i in range(40)], "node bigint, component bigint")
    with Workspace(spark) as space:
        found = near_dedup.long_lists(lists, spark.createDataFrame([(3,)], "key bigint"), space, done)
        assert sorted((r.key, r.rep) for r in found.collect()) == [*((2, i) for i in [*range(40), 77]), (3, 1), (3, 99)]


def test_sides_of_a_long_list_meet_once(spark, monkeypatch):
    random.seed(4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(changed(base, random.sample(range(100), 3), f"x{i}")) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    made = docs.coalesce(1).mapInArrow(near_dedup._sketches(2), "doc bigint, n bigint, fp1 bigint, fp2 bigint, sketch binary").withColumnRenamed("doc", "rep").cache()
    lists = made.select("rep", "n", "sketch").mapInArrow(near_dedup._list_rows, "key bigint, rep bigint, n bigint").cache()
    nobody = spark.createDataFrame([], "node bigint, component bigint")
    split = spark.createDataFrame([], "key bigint")
    with Workspace(spark) as space:
        found = near_dedup.search_long_lists(near_dedup.long_lists(lists, split, space), made, docs, nobody, 2, 80, space)
        got = [(r.a, r.b) for r in found.collect()]
    sets = [shingles(x, 2) for x in texts]
    linked = {(i, j) for j in range(50) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert {(min(p), max(p)) for p in got} <= linked and len(got) == len(set(got))
    tree = list(range(50))
    for i, j in got:
        tree = [tree[i] if t == tree[j] else t for t in tree]
    assert all(tree[i] == tree[j] for i, j in linked)


def laid_out(spark, rows):
    """Members of each part (key, low, high) of a list's (key, rep, n, label), and the rows that are sent."""
    with Workspace(spark) as space:
        known = space.table(spark.createDataFrame(rows, "key bigint, rep bigint, n bigint, label bigint"), "known")
        dealt = near_dedup.in_parts(known, space).collect()
    parts = collections.defaultdict(lambda: (set(), set()))
    for r in dealt:
        for other in r.others:
            parts[r.key, min(r.own, other), max(r.own, other)][r.own > other].add((r.rep, r.label))
    return parts, sum(len(r.others) for r in dealt)


def test_a_stray_in_a_long_list_costs_no_square(spark):
    rows = [(7, i, 100, 0 if i else 99) for i in range(20_000)] + [(8, i, 10, 5) for i in range(3000)]  # list 8 is connected
    parts, sent = laid_out(spark, rows)
    assert sent <= 2 * 20_000 and {key for key, *_ in parts} == {7}
    assert laid_out(spark, [(1, i, 100, i % 2) for i in range(20_000)])[1] <= 6 * 20_000


def test_unlike_members_of_a_list_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    random.seed(6)
    labels = [0] * 50 + [1] * 30 + [2] * 5 + [3] * 4 + [4] * 3 + list(range(10, 40))
    rows = [(k, i, 10, x) for k in (1, 2) for i, x in enumerate(labels)] + [(3, 5, 10, 1), (3, 6, 10, 2)]
    random.shuffle(rows)
    parts, _ = laid_out(spark, rows)
    met = collections.Counter()
    for (key, low, high), (first, second) in parts.items():
        pairs = itertools.combinations(sorted(first), 2) if low == high else itertools.product(first, second)
        met.update((key, min(a, b), max(a, b)) for (a, x), (b, y) in pairs if x != y)
    by_key = collections.defaultdict(list)
    for key, i, _, x in rows:
        by_key[key].append((i, x))
    assert met == collections.Counter((key, a, b) for key, held in by_key.items() for (a, x), (b, y) in itertools.combinations(sorted(held), 2) if x != y)


def test_links_between_large_groups_of_distinct_texts(spark, monkeypatch):
    """Two groups whose members lie in long lists only, joined by one link between two outer members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    random.seed(8)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(300)]
        start = random.randrange(200)
        own = lambda words, tag, k: " ".join([*words, *(f"{tag}{random.random()}" for _ in range(k))])  # noqa: E731, B023
        b_words, near_a = changed(base, range(start, start + 54), f"b{g}"), changed(base, range(start, start + 24), f"b{g}")
        texts += [own(base, "p", 6) for _ in range(60)] + [own(b_words, "q", 20) for _ in range(60)] + [" ".join(near_a), " ".join(b_words)]
    random.shuffle(texts)
    df = frame(spark, texts)
    brute = near_brute([(r.doc_id, r.text) for r in df.collect()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=2).collect() if r.doc_id is not None} == brute


@pytest.mark.parametrize("sparse", [True, False])
def test_parts_give_spanning_forests(monkeypatch, sparse):
    """A part's forest connects what its links connect, by single comparisons and by matrix products."""
    monkeypatch.setattr(near_dedup, "PRODUCT_COST", 1.0 if sparse else 0.0)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    members = []
    for i in range(60):
        own = base.copy()
        own[rng.choice(150, rng.integers(5, 40), replace=False)] = rng.integers(0, 1 << 63, 1)
        own = np.unique(own)
        members.append((i, i // 2, len(own), own))
    part = near_dedup.Part(np.iinfo(np.int64).min, members[:40], members[40:], 80)  # no pair has a smaller list
    near = part.near()
    want = [(i, 40 + j) for i, j in zip(*np.nonzero(near), strict=True) if 5 * (c := len(np.intersect1d(members[i][3], members[40 + j][3]))) >= 4 * (members[i][2] + members[40 + j][2] - c)]
    got = part.forest()
    assert want and set(got) <= set(want) and len(got) < 30

    def classes(links):
        tree = [i // 2 for i in range(60)]
        for i, j in links:
            tree = [tree[i] if t == tree[j] else t for t in tree]
        return [tree.index(t) for t in tree]

    assert classes(got) == classes(want)


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(both[:2400])[:64][None], np.sort(both[600:])[:64][None]
    assert abs(near_dedup.jaccard_estimates(a, b)[0] - 0.6) < 0.25
    assert near_dedup.jaccard_estimates(a, a)[0] == 1


# Decontamination.


def contamination_brute(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        m = min(len(w), window)
        for s in range(len(w) - m + 1 if m and i is not None else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                found = windows.get(tuple(w[s : s + m]))
                if found:
                    hit.update(range(s, s + m))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    words = [f"t{i}" for i in range(12)] + ["É", "x9"]
    items = [(i, " ".join(random.choices(words, k=n))) for i, n in enumerate([1, 2, 4, 5, 12, 13, 14, 20, 60, 60, 300])]
    items += [(100, None), (101, ""), (102, "..."), (103, items[8][1]), (None, "t1 t2 t3"), (104, "a a a a a a a a a a a a a a a a a a")]
    texts = list(CASES)
    for _ in range(60):
        parts = [" ".join(random.choices(words + ["q", "z"], k=random.randint(0, 40)))]
        source = random.choice(items)[1] or ""
        w = source.split()
        s = random.randint(0, len(w))
        parts += [" ".join(w[s : s + random.randint(8, 30)]).upper(), " - ".join(random.choices(words, k=20))]
        texts.append(". ".join(parts))
    texts += ["a " * 50, "a " * 5000]
    df, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    brute = contamination_brute([(r.doc_id, r.text) for r in df.collect()], items)
    check = lambda: {r[0]: tuple(r)[1:] for r in decontaminate.judge(decontaminate.mark_contamination(df, bench)).collect()}
    assert check() == brute
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)  # several blocks of items
    assert check() == brute
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in brute.items() if not x[4]}
    assert decontaminate.mark_contamination(empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.judge(decontaminate.mark_contamination(df, bench.limit(0))).collect()} == {0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=60), st.integers(1, 9))
def test_winnowing_keeps_one_of_every_run(values, run):
    kept = set(decontaminate.winnow(np.array(values, np.uint64), run).tolist())
    for s in range(len(values) - run + 1):
        part = values[s : s + run]
        last = max(i for i in range(run) if part[i] == min(part))
        assert s + last in kept


# Tokens.


def test_token_files_give_the_librarys_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    random.seed(7)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "😀", "'s", "1", ".", "\xa0", " \n", "\n ", "<|endoftext|>", "\r"]
    texts = CASES + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(400)]
    df = frame(spark, texts)
    token_files.write_tokens(df, f"file://{tmp_path}/out")
    got = token_files.read_tokens(spark, f"file://{tmp_path}/out").orderBy("start").collect()
    library = Tokenizer.from_file(token_files.default_tokenizer())
    library.encode_special_tokens = True
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in df.collect() if r.doc_id is not None)]
    at, by_id = 0, {i: t for i, t in enumerate(texts)}
    for r in got:
        text = "One two.\nThree four five six." if r.doc_id is None else by_id[r.doc_id]
        assert r.ids == library.encode(text or "", add_special_tokens=False).ids + [0] and r.start == at
        at += len(r.ids)
    digests = rows_of(token_files.read_digests(spark, f"file://{tmp_path}/out"))
    assert all(digests[r.doc_id].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and digests[r.doc_id].n_tokens == len(r.ids) for r in got)
    token_files.write_tokens(empty(spark), f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=5000), st.integers(1, 64), st.integers(32, 512))
def test_range_coding_round_trips(values, lanes, checkpoint):
    symbols = np.array(values, np.uint16)
    table = rans.FrequencyTable.of_counts(np.bincount(symbols, minlength=400))
    assert table.freqs.sum() == 1 << table.bits
    blob = rans.encode(symbols, rans.FrequencyTable.from_bytes(table.to_bytes()), lanes, checkpoint)
    block = rans.Block(blob, table)
    assert (block.symbols() == symbols).all()
    last = block.marks[-1][0] * block.lanes
    assert (block.part(len(block.marks) - 1) == symbols[last:]).all()  # decoding from a checkpoint
    with pytest.raises(rans.BadBlock):
        rans.Block(blob[:-1] + bytes([blob[-1] ^ 1]), table)


def test_pieces_give_the_librarys_ids_and_texts(spark):
    import sentencepiece

    random.seed(9)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    parts = ["a", "th", "the", " ", "  ", "\n", "▁", "é", "中", "😀", "\x00", "\t", "12", ".", "ing", "<s>", "<0x0A>", "\u0301", "   "]
    texts = CASES + ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(500)]
    df = frame(spark, texts)
    found = pieces.decode(pieces.encode(df))
    assert found.columns == [*df.columns, "ids", "decoded"]
    for r in found.collect():
        want = library.encode(r.text or "") + [library.eos_id()]
        assert r.ids == want and r.decoded == library.decode(want)
    for r in pieces.digest(df).collect():
        want = library.encode((texts[r.doc_id] if r.doc_id is not None else "One two.\nThree four five six.") or "") + [library.eos_id()]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert pieces.encode(empty(spark)).count() == 0


def test_word_table_starts_anew_when_full():
    table = kernel.WordTable(np.int32, 100)
    rng = np.random.default_rng(0)
    for _ in range(30):
        keys = rng.integers(0, 400, 80).astype(np.uint64)
        make = lambda at, keys=keys: (at[::-1], np.concatenate([np.full(k % 3, k) for k in keys[at[::-1]].tolist()] or [np.zeros(0)]).astype(np.int32), np.array([k % 3 for k in keys[at[::-1]].tolist()], np.int64))
        values, ends = table.lookup(keys, kernel.mix(keys), make)
        assert values.tolist() == [k for k in keys.tolist() for _ in range(k % 3)] and len(ends) == 80
        assert table.words <= 100


# Language ID.

_SAMPLES = {"en": "the people of the town were reading the news in the morning and then they went home", "de": "die leute in der stadt lesen am morgen die zeitung und gehen danach nach hause", "fr": "les gens de la ville lisent le journal le matin et puis ils rentrent à la maison"}


def test_language_mixtures(spark):
    random.seed(4)
    rows = [(i, lang, " ".join(random.choices(_SAMPLES[lang].split(), k=30))) for i in range(300) for lang in [random.choice(list(_SAMPLES))]]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit_labelled(labelled)
    assert model.names == ["de", "en", "fr"]
    found = rows_of(language.identify(labelled, model))
    assert sum(found[i]["__lang"] == lang for i, lang, _ in rows) / len(rows) > 0.97
    half = " ".join(_SAMPLES["en"].split() * 4 + _SAMPLES["de"].split() * 4)
    cases = rows_of(language.identify(frame(spark, [*CASES, half, "12 34 ...", "été"]), model))
    assert 0.3 < cases[len(CASES)]["__score"] < 0.7 and cases[len(CASES)]["__lang"] in ("en", "de")
    for i in (0, 1, 2, 3, len(CASES) + 1):
        assert (cases[i]["__lang"], cases[i]["__score"]) == ("und", 0)
    assert all(0 <= r["__score"] <= 1 and (r["__lang"] == "und" or r["__lang"] in model.names) for r in cases.values())
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.fit_labelled(empty(spark))
    assert {r["__lang"] for r in language.identify(frame(spark), nothing).collect()} == {"und"}


def lettered_words(text):
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").translate(LOWER).encode())


def trigram_logs(labelled):
    """Language, then the logarithm of a word's probability, from counts of whole trigrams."""
    counts = {}
    for lang, text in labelled:
        for w in lettered_words(text):
            padded = b" " + w + b" "
            counts.setdefault(lang, collections.Counter()).update(padded[i : i + 3] for i in range(len(w)))
    total = {lang: sum(c.values()) + 0.1 * language.BUCKETS for lang, c in counts.items()}

    def logs(word, lang):
        padded = b" " + word + b" "
        return sum(math.log((counts[lang][padded[i : i + 3]] + 0.1) / total[lang]) for i in range(len(word)))

    return sorted(counts), logs


def mixture_brute(labelled, text, uniform=False):
    """Proportions by expectation-maximisation to convergence over every set of languages, the best set by penalised likelihood."""
    names, logs = trigram_logs(labelled)
    words = collections.Counter(lettered_words(text))
    like = {w: [logs(w, x) for x in names] + [-len(w) * math.log(language.BUCKETS)] * uniform for w in words}
    names = [*names, "und"] if uniform else names
    n, best = sum(words.values()), None
    for size in range(1, len(names) + 1):
        for some in itertools.combinations(range(len(names)), size):
            share = dict.fromkeys(some, 1 / size)
            for _ in range(200):
                fresh = dict.fromkeys(some, 0.0)
                for w, times in words.items():
                    top = max(like[w][k] for k in some)
                    parts = {k: share[k] * math.exp(like[w][k] - top) for k in some}
                    total = sum(parts.values())
                    for k in some:
                        fresh[k] += times * parts[k] / total / n
                share = fresh
            fit = sum(times * (max(like[w]) + math.log(max(sum(share[k] * math.exp(like[w][k] - max(like[w])) for k in some), 1e-30))) for w, times in words.items())
            fit -= 0.5 * (size - 1) * math.log(max(n, 2))
            if best is None or fit > best[0]:
                best = fit, {names[k]: v for k, v in share.items()}
    return best[1]


@pytest.mark.parametrize("uniform", [False, True])
def test_mixtures_equal_brute_force(spark, uniform):
    random.seed(12)
    labelled = [(lang, " ".join(random.choices(text.split(), k=40))) for lang, text in _SAMPLES.items() for _ in range(8)]
    rows = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(labelled)], "id long, lang string, text string")
    model = language.LanguageModel.fit(rows)
    junk = ["".join(random.choices("bcdfghjklmnpqrstvwxz", k=random.randint(4, 9))) for _ in range(40)]
    pools = [*(t.split() for t in _SAMPLES.values()), *([junk] if uniform else [])]  # no language fits junk better than another
    texts = []
    for _ in range(30):
        words = [w for pool in random.sample(pools, random.randint(1, 3)) for w in random.choices(pool, k=random.choice([3, 10, 40]))]
        random.shuffle(words)
        texts.append(" ".join(words))
    found = rows_of(language.identify(frame(spark, texts), model, uniform=uniform))
    for i, t in enumerate(texts):
        want = mixture_brute(labelled, t, uniform)
        none = want.pop("und", 0)
        if abs(none - language.NO_LANGUAGE) < 0.1:
            continue
        if none > language.NO_LANGUAGE:
            assert found[i]["__lang"] == "und" and abs(found[i]["__score"] - none) < 0.1, (t, want, found[i])
        else:
            close = max(want.values()) - want.get(found[i]["__lang"], 0)
            assert close < 0.05 and abs(found[i]["__score"] - max(want.values())) < 0.1, (t, want, found[i])


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = spark.createDataFrame([(i, "xx", "strange words only") for i in ids] + [(i, "en", _SAMPLES["en"]) for i in range(200) if i not in ids], "doc_id long, lang string, text string")
    assert language.fit_labelled(rows).names == ["en"]
    assert {r.doc_id for r in rows.where(language.held_out()).collect()} == set(ids)


# HTML.

PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div id="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Title &eacute;</h1></header><p>One <b>two</b>three<br>four&nbsp;five</p><div class="ad-slot">Buy</div><aside>side</aside>
<form><p>mail</p></form><script>var t="</p>";</script><ul><li>a<li>b</ul><section class="comments"><p>nice</p></section><footer>tags</footer></article></main><footer>f</footer></body></html>"""


def test_markup_gives_the_article():
    assert html_text.blocks_of(PAGE) == ["Title é", "One twothree four five", "a", "b"]
    assert html_text.blocks_of('<div class="menu">m</div><div>Body <p>x<p>y</div><div id="comments"><p>c</p></div><p>cut &am') == ["Body", "x", "y", "cut &am"]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == html_text.blocks_of("<p") == []
    assert html_text.blocks_of("<p>" + "a <i>b</i> " * 50_000) == [html.unescape("a b " * 50_000).strip()]


def test_extraction_over_a_table(spark):
    random.seed(8)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(3000)]
    share = "please share this story with all of your friends and family today"
    rows = [(i, f"http://A.example.com/{i}", f"<article><h1>T{i}</h1><p>{' '.join(random.choices(words, k=80))}</p><p>{share}</p></article>") for i in range(60)]
    quoted = " ".join(random.choices(words, k=60))
    rows += [(i, f"http://b.example.com/{i}", f"<p>{quoted if i % 3 == 0 else ''} {' '.join(random.choices(words, k=80))}</p>") for i in range(60, 100)]
    menu = "our own long menu of things that every page has on top"
    rows += [(i, f"http://c.example.com/{i}", f"<div class=x1>{menu}</div><div class=x2><p>{' '.join(random.choices(words, k=50))}</p></div>") for i in range(200, 206)]
    rows += [(i, f"http://d.example.com/{i}", f"<article><p>{quoted}</p><p>own {i}</p></article>") for i in range(210, 216)]
    rows += [(100, None, PAGE), (101, "no scheme", None), (102, "http://a.example.com/x", ""), (103, "http://b.example.com/y", rows[70][2]), (103, "http://b.example.com/y", rows[70][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "__at", "text", "sig")})
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "host", "__at", "sig", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert not any(share in got[i] for i in range(60)) and all(got[i].startswith(f"T{i}\n\n") for i in range(60))
    assert all(quoted in got[i] for i in range(60, 100) if i % 3 == 0)
    assert not any("menu" in got[i] for i in range(200, 206)) and all(len(got[i].split()) == 50 for i in range(200, 206))
    assert all(got[i] == f"{quoted}\n\nown {i}" for i in range(210, 216))  # marked, and too few pages to tell
    assert got[100] == "Title é\n\nOne twothree four five\n\na\n\nb" and got[101] == got[102] == "" and out.count() == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def repeats_brute(streams, least):
    """Tokens of each stream that a substring of WINDOW tokens or more covers that ``least`` streams hold: all lengths are tried."""
    n = html_text.WINDOW
    holders = {}
    for k, s in enumerate(streams):
        for length in range(n, len(s) + 1):
            for i in range(len(s) - length + 1):
                holders.setdefault(tuple(s[i : i + length]), set()).add(k)
    out = []
    for s in streams:
        gone = [False] * len(s)
        for length in range(n, len(s) + 1):
            for i in range(len(s) - length + 1):
                if len(holders[tuple(s[i : i + length])]) >= least:
                    gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_windows_cover_what_repeated_substrings_of_any_length_cover():
    rng = np.random.default_rng(3)
    runs = [rng.integers(1, 200, k) for k in (5, 8, 9, 14, 20)]
    streams = [np.concatenate([x for _ in range(3) for x in (rng.integers(1, 1000, rng.integers(0, 6)), runs[rng.integers(5)])]).astype(np.uint16) for _ in range(12)]
    for least in (2, 3, 5):
        windows, pages = html_text.suffix_windows(streams, least=least)
        for s, want in zip(streams, repeats_brute(streams, least), strict=True):
            hits = np.flatnonzero(np.isin(kernel.grams(s.astype(np.uint64), html_text.WINDOW), windows))
            assert html_text._covered(hits, len(s)).tolist() == want
        assert (pages >= least).all()


def templates(rng):
    """Pages of four hosts without marked articles: three templates on one, a common sentence, a tiny host, and a host of unique pages."""
    words = lambda k: " ".join(rng.choices([f"w{i}" for i in range(5000)], k=k))
    heads = [" ".join(f"t{k}head{i}" for i in range(12)) for k in range(3)]
    common = "this sentence stands on many pages of the host and says nothing new"
    out = [(f"three.example.com/{i}", [heads[i % 3], words(40), words(30)], [1, 2]) for i in range(60)]
    out += [(f"common.example.com/{i}", [words(30), *([common] if i < 15 else [])], [0]) for i in range(24)]
    out += [(f"tiny.example.com/{i}", [heads[0], words(20)], [1]) for i in range(3)]
    out += [(f"own.example.com/{i}", [words(30), words(20)], [0, 1]) for i in range(30)]
    return out


@pytest.mark.parametrize("partitions", [1, 4, 24, 211])
def test_boilerplate_goes_however_a_host_is_cut(spark, monkeypatch, partitions):
    made = templates(random.Random(9))
    rows = [(i, f"http://{url}", "".join(f"<div class=b{j}>{t}</div>" for j, t in enumerate(blocks))) for i, (url, blocks, _) in enumerate(made)]
    monkeypatch.setattr(html_text, "CHUNK", 16 if partitions == 4 else 512)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, (_, blocks, left) in enumerate(made):
        assert got[i] == "\n\n".join(blocks[j] for j in left), made[i][0]
        assert len(left) == len(blocks) or got[i] != "\n\n".join(html_text.blocks_of(rows[i][2]))  # the suffix array has made the difference


def test_levels_of_evidence():
    assert html_text.level_of(np.array([1, 2, 3, 3, 6, 15, 60, 9]), np.array([1, 50, 3, 30, 6, 24, 60, 10])).tolist() == [0, 0, 2, 0, 2, 2, 3, 2]


def test_forms_around_a_whole_page_count():
    page = "<body><form id=f><div><label>Name</label><p>The article of the page.</p></div></form></body>"
    assert html_text.blocks_of(page) == ["The article of the page."]
    assert html_text.blocks_of("<p>Text.</p><form><p>Your mail</p></form>") == ["Text."]
    assert html_text.blocks_of("<form><article><p>Text.</p><form><p>mail</p></form></article></form>") == ["Text."]


def test_suffix_windows_count_streams():
    streams = [np.array(x, np.uint16) for x in ([1, 2, 3, 4, 5, 6], [9, 2, 3, 4, 5, 7], [2, 3, 4, 5, 2, 3, 4, 5], [8])]
    windows, pages = html_text.suffix_windows(streams, 4)
    wanted = kernel.grams(np.array([2, 3, 4, 5], np.uint64), 4)
    assert windows.tolist() == wanted.tolist() and pages.tolist() == [3]


@pytest.mark.parametrize(("pages", "partitions"), [(9, 1), (520, 1), (520, 3), (20_000, 211)])
def test_unlike_pages_of_a_cut_host_give_no_candidates(spark, pages, partitions):
    rng = np.random.default_rng(pages)
    rows = [("h", int(rng.integers(1 << 62)), rng.integers(1, 60_000, 60).astype("<u2").tobytes()) for _ in range(pages)]
    table = spark.createDataFrame(rows, "host string, sig bigint, stream binary")
    laid = table.repartitionByRange(partitions, "host", "sig").sortWithinPartitions("host", "sig").mapInArrow(html_text._chunks(html_text.CHUNK), html_text._LAID).cache()
    assert html_text.candidate_windows(laid).count() == 0
    assert laid.where("stream IS NOT NULL").count() == pages


def test_a_task_gives_its_free_memory_back(monkeypatch):
    from lodestream.llm import kernel

    class Pool:
        given = 0

        def release_unused(self):
            self.given += 1

    pool = Pool()
    monkeypatch.setattr(kernel.pa, "default_memory_pool", lambda: pool)
    task = kernel.tidied(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and pool.given == 1
    stopped = task(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert pool.given == 2
