"""Spelling variants, license scan and Merkle manifest against brute force, with the cases that each one defines."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestream.llm import license_scan, merkle, queries, spelling
from test_text_operators import CASES, LOWER, empty, frame

SF = "/root/testdata/sf0.001"

# Spelling variants.


def run_brute(rows, slips):
    out = []
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            out.append(run)
    return out


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_brute(counts, ratio=5):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [x for x in counts if is_near(w, x)]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    random.seed(7)
    base = ["garden", "gardens", "gartens", "mountain", "mountains", "naïveté", "strasse", "straße", "ÀÉÎÕÜß", "abcabc", "bcabca", "listen", "silent", "enlist"]
    words = []
    for w in base:
        words += [w] * random.choice([7, 40, 300])
        for _ in range(12):
            p, c = random.randrange(len(w)), random.choice("aeinß÷")
            words += [random.choice([w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]])] * random.choice([4, 5, 6, 30])
    words += ["a" * 7, "a" * 8, "a" * 9, "Ab" * 5000, "ab" * 5000 + "b"] * 5 + ["short"] * 50
    random.shuffle(words)
    texts = [" ".join(words[i : i + 37]) for i in range(0, len(words), 37)]
    df = frame(spark, [*CASES, *texts])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for slips in (None, 3):
        counts = {w: n for w, n in collections.Counter(run_brute(rows, slips)).items() if len(w) >= 6 and n >= 5}
        assert variants_of(spelling.variants(df.repartition(5), slips=slips)) == variant_brute(counts)
    assert spelling.variants(empty(spark)).count() == 0


def test_variants_of_chains_ties_and_anagrams(spark):
    table = [("abcdef", 3125), ("abcdeg", 625), ("abcdhg", 125), ("abcihg", 25), ("abjihg", 5), ("zzzzzz", 5), ("zzzzzx", 25), ("zzzzzb", 25), ("fedcba", 9)]
    table += [("".join(p), 5) for p in {tuple(random.Random(i).sample("mnopqrstu", 9)) for i in range(300)}]
    out = variants_of(spelling.group_variants(spark.createDataFrame(table, "word string, n long")))
    assert out == variant_brute(dict(table))
    assert out["abjihg"][:2] == ("abcihg", "abcdef") and out["zzzzzz"][0] == "zzzzzb" and out["fedcba"][3] == 0


def test_letters_in_the_same_order_meet_only_if_a_half_is_equal(spark):
    """Of words of the same letters, only those with an equal half meet in the join."""
    table = spark.createDataFrame([("".join(random.Random(i).sample("abcdefghijkl", 12)), 5) for i in range(400)], "word string, n long").distinct()
    rows = spelling._rows(table)
    largest = rows.groupBy("key").count().agg(F.max("count")).first()[0]
    assert rows.count() <= 2 * 13 * 400 and largest < 20


# License scan.


def phrase_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for label, phrase in license_scan.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


GRANT = license_scan._GRANT
LICENSES = [
    "under the mit license under the MIT-license!",
    "cc by nc",
    "CC BY-NC-SA; apache license, version 2 Apache License Version 20",
    "the mit license under",
    "word " + GRANT.replace("any person", "any very kind person").replace("sublicense, ", "") + " tail",
    GRANT[: len(GRANT) // 2],
    GRANT + " and once more " + GRANT,
    "Licensed under the GPL License, Version 2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "under the mit license " * 3000,
    "übER the mit license中 under",
]


def test_base_phrases_equal_brute_force(spark):
    random.seed(4)
    pool = "under the mit license apache version 2 cc by nc x".split()
    mixed = [" ".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(150)]
    df = frame(spark, [*CASES, *LICENSES, *mixed])
    rows = license_scan.label(df.repartition(4)).collect()
    assert len(rows) == df.count()
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == collections.Counter((r.doc_id, *phrase_brute(r.text)) for r in df.collect())
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert license_scan.label(empty(spark)).count() == 0


def test_changed_licenses_are_found_and_other_texts_left(spark):
    rows = {r.doc_id: r for r in license_scan.label(spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in (4, 5, 6, 7, 8, 9)] == ["mit", "", "mit", "", "cc-by-sa", "cc-by"]
    assert 0.95 < rows[4].score < 1 and rows[6].score == 1
    spans = license_scan.scan(spark.createDataFrame([(1, LICENSES[6])], "doc_id long, text string")).where("template IS NOT NULL").orderBy("first").collect()
    n = len(re.findall(license_scan.WORD, GRANT.lower()))
    assert [(s.first, s.last) for s in spans] == [(0, n - 1), (n + 3, 2 * n + 2)]


def test_templates_are_a_parameter_of_any_size(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one TWO three four five"), (2, "two three"), (3, None), (4, "one two one two")], "doc_id long, text string")
    table = license_scan.templates(spark, [("long", "one two three four five six", "three four")], [("pair", "one two")])
    expected = {1: (1, 0, "pair", "long,pair"), 2: (0, None, "", ""), 3: (0, None, "", ""), 4: (2, 0, "pair", "pair")}
    for most in (license_scan.BROADCAST_GRAMS, 0):  # beyond the bound, the join shuffles
        monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", most)
        found = license_scan.label(docs, table=table)
        assert {r.doc_id: (r.n_base, r.first_word, r.base_labels, r.labels) for r in found.collect()} == expected
    assert {r.labels for r in license_scan.label(docs, table=table.limit(0)).collect()} == {""}


def test_license_scan_is_native(spark):
    plan = license_scan.label(frame(spark, LICENSES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("hashpartitioning") <= 2


# Merkle manifest.


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof_of(levels, i):
    """Each level's digests left and right of place i."""
    steps = []
    for nodes in levels[:-1]:
        start = i // 16 * 16
        steps.append((nodes[start:i], nodes[i + 1 : start + 16]))
        i //= 16
    return steps


def manifest_brute(rows, tampered):
    """Counter of (id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    first = lambda x: (x is not None, x)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((first(r[0]), h(*map(field, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:2])
    trees = {s: levels_of([leaf for _, leaf, _ in groups[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = collections.Counter()
    for k, s in enumerate(order):
        for i, (_, leaf, r) in enumerate(groups[s]):
            steps = proof_of(trees[s], i) + proof_of(top, k)
            node = h(*map(field, (*r[:4], r[4] and r[4].translate(LOWER)))) if tampered(r[0]) else leaf
            for left, right in steps:
                node = h(*left, node, *right)
            out[r[0], leaf, trees[s][-1][0], top[-1][0], h(*(d for left, right in steps for d in left + right)), node, node == top[-1][0]] += 1
    return out


def test_manifest_equals_brute_force(spark):
    sizes = {None: 17, "": 1, "a": 16, "b": 33, "ä": 257, "Z": 2, "hot": 4099, "中": 15}
    sizes |= {f"s{i}": 1 for i in range(20)}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, source, random.Random(i).choice([None, "en", "fr"]), i % 50 or None, random.Random(i).choice([None, "", "Some TEXT", "ÉTÉ été", "plain", CASES[4]])))
    rows += [rows[3]] * 40 + [(rows[5][0], "a", "xx", 1, "other")] + [(None, "a", None, None, None), (None, None, None, None, "X")] + [(1_000_000, "a", "en", 1, CASES[9])]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumns({c: F.lit(1) for c in ("group", "id", "node", "rank", "n", "claim", "block", "above")})
    tampered = lambda x: x is not None and zlib.crc32(str(x).encode()) % 5 == 0
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = merkle.prove(df.repartition(7), merkle.FIELDS, claimed={"text": F.translate("text", merkle._UPPER, merkle._LOWER)}, changed=changed)
    got = collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.drop("path").collect())
    brute = manifest_brute(rows, tampered)
    assert got == brute and not all(r[-1] for r in brute)
    manifest = {r.source: (r.subroot, r.n_rows, r.root) for r in merkle.roots(df, merkle.FIELDS).collect()}
    assert {v[2] for v in manifest.values()} == {r[3] for r in brute} and {v[0] for v in manifest.values()} == {r[2] for r in brute}
    assert set(manifest) == set(sizes) and sum(v[1] for v in manifest.values()) == len(rows)


def test_manifest_of_many_groups_and_of_nothing(spark):
    rows = [(i, f"s{i:05d}", None, 1, "T") for i in range(4200)]  # more groups than a block holds
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    got = collections.Counter(tuple(r) for r in merkle.prove(spark.createDataFrame(rows, schema), merkle.FIELDS).drop("path").collect())
    assert got == manifest_brute(rows, lambda x: False)
    assert merkle.prove(spark.createDataFrame([], schema), merkle.FIELDS).count() == 0
    assert merkle.roots(spark.createDataFrame([], schema), merkle.FIELDS).count() == 0
    one = merkle.prove(spark.createDataFrame([(1, None, None, None, None)], schema), merkle.FIELDS).first()
    assert one.leaf == one.root == one.subroot == one.folded_root and one.proof_sha256 == h("") and one.verified and one.path == []


# Against the SQL.


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_license_scan", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = con.execute(queries.SQL[name])
    columns = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert collections.Counter(map(tuple, df.select(columns).collect())) == collections.Counter(out.fetchall())
