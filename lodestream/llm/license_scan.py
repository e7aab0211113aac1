r"""License scan by diagonal voting.

Templates are license texts and notices. All rolling grams of a document's words are joined with the
positions that they have in templates. Grams of one occurrence of a template lie on one diagonal, the
document's position less the template's, or on neighbouring ones where words were added or left out.
Hits are summed up by diagonal, neighbouring diagonals are merged to a span, and a span is verified:
how many of the template's words it covers in how many words of the document, and whether the words
that name the license are among them. The join compares the grams' words, not only their hashes.

Everything is DataFrame expressions. Grams are looked up where they are made: the table of templates
is sent to all tasks if it is within ``BROADCAST_GRAMS``, and only hits are shuffled, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestream.scratch import Workspace

#: Words of a gram; fewer if a template has fewer.
GRAM = 3
#: Grams of templates that are sent to all tasks, about 100 bytes each; a larger table is joined by shuffle.
BROADCAST_GRAMS = 500_000
#: Diagonals of one template this near are one span, at most a quarter of its words.
DRIFT = 12
#: Least score of a span.
LEAST = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The contract's phrases: (label, phrase).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_KEEP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
# Wording of public licenses and their usual notices, (label, text, the words that name it).
TEMPLATES = [
    ("mit", _GRANT, "to deal in the Software without restriction"),
    ("mit", "Licensed under the MIT License", "mit"),
    ("mit", "Released under the MIT License", "mit"),
    ("bsd-2", _KEEP, "this list of conditions and the following disclaimer"),
    ("bsd-3", f"{_KEEP} {_NAMES}", "endorse or promote products derived from this software"),
    ("bsd-3", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file", "bsd style"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "apache",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "version 3"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "version 2"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4 0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none. Plain ASCII texts take the faster way."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, texts: list[tuple[str, str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(template, label, base, text, named): phrases count as they stand (base), texts where a span is verified."""
    rows = [(a, b, b, True) for a, b in phrases] + [(*t, False) for t in texts]
    made = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text"), F.lit(named).alias("named")) for i, (label, text, named, base) in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*made)))


def _grams(held: Column, n: Column | int) -> Column:
    """Joined grams of n words of an array of words."""
    last = F.size(held) - n
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *(F.get(held, i + j) for j in range(n))))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def _positions(made: Workspace, table: DataFrame) -> tuple[DataFrame, int, int]:
    """Grams of the templates with what a span has to be verified by; their length and their number."""
    held = made.table(table.withColumn("w", words(F.col("text"))).withColumn("k", words(F.col("named"))).where(F.size("w") > 0), "license-templates")
    n = min(GRAM, held.agg(F.min(F.size("w"))).first()[0] or GRAM)
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.size("k")) == F.col("k"))
    first = F.coalesce(F.get(at, F.lit(0)) - 1, F.lit(0))  # without such words, no word is asked for
    held = held.withColumn("named_from", first).withColumn("named_to", F.when(F.size(at) > 0, first + F.size("k")).otherwise(0))
    rows = held.select("template", "label", "base", F.size("w").alias("length"), "named_from", "named_to", F.posexplode(_grams(F.col("w"), n)).alias("t", "t_gram"))
    rows = made.table(rows.withColumn("t_hash", F.xxhash64("t_gram")), "license-grams")
    return rows, n, rows.count()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None) -> DataFrame:
    """One row for each verified span and base place, and one with null template for each document.

    Columns: __row (a number of the document's row), id_col, n_words, template, label, base, first and
    last (words of the document, from 0), covered (template words found), score. Defined results:
    null and empty texts have no words; a null id is given out as null; repeated rows are scanned each
    for itself; occurrences of one template next to each other are spans of their own unless they
    begin within the drift; very long texts are taken whole; other columns play no part; an
    empty table gives no rows; without templates only the rows of the documents are left.
    """
    spark = docs.sparkSession
    with Workspace(spark) as made:
        grams, k, size = _positions(made, templates(spark) if table is None else table)
        made.keep(grams)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__words"))
    rows = rows.select("__row", "__id", F.size("__words").cast("bigint").alias("n_words"), _grams(F.col("__words"), k).alias("__grams"))
    each = rows.select("__row", "__id", "n_words", F.posexplode(F.concat(F.col("__grams"), F.array(F.lit("")))).alias("at", "gram"))  # the last one, empty, stands for the document
    each = each.withColumn("hash", F.when(F.col("gram") == "", F.col("__row")).otherwise(F.xxhash64("gram")))
    lookup = F.broadcast(grams) if size <= BROADCAST_GRAMS else grams
    hits = each.join(lookup, (each["hash"] == grams["t_hash"]) & (each["gram"] == grams["t_gram"]), "left").where((F.col("gram") == "") | F.col("template").isNotNull())
    kept = ["__row", "__id", "n_words", "template", "label", "base", "length", "named_from", "named_to"]
    hits = hits.select(*kept, (F.col("at") - F.col("t")).alias("diagonal"), "at", "t").repartition("__row")
    voted = hits.groupBy(*kept, "diagonal").agg(F.collect_set("t").alias("found"), F.min("at").alias("first"), (F.max("at") + k - 1).alias("last"))  # at most the template's words
    on = Window.partitionBy("__row", "template").orderBy("diagonal")
    drift = F.when(F.col("base"), 0).otherwise(F.least(F.lit(DRIFT), F.floor(F.col("length") / 4)))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(on) > drift, F.lit(True))
    spans = voted.withColumn("__new", apart.cast("int")).withColumn("span", F.sum("__new").over(on.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy(*kept, "span").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.aggregate(F.col("found"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, t: F.struct((a["n"] + t + k - F.greatest(t, a["end"])).alias("n"), (t + k).alias("end")))["n"]
    joint = min(k - 1, 1)  # words that name a license have to stand next to each other: each by a gram that holds its successor, too
    named = F.forall(F.slice(F.sequence(F.col("named_from"), F.greatest("named_from", "named_to")), 1, F.col("named_to") - F.col("named_from")), lambda x: F.exists("found", lambda t: (t <= x) & (F.least(x + joint, F.col("named_to") - 1) < t + k)))
    spans = spans.withColumn("covered", covered).withColumn("score", F.col("covered") / F.greatest(F.col("length").cast("bigint"), F.col("last") - F.col("first") + 1))
    right = F.when(F.col("base"), F.col("covered") == F.col("length")).otherwise((F.col("score") >= LEAST) & named)
    return spans.where(F.col("template").isNull() | right).select("__row", F.col("__id").alias(id_col), "n_words", "template", "label", "base", *(F.col(c).cast("bigint").alias(c) for c in ("first", "last", "covered")), "score")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of ``docs``; the cases are ``scan``'s."""
    found = scan(docs, id_col, text_col, table)
    place = F.when(F.col("base"), F.col("first"))
    joined = lambda of: F.array_join(F.array_sort(F.collect_set(of)), ",")
    return (
        found.groupBy("__row", id_col, "n_words")
        .agg(F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.round(F.max("score"), 6), F.lit(0.0)).alias("score"))
        .drop("__row")
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_quoted(a)}, {b}, {_quoted(t)}, {_quoted(named)})" for i, (a, b, t, named) in enumerate([(a, True, p, p) for a, p in PHRASES] + [(a, False, t, named) for a, t, named in TEMPLATES]))
_SQL_WORDS = f"regexp_extract_all(translate(coalesce({{}}, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
licenses AS (SELECT t.i, label, base, {_SQL_WORDS.format("t.wording")} AS w, {_SQL_WORDS.format("t.named")} AS k FROM (VALUES {_VALUES}) t(i, label, base, wording, named)),
named AS (SELECT i, coalesce(min(x) FILTER (WHERE w[x : x + len(k) - 1] = k), 0) AS start FROM (SELECT i, w, k, unnest(range(1, len(w) + 1)) AS x FROM licenses) GROUP BY i),
t_grams AS (SELECT i, x AS t, w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] AS gram FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS x FROM licenses)),
d_grams AS (SELECT r, x AS p, w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS x FROM docs)),
hits AS (SELECT r, i, p, t, p - t AS diagonal FROM d_grams JOIN t_grams USING (gram)),
diagonals AS (SELECT r, i, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY r, i ORDER BY diagonal) AS step FROM (SELECT DISTINCT r, i, diagonal FROM hits)),
numbered AS (
    SELECT r, i, diagonal, sum(CASE WHEN step <= CASE WHEN base THEN 0 ELSE least({DRIFT}, len(w) // 4) END THEN 0 ELSE 1 END) OVER (PARTITION BY r, i ORDER BY diagonal) AS span
    FROM diagonals JOIN licenses USING (i)
),
spanned AS (SELECT r, i, span, min(p) AS first, max(p) + 2 AS last, list(DISTINCT t) AS found FROM hits JOIN numbered USING (r, i, diagonal) GROUP BY r, i, span),
each_word AS (
    SELECT r, i, span, first, last, x, len(list_filter(found, lambda t: t <= x AND x < t + 3)) > 0 AS seen, start > 0 AND x >= start AND x < start + len(k) AS asked,
        len(list_filter(found, lambda t: t <= x AND least(x + 1, start + len(k) - 1) < t + 3)) > 0 AS joined
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS x FROM spanned JOIN licenses USING (i) JOIN named USING (i))
),
judged AS (
    SELECT r, i, first, last, count(*) FILTER (WHERE seen) AS covered, count(*) AS length, count(*) FILTER (WHERE asked AND NOT joined) = 0 AS complete
    FROM each_word GROUP BY r, i, span, first, last
),
verified AS (
    SELECT r, first - 1 AS first, label, base, covered / greatest(length, last - first + 1) AS score FROM judged JOIN licenses USING (i)
    WHERE CASE WHEN base THEN covered = length ELSE complete AND covered / greatest(length, last - first + 1) >= {LEAST} END
)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(round(max(score), 6), 0) AS score
FROM docs LEFT JOIN verified USING (r) GROUP BY r, doc_id
"""
