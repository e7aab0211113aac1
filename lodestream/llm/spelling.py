"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so the order of the letters plays no part.
Words that differ by one letter have keys that differ by that letter's power, or by the difference of
two powers where one letter stands for another. Both are equi-joins: a word gives one row for each
of its distinct letters with its key less that letter's power. It meets the words whose whole key that
is (one letter more or fewer), and the words that give the same number for another letter (a letter
exchanged). An edit leaves one half of a word as it was, so rows carry their half, too; that keeps
words made of the same letters apart, of which a group could hold very many. Edit distance settles
the order of the letters of the pairs that meet.

Rows are a small multiple of the distinct words; texts are counted with map-side partial sums and
never shuffled. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestream.scratch import Workspace

#: Power of a letter's code point in a key, and what keys are taken modulo of.
POWER, MODULUS = 5, (1 << 61) - 1
#: Words of at least so many letters and occurrences count.
MIN_LETTERS, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, every other character stays; plain ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS) -> DataFrame:
    r"""(id, run): maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least ``least`` letters, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(rf"[a-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))


def count_words(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of a table of occurrences that are long and frequent enough."""
    return words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out % MODULUS


def _rows(vocabulary: DataFrame) -> DataFrame:
    """What words give to the join: key, letter (null for the whole word), first (whether the half is the first one), word, n."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    rows = vocabulary.select("word", "n", F.char_length("word").alias("__length"), letters.alias("__letters"))
    rows = rows.withColumn("__key", F.aggregate("__letters", F.lit(0).cast("bigint"), lambda a, c: (a + _power(c)) % MODULUS))
    less = F.transform(F.array_distinct("__letters"), lambda c: F.struct(c.alias("letter"), F.pmod(F.col("__key") - _power(c), F.lit(MODULUS)).alias("sum"), F.col("__length").alias("length")))
    whole = F.struct(F.lit(None).cast("string").alias("letter"), F.col("__key").alias("sum"), (F.col("__length") + 1).alias("length"))
    rows = rows.select("word", "n", F.explode(F.concat(less, F.array(whole))).alias("x")).select("word", "n", "x.*", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    split = F.floor(F.col("length") / 2).cast("int")
    half = F.when(F.col("first"), F.left("word", split)).otherwise(F.right("word", F.col("length") - split))
    return rows.select(F.xxhash64("sum", "length", "first", half).alias("key"), "letter", "first", "word", "n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words that differ by one inserted, deleted or replaced letter, each once."""
    with Workspace(vocabulary.sparkSession) as made:
        table = made.table(_rows(vocabulary), "spelling-rows")
        made.keep(table)
    a = table.where("letter IS NOT NULL").select("key", "first", *(F.col(c).alias(f"{c}_a") for c in ("letter", "word", "n")))
    b = table.select("key", *(F.col(c).alias(f"{c}_b") for c in ("letter", "word", "n")))
    exchanged = (F.col("letter_a") != F.col("letter_b")) & (F.col("word_a") < F.col("word_b"))
    removed = F.col("letter_b").isNull() & (F.char_length("word_a") == F.char_length("word_b") + 1)
    split = F.floor(F.char_length("word_a") / 2).cast("int")
    again = ~F.col("first") & (F.left("word_a", split) == F.left("word_b", split))  # the first halves have met as well
    near = F.levenshtein("word_a", "word_b", 1) == 1
    met = a.join(b, "key").where((exchanged | removed) & ~again & near)
    return met.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    A word's form is its most frequent near word, of equals the first in code-point order, if it is
    at least ``ratio`` times as frequent. ``root`` is where following forms ends.
    """
    spark = vocabulary.sparkSession
    with Workspace(spark) as made:
        words = made.table(vocabulary, "spelling-words")
        both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
        pairs = near_pairs(words)
        near = pairs.select(F.explode(both).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
        enough = -F.col("best.m") >= F.col("n") * ratio
        judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).cast("bigint").alias("form_n"))
        judged = made.table(judged, "spelling-judged")
        for path in {f.rpartition("/")[0] for f in pairs.inputFiles()}:
            made.paths.append((pairs, path))
        up = made.table(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-up")
        while True:  # frequencies grow by the ratio at each step, so chains are short
            above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
            jumped = made.table(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-up")
            made.drop(up)
            up = jumped
            if jumped.where("moved").limit(1).count() == 0:
                break
        made.keep(judged, up)
        return judged.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """``group_variants`` of the words of whole texts; with ``slips``, one occurrence in so many loses a letter first.

    A slip is decided by the crc32 of ``<id>:<run>``: if ``slips`` divides it, its remainder by the
    run's length names the letter that goes. Defined results: null and empty texts have no words; a
    null id counts as an empty one; every row counts, also one that repeats another; runs of any
    length are words; other columns play no part; an empty table gives no words.
    """
    found = runs(docs, id_col, text_col)
    word = F.col("run")
    if slips:
        crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        found = found.withColumn("crc", crc)
        at = F.pmod(F.col("crc"), F.char_length("run").cast("bigint")).cast("int")
        word = F.when(F.pmod(F.col("crc"), F.lit(slips)) == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return group_variants(count_words(found.select(word.alias("word"))))


#: One occurrence in so many loses a letter in the registered query, by contract.
SLIPS = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), slips=SLIPS)


#: crc32 of a list of bytes, ``crc_table.t`` and the list given: no function of DuckDB, so worked out byte by byte.
CRC_TABLE_SQL = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc_sql(numbers: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {numbers}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
sums AS (SELECT run, {crc_sql(_BYTES)} AS h FROM runs, crc_table WHERE length(run) >= {MIN_LETTERS}),
words AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM sums),
vocabulary AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
less AS (SELECT word, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
    SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT l.word, v.word FROM less l JOIN vocabulary v ON l.rest = v.word
    UNION SELECT v.word, l.word FROM less l JOIN vocabulary v ON l.rest = v.word
),
near AS (SELECT p.word, count(*) AS n_near, first(p.other ORDER BY v.n DESC, p.other) AS form, max(v.n) AS form_n FROM pairs p JOIN vocabulary v ON v.word = p.other GROUP BY p.word),
judged AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM vocabulary LEFT JOIN near USING (word)),
chains AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT c.word, j.word, j.form FROM chains c JOIN judged j ON j.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, root FROM chains WHERE next IS NULL) USING (word)
"""
