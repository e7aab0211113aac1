"""Secret scan: patterns find candidates, a random forest removes false positives.

Candidates are key blocks, credentials in urls, values assigned to names, and runs of key characters
with letters and digits. The forest sees the candidate's length, its character transitions, how much
of it dictionary words cover, the words next to it and the parts of the document's path. The transition
table, the weights of neighbouring words and path parts, the dictionary and the forest all come from
labelled findings, a table of bounded size that is a parameter. A text is cut once at its candidates, so
the work is in proportion to its length; of the texts nothing is shuffled, only candidates are. All
of it is DataFrame expressions and JVM transformers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Labelled findings that are made by rule when no table is given.
LABELLED = 3000
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 48
#: Neighbouring words on each side that are looked up.
NEIGHBOURS = 3
#: Buckets that words and path parts are hashed to.
BUCKETS = 1024
#: Printable ASCII characters, and one class for all others.
_CLASSES = 96

# Words of telling names; what follows in the same identifier starts with a separator, a digit or a capital.
_NAMES = r"passwords?|passwd|pwd|passphrase|pass|secrets?|tokens?|keys?|auth|credentials?"
_END = r"\s{0,3}[:=]\s{0,3}[\"']?"
_NAMED = rf"(?i:{_NAMES})(?:[A-Z0-9_-][\w-]*+)?[\"']?{_END}"
_ANY = r"(?<![\w.-])[A-Za-z_][\w.-]*+\s{0,3}=\s{0,3}[\"']?"
_LOGIN = r"(?<=://)[^\s/:@\"'<>]*+:"
_BODY = r"[^\s\"'<>&;,]"
_MIXED = r"(?=[^\s\"'<>&;,0-9]*+[0-9])(?=[^\s\"'<>&;,A-Za-z]*+[A-Za-z])"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
_ARMOUR = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_BLOCK = rf"-----BEGIN {_ARMOUR}(?:(?:(?!-----)[\s\S])*+-----END {_ARMOUR})?"
CANDIDATE = rf"{_BLOCK}|{_LOGIN}[^\s/@\"'<>]{{3,}}+(?=@)|{_NAMED}{_BODY}{{6,}}+|{_ANY}{_MIXED}{_BODY}{{8,}}+|{_RUN}"
#: What of a candidate isn't its value, for assignments and for logins.
_ASSIGNED = rf"^(?:{_NAMED}(?={_BODY}{{6}})|{_ANY}(?={_MIXED}{_BODY}{{8}}))"
_USER = r"^[^:]*:"
_TRAILING = r"[.:)\]]+$"
_LETTERS = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"

# Words that plain names and placeholders are made of, beside those of the labelled findings.
DICTIONARY = (
    "your here change example sample dummy test password secret token key user name value account service client server config default index image file page list "
    "item data time date type get set http www html the and with that for from version release build feature number string object request response handler manager "
    "controller abc xxx foo bar main src java python node module package import export function class public private static void return null true false"
).split()

FEATURES = ["length", "transitions", "letter_digit", "case_change", "symbol", "distinct", "hex", "vowel_run", "covered", "repeat", "named", "assigned", "words_before", "words_after", "path_parts"]


@dataclass(frozen=True)
class Evidence:
    """What labelled findings teach: logarithms of odds by character pair, word and path part, and dictionary words."""

    pairs: list[float]
    before: list[float]
    after: list[float]
    path: list[float]
    words: list[str]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _pairs(value: Column) -> Column:
    """Numbers of the pairs of neighbouring character classes."""
    codes = F.transform(F.split(value, ""), lambda c: F.when((F.ascii(c) > 31) & (F.ascii(c) < 127), F.ascii(c) - 32).otherwise(_CLASSES - 1))
    held = F.transform(F.array(codes), lambda x: F.transform(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda c, i: c * _CLASSES + F.get(x, i + 1)))
    return F.get(held, F.lit(0))


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _neighbours(before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Buckets of the words before a value, the name that it is assigned to among them, of those after it, and of the path's parts."""
    return {
        "before": _buckets(F.slice(F.reverse(_words(before)), 1, NEIGHBOURS)),
        "after": _buckets(F.slice(_words(after), 1, NEIGHBOURS)),
        "path": _buckets(_words(path.cast("string"))),
    }


def _table(numbers: list[float]) -> Column:
    """A list of numbers as a constant array, folded from one string."""
    return F.split(F.lit(" ".join(f"{x:.4g}" for x in numbers)), " ").cast("array<double>")


def _mean(table: list[float], places: Column) -> Column:
    found = F.transform(places, lambda i: F.get(_table(table), i))
    return F.when(F.size(places) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(places)).otherwise(F.lit(0.0))


def learn(findings: DataFrame) -> Evidence:
    """``Evidence`` from labelled findings; as many rows as pairs and buckets come to the driver."""
    kinds = {"pairs": _pairs(F.col("value")), **_neighbours(F.concat("before", "prefix"), F.col("after"), F.col("path"))}
    seen = findings.select("label", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("array<int>").alias("places")) for k, v in kinds.items()))).alias("x"))
    places = seen.select("label", "x.kind", F.explode("x.places").alias("place"))
    rows = places.groupBy("kind", "place").agg(F.sum("label").alias("secret"), F.count("*").alias("n")).collect()
    tables = {}
    for kind in kinds:
        mine = [(r["place"], r["secret"], r["n"] - r["secret"]) for r in rows if r["kind"] == kind]
        base = math.log((sum(s for _, s, _ in mine) + 2) / (sum(o for _, _, o in mine) + 2))
        tables[kind] = [0.0] * (_CLASSES**2 if kind == "pairs" else BUCKETS)
        for place, secret, other in mine:
            tables[kind][place] = math.log((secret + 2) / (other + 2)) - base
    plain = findings.where("label < 0.5").select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(_LETTERS), F.lit(0)), F.lower))).alias("word"))
    words = plain.where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n")).where("n > 1").collect()  # words of a bounded table
    return Evidence(**tables, words=sorted({*DICTIONARY, *(r["word"] for r in words)}))


def features(evidence: Evidence, value: Column, before: Column, after: Column, prefix: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate, the text around it and the path; no nulls."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    near = _neighbours(F.concat(before, prefix), after, path)
    plain = F.filter(F.regexp_extract_all(value, F.lit(_LETTERS), F.lit(0)), lambda w: F.lower(w).isin(*evidence.words))
    return {
        "length": F.least(n, F.lit(200.0)),
        "transitions": _mean(evidence.pairs, _pairs(value)),
        "letter_digit": _count(value, "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / n,
        "case_change": _count(value, "[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "symbol": _count(value, "[^A-Za-z0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(n, F.lit(64.0)),
        "hex": F.when(F.regexp_like(value, F.lit("^[0-9a-fA-F]+$")), 1.0).otherwise(0.0),
        "vowel_run": _count(value, "[b-df-hj-np-tv-xz][aeiou][b-df-hj-np-tv-xz]") * 3 / n,
        "covered": F.aggregate(plain, F.lit(0.0), lambda a, w: a + F.length(w)) / n,
        "repeat": _count(value, r"(.)\1") / n,
        "named": F.when(F.regexp_like(prefix, F.lit(rf"(?i:{_NAMES})|^[^=]*:$")), 1.0).otherwise(0.0),
        "assigned": F.when(prefix != "", 1.0).otherwise(0.0),
        "words_before": _mean(evidence.before, near["before"]),
        "words_after": _mean(evidence.after, near["after"]),
        "path_parts": _mean(evidence.path, near["path"]),
    }


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(value, before, prefix, after, path, label): findings made by rule from hashes of their numbers.

    Half are secrets: hexadecimal, base64-like and mixed values, mostly assigned to a telling name.
    The others are what scanners mistake for secrets: commit ids and checksums, version strings,
    compound identifiers, placeholders, times and file names.
    """
    hexa = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(hexa(salt))), "[+/=]", "Q")
    pick = lambda salt, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    draw = lambda salt, lo, hi: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("int")
    word = lambda salt: pick(salt, "user", "account", "service", "client", "request", "handler", "image", "index", "config", "value", "release", "feature", "default")
    kind = F.pmod(F.col("id"), F.lit(12))
    secret = kind < 6
    value = (
        F.when(kind < 2, F.left(hexa("a"), draw("n", 12, 64)))
        .when(kind < 4, F.left(mixed("b"), draw("m", 12, 43)))
        .when(kind == 4, F.concat(pick("pre", "AKIA", "ghp_", "sk_live_", "xoxb-"), F.left(mixed("c"), draw("k", 16, 36))))
        .when(kind == 5, F.concat(pick("pw", "Summer", "hunter", "Admin", "letme", "Qwerty", "root"), F.left(mixed("p"), draw("q", 4, 12)), pick("pe", "!", "#1", "", "x9")))
        .when(kind == 6, F.left(hexa("d"), pick("len", "40", "64", "32").cast("int")))
        .when(kind == 7, F.concat_ws("_", word("1"), word("2"), word("3"), draw("v", 1, 99).cast("string")))
        .when(kind == 8, F.concat(F.lit("your-"), word("4"), pick("ph", "-api-key-here", "-password-123", "-token-0000")))
        .when(kind == 9, F.concat(pick("rp", "xxxxxxxxxxxxxxxx1", "0000000000000000a", "changeme-example-1", "aaaaaaaa11111111"), draw("x", 1, 9).cast("string")))
        .when(kind == 10, F.concat(draw("y", 2000, 2030).cast("string"), F.lit("-0"), draw("mo", 1, 9).cast("string"), F.lit("-1"), draw("da", 0, 9).cast("string"), F.lit("T0"), draw("ho", 0, 9).cast("string"), F.lit(":1"), draw("mi", 0, 9).cast("string"), F.lit(":00Z")))
        .otherwise(F.concat(word("5"), F.initcap(word("6")), F.initcap(word("7")), F.lit("Version"), draw("w", 1, 20).cast("string")))
    )
    share = F.when(secret, 8).when(kind.isin(8, 9), 8).when(kind == 6, 0).otherwise(1)  # nobody names a checksum a password
    named = (F.pmod(F.xxhash64("id", F.lit("s")), F.lit(10)) < share) | (kind == 5)
    plain = F.pmod(F.xxhash64("id", F.lit("an")), F.lit(10)) < F.when(secret, 5).otherwise(6)
    telling = pick("bn", "password=", "token = \"", "api_key: ", "secret='", "AWS_KEY=", "DB_PASS=", "auth_token = '", "app:")
    other = F.when(secret, pick("ba", "sig=", "s=", "conn=\"", "x=")).otherwise(pick("bb", "id=", "class=\"", "version=", "sha=", "time=", "href=\""))
    prefix = F.when(named, telling).when(plain, other).otherwise("")
    before = F.when(secret, pick("bs", "use the key ", "bearer ", "login with ", "and then ", "for example of the ", "https://h.com/x?", "", "export ")).otherwise(pick("bf", "commit ", "sha256 checksum ", "the version ", "for example of the ", "build id ", "and then ", "", "see https://h.com/x?"))
    after = F.when(secret, pick("as", "", " and then", "@db", " of the", "\" end")).otherwise(pick("af", "", " and then", " of the", ".min.js", " is a placeholder"))
    path = F.when(secret, pick("ps", "src/app.py", "config/prod.env", "deploy.sh", "", "", "data")).otherwise(pick("pf", "tests/test_app.py", "docs/readme.md", "package-lock.json", "src/app.py", "", "data"))
    return spark.range(0, rows, 1, 1).select(value.alias("value"), before.alias("before"), prefix.alias("prefix"), after.alias("after"), path.alias("path"), secret.cast("double").alias("label"))


def _assemble(rows: DataFrame, evidence: Evidence, names: tuple[str, ...] = ("value", "before", "after", "prefix", "path")) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    made = features(evidence, *(F.col(n) for n in names))
    rows = rows.withColumns({f"__f_{k}": v for k, v in made.items()})
    return VectorAssembler(inputCols=[f"__f_{k}" for k in FEATURES], outputCol="__features").transform(rows).drop(*(f"__f_{k}" for k in FEATURES))


def _whole(findings: DataFrame) -> DataFrame:
    """``findings`` with empty strings for what it lacks."""
    return findings.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in findings.columns else F.lit("").alias(c) for c in ("value", "before", "prefix", "after", "path")), F.col("label").cast("double").alias("label"))


def fit_forest(findings: DataFrame):
    """(evidence, a random forest) from labelled findings (value, label; before, prefix, after and path may lack)."""
    from pyspark.ml.classification import RandomForestClassifier

    findings = _whole(findings)
    evidence = learn(findings)
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", predictionCol="__prediction", probabilityCol="__probability", rawPredictionCol="__raw", numTrees=24, maxDepth=7, seed=11)
    return evidence, forest.fit(_assemble(findings, evidence))


def _placed(text: Column) -> Column:
    """array<struct<match, gap, before, after>>: each candidate, the characters between it and the one before, its neighbourhood."""
    matches, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)

    def placed(x: Column) -> Column:
        m, gaps = x["m"], x["b"]
        around = lambda i: F.concat(F.coalesce(F.right(F.get(m, i - 1), F.lit(NEAR)), F.lit("")), F.get(gaps, i))
        return F.transform(m, lambda c, i: F.struct(c.alias("match"), F.length(F.get(gaps, i)).alias("gap"), F.right(around(i), F.lit(NEAR)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("after")))

    return F.get(F.transform(F.array(F.struct(matches.alias("m"), between.alias("b"))), placed), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """One row for each candidate: id_col, start, rule, value, score, is_secret.

    ``start`` is the value's first code point, from 0, in the whole text; ``value`` is what is
    assigned, without name and quotes, or a key block with its body, if it has an end; ``score`` is the forest's share for a secret. Defined results:
    null and empty texts have no candidates; a null path counts as an empty one, a null id is given
    out as null; equal candidates of a text are each found where they stand; repeated rows are
    scanned alike; very long texts with very many candidates are cut once, from start to end, and their
    candidates are summed up in one task; other columns play no part; an empty table gives no rows.
    """
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), path.alias("__path")).where(F.regexp_like("__text", F.lit(CANDIDATE)))
    rows = rows.select("__id", "__path", F.monotonically_increasing_id().alias("__row"), _placed(F.col("__text")).alias("__hits"))
    hits = rows.select("__id", "__path", "__row", F.posexplode("__hits").alias("__number", "__hit")).select("__id", "__path", "__row", "__number", "__hit.*")
    so_far = Window.partitionBy("__row").orderBy("__number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("__at", F.sum(F.col("gap") + F.length("match")).over(so_far) - F.length("match"))
    key = F.regexp_like("match", F.lit(f"^{_BLOCK}$"))
    login = F.startswith("after", F.lit("@")) & F.endswith("before", F.lit("://")) & ~key
    hits = hits.withColumn("__prefix", F.when(key, "").when(login, F.regexp_extract("match", _USER, 0)).otherwise(F.regexp_extract("match", _ASSIGNED, 0)))
    whole = F.substr("match", F.length("__prefix") + 1)
    hits = hits.withColumn("__value", F.when(login | key, whole).otherwise(F.regexp_replace(whole, _TRAILING, "")))
    rule = F.when(key, "private_key").when(login, "url_login").when(F.col("__prefix") != "", "assignment").otherwise("key_run")
    hits = hits.select("__id", (F.col("__at") + F.length("__prefix")).cast("bigint").alias("__start"), rule.alias("__rule"), "__value", "before", "after", "__prefix", "__path")
    evidence, forest = fit_forest(findings if findings is not None else labelled_findings(spark))
    scored = forest.transform(_assemble(hits, evidence, ("__value", "before", "after", "__prefix", "__path")))
    score = F.when(F.col("__rule") == "private_key", 1.0).otherwise(vector_to_array("__probability")[1])
    return scored.select(F.col("__id").alias(id_col), F.col("__start").alias("start"), F.col("__rule").alias("rule"), F.col("__value").alias("value"), score.alias("score"), (score >= 0.5).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "rule", F.length("value").cast("bigint").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
