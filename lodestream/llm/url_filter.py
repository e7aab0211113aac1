"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame expressions and JVM transformers. The classifier is trained from a small
labelled table of invented addresses, which is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets that n-grams are hashed to, and the lengths of n-grams.
BUCKETS = 1 << 14
LENGTHS = (3, 4, 5)

#: The contract's rules: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# Parts of the labelled addresses: fixed values, invented here.
_BAD = (
    "casino casinos gambling gamble roulette blackjack baccarat poker bets betting bookmaker wager slots jackpot jackpots lottery bingo pills viagra cialis pharma pharmacy "
    "drugstore steroids xanax adult xxx porn porno sex sexy nude erotic escort escorts hookup singles cams spam links seo backlinks ads adserver track clicks popunder popups "
    "warez torrent torrents keygen cracks serials replica replicas fakewatches payday loans quickcash crypto airdrop giveaway prize winner malware phish phishing trojan botnet"
).split()
_GOOD = (
    "library libraries museum museums weather gardening cooking recipes astronomy history physics chemistry biology geology university college school kindergarten council "
    "newsroom herald gazette travel hiking cycling sailing chess docs manual guide wiki encyclopedia health hospital clinic parliament courts statistics census maps atlas poetry "
    "novels theatre orchestra choir railways tramway bakery carpentry pottery village town football rowing swimming archive research journal software engineering"
).split()
_AROUND = ["best-{}", "{}-online", "free-{}", "{}-win", "{}-farm", "my-{}", "{}-tube"]
_HOSTS = ["{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.com", "{}.example.org"]
_PATHS = ["/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/en/{}.html", "/fr/{}"]


def labelled_urls(spark: SparkSession, bad: list[str] = _BAD, good: list[str] = _GOOD) -> DataFrame:
    """(host, path, label) with label 1 for addresses to block: several hundred rows, made by rule.

    Paths are drawn alike for both labels, so that numbers in them tell nothing; names made of
    syllables stand for the many harmless hosts whose words no list holds.
    """
    rows = []
    syllables = ["th", "er", "an", "re", "in", "on", "ti", "st", "al", "ou", "ed", "ha", "sh", "ing", "tion", "ble", "wh", "es"]
    made = [syllables[i % 18] + syllables[(7 * i + i // 18) % 18] + (syllables[(5 * i + i // 18) % 18] if i % 2 else "") for i in range(216)]
    around = lambda words: [_AROUND[(i + k) % len(_AROUND)].format(w) for i, w in enumerate(words) for k in (0, 2, 5)]
    for label, names in ((1.0, bad + around(bad)), (0.0, good + around(good) + made)):
        for i, name in enumerate(names):
            rows += [(_HOSTS[(i + k) % len(_HOSTS)].format(name), _PATHS[(5 * i + k) % len(_PATHS)].format((i * 7919 + k * 104729) % 50000), label) for k in range(3)]
    values = ", ".join(f"('{h}', '{p}', {y}D)" for h, p, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, label)")


def _after(url: Column) -> Column:
    return F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)


def _parts(url: Column, group: int) -> Column:
    found = F.regexp_extract(_after(url), r"^([^/?#]*)([^?#]*)", group)
    return F.when(F.contains(url, F.lit("://")), found).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased; empty for null or without ://."""
    return F.translate(_parts(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return _parts(url, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), h + p, verdict) for verdict, h, p in ordered]
    return F.coalesce(*(F.when(ok, name) for ok, name, _ in fits)), F.coalesce(*(F.when(ok, verdict) for ok, _, verdict in fits))


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with the part it is from; numbers in paths are all one."""

    def of(text: Column, mark: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n))))

    return F.concat(*(of(text, mark, n) for text, mark in ((host, "h:"), (F.regexp_replace(path, "[0-9]+", "0"), "p:")) for n in LENGTHS))


def fit(labelled: DataFrame):
    """(HashingTF, logistic regression) of (host, path, label) rows, a table of bounded size."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__lodestream_grams", outputCol="__lodestream_features")
    train = hashing.transform(labelled.select(F.col("label").alias("__lodestream_label"), _grams(F.col("host"), F.col("path")).alias("__lodestream_grams")).coalesce(1))
    regression = LogisticRegression(featuresCol="__lodestream_features", labelCol="__lodestream_label", predictionCol="__lodestream_block", probabilityCol="__lodestream_probability", rawPredictionCol="__lodestream_raw", regParam=0.005, maxIter=40)
    return hashing, regression.fit(train)


def filter_urls(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``__host``, ``__path``, ``__rule`` and ``__verdict`` (allow or block).

    Defined results: a null url and one without :// have an empty host and path, which no rule fits
    and the classifier judges like any other; of rules of one length that both fit, the first listed
    wins; very long urls are judged by all their n-grams; repeated rows are judged alike; columns of
    the four new names are replaced, others pass through; an empty table gives an empty one.
    """
    hashing, model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    rows = pages.drop("__rule", "__verdict").withColumn("__host", host_of(F.col(url_col))).withColumn("__path", path_of(F.col(url_col)))
    scored = model.transform(hashing.transform(rows.withColumn("__lodestream_grams", _grams(F.col("__host"), F.col("__path")))))
    name, verdict = rule_of(F.col("__host"), F.col("__path"), RULES if rules is None else rules)
    judged = F.coalesce(verdict, F.when(F.col("__lodestream_block") == 1, "block").otherwise("allow"))
    return scored.withColumn("__rule", name).withColumn("__verdict", judged).drop("__lodestream_grams", "__lodestream_features", "__lodestream_raw", "__lodestream_probability", "__lodestream_block")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_urls(pages)
    return out.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
