"""Column functions and plain policy against worked values."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestream.functions import text, vector
from lodestream.operators import policy


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_upper_keeps_the_length(spark):
    assert one(spark, text.upper(F.col("t")), t="Straße ŉ𝒳 ﬁx") == "STRAßE ŉ𝒳 ﬁX"
    assert one(spark, text.upper(F.col("t")), t="über") == "ÜBER" and one(spark, text.upper(F.col("t")), t="") == ""


def test_tokens_drop_stop_words_and_keep_repeats(spark):
    assert one(spark, text.tokens(F.col("t")), t="The café of the_end, café 2x") == ["café", "the_end", "café", "2x"]
    assert text.tokens_of("The café of the_end, café 2x") == ["café", "the_end", "café", "2x"]
    assert one(spark, text.tokens(F.lit(None).cast("string")), t="") == []


@pytest.mark.parametrize(("query", "fraction"), [("", 0.0), ("   ", 0.0), ("foo `bar`", 0.5), ("a/b", 1.0), ("/", 0.0), ("os.path", 1.0), ("camelCase here", 0.5), ("snake_case", 1.0), ("MAX_SIZE", 1.0), ("ValueError", 1.0), ("v1.2", 1.0), ("1234567890", 0.0), ("(JSON)", 1.0), ("how are you", 0.0)])
def test_technical_fraction(spark, query, fraction):
    assert one(spark, text.technical_fraction(F.col("q")), q=query) == fraction
    assert policy.technical_fraction(query) == fraction


@pytest.mark.parametrize(("raw", "category"), [("AI", "ai"), (' "Machine Learning" ', "machine_learning"), ("a b c d", "uncategorised"), ("", "uncategorised"), ("### Notes", "notes"), ("`fetch`", "fetch"), ("4._[x]", "uncategorised"), ("Deep-Learning!", "deep-learning")])
def test_categories(spark, raw, category):
    assert one(spark, text.normalise_category(F.col("r")), r=raw) == category


def test_model_responses(spark):
    parse = lambda r: tuple(one(spark, text.parse_response(F.col("r")), r=r))
    assert parse('{"category": "Deep Learning", "keywords": [" A ", "b", ""], "summary": " s "}') == ("deep_learning", ["a", "b"], "s")
    assert parse('```json\n{"category": "x", "keywords": "no"}\n```') == ("x", [], "")
    assert parse("plain words") == ("plain_words", [], "")
    assert len(parse('{"category": "x", "summary": "' + "y" * 400 + '"}')[2]) == 301
    assert one(spark, text.strip_label(F.col("r")), r='**Title:** **"Foo bar"**\n\nBecause') == "Foo bar"
    assert one(spark, text.parse_keywords(F.col("r")), r="Keywords: Alpha, beta\nGamma,, ") == ["alpha", "beta", "gamma"]
    assert one(spark, text.derive_category(F.array(F.lit("[x]"), F.lit("Good One")), F.lit("t")), r="") == "good_one"
    assert one(spark, text.derive_category(F.array().cast("array<string>"), F.lit("Big Title Here")), r="") == "big_title"


def test_keyword_rules(spark):
    assert one(spark, text.keyword_category(F.col("t")), t="Python api, neural TOKEN token") == "AI"
    assert one(spark, text.keyword_category(F.col("t")), t="logic cell") == "Philosophy"  # a tie: the earlier rule
    assert one(spark, text.keyword_category(F.col("t")), t="nothing") == "uncategorised"
    assert text.load_rules('[{"pattern": "x", "category": "y"}]') == [("x", "y")]
    assert text.load_rules("{broken") == text.load_rules('[{"pattern": 1}]') == text.load_rules(None) == text.KEYWORD_RULES


def test_small_text_functions(spark):
    assert one(spark, text.strip_ansi(F.col("t")), t="\x1b[31mred\x1b[0m") == "red"
    assert one(spark, text.short_id(F.lit(7), F.lit("abc")), t="") == "000007-a9993e364706"
    assert [one(spark, text.evidence_grade(F.col("a"), F.col("b")), a="The  Quick brown fox", b=b) for b in ("quick BROWN", "the quick dog runs", "zebra", "")] == [2, 1, 0, 0]
    assert one(spark, text.identifiers(F.col("t"), "snake_case"), t="a_b a_b c_d plain") == ["a_b", "c_d"]


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.0))
    assert one(spark, vector.squared_l2(a, b), t=0) == 8.0
    assert one(spark, vector.cosine(a, a), t=0) == pytest.approx(1)
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), t=0) == 0
    assert one(spark, vector.score_of(F.lit(1.0)), t=0) == 0.5 and one(spark, vector.score_of(F.lit(None).cast("double")), t=0) == 0
    for logit, share in ((-2.0, 0.119), (3.5, 0.970), (0.5, 0.622), (-800.0, 0.0)):
        assert one(spark, vector.sigmoid(F.lit(logit)), t=0) == pytest.approx(share, abs=1e-3)


def test_pool_and_threshold():
    assert policy.fetch_pool(5, True) == 100 and policy.fetch_pool(5, False) == 5 and policy.fetch_pool(50, True) == 150
    assert policy.fetch_pool(5, True, 7) == 7 and policy.fetch_pool(5, False, 0) == 1 and policy.fetch_pool(5, True, 1000, 20) == 20
    assert policy.scaled_threshold(0.3, True) == pytest.approx(0.01) and policy.scaled_threshold(0.3, False) == 0.3 and policy.scaled_threshold(-1, True) == 0


def test_rerank_decisions():
    assert policy.rerank_decision("x", explicit=False) == (False, "explicit")
    assert policy.rerank_decision("x", profile=policy.PROFILES["codebase"])[0] is False
    assert policy.rerank_decision("os.path MAX_A", everywhere=True)[0] is True
    assert policy.rerank_decision("x", semantic=False)[0] is False
    assert policy.rerank_decision("os.path now")[0] is False and policy.rerank_decision("tell me a story")[0] is True
    assert policy.resolve_profile(None).name == "documents"
    with pytest.raises(ValueError):
        policy.resolve_profile("hybrid")
    assert {x["lever"] for x in policy.profile_change(policy.PROFILES["documents"], policy.PROFILES["codebase"]) if x["reindex"]} == {"chunk_fallback", "taxonomy"}


def test_model_files():
    assert policy.model_files("x/gte-reranker-modernbert-base", "x86_64")[0] == "onnx/model_quantized.onnx"
    assert policy.model_files("ms-marco", "ARM64") == ["onnx/model_qint8_arm64.onnx", "onnx/model.onnx"]
    assert policy.model_files("ms-marco", "x86_64") == ["onnx/model.onnx"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ_./`1 E", max_size=20))
def test_fraction_is_a_share(query):
    assert 0 <= policy.technical_fraction(query) <= 1 and not math.isnan(policy.technical_fraction(query))


def test_labels_around_values(spark):
    cases = {
        '**Title:** **"Foo bar"**\n\nBecause': "Foo bar", "keywords : a, b": "a, b", "  ** Summary ** :\n\n text * ": "text", "Title: x\n\nTitle: y": "x", "\n\nTitle: x": "x", "\n\nplain": "",
        "Subtitle: x": "Subtitle: x", "a: b": "a: b", "* *'quoted'* *": "quoted", "no label": "no label", "": "", "title": "title", "KEYWORD:": "", "** \"value\" **": "value",
    }
    for raw, value in cases.items():
        assert one(spark, text.strip_label(F.col("r")), r=raw) == value


def test_policy_columns_equal_the_functions(spark):
    rows = [(k, r, n) for k in (1, 5, 50) for r in (True, False) for n in (0, 3, 60, 1000)]
    table = spark.createDataFrame(rows, "k int, r boolean, n int").withColumn("pool", policy.pool(F.col("k"), F.col("r"), F.col("n")))
    assert [(x.k, x.r, x.n, x.pool) for x in table.collect()] == [(*x, policy.fetch_pool(*x)) for x in rows]
    for query in ("how are roses watered", "fix `HTTPError` in api.py", "", "a b_c d"):
        assert one(spark, policy.reranked(F.col("q")), q=query) == policy.rerank_decision(query)[0]
