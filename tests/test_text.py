from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prufspark.functions import similarity, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("value, want", [("Größe  ab!", "grösse ab"), ("ΛΟΓΟΣ", "λογοσ"), ("", ""), (None, None), ("a b", "a b")])
def test_simplify(spark, value, want):
    assert one(spark, value, text.simplify) == want


@pytest.mark.parametrize("value, want", [("Wort-\nteil", "Wortteil"), ("eins\nzwei", "eins zwei"), ("a\n\n\n\nb", "a\n\nb"), ("x y", "x y"), (None, None)])
def test_normalize_document(spark, value, want):
    assert one(spark, value, text.normalize_document) == want


@pytest.mark.parametrize(
    "g, p, want",
    [("", "", 1.0), ("", "x", 0.0), ("Abc, def!", "abc DEF", 1.0), ("alpha beta", "alpha beta gamma", 0.95), ("abcd", "abce", 2 / 3), ("eins zwei drei vier", "eins zwei drei fünf", 0.692308)],
)
def test_span_score(spark, g, p, want):
    df = spark.createDataFrame([(g, p)], "g string, p string")
    f = lambda c: similarity.span_features(text.simplify(F.col(c)))
    got = df.select(f("g").alias("g"), f("p").alias("p")).select(similarity.span_score(F.col("g"), F.col("p")).alias("s")).first()["s"]
    assert got == pytest.approx(want, abs=1e-6)


def test_keywords_and_preview(spark):
    assert one(spark, "Wie wird die Bremsspur an der Leitplanke vermessen vermessen", text.keywords) == ["bremsspur", "leitplanke", "vermessen"]
    assert one(spark, "x" * 100, lambda c: text.preview(c, 10)) == "x" * 9 + "…"
    assert one(spark, None, text.preview) is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_rule_sentences(spark):
    assert one(spark, "Eins ist da. Zwei folgt: Drei? vier", text.rule_sentences) == ["Eins ist da.", "Zwei folgt:", "Drei? vier"]
    assert one(spark, "", text.rule_sentences) == []
