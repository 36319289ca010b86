from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prufspark.llm.unify import build_mapping, changed_values, transducer, unify_values


@pytest.mark.parametrize(
    "value, form",
    [
        ("Ma​ssstab", "Massstab"), ("Ｕｍｓｃｈａｕ", "Umschau"), ("nісht", "nicht"), ("Gefälle", "Gefälle"), ("modiﬁée", "modifiée"), ("a b", "a b"), ("x‑y", "x-y"),
        ("K", "K"), ("² ° ß … Δv „a“ 、。", "² ° ß … Δv „a“ 、。"), ("В момент удара", "В момент удара"), ("a–b", "a–b"), ("", ""), (None, None), ("５.５", "5.5"), ("a​̈", "ä"), ("ab\tc\n", "ab\tc\n"),
    ],
)
def test_forms(value, form):
    assert transducer()(value) == form


@settings(deadline=None)
@given(st.text(max_size=40))
def test_idempotent_and_composed(s):
    f = transducer()
    once = f(s)
    assert f(once) == once and unicodedata.is_normalized("NFC", once)
    assert not any(c in build_mapping() for c in once)


def test_values_and_repeats(spark):
    df = spark.createDataFrame([("chunks", "1", "text", "a b"), ("chunks", "1", "text", "a b"), ("gold", "2", "span_text", "rein"), ("gold", "3", "correction", None)], "tbl string, record_key string, field string, value string")
    assert [tuple(r) for r in changed_values(df).collect()] == [("chunks", "1", "text")]
    assert {(r["record_key"], r["form"]) for r in unify_values(df).collect()} == {("1", "a b"), ("2", "rein"), ("3", None)}
    assert changed_values(df.limit(0)).count() == 0
