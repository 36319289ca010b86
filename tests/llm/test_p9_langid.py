from __future__ import annotations

import pytest

from prufspark.llm import langid

DE = "Der Bus hielt kurz vor der Haltelinie an und die Frau wurde nicht gesehen."
FR = "Le témoin a déclaré que la voiture roulait sur la chaussée et que le feu était rouge."
EN = "The witness stated that the vehicle was on the road and that the light had been red."
RU = "В момент удара автобус столкнулся с грузовиком."


@pytest.mark.parametrize("label, want", [("de-CH", "de"), ("ger", "de"), ("Deutsch", "de"), ("", None), (None, None), ("und", None), ("n/a", None), ("français", "fr"), ("en_GB", "en"), ("EL", "el"), ("chi", "zh")])
def test_canonical(label, want):
    assert langid.canonical(label) == want


def table(spark, n=15):
    rows = [(i * 10 + k, t, lang, "s") for i in range(n) for k, (t, lang) in enumerate(((DE, "de"), (FR, "fr"), (EN, "en"), (RU, "ru")))]
    rows += [(900, DE + " " + FR, "de", "s"), (901, DE, "fr", None), (902, FR, None, "s"), (903, "", "de", "s"), (904, None, "de", "s"), (905, "12.5 | 13", "und", "s"), (906, f"﻿ {RU}\n\n{EN}", "ru", "s")]
    rows += [(907, "Er sagte: «The light had been red …», und die Frau wurde nicht gesehen.", "de", "s"), (908, (DE + " ") * 2000, "DE", "s")]
    return spark.createDataFrame([(*r, f"c{r[0] % 3}", 1) for r in rows], "doc_id bigint, text string, lang string, source string, case_id string, start_pos int").repartition(3)


def test_stretches_labels_and_errors(spark):
    df = table(spark)
    rows = langid.language_stretches(df).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["start_pos"], r["lang"]))
        assert 0 < r["confidence"] <= 1
    assert sorted(by[900]) == [(1, "de"), (len(DE) + 2, "fr")] and by[901] == [(1, "de")] and by[902] == [(1, "fr")]
    assert sorted(by[906]) == [(3, "ru"), (len(RU) + 5, "en")] and by[907] == [(1, "de")] and by[908] == [(1, "de")]
    assert not {903, 904, 905} & set(by)
    assert {r["doc_id"] for r in langid.label_errors(langid.language_stretches(df)).collect()} == {900, 901, 902, 906}


def test_empty(spark):
    assert langid.language_stretches(table(spark).limit(0)).count() == 0


NL = "De bus is niet gestopt en het licht werd rood omdat de vrouw bij de kruising stond."


def test_a_small_language_is_found_beside_any_number_of_others(spark):
    """What a language's own documents say decides, not its share of the corpus."""
    small = [(i, NL, "nl" if i % 2 else None, "s", "c") for i in range(40)] + [(50, NL + " " + DE, "nl", "s", "c")]
    few = spark.createDataFrame(small, "doc_id bigint, text string, lang string, source string, case_id string")
    many = few.unionByName(spark.range(1000, 5000).selectExpr("id as doc_id", f"concat('{DE} ', id) as text", "'de' as lang", "'t' as source", "'d' as case_id"))
    get = lambda df: {(r["doc_id"], r["start_pos"], r["lang"]) for r in langid.language_stretches(df).where("doc_id < 1000").collect()}
    want = {(i, 1, "nl") for i in range(40)} | {(50, 1, "nl"), (50, len(NL) + 2, "de")}
    assert get(few.unionByName(table(spark).selectExpr("doc_id + 5000 as doc_id", *few.columns[1:]))) == want
    assert get(many) == want


def test_surely_one_language_agrees_with_the_viterbi_pass(spark):
    import numpy as np

    counts, _ = langid._count_pass(table(spark), None)
    logp = langid.trigram_model(counts)
    texts = [DE, FR, DE + " " + FR, EN + " 12.5. " + EN, RU + "\n" + EN, (DE + " ") * 30 + FR, "A.", f"{FR} {FR} {DE} {FR}"]
    sure, lang, conf = langid.of_one_language(langid.Batch(texts), np.zeros((len(texts), len(langid.LANGS))), np.ascontiguousarray(logp.T), np.arange(len(langid.LANGS)))
    assert sure[:2].all() and not sure[[2, 4, 5]].any()
    for i, t in enumerate(texts):
        if sure[i] and langid.WORD.search(t):
            assert [x[1] for x in langid.stretches(t, np.zeros(len(langid.LANGS)), logp)] == [langid.LANGS[lang[i]]]
