from __future__ import annotations

import pytest

from prufspark.llm import scanrepair
from prufspark.llm.scanrepair import Evidence

E = Evidence({"fwurcle": "90 wurde", "fniclit": "80 nicht", "cfussgängerin": "50", "cweg-zeit-rechnung": "9", "cpare-brise": "5", "fbescha'digt": "30 beschädigt", f"egutaehten {scanrepair.PLACE}": "9", f"e={scanrepair.fold('bericht der stelle')}": "4"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Das ist der Text, der lange lief und die Fus-\nsgängerin kam.", [(1, "broken")]), ("Das ist der Text und die Weg-\nZeit-Rechnung ergab.", []), ("le pare-\nbrise est là.", []),
        ("Der Text geht weiter und\nGutachten GA-2023-6711\nhier zu Ende.", [(2, "furniture")]), ("Seite 3 von 9\nDer Text ist hier zu Ende.", [(1, "furniture")]), ("Der Text Wer¬\nkstatt lief.", [(1, "broken")]),
        ("Das niclit hier.", [(1, "misread")]), ("Die S†rasse", [(1, "misread")]), ("Wert 76S2 und Spur S13", [(1, "misread")]), ("Spur S13 und 3D-Modell, Haus 12a", []), ("Mail ol2@x.example", []), ("", []),
        ("Der Text lief und die Fus-\nGutachten GA-2023-6711 | S. 3/9\nsgängerin kam.", [(1, "broken"), (2, "furniture")]), ("8.7 Ausgangslage\n\nDer Text.", []),
        ("Am 28.l0.2022 um I1:52", [(1, "misread")]), ("Wert S1,78 km", [(1, "misread")]), ("Er war bescha'digt.", [(1, "misread")]), ("p. 4/36\nDer Text ist hier zu Ende.", [(1, "furniture")]),
        ("Der Text geht weiter und\nBericht der Stelle\nkommt hier zu seinem langen Ende, das hier ist.", [(2, "furniture")]), ("Der Text.\nBericht der Stelle\nNeuer Satz hier.", []),
    ],
)
def test_judge(text, want):
    assert sorted(scanrepair.judge(text, E)) == sorted(want)


def test_all_that_is_found_is_repaired():
    assert scanrepair.repair("Am 26 giugno 2O20 um I1:52 auf 1O5 Metern war die S†rasse BEI DER S†RASSE bescha'digt, Mail ol2@x.example", E) == "Am 26 giugno 2020 um 11:52 auf 105 Metern war die Strasse BEI DER STRASSE beschädigt, Mail ol2@x.example"


def test_repair_gives_running_text():
    t = "Der Bus wurcle gesehen und die Fus-\nGutachten GA-2023-6711\nsgängerin kam\nnach Hause.\n\nNeuer Absatz."
    assert scanrepair.repair(t, E) == "Der Bus wurde gesehen und die Fussgängerin kam nach Hause.\n\nNeuer Absatz."


def test_corrections_join_finds_confusions_only(spark):
    words = [("wurde", 900), ("wurcle", 2), ("nicht", 800), ("niclit", 3), ("stand", 500), ("starid", 1), ("hand", 400), ("band", 390), ("selten", 2)]
    df = spark.createDataFrame(words, "key string, n bigint")
    got = {r["wrong"]: r["right"] for r in scanrepair.corrections(df).collect()}
    assert got == {"wurcle": "wurde", "niclit": "nicht", "starid": "stand"}


def test_tables(spark):
    rows = [(f"{i}", "Der Bus wurde nicht gesehen und stand hier lange.\nGutachten GA-2020-%04d\nEr fuhr dann weiter bis zum Ende." % i) for i in range(40)]
    rows += [("x", "Der Bus wurcle gesehen."), ("x", "Der Bus wurcle gesehen."), ("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = [tuple(r) for r in scanrepair.damaged_lines(df).collect()]
    assert ("x", 1, "misread") in got and len(got) == 41 and {k for _, _, k in got} == {"misread", "furniture"}
    assert scanrepair.damaged_lines(df.limit(0)).count() == 0
    # Evidence that is joined says the same as evidence that is broadcast.
    assert sorted(tuple(r) for r in scanrepair.damaged_lines(df, most=0).collect()) == sorted(got)
    listed = df.selectExpr("id", "text", "struct('paragraph' as content_type) as metadata")
    assert sorted(scanrepair.repaired(listed, most=0).collect()) == sorted(scanrepair.repaired(listed).collect())


def test_evidence_holds_beside_any_amount_of_other_text(spark):
    rows = [(f"{i}", "Der Bus wurde nicht gesehen und stand hier lange.\nGutachten GA-2020-%04d\nEr fuhr dann weiter bis zum Ende." % i) for i in range(20)] + [("x", "Der Bus wurcle gesehen.")]
    few = spark.createDataFrame(rows, "id string, text string")
    many = few.unionByName(spark.range(4000).selectExpr("concat('y', id) as id", "concat('Ganz anderer Inhalt mit vielen Zeilen und Worten.\nDie Leitplanke blieb unversehrt.\nKapitel ', id) as text"))
    get = lambda df: sorted(tuple(r) for r in scanrepair.damaged_lines(df).where("record_key not like 'y%'").collect())
    assert get(many) == get(few) and len(get(few)) == 21


def test_word_evidence_counts_in_a_large_corpus_too(spark):
    """A word seen a few hundred times among very many others stays evidence."""
    df = spark.createDataFrame([("wurde", 200), ("wurcle", 2), ("und", 10**9)], "key string, n bigint")
    assert {r["wrong"]: r["right"] for r in scanrepair.corrections(df).collect()} == {"wurcle": "wurde"}
