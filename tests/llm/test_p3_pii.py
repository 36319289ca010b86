from __future__ import annotations

import re

import pytest

from prufspark.llm import pii

LEX = pii.Lexicon({"tannwald", "koller-wied", "birnfels"}, {"petra": "f", "anna-lena": "f", "reto": "m"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Herr Reto Tannwald kam.", [("name", "Reto Tannwald")]), ("Frau Koller-Wied kam.", [("name", "Koller-Wied")]), ("P. Tannwald kam", [("name", "P. Tannwald")]),
        ("Birnfels, Petra", [("name", "Birnfels, Petra")]), ("Die Tannwald Bau AG lieferte", []), ("in 6519 Birnfels", []), ("Anouk kam", []),
        ("Tel. (063) 922 23 78 oder +41 (0)94 143-54-33", [("phone", "063) 922 23 78"), ("phone", "+41 (0)94 143-54-33")]),
        ("<mailto:a.b+c@x1.example> oder m_n (at) post.test", [("email", "a.b+c@x1.example"), ("email", "m_n (at) post.test")]),
        ("756.0072.4791.02, 1 05 99 99 220 168 54, FCSCZR35T75Z946H, X0M27876", [("id", "756.0072.4791.02"), ("id", "1 05 99 99 220 168 54"), ("id", "FCSCZR35T75Z946H"), ("id", "X0M27876")]),
        ("wohnhaft Rebgasse 3a, CH-1258 Birnfels, bog", [("address", "Rebgasse 3a, CH-1258 Birnfels")]), ("à 59 av. de la Fontaine.", [("address", "59 av. de la Fontaine")]), ("via alla Sorgente, 74.", [("address", "via alla Sorgente, 74")]),
        ("uscito di strada al km 4,1", []), ("an der Rosa-Frei-Weg, Verzweigung", []), ("Am 01.02.2020 mit 18.7 fps @ 204 Pixel", []), ("Koordinaten 2676'545.2 / 1148'682.9", []), ("", []),
    ],
)
def test_find(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, LEX)] == want


def test_aligned_positions():
    t = "Zeile\nHerr​ Re­to\nTann-\nwald, Koller-\nWied"
    form, pos = pii.aligned(t)
    assert form == "Zeile Herr Reto Tannwald, Koller-Wied"
    assert [t[p] for p in pos][:5] == list("Zeile") and t[pos[form.index("Tann")]] == "T"


def test_learns_names_and_reports_once(spark):
    rows = [("chunks", str(i), f"Frau Petra Tannwald und Herr Tannwald und Herr Reto Birnfels, Frau Birnfels kamen am Tag {i}. Die Strasse war nass.") for i in range(6)]
    rows += [rows[0], ("chunks", "n", None), ("chunks", "e", "")]
    df = spark.createDataFrame(rows, "tbl string, record_key string, value string")
    lex = {(r["word"], r["role"], r["gender"]) for r in pii.learn(df).collect()}
    assert {x[:2] for x in lex} == {("tannwald", "s"), ("birnfels", "s"), ("petra", "g"), ("reto", "g")} and ("petra", "g", "f") in lex and ("reto", "g", "m") in lex
    assert pii.found_items(df).where("record_key = '0'").count() == 4
    assert pii.found_items(df.limit(0)).count() == 0
    key = ["record_key", "kind", "start_pos"]
    assert sorted(pii.found_items(df, most=0).select(key).collect()) == sorted(pii.found_items(df).select(key).collect())


def test_a_rare_person_is_found_beside_any_number_of_others(spark):
    few = [("chunks", "a", "Herr Reto Tannwald kam."), ("chunks", "b", "Frau Birnfels und Herr Birnfels kamen.")]
    few = spark.createDataFrame(few, "tbl string, record_key string, value string")
    many = few.unionByName(spark.range(20000).selectExpr("'chunks' as tbl", "concat('x', id) as record_key", "concat('Herr Ivo Vogelsang, Frau Vogelsang und Herr Vogelsang sahen ', id, ' Wagen.') as value"))
    get = lambda df: sorted(tuple(r) for r in pii.found_items(df).where("record_key in ('a', 'b')").collect())
    assert get(many) == get(few) and len(get(few)) == 2


NAMES = [("tannwald", "s", "m"), ("birnfels", "s", "m"), ("petra", "g", "f"), ("reto", "g", "m")]


def shown(kind, item, key=b"k", lex=LEX):
    return pii.surrogate(key, kind, item, lex)


def test_forms_of_one_entity_get_forms_of_one_surrogate():
    lex = pii.Lexicon({"müller", "иванов"}, {"hans": "m", "иван": "m"})
    given, sur = shown("name", "Hans Müller", lex=lex).split()
    assert shown("name", "H. Müller", lex=lex) == f"{given[0]}. {sur}" and shown("name", "HANS MÜLLER", lex=lex) == f"{given} {sur}".upper()
    assert all(0x400 <= ord(c) < 0x530 for c in shown("name", "Иван Иванов", lex=lex).replace(" ", ""))
    a, b = shown("phone", "+41 79 123 45 67"), shown("phone", "079 123 45 67")
    assert a.replace("+41 ", "0") == b != "079 123 45 67" and shown("phone", "+41 (0)79 123-45-67") == a.replace("79", "(0)79").replace(" ", "-").replace("+41-", "+41 ").replace("79-", "79 ")
    street, long = shown("address", "Hauptstr. 5, 8001 Birnfels"), shown("address", "Hauptstrasse 5, 8001 Birnfels")
    assert street.replace("strasse.", "strasse") == long and re.fullmatch(r"\w+strasse \d, 8\d{3} [A-Z]\w+", long) and "Haupt" not in long and "Birnfels" not in long
    assert re.fullmatch(r"\w+\.\w+@\w+\.example", shown("email", "petra.birnfels@x1.example"))


def test_units_that_clash_are_kept_apart(spark):
    words = [("s", w) for w in "tannwald birnfels vogelsang koller wied jaeger".split()]
    real = pii.unit_surrogate(b"k", "s", "tannwald")
    df = spark.createDataFrame([*words, ("s", real)], "role string, word string")
    salts = {(r["role"], r["word"]): r["salt"] for r in pii.distinct_units(df, b"k").collect()}
    assert salts.get(("s", "tannwald"), 0) > 0
    made = {pii.unit_surrogate(b"k", r, w, salts.get((r, w), 0)) for r, w in [*words, ("s", real)]}
    assert len(made) == len(words) + 1 and not made & {w for _, w in [*words, ("s", real)]}


def test_surrogates_are_consistent_distinct_and_keyed(spark):
    df = spark.createDataFrame([("t", "1", "Herr Reto Tannwald, Tel. 063 922 23 78."), ("t", "2", "Frau Petra Tannwald, Tel. 063 922 23 79, 756.0072.4791.02"), ("t", "3", "")], "tbl string, record_key string, value string")
    out = {r["record_key"]: r["text"] for r in pii.pseudonymised(df, b"k", spark.createDataFrame(NAMES, "word string, role string, gender string")).collect()}
    joined = {r["record_key"]: r["text"] for r in pii.pseudonymised(df, b"k", spark.createDataFrame(NAMES, "word string, role string, gender string"), most=0).collect()}
    assert joined == out
    sur = [re.search(r"\[NAME \S+ (\S+)\]", out[k]).group(1) for k in "12"]
    with pytest.raises(ValueError):
        pii.pseudonymised(df, b"")
    assert sur[0] == sur[1] and "Tannwald" not in out["1"] and "[PHONE 063 " not in out["1"].replace("[PHONE 063 9", "") and out["3"] == ""
    assert pii.surrogate(b"k", "phone", "063 922 23 78", LEX) != pii.surrogate(b"k", "phone", "063 922 23 79", LEX)
    assert len({pii.permuted_digits(b"k", "id", f"{i:04d}") for i in range(10000)}) == 10000
    assert pii.surrogate(b"a", "name", "Reto", LEX) != pii.surrogate(b"b", "name", "Reto", LEX)
