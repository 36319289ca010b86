"""Invented sentences in which detectors find something; the given tables hold no such text. The same rows in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prufspark.sources.tables import table

SENTENCES = [
    "Wir wissen, dass der Wagen stand.", "Der Lenker wollte offenbar noch vorbei.", "Die Spur könnte älter sein als der Stoss.", "Falls die Spur echt ist, wird der Hergang bestätigt.",
    "Sofern das Licht an war, wäre der Zeuge vermutlich gewarnt worden.", "Der Abstand betrug 12 mm und danach 3 m auf der Fahrbahn.", "Nach 5 Minuten und 30 Sekunden war die Strasse wieder frei.",
    "Die Länge von 10 mm entspricht 1 cm auf dem Plan.", "Das ist zweifelsfrei der Fall und bestehen keine Zweifel daran.", "Die Beurteilung ist nach Angaben der Stelle noch offen.",
    "Auszug Stpo und Stgb gemäss Beilage.", "Das Urteil ist in Bge 140 zu finden.", "Das ist not very clear hier.", "Es gilt ivm Art. 3 das Gesetz.", "Am 31.02.2030 und am 3-4-2031 sowie am 5. Sept. 2032 fuhr er.",
    "Der Fahrer nahm in Kauf, dass es regnet.", "Die Hypothese H1 wird klar gestützt.", "Die Fahrt dauerte 2 Stunden und 2 Stunden und 30 Minuten.", "Ein Wert von 3 kg, 4 kg und 500 g wurde gemessen.", "Es war ein gewöhnlicher Tag ohne Befund.",
]

# Invented language findings: span, correction, rationale, and why they are dropped.
LANGUAGE = [
    (None, "x", "falsch", "no_span"), ("Haus", "Haus", "falsch", "no_change"), ("Xylo", None, "Möglicher Tippfehler gefunden.", "unknown_word"), ("Er ging.", "Er ging. ", "Punkt fehlt", "no_change"),
    ("Er ging.", "Er lief nun.", "Schlusspunkt fehlt", "stop_is_there"), ("das «Wort»", "das Wort", "Zeichensetzung", "quotation"), ("Strasse", "Straße", "Rechtschreibung", "sharp_s"), ("die Beschuldigte Person", "die beschuldigte Person", "Attributives Adjektiv klein", "kept"),
    ("FOR ZH", "For Zürich heute", "Schreibweise", "capitals"), ("Wagen hier", "Auto hier und dort so", "nicht konsistent", "taste"), ("fuhr Wagen langsam davon", "fuhr der Wagen langsam davon", "Grammatik", "article"), ("Wagen", "Auto", "schöner so", "short_replacement"),
    ("Wagn", "Wagen", "Tippfehler", "kept"), ("befind-lichen", "befindlichen", "Rechtschreibung", "hyphenated"), ("Ergän-", "Ergänzung", "Rechtschreibung", "cut_word"), ("zung", "zungen", "Möglicher Tippfehler gefunden.", "scrap"),
    ("map", None, "falsch", "foreign"), ("das das Haus steht", "das Haus steht", "Doppelung, falsch", "kept"),
]


def sample_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(id, text)``: two sentences for every order."""
    s, n = F.array(*map(F.lit, SENTENCES)), len(SENTENCES)
    k = F.col("o_orderkey")
    pick = lambda c: F.element_at(s, (F.pmod(c, F.lit(n)) + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), F.concat_ws(" ", pick(k), pick(F.floor(k / n) + 7 * k)).alias("text"))


def sample_sql() -> str:
    """The same rows as a common table expression ``t``."""
    s, n = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SENTENCES) + "]", len(SENTENCES)
    return f"t AS (SELECT o_orderkey AS id, ({s})[o_orderkey % {n} + 1] || ' ' || ({s})[(o_orderkey // {n} + 7 * o_orderkey) % {n} + 1] AS text FROM orders)"
