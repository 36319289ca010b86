"""Filters of language findings ``(…, span_text, correction, rationale)``: each rule is a condition, and the first that
holds is kept as ``drop_reason``, so a filter is ``where drop_reason is null``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prufspark.functions.text import squeeze

# Articles, words of a rationale that name a real mistake, quotation marks, nouns of institutions.
ARTICLES = "der die das dem den des ein eine einer einem einen".split()
MISTAKES = "orthograf rechtschreib grammatik zeichensetzung komma adjektiv einheit abkürzung abbildung referenz tippfehler inkonsistent nummer falsch ungültig schreibweise".split()
QUOTES = "«»„“‚'"
INSTITUTIONS = """abteilung abteilungen amt ämter behörde behörden departement departements dienst dienste direktion direktionen gericht gerichte gerichts
instituts institut institute kammer kammern kommission kommissionen ministerium ministeriums polizei sektion sektionen staatsanwaltschaft staatsanwaltschaften
stelle stellen""".split()
INSTITUTION_START = r"(?i)^(?:der|die|das|dem|den|des|von|vom|zur|zum|beim|an\s+der|an\s+die)\s"
TYPO, ADJECTIVE, SAME_USE = "möglicher tippfehler", "attributives adjektiv", "konsistenter gebrauch"
PIECES = r"[A-Za-zÄÖÜäöüß0-9\-]+|[^\p{L}\p{N}_\s]"


def drop_reason(span: Column, correction: Column, rationale: Column) -> Column:
    """Why a language finding is implausible, null for a plausible one. Missing values are empty. An added article is
    only a reason where something was added at all."""
    s, v = F.trim(F.coalesce(span, F.lit(""))), F.trim(F.coalesce(correction, F.lit("")))
    why = F.lower(F.trim(F.coalesce(rationale, F.lit(""))))
    given = v != ""
    case_only = F.contains(why, F.lit(ADJECTIVE)) | (given & (F.lower(s) == F.lower(v)) & (s != v))
    sharp = lambda c: F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))
    pieces = lambda c: F.regexp_extract_all(c, F.lit(PIECES), F.lit(0))
    added = F.filter(pieces(v), lambda x: ~F.array_contains(pieces(s), x))
    n_words = lambda c: F.size(F.filter(F.split(squeeze(c), " "), lambda x: x != ""))
    named = F.rlike(why, F.lit("|".join(MISTAKES)))
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    letters = F.regexp_extract_all(s, F.lit("[A-Za-zÄÖÜäöüß]+"), F.lit(0))
    capitals = (F.size(letters) > 0) & F.forall(letters, lambda t: (F.length(t) >= 2) & (t == F.upper(t)))
    rules = [
        ("no_span", s == ""),
        ("no_change", given & (v == s)),
        ("unknown_word", ~given & why.startswith(TYPO)),
        ("stop_is_there", F.contains(why, F.lit("punkt")) & F.rlike(s, F.lit("[.!?]$"))),
        ("quotation", F.rlike(s, F.lit(f"[{QUOTES}]"))),
        ("sharp_s", ~case_only & (sharp(s) == sharp(v))),
        ("capitals", ~case_only & capitals),
        ("taste", F.contains(why, F.lit("konsistent")) | F.contains(F.lower(v), F.lit(SAME_USE))),
        ("article", given & F.size(added).between(1, 2) & F.forall(added, lambda t: F.lower(t).isin(ARTICLES))),
        ("short_replacement", (n_words(s) <= 3) & (n_words(v) <= 3) & (F.lower(s) != F.lower(v)) & ~case_only & ~named),
        ("hyphenated", given & F.rlike(s, F.lit(r"[\p{L}\p{N}_]-[\p{L}\p{N}_]")) & ~F.contains(s, F.lit(" ")) & (bare(s) == bare(v))),
        ("cut_word", F.rlike(s, F.lit("^[A-Za-zÄÖÜäöüß]{2,}-$"))),
        ("scrap", F.rlike(s, F.lit("^[a-zäöüß]{2,5}$")) & why.startswith(TYPO) & given & (F.length(v) <= 8)),
        ("foreign", F.rlike(s, F.lit("^[a-z]{1,4}$")) & ~given),
    ]
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])


def in_text(span: Column, text: Column) -> Column:
    """Does the span stand in the text, white space apart? An empty span never does."""
    s = squeeze(F.coalesce(span, F.lit("")))
    return (s != "") & F.contains(squeeze(text), s)


def names_institution(span: Column, rationale: Column) -> Column:
    """A capital adjective in the name of an institution is no mistake."""
    words = F.split(F.lower(squeeze(F.coalesce(span, F.lit("")))), " ")
    return F.contains(F.lower(F.coalesce(rationale, F.lit(""))), F.lit(ADJECTIVE)) & F.rlike(F.coalesce(span, F.lit("")), F.lit(INSTITUTION_START)) & F.exists(words, lambda w: w.isin(INSTITUTIONS))


def without_known_words(findings: DataFrame, words: DataFrame, least: int = 4) -> DataFrame:
    """Findings none of whose words of ``least`` letters is a known one of the case, ``words(case_id, word)`` in lower case."""
    found = findings.select("case_id", "finding_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("span_text", F.lit(""))), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))).alias("word"))
    hit = found.where(F.length("word") >= least).join(words.distinct(), ["case_id", "word"], "left_semi").select("case_id", "finding_id").distinct()
    return findings.join(hit, ["case_id", "finding_id"], "left_anti")
