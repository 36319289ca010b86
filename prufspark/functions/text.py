"""Text functions as Column expressions; all stay inside code generation and give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"[^\p{L}\p{N}_]+"
# German words that carry no topic in a question.
STOP_WORDS = """als am an auch aus bei bis dabei das dass dem den der des die dies diese dieser doch durch ein eine einem einen einer eines er es für habe haben
hat hinter ich im in ist ja kann können mich mir mit muss müssen nach noch nun oder sehr sein sind so soll sollen tue tun und unter vom von vor war was welche
welcher welches wenn wer wie wir wird wo zu zum zur""".split()


def fold_case(c: Column) -> Column:
    """Lower case with sharp s and final sigma written out, so that equal words compare equal."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def squeeze(c: Column) -> Column:
    """Trimmed, runs of white space (no-break spaces too) as one space."""
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n\\x0B\\f\u00a0\u2007\u202f]+", " "))


def simplify(c: Column) -> Column:
    """The form for comparing: case folded, everything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(fold_case(squeeze(c)), WORD_CLASS, " "))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, though the body names it many times or in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def simple_tokens(simple: Column) -> Column:
    """Distinct tokens of an already simplified text."""
    return F.array_distinct(F.filter(F.split(simple, " "), lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Distinct tokens of the simplified text; empty for a blank one."""
    return simple_tokens(simplify(c))


def bigrams(simple: Column) -> Column:
    """Distinct character pairs of a simplified text without its spaces; a single character is its own pair."""

    def pairs(s: Column) -> Column:
        n = F.length(s)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
        return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(s)).otherwise(many)

    return bind(F.replace(simple, F.lit(" "), F.lit("")), pairs)


def normalize_document(c: Column) -> Column:
    """Line ends unified, words joined over hyphenated and soft breaks, spaces unified, blank lines limited to one."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    c = F.regexp_replace(c, r"([\p{L}])\n([\p{L}])", "$1 $2")
    c = F.regexp_replace(c, "[\u00a0\u2007\u202f]", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def keywords(c: Column, most: int = 8, least_letters: int = 4) -> Column:
    """The first distinct lower-cased tokens that are long enough and no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-zäöüß0-9][a-zäöüß0-9\-_/]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= least_letters) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def preview(c: Column, most: int = 80) -> Column:
    """One line of at most ``most`` characters, with an ellipsis where it was cut."""
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def chunk_id(file_hash: Column, path: Column, index: Column, text: Column) -> Column:
    """Content address of a chunk."""
    return F.sha2(F.concat_ws("|", file_hash, path, index.cast("string"), F.sha2(text.cast("binary"), 256)).cast("binary"), 256)


def split_marked(c: Column, pattern: str, replacement: str) -> Column:
    """Split after marking places with a control character: the way to split without looking behind."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, pattern, replacement), "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def rule_sentences(c: Column) -> Column:
    """Sentences by rule: a stop, colon or semicolon, white space, then a capital, digit or opening quote."""
    return split_marked(squeeze(c), r"([.!?:;])\s+([A-ZÄÖÜ0-9\"„«])", "$1\x01$2")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines."""
    return split_marked(c, r"\n[ \t]*\n\s*", "\x01")


def composed(c: Column) -> Column:
    """Canonical composition without soft hyphens, all white space as single spaces; null for null."""
    import unicodedata

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: " ".join(unicodedata.normalize("NFC", t.replace("\u00ad", "").replace("\u00a0", " ")).split()), na_action="ignore")

    return run(c)


def first_lines(c: Column, most: int = 25) -> Column:
    """The first lines that are not blank: the header of a document."""
    return F.array_join(F.slice(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), 1, most), "\n")
