"""Problem 2: bring equal-looking text to one form.

A longest-match transducer over grapheme clusters rewrites widths, letters with their marks,
spaces, invisible characters, hyphens, joined letters and look-alike letters in one pass. All of
them are entries of one automaton, compiled from a mapping that is generated from character
properties and checked for conflicts; look-alikes carry two forms, and the word they stand in
says which one holds.

Defined results: a null value stays null and is never a case; an empty value stays
empty; running the transducer twice gives what running it once gives.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letter a reader takes them for.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o",
    "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Ӏ": "l", "ӏ": "l", "ү": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k",
    "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
}
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
HYPHENS = "‐‑﹣－"
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


def build_mapping() -> dict[str, str]:
    """Single characters and their one form, generated from character properties."""
    out: dict[str, str] = {}

    def put(src: str, dst: str) -> None:
        if out.setdefault(src, dst) != dst:
            raise ValueError(f"two forms for {src!r}: {out[src]!r} and {dst!r}")

    for cp in range(0x80, 0x20000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            put(c, " ")
        elif kind == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD):
            put(c, "")
    for c in INVISIBLE_EXTRA + "".join(map(chr, range(0xFE00, 0xFE10))):
        put(c, "")
    for c in HYPHENS:
        put(c, "-")
    for a, b in ((0x21 + 0x0F, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        for cp in range(a, b):
            put(chr(cp + 0xFEE0), chr(cp))
    for c, s in JOINED.items():
        put(c, s)
    for src, dst in out.items():
        if any(c in out for c in dst):
            raise ValueError(f"the form of {src!r} is itself rewritten")
    return out


def compositions() -> dict[str, str]:
    """Letters with marks as they may be taken apart, whole or by the last mark, and their composed form."""
    out = {}
    for cp in (*range(0xC0, 0x3400), *range(0xF900, 0xFB50)):
        c = chr(cp)
        parts = unicodedata.decomposition(c)
        if not parts or parts[0] == "<" or unicodedata.category(c)[0] != "L":
            continue
        whole = unicodedata.normalize("NFC", c)
        for key in {c, unicodedata.normalize("NFD", c), "".join(chr(int(x, 16)) for x in parts.split())} - {whole}:
            out[key] = whole
    return out


def build_clusters() -> dict[str, tuple[str, str]]:
    """Every entry of the automaton: its form, and its form in a word with Latin letters. An entry with two forms in one
    place, a form that holds an entry and a Latin form that holds one are errors."""
    out: dict[str, tuple[str, str]] = {}

    def put(src: str, form: str, latin: str) -> None:
        if out.setdefault(src, (form, latin)) != (form, latin):
            raise ValueError(f"two forms for {src!r}: {out[src]!r} and {(form, latin)!r}")

    for src, form in build_mapping().items():
        put(src, form, form)
    for src, form in compositions().items():
        put(src, form, LOOK_ALIKES.get(form, form))
    for src, latin in LOOK_ALIKES.items():
        put(src, src, latin)
    for src, (form, latin) in out.items():
        for x in (form, latin):
            if x != src and any(c in out and out[c] != (c, LOOK_ALIKES.get(c, c)) for c in x) or any(c in LOOK_ALIKES for c in latin):
                raise ValueError(f"the form of {src!r} is itself rewritten")
    return out


def _char_class(chars: Iterable[str]) -> str:
    """A regex class body with runs of code points written as ranges."""
    cps = sorted(map(ord, chars))
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        parts.append(f"\\U{cps[i]:08x}" + (f"-\\U{cps[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(parts)


class Transducer:
    """Longest match over clusters (base and marks), one pass from left to right."""

    def __init__(self) -> None:
        self.single = build_mapping()
        clusters = build_clusters()
        self.automaton = ahocorasick.Automaton()
        for key, (form, latin) in clusters.items():
            self.automaton.add_word(key, (len(key), form, latin))
        self.automaton.make_automaton()
        look = "".join(LOOK_ALIKES)
        # Any text without one of these and in composed form is already in the one form.
        self.quick = re.compile(f"[{_char_class([*self.single, *LOOK_ALIKES])}]")
        self.suspect = re.compile(f"[{_char_class(self.single)}]|[A-Za-zÀ-ɏＡ-Ｚａ-ｚ][{look}]|[{look}][A-Za-zÀ-ɏＡ-Ｚａ-ｚ]")
        odd = _char_class(self.single)
        self.unit = regex.compile(rf"[\p{{L}}\p{{M}}{odd}]+|[^\p{{L}}\p{{M}}{odd}]\p{{M}}+")
        # A word is a run of letters; what will go counts as nothing, so it does not part them.
        gone = _char_class(k for k, v in self.single.items() if not v)
        self.before = regex.compile(rf"[\p{{L}}\p{{M}}{gone}]*", regex.REVERSE)
        self.after = regex.compile(rf"[\p{{L}}\p{{M}}{gone}]*")
        self.latin = regex.compile(r"\p{Latin}")

    def rewrite(self, text: str) -> str:
        out: list[str] = []
        at = end_of_word = 0
        in_latin = False
        for end, (size, form, latin) in self.automaton.iter_long(text):
            start = end + 1 - size
            if form != latin:
                if start >= end_of_word:
                    stop = self.after.match(text, start).end()
                    begin = self.before.match(text, 0, start).start()
                    end_of_word, in_latin = max(stop, start + 1), self.latin.search(text, begin, stop) is not None
                if in_latin:
                    form = latin
            out += (text[at:start], form)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str | None) -> str | None:
        if not text or text.isascii():
            return text
        composed = unicodedata.is_normalized("NFC", text)
        if composed and not (self.quick.search(text) and self.suspect.search(text)):
            return text
        out = self.rewrite(text)
        # Marks in another order, or brought to their letter by what went between, are no entries; composed, they may be.
        while not unicodedata.is_normalized("NFC", out):
            out = self.rewrite(unicodedata.normalize("NFC", out))
        return out


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def unified(col: Column) -> Column:
    """The one form of a text column, null for null."""

    @F.pandas_udf(T.StringType())
    def run(s):
        f = transducer()
        return s.map(f, na_action="ignore")

    return run(col)


def unify_values(values: DataFrame) -> DataFrame:
    """``(tbl, record_key, field, value)`` to the same with ``form`` and ``changed``; extra columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = transducer()
        for b in batches:
            src = b.column("value").to_pylist()
            out = [f(v) for v in src]
            yield pa.RecordBatch.from_arrays(
                [b.column("tbl"), b.column("record_key"), b.column("field"), pa.array(out, pa.string()), pa.array([a is not None and a != o for a, o in zip(src, out)], pa.bool_())],
                names=["tbl", "record_key", "field", "form", "changed"],
            )

    return values.select("tbl", "record_key", "field", "value").mapInArrow(run, "tbl string, record_key string, field string, form string, changed boolean")


def finding_values(df: DataFrame, findings: str, tbl: str) -> DataFrame:
    """Span text and correction of each finding as rows; findings without an id or value give none."""
    f = df.select(F.explode(findings).alias("f"))
    both = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(f"f.{n}").alias("value")) for n in ("span_text", "correction")]
    )
    return (
        f.select(F.lit(tbl).alias("tbl"), F.col("f.finding_id").alias("record_key"), F.explode(both).alias("v"))
        .select("tbl", "record_key", "v.field", "v.value")
        .where(F.col("value").isNotNull() & F.col("record_key").isNotNull())
    )


def chunk_values(chunks: DataFrame) -> DataFrame:
    """Chunk texts as value rows."""
    return chunks.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(
        F.lit("chunks").alias("tbl"), F.col("id").alias("record_key"), F.lit("text").alias("field"), F.col("text").alias("value")
    )


def all_values(chunks: DataFrame, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return (
        chunk_values(chunks)
        .unionByName(finding_values(gold, "gold_findings", "gold"))
        .unionByName(finding_values(predictions, "predicted_findings", "predictions"))
    )


def changed_values(values: DataFrame) -> DataFrame:
    """Keys of the values that were not in their one form; repeated rows count once."""
    return unify_values(values).where("changed").select("tbl", "record_key", "field").distinct()
