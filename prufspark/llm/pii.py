"""Problem 3: personal information in free text.

Detection runs on an aligned form of the text (one form of characters, words joined over line
ends) whose positions lead back to the stored text. Formats give emails, phones and personal
numbers; street grammars of four languages give addresses; names come from lexicons that grouped
aggregation learns from titles and forms of address across the whole corpus.

Replacement is by keyed surrogates inside typed placeholders: forms of one entity get forms of one
surrogate (coreference), digits go through a keyed permutation of their format, names get names of the
same gender and script, streets and towns keep their words of place; a grouped collision check, repeated
until none is left, lengthens surrogates that two entities would share or that really occur.

Defined results: null and empty values have no items and stay as they are; repeated rows count once.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.llm.deliver import ENTRIES, MOST, deliver
from prufspark.llm.unify import transducer
from prufspark.plans.lineage import cut

# Titles and forms of address before a name.
CAPITAL_TITLES = """herr herrn frau hr hrn fr frl wm wmin kpl gfr pol mme mlle m me madame monsieur mademoiselle maître sig sigra sig.ra signor signora
signore dott dott.ssa avv mr mrs ms miss dr prof pc sgt insp cpl adj sr sra señor señora dhr mevr""".split()
SMALL_TITLES = "sig sigra sig.ra signor signora signore dott dott.ssa avv dr prof med iur lic ing dipl phil rer nat oec dhr mevr".split()
FEMALE = {"frau", "fr", "frl", "wmin", "mme", "mlle", "madame", "mademoiselle", "sigra", "sig.ra", "signora", "dott.ssa", "mrs", "ms", "miss", "sra", "señora", "mevr"}


def _capitals(words: list[str]) -> str:
    forms = {w.capitalize() for w in words} | {w.upper() for w in words} | {"Sig.ra", "Dott.ssa"}
    return "|".join(sorted(map(re.escape, forms), key=len, reverse=True))


TITLE = rf"(?:{_capitals(CAPITAL_TITLES)}|{'|'.join(sorted(map(re.escape, SMALL_TITLES), key=len, reverse=True))})\.?"
TITLE_TOKENS = {w + dot for w in (*(f(x) for x in CAPITAL_TITLES for f in (str.capitalize, str.upper)), "Sig.ra", "Dott.ssa", *SMALL_TITLES) for dot in ("", ".")}
TITLE_TOKENS |= {a + q + t for t in ("avv.", "ing.", "avv") for a in "Ll" for q in "'’"}
CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)*"
TITLED = re.compile(rf"((?:(?:[Ll]['’])?{TITLE}\s+)+)((?:{CAP}|[^\W\d_]\.)(?:\s+{CAP}){{0,2}})(?=\s|[,;.:)|]|$)")
# Words before "M." that make it a form of address; elsewhere it is an initial.
BEFORE_MONSIEUR = re.compile(r"(?:[.!?»”:]|\b(?:selon|de|par|à|pour|et|que|chez|avec|sur|contre))\s*$", re.I)
BEFORE_TITLE = re.compile(rf"(?<![\w@+-])(?:[Ll]['’])?(?:{TITLE}\s+)+$")
WORD = re.compile(r"(?<![\w@+])[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)*(?![\w@+])")
INITIALS = re.compile(r"(?:(?<![\w.])[^\W\d_a-zß-öø-ÿ]\.\s*-?)+\s?$")
LEGAL = re.compile(r"\s*(?:&\s*(?:Söhne|Sohn|Co|Fils|Figli|Sons|Partner)|(?:Bau|Transporte|Logistik|Garage|Treuhand|Immobilien|Reisen|Holz|Metall|Technik|Elektro|Handels)?\s*(?:AG|SA|Sagl|Sàrl|GmbH|Holding|KG|OHG|Srl|S\.?p\.?A|Ltd|LLC|Inc|plc|BV|NV|Genossenschaft|Stiftung)\b)", re.I)

AT = r"\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?"
EMAIL = re.compile(rf"[\w.+%-]+(?:{AT})[\w-]+(?:\s?\.\s?[\w-]+)+", re.I)
PHONE = re.compile(r"[+0(](?<![\w.,'’/+-][+0(])(?:(?<=\+)\d{2,3}|(?<=0)0\d{2}|(?<=\()0\d{1,3}\)|(?<=0)\d{1,4})(?:[ ./-]{0,2}\(0\))?(?:[ ./-]{0,1}\d+)+(?![\w'’])")
SOCIAL = re.compile(r"(?<![\w.'’-])756[. ]?\d{4}[. ]?\d{4}[. ]?\d{2}(?![\w'’])")
INSEE = re.compile(r"[12](?<![\w.'’-][12]) ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w'’])")
FISCAL = re.compile(r"[A-Z](?<![\w-][A-Z])[A-Z]{5}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![\w-])")
PAPER = re.compile(r"[A-Z](?<![\w-][A-Z])\d[A-Z]\d{5}(?![\w-])")

NO = r"\d{1,4}(?:\s?[a-z](?![\w]))?(?:/\d{1,3})?"
# Endings of German street names.
STREET_ENDS = "strasse straße str. weg gasse platz allee gässli steig ufer quai rain halde matte promenade".split()
STREET_GAP = re.compile(r"\s(?=\d)(?:" + "|".join(rf"(?<={re.escape(v)}\s)" for e in STREET_ENDS for v in (e, e.upper(), e.capitalize())) + ")")
STREET_LEFT = re.compile(
    r"(?<![\w-])(?:(?:Alte[rsn]?|Neue[rsn]?|Unter[en]+|Ober[en]+|Kleine|Grosse|Hinter[en]+|Vorder[en]+|Lange|Sankt|St\.)\s)?[^\W\d_][\w.]*(?:-\s?[\w.]+)*$", re.I
)
STREET_NO = re.compile(rf"{NO}(?!\w)", re.I)
STREETS = [
    # Words of which one stands in any such address, and the grammar.
    (None, re.compile(rf"(?<![\w-])(?:Im|Am|An der|In der|Auf der|Auf dem|Zum|Zur|Beim|Hinter der)\s[A-ZÄÖÜ][^\W\d_]+\s{NO}(?=\s*(?:[,;|./\n]|$|//)|\s(?:in|kam|und|CH-)\b)(?!\w)")),
    ("rue route rte chemin ch. avenue av. boulevard bd place pl. impasse allée quai ruelle sentier passage cours square", re.compile(rf"(?<![\w,.'’/-]){NO},?\s(?:bis\s|ter\s)?(?:rue|route|rte|chemin|ch\.|avenue|av\.|boulevard|bd|place|pl\.|impasse|allée|quai|ruelle|sentier|passage|cours|square)\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’]|le\s|la\s|les\s)?[^\W\d_][\w'’-]*", re.I)),
    ("rue route rte chemin ch. avenue av. boulevard bd place pl. impasse allée quai ruelle sentier passage cours square", re.compile(rf"(?<![\w-])(?:rue|route|rte|chemin|ch\.|avenue|av\.|boulevard|bd|place|pl\.|impasse|allée|quai|ruelle|sentier|passage|cours|square)\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’]|le\s|la\s|les\s)?[^\W\d_][\w'’-]*,?\s{NO}(?![\w]|[.,]\d)", re.I)),
    ("via viale piazza piazzale piazzetta vicolo strada corso largo contrada salita riva", re.compile(rf"(?<![\w-])(?:via|viale|piazza|piazzale|piazzetta|vicolo|strada|corso|largo|contrada|salita|riva)\s(?:(?!km\b)[^\W\d_]+['’]?\s?){{1,4}}?,?\s{NO}(?![\w]|[.,]\d)", re.I)),
    ("street road lane close avenue drive court way place square terrace gardens hill row mews crescent walk grove rd st", re.compile(rf"(?<![\w,.'’/-])(?:(?:Flat|Unit|Apt\.?|Apartment|Suite)\s\d+[a-z]?,\s)?{NO}\s(?:[^\W\d_][\w'’-]*\s){{1,3}}(?:Street|Road|Lane|Close|Avenue|Drive|Court|Way|Place|Square|Terrace|Gardens|Hill|Row|Mews|Crescent|Walk|Grove|Rd|St)\b(?!\.?\w)", re.I)),
]
STREETS = [(frozenset(w.split()) if w else None, rx) for w, rx in STREETS]
BREAKS = re.compile(r"([^\W\d_])-[ \t]*\n\s*([^\W\d_])|\n")


def aligned(text: str) -> tuple[str, list[int] | None]:
    """A form to match on and, where it differs in length, the offset in ``text`` of each of its characters."""
    f = transducer()
    if f(text) == text:
        if "-\n" not in text and "- \n" not in text:
            return text.replace("\n", " "), None
        return _joined(text, list(range(len(text))))
    out: list[str] = []
    pos: list[int] = []
    i = 0
    for m in f.unit.finditer(text):
        for k in range(i, m.start()):
            out.append(text[k])
            pos.append(k)
        run = m.group()
        form = f(run) or ""
        if form == run:
            out += run
            pos += range(m.start(), m.end())
        else:
            # Each source character keeps its place; what it composes with goes to the base.
            at = 0
            for k, c in enumerate(run):
                piece = f.single.get(c, c)
                for _ in piece:
                    if at < len(form) and not (_is_mark(c) and at):
                        out.append(form[at])
                        pos.append(m.start() + k)
                        at += 1
        i = m.end()
    for k in range(i, len(text)):
        out.append(text[k])
        pos.append(k)
    s = "".join(out)
    return _joined(s, pos) if "\n" in s else (s, pos)


def _joined(s: str, pos: list[int]) -> tuple[str, list[int]]:
    """Line ends become spaces; a word cut by a hyphen at a line's end is one word."""
    parts: list[str] = []
    where: list[int] = []
    i = 0
    for m in BREAKS.finditer(s):
        parts.append(s[i : m.start()])
        where += pos[i : m.start()]
        if m.group() == "\n":
            parts.append(" ")
            where.append(pos[m.start()])
        else:
            glue = "-" if m.group(2).isupper() else ""
            parts.append(m.group(1) + glue + m.group(2))
            where += [pos[m.start()], *([pos[m.start() + 1]] if glue else []), pos[m.end() - 1]]
        i = m.end()
    parts.append(s[i:])
    where += pos[i:]
    return "".join(parts), where


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


@dataclass
class Lexicon:
    surnames: set[str] = field(default_factory=set)
    given: dict[str, str] = field(default_factory=dict)

    def mentions(self, text: str) -> bool:
        """Does any surname stand in the text?"""
        if not self.surnames:
            return False
        got = self.__dict__.get("_automaton")
        if got is None:
            got = self.__dict__["_automaton"] = automaton(self.surnames)
        return next(got.iter(text.casefold()), None) is not None

    def __getstate__(self) -> dict:
        return {"surnames": self.surnames, "given": self.given}


def automaton(words: set[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def titled_words(text: str) -> Iterator[tuple[str, str, str]]:
    """``(role, word, gender)`` evidence of one text: single words after titles, first and last of two or three."""
    words = text.split()
    if TITLE_TOKENS.isdisjoint(words):
        return
    for i, w in enumerate(words):
        if w not in TITLE_TOKENS or i and words[i - 1] in TITLE_TOKENS:
            continue
        m = TITLED.match(" ".join(words[i : i + 8]))
        if not m:
            continue
        titles = [re.sub("^[Ll]['’]", "", t).strip(".").lower() for t in m.group(1).split()]
        named = []
        for x in m.group(2).split():
            if not x[0].isupper():
                break
            named.append(x)
        gender = "f" if any(t in FEMALE for t in titles) else "m"
        if len(named) == 1 and not named[0].endswith("."):
            yield "single", named[0].casefold(), gender
        elif len(named) > 1:
            for x in named[:-1]:
                yield "first", x.casefold(), gender
            yield "last", named[-1].casefold(), gender


ANY_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def learn(values: DataFrame) -> DataFrame:
    """``(word, role, gender)``: the lexicon of surnames (``s``) and given names (``g``) of the whole corpus.

    Candidates are words behind titles, counted with how often each occurs at all. Surnames are words single behind a
    title; given names stand before another name there. Both must do so in at least a fiftieth of all their
    occurrences. One use is enough at any size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        uses: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = [*seen, *(("any", w, "") for w in uses)]
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([*seen.values(), *uses.values()], pa.int64())], names=["role", "word", "gender", "n"])
            seen.clear()
            uses.clear()
            return out

        for b in batches:
            for t in b.column("value").to_pylist():
                if t:
                    seen.update(titled_words(t.replace("\n", " ")))
                    found = ANY_WORD.findall(t.casefold())
                    uses.update(found)
                    uses.update(p for w in found if not w.isalpha() for p in re.split("['’-]", w))
            if len(uses) > 300_000:
                yield flush()
        if seen or uses:
            yield flush()

    n = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0)).alias(role)
    female = F.sum(F.when((F.col("role") == "first") & (F.col("gender") == "f"), F.col("n")).otherwise(0)).alias("female")
    per = values.select("value").mapInArrow(count, "role string, word string, gender string, n bigint").groupBy("word").agg(n("single"), n("first"), n("last"), n("any"), female)
    # Words glued to others by signs are no words of their own there: a name counts at least as often as it is titled.
    often = F.greatest("any", "single", "first")
    given = (F.col("first") * 50 >= often) & (F.col("first") > F.col("single")) & (F.length("word") >= 2)
    surname = (F.col("single") > 0) & (F.col("single") * 50 >= often) & (F.col("single") >= F.col("first")) & (F.length("word") >= 3)
    return cut(per.where(given | surname).select("word", F.when(given, "g").otherwise("s").alias("role"), F.when(2 * F.col("female") >= F.col("first"), "f").otherwise("m").alias("gender")))


def lexicon_of(entries: dict[str, str]) -> Lexicon:
    """The lexicon from ``{word: role and gender}``; kept with the mapping's last use, as batches share one."""
    got = _LAST.get("of")
    if got is None or got[0] is not entries:
        out = Lexicon()
        for word, v in entries.items():
            if v[0] == "s":
                out.surnames.add(word)
            else:
                out.given[word] = v[1]
        got = _LAST["of"] = (entries, out)
    return got[1]


_LAST: dict = {}


def capital_words(text: str) -> set[str]:
    return {w.casefold() for w in WORD.findall(aligned(text)[0]) if w[0].isupper()}


def with_lexicon(values: DataFrame, names: DataFrame, most: int = MOST) -> tuple[DataFrame, Callable[[pa.RecordBatch], dict[str, str]]]:
    """``values(tbl, record_key, value)`` and the names each batch of them needs."""
    return deliver(values.select("tbl", "record_key", "value"), "value", names.select(F.col("word").alias("key"), F.concat("role", "gender").alias("value")), capital_words, most)


TOWN = re.compile(r"(?:,?\s(?:CH-|D-|F-|I-|A-)?\d{4,5}\s|,?\s(?:in|à|a|im)\s)(?:St\.\s|Val-)?[^\W\d_][\w'’-]*")


def streets(text: str) -> Iterator[tuple[int, int]]:
    """Spans of street and number."""
    for m in STREET_GAP.finditer(text):
        from_ = max(0, m.start() - 60)
        left = STREET_LEFT.search(text[from_ : m.start()])
        no = STREET_NO.match(text, m.end())
        if left and no:
            yield from_ + left.start(), no.end()
    words = {w.strip(".,;:()|") for w in text.lower().split()}
    for keys, rx in STREETS:
        if keys is None or not keys.isdisjoint(words) or "av." in text or "ch." in text:
            for m in rx.finditer(text):
                yield m.span()


def monsieur(text: str, m: re.Match) -> bool:
    """Is the "M." before a family name a form of address?"""
    if m.group().strip() != "M.":
        return False
    before = text[max(0, m.start() - 12) : m.start()].rstrip()
    return bool(BEFORE_MONSIEUR.search(before)) if before else len(text) >= 200


def find(text: str, lex: Lexicon) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in the given form, in order, not overlapping."""
    taken: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if not any(a < y and x < b for _, x, y in taken):
            taken.append((kind, a, b))

    digits = any(c.isdigit() for c in text)
    if "@" in text or "at]" in text.lower() or "at)" in text.lower():
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end())
    if digits:
        for rx in (SOCIAL, FISCAL, PAPER, INSEE) if "756" in text else (FISCAL, PAPER, INSEE):
            for m in rx.finditer(text):
                add("id", m.start(), m.end())
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 9 <= n <= 15 and not re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", m.group()):
                add("phone", m.start() + (m.group()[0] == "("), m.end())
        for a, b in streets(text):
            town = TOWN.match(text, b)
            add("address", a, town.end() if town else b)
    if not lex.mentions(text):
        return sorted(taken, key=lambda x: x[1])
    low = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text) if m.group()[0].isupper()]
    i = 0
    while i < len(low):
        a, b, w = low[i]
        key = w.casefold()
        if key not in lex.surnames and key not in lex.given:
            i += 1
            continue
        j = i
        while j + 1 < len(low) and re.fullmatch(r",?\s+", text[low[j][1] : low[j + 1][0]]) and (low[j + 1][2].casefold() in lex.surnames or low[j + 1][2].casefold() in lex.given):
            comma = "," in text[low[j][1] : low[j + 1][0]]
            if comma and not (j == i and low[j][2].casefold() in lex.surnames and low[j + 1][2].casefold() in lex.given):
                break
            j += 1
        run = low[i : j + 1]
        kinds = ["s" if x[2].casefold() in lex.surnames else "g" for x in run]
        begin, end = run[0][0], run[-1][1]
        initials = INITIALS.search(text, max(0, begin - 12), begin) if kinds[0] == "s" else None
        if initials and initials.group().strip() and not monsieur(text, initials):
            begin = initials.start() + (len(initials.group()) - len(initials.group().lstrip()))
        titled = BEFORE_TITLE.search(text, max(0, run[0][0] - 40), run[0][0])
        full = "s" in kinds and ("g" in kinds or begin < run[0][0])
        firm = LEGAL.match(text, end)
        zip_code = re.search(r"\d{4,5}\s$", text[max(0, begin - 6) : begin])
        if "s" in kinds and (full or titled) and not firm and not (zip_code and not full):
            add("name", begin, end)
        i = j + 1
    return sorted(taken, key=lambda x: x[1])


def found_items(values: DataFrame, names: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """``(tbl, record_key, value)`` to ``(tbl, record_key, kind, start_pos)``, 1-based in the stored text."""
    rows, entries = with_lexicon(values, names if names is not None else learn(values), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, starts = [], [], []
            lex = lexicon_of(entries(b))
            for i, t in enumerate(b.column("value").to_pylist()):
                if not t:
                    continue
                form, pos = aligned(t)
                for kind, a, _ in find(form, lex):
                    rows.append(i)
                    kinds.append(kind)
                    starts.append((pos[a] if pos else a) + 1)
            out = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([out.column("tbl"), out.column("record_key"), pa.array(kinds, pa.string()), pa.array(starts, pa.int64())], names=["tbl", "record_key", "kind", "start_pos"])

    return rows.mapInArrow(run, "tbl string, record_key string, kind string, start_pos bigint").distinct()


def personal_values(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    c = chunks.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select(F.lit("chunks").alias("tbl"), F.col("id").alias("record_key"), F.col("text").alias("value"))
    value = F.col("facts.beschuldigte_person.value")
    r = facts.where(F.col("file_name").isNotNull() & value.isNotNull()).select(F.lit("reference_facts").alias("tbl"), F.col("file_name").alias("record_key"), value.alias("value"))
    return c.unionByName(r)


# Surrogates -----------------------------------------------------------------------------------
#
# Entities are taken apart into units, whose surrogates are put together again in the format of the stored text: words of
# names, streets, towns and mails, and runs of digits. Forms of one entity (initial and given name, a phone number with and
# without the country's code, "str." and "strasse") share their units, so they stay forms of one entity.

# Sounds of the alphabets that surrogates are made of, consonants, vowels and endings by role.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v w z".split(), "a e i o u au ei ie".split(), {"f": "a ea ina ia elle ine".split(), "m": "o in ar us er an".split(), "s": "berg mann wald hofer rieder acher inger".split()}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"f": "а ия ина ела".split(), "m": "ан ор ий ен".split(), "s": "ов ин ский енко".split()}),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο ου".split(), {"f": "α η ία ίνα".split(), "m": "ος ης ας".split(), "s": "ίδης όπουλος άκης ίου".split()}),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
# Short forms of street words and the full ones, and words of addresses that are kept.
STREET_SHORT = {"str": "strasse", "straße": "strasse", "rte": "route", "ch": "chemin", "av": "avenue", "bd": "boulevard", "pl": "place", "rd": "road"}
ADDRESS_WORDS = set("""strasse straße str weg gasse platz allee steig ufer quai rain rue route rte chemin avenue av boulevard bd place pl impasse allée ruelle
sentier passage cours square via viale piazza piazzale piazzetta vicolo strada corso largo contrada salita riva street road lane close drive court way terrace
gardens hill row mews crescent walk grove rd st flat unit apt apartment suite im am an der in auf dem zum zur beim hinter de la des du le les d l à a bis ter
alla alle al del della dei di alte alter altes neue neuer kleine grosse obere untere lange sankt ch""".split())
# Codes of countries before a phone number.
COUNTRY = re.compile(r"(?:\+|00)(41|49|43|423|33|39|44|31|32|34|351|352|30|7|1|\d{2})")
UNIT_WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[^\W\d_]+|\d+")


def _keyed(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:12], "big")


def alphabet_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def moved_letter(key: bytes, letter: str) -> str:
    """A keyed one-to-one map of an alphabet's letters: initials move with the names they stand for."""
    alphabet = ALPHABETS[alphabet_of(letter)]
    base = unicodedata.normalize("NFD", letter.casefold())[0]
    order = sorted(alphabet, key=lambda c: _keyed(key, "letter", c))
    return order[alphabet.find(base)] if base in alphabet else order[0]


def made_word(key: bytes, role: str, word: str, salt: int = 0) -> str:
    """A pronounceable word of the key in the alphabet of ``word``; ``role`` (f, m, s) chooses the ending and with it gender
    or family name, and the first letter depends on the first letter only. Each salt adds a syllable."""
    consonants, vowels, ends = SOUNDS[alphabet_of(word)]
    n = _keyed(key, "word", role, word, str(salt))
    out = moved_letter(key, word[0])
    for i in range(2 + salt):
        if i or out[0] in vowels:
            n, a = divmod(n, len(consonants))
            out += consonants[a]
        n, b = divmod(n, len(vowels))
        out += vowels[b]
    n, c = divmod(n, len(consonants))
    return out + consonants[c] + ends[role][n % len(ends[role])]


def permuted_digits(key: bytes, kind: str, digits: str) -> str:
    """A keyed one-to-one map of digit strings of one length (alternating Feistel rounds), so no two collide."""
    n = len(digits)
    if n == 1:
        return str(sorted(range(10), key=lambda d: _keyed(key, kind, str(d))).index(int(digits)))
    if n == 0:
        return digits
    h = n // 2
    a, b = digits[:h], digits[h:]
    for r in range(6):
        if r % 2:
            a = str((int(a) + _keyed(key, kind, str(r), b)) % 10 ** len(a)).zfill(len(a))
        else:
            b = str((int(b) + _keyed(key, kind, str(r), a)) % 10 ** len(b)).zfill(len(b))
    return a + b


def street_stem(word: str) -> tuple[str, str]:
    """Stem and ending of a word such as "Rebgasse"; no ending for others."""
    low = word.casefold()
    for e in sorted((x.strip(".") for x in STREET_ENDS), key=len, reverse=True):
        if low.endswith(e) and len(low) > len(e) + 1:
            return low[: -len(e)], STREET_SHORT.get(e, e)
    return low, ""


def units_of(kind: str, item: str, lex: Lexicon) -> list[tuple[str, str]]:
    """``(role, word)`` of the words in an item that get surrogates: roles f, m and s of names, p of places, e of mails."""
    out = []
    if kind == "name":
        for w in UNIT_WORD.findall(item):
            if len(w) > 1:
                low = w.casefold()
                whole = next((x.casefold() for x in WORD.findall(item) if low in x.casefold().split("-")), low)
                out.append((lex.given.get(low) or lex.given.get(whole) or "s", low))
    elif kind == "address":
        for w in UNIT_WORD.findall(item):
            if len(w) > 1 and w.casefold() not in ADDRESS_WORDS:
                out.append(("p", street_stem(w)[0]))
    elif kind == "email":
        for w in UNIT_WORD.findall(re.split(AT, item, maxsplit=1)[0]):
            low = w.casefold()
            out.append((lex.given.get(low) or ("s" if low in lex.surnames else "e"), low))
    return out


def unit_surrogate(key: bytes, role: str, word: str, salt: int = 0) -> str:
    return made_word(key, role if role in "fm" else "s", word, salt)


def recased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def surrogate(key: bytes, kind: str, item: str, lex: Lexicon, salts: dict[tuple[str, str], int] | None = None) -> str:
    """The replacement of an item, of its kind and format; forms of one entity get forms of one surrogate."""
    salts = salts or {}
    made = lambda role, w: unit_surrogate(key, role, w, salts.get((role, w), 0))
    if kind == "name":
        roles = dict((w, r) for r, w in units_of(kind, item, lex))
        return UNIT_WORD.sub(lambda m: recased(m.group(), made(roles[m.group().casefold()], m.group().casefold())) if len(m.group()) > 1 else moved_letter(key, m.group()).upper(), item)
    if kind == "email":
        roles = dict((w, r) for r, w in units_of(kind, item, lex))
        local = re.split(AT, item, maxsplit=1)[0]
        new = PARTS.sub(lambda m: permuted_digits(key, "mail", m.group()) if m.group().isdigit() else made(roles[m.group().casefold()], m.group().casefold()), local)
        return f"{new}@{made_word(key, 's', item[len(local):].casefold().lstrip('@') or 'x')[:12]}.example"
    if kind == "address":

        def part(m: re.Match) -> str:
            w = m.group()
            if w.isdigit():
                return w[0] + permuted_digits(key, "zip", w[1:]) if len(w) > 3 else str(1 + int(permuted_digits(key, "house", w)) % (10 ** len(w) - 1) if int(w) else 0)
            if len(w) == 1 or w.casefold() in ADDRESS_WORDS:
                return w
            stem, end = street_stem(w)
            return recased(w, made("p", stem) + end)

        return PARTS.sub(part, item)
    plain = "".join(c for c in item if c.isdigit())
    if kind == "phone":
        code = COUNTRY.match(item)
        head = len(re.sub(r"\D", "", code.group())) if code else 0
        own = plain[head:].removeprefix("0") if code else plain.lstrip("0")
        new = iter(plain[: len(plain) - len(own)] + own[:2] + permuted_digits(key, "phone" + own[:2], own[2:]))
    else:
        keep = 3 if len(plain) >= 13 else 0
        new = iter(plain[:keep] + permuted_digits(key, kind, plain[keep:]))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "".join(next(new) if c.isdigit() else letters[(letters.find(c.upper()) + _keyed(key, "letter", str(i))) % 26] if kind == "id" and c.isascii() and c.isalpha() else c for i, c in enumerate(item))


def distinct_units(units: DataFrame, key: bytes) -> DataFrame:
    """``units(role, word)`` to the salts ``(role, word, salt)`` over zero that keep all surrogates apart.

    Of units that share a surrogate the first keeps it; one that makes a word which really occurs keeps nothing. The
    others take the next salt, round by round, until none clashes. Grouped counts decide; nothing is collected."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [unit_surrogate(key, r, w, n) for r, w, n in zip(*(b.column(c).to_pylist() for c in ("role", "word", "salt")))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.string())], names=["role", "word", "salt", "made"])

    schema = "role string, word string, salt int, made string"
    state = cut(units.distinct().withColumn("salt", F.lit(0)).mapInArrow(make, schema))
    while True:
        # Words of names share one list, so that a surrogate of a given name is no surname either.
        first = state.groupBy("made").agg(F.min(F.struct("salt", "word")).alias("first"))
        real = state.select(F.col("word").alias("made")).distinct().withColumn("real", F.lit(True))
        judged = state.join(first, "made").join(real, "made", "left")
        judged = cut(judged.withColumn("clash", F.col("real").isNotNull() | (F.col("first.word") != F.col("word"))).select("role", "word", "salt", "made", "clash"))
        if judged.where("clash").limit(1).count() == 0:
            break
        again = judged.where("clash").select("role", "word", (F.col("salt") + 1).alias("salt")).mapInArrow(make, schema)
        state = judged.where("not clash").drop("clash").unionByName(again)
    return judged.where("salt > 0").select("role", "word", "salt")


def pseudonymised(values: DataFrame, key: bytes, names: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """``(tbl, record_key, text)`` with each item as ``[KIND surrogate]``. The key is the caller's secret."""
    if not key:
        raise ValueError("a key is needed")
    names = names if names is not None else learn(values)
    rows, entries = with_lexicon(values.where("value is not null"), names, most)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lex, got = lexicon_of(entries(b)), set()
            for t in b.column("value").to_pylist():
                form, _ = aligned(t)
                for kind, x, y in find(form, lex):
                    got.update(units_of(kind, form[x:y], lex))
            cols = list(zip(*got)) if got else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["role", "word"])

    salts = cut(distinct_units(rows.mapInArrow(units, "role string, word string"), key))
    salts = salts.groupBy("word").agg(F.concat_ws(",", F.collect_list(F.concat_ws(":", "role", "salt"))).alias("value")).withColumnRenamed("word", "key")
    words = lambda t: {x for w in UNIT_WORD.findall(aligned(t)[0]) for x in (w.casefold(), street_stem(w)[0])}
    rows, salted = deliver(rows.withColumnRenamed(ENTRIES, "_names"), "value", salts, words, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lex = lexicon_of(entries(b.rename_columns([{"_names": ENTRIES, ENTRIES: "_salts"}.get(c, c) for c in b.schema.names])))
            known = {(r, w): int(n) for w, v in salted(b).items() for r, n in (x.split(":") for x in v.split(","))}
            out = []
            for t in b.column("value").to_pylist():
                form, pos = aligned(t)
                at, parts = 0, []
                for kind, x, y in find(form, lex):
                    i, j = (pos[x], pos[y - 1] + 1) if pos else (x, y)
                    parts += [t[at:i], f"[{kind.upper()} {surrogate(key, kind, form[x:y], lex, known)}]"]
                    at = j
                out.append("".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("record_key"), pa.array(out, pa.string())], names=["tbl", "record_key", "text"])

    return rows.mapInArrow(run, "tbl string, record_key string, text string").distinct()
