"""Problem 6: repair text of scanned pages.

Corpus statistics come first: word counts, and skeletons of lines that stand alone by the page's layout.
Rare words are joined in SQL with frequent words whose anagram hash differs by that of a known confusion;
the most frequent partner is the correction. Edge lines are removed when their skeleton recurs or they are
page numbers; a hyphen at a line's end is dropped when the joined word has better evidence than the
hyphenated one.

All evidence is counted per word and per skeleton and asks for fixed numbers, so what is found does not
depend on how much other text there is. It reaches the texts through ``deliver``, which joins what is large.

Defined results: null and empty texts have no lines to report and stay as they are; a repeated
row counts once; lines are counted over ``\\n``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.llm.deliver import MOST, deliver
from prufspark.llm.unify import transducer
from prufspark.plans.lineage import cut

# What was printed, and what recognition makes of it (lower case).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("u", "ii"), ("ü", "ii"), ("n", "ri"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("h", "li"),
    ("w", "vv"), ("g", "q"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("b", "8"), ("t", "†"), ("i", "l"), ("l", "i"),
    ("u", "n"), ("n", "u"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("z", "2"), ("g", "9"), ("l", "|"), ("i", "|"),
    ("é", "e'"), ("è", "e'"), ("ê", "e'"), ("à", "a'"), ("ä", "a'"), ("ö", "o'"), ("ü", "u'"), ("ä", 'a"'), ("ö", 'o"'), ("ü", 'u"'), ("ò", "o'"), ("ù", "u'"), ("ì", "i'"),
]
# Digits and the letters that recognition makes of them.
DIGIT_FORMS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8"})
RATIO = 20
PRIME = (1 << 61) - 1
# A word is evidence from so many occurrences on, however large the corpus.
LEAST = 5
# A line's skeleton is furniture when it stands alone so many times.
EDGE_LEAST = 3
# Narrower pages than this are taken to be so wide.
PAGE_WIDTH = 50

WORD = re.compile(r"[\w†|]+(?:-[\w†|]+)*")
LETTER = re.compile(r"[^\W\d_]")
PLAIN = re.compile(r"[\w†|]+")
MIXED = re.compile(r"\d[OolISB]|[OolISB]\d")
DIGIT_WORD = re.compile(r"(?<![\w†])[\dOolISB]+(?:(?<=\d)[.,:][\dOolISB]+|[.,](?=[\dOolISB]*\d)[\dOolISB]+)*(?![\w†])")
# Words with a sign in place of an accent, as in "unvollsta'ndig".
SIGNED = re.compile(r"(?<![\w†|])[^\W\d_][\w†|]*+(?:(?<=[aeiouAEIOU])['\"][\w†|]*+)+")
TOKEN = re.compile(SIGNED.pattern + r"|[\w†|]+(?:-[\w†|]+)*")
ADDRESS = re.compile(r"\S*(?:@|\[at\]|\(at\)|www\.|://|_)\S*")
BREAK = re.compile(r"([^\W\d_](?:[\w†'’|-]*[^\W\d_†|]|[\w†|]*)?)[-¬­‐‑]\s*$")
HYPHENS = tuple('-¬\xad‐‑')
GLUE = re.compile(r"[@_/\d]|www\.")
DIGIT = r"[\dOolISB|]"
NUMBER = rf"{DIGIT}{{1,4}}"
LABEL = r"(?:seit[ec]|blatt|pag[ei]na|pag[ec]|pág|pag|pp?|s|sida|pagina|стр|σελ|หน้า)\.?"
PAGE = re.compile(
    rf"(?:[-~–—]\s?{NUMBER}\s?[-~–—]|\[\s?{NUMBER}\s?\]|(?:{LABEL}\s*)?{NUMBER}\s*(?:/|von|of|sur|di|de|van|из)\s*{NUMBER}|{LABEL}\s*{NUMBER}|{NUMBER})", re.I
)
SEPARATOR = r"(?:\s*[|·•]\s*|\s{2,}|\s+[–—-]\s+)"
LEAD = re.compile(rf"^\s*({PAGE.pattern}){SEPARATOR}(?=\S)", re.I)
TAIL = re.compile(rf"{SEPARATOR}({PAGE.pattern})\s*$", re.I)
# Scripts in which the end of a sentence may have no sign.
UNCASED = re.compile("[\u0e00-\u0eff\u3040-\u9fff\uac00-\ud7af]")
CLOSED = re.compile(r"[.!?…:;,。！？؟]['\"»”“’)\]]*\s*$")
FOLDS = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("c", "e"), ("q", "g"), ("†", "t"), ("1", "l"), ("0", "o"), ("5", "s"), ("8", "b"), ("|", "l")]


def anagram_hash(word: str) -> int:
    """Sum over characters of the fifth power of the code point, modulo 2**61 - 1.

    The hash of a word with one part replaced differs by a constant of the two parts."""
    return sum(ord(c) ** 5 for c in word) % PRIME


def fold(s: str) -> str:
    """A form in which a phrase and its misreadings mostly agree."""
    s = re.sub(r"[^\w†|]+", " ", s.lower())
    for wrong, right in FOLDS:
        s = s.replace(wrong, right)
    return s


NUMBERED = re.compile(r"\d")
PLACE = "ª"  # Stands for a number in a skeleton.


def without_page(line: str) -> tuple[bool, str]:
    """Does the line hold a page number set apart at an end, and the rest of the line."""
    if any(c in line for c in "|·•–—-") or "  " in line:
        for rx in (LEAD, TAIL):
            m = rx.search(line)
            if m:
                return True, line[: m.start()] + line[m.end() :]
    return False, line


def skeleton_of(line: str) -> tuple[str, int]:
    """The line's words as misreadings leave them, numbers as ``PLACE``, and how many numbers; empty for a single word, a
    number in front and more than two numbers."""
    words = line.split()
    numbered = [NUMBERED.search(w) is not None for w in words]
    n = sum(numbered)
    if len(words) < 2 or numbered[0] or n > 2:
        return "", 0
    return fold(" ".join(PLACE if is_number else w for w, is_number in zip(words, numbered))).strip(), n


def standing_out(lines: list[str]) -> list[tuple[int, bool, str, bool]]:
    """``(line, has a page number, skeleton, stands alone)`` of lines that may be furniture: page numbers, and lines
    without a sentence end. A line stands alone when the next word would have fitted on it (the last one is left open);
    others count with exactly one number only. Texts that have more lone lines than others are lists. A skeleton without
    a number is marked ``=`` and given only where the line breaks into a sentence, which headings do not."""
    out = list(_standing_out(lines))
    if 2 * sum(alone for *_, k, alone in out if k) > sum(1 for x in lines if x.strip()):
        out = [(i, paged, "", alone) for i, paged, _, alone in out if paged]
    return out


def _standing_out(lines: list[str]) -> Iterator[tuple[int, bool, str, bool]]:
    if len(lines) < 2:
        return
    width = max(PAGE_WIDTH, *map(len, lines))
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or CLOSED.search(s) or s[0] in "„«\"'“(•":
            continue
        if len(s) <= 30 and PAGE.fullmatch(s):
            yield i, True, "", True
            continue
        if s[0].islower():
            continue
        following = next((x for x in lines[i + 1 :] if x.strip()), "")
        alone = following != "" and len(s) + 1 + len(following.split(None, 1)[0]) <= width
        paged, rest = without_page(s)
        # Cheap tests before the words are looked at.
        if not (alone or paged or NUMBERED.search(rest)) or UNCASED.search(s):
            continue
        skeleton, n = skeleton_of(rest) if alone or paged or sum(NUMBERED.search(w) is not None for w in rest.split()) == 1 else ("", 0)
        if skeleton and not n:
            before = next((x for x in reversed(lines[:i]) if x.strip()), "")
            inside = before and not CLOSED.search(before) and following and following.lstrip()[0].islower()
            skeleton = "=" + skeleton if inside else ""
        if paged or skeleton:
            yield i, paged, skeleton, alone


def clean_lines(text: str) -> list[str]:
    return transducer()(text.replace("­\n", "-\n")).split("\n")


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """``(kind, key, n)``: word counts (``w``) and skeletons of lines that stand out (``e``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        edges: Counter = Counter()
        out = []

        def flush() -> pa.RecordBatch:
            keys = [*words, *edges]
            b = pa.RecordBatch.from_arrays(
                [pa.array(["w"] * len(words) + ["e"] * len(edges), pa.string()), pa.array(keys, pa.string()), pa.array([*words.values(), *edges.values()], pa.int64())], names=["kind", "key", "n"]
            )
            words.clear()
            edges.clear()
            return b

        for b in batches:
            for t in b.column("text").to_pylist():
                if not t:
                    continue
                lines = clean_lines(t)
                low = "\n".join(lines).lower()
                found = WORD.findall(low)
                words.update(found)
                if "'" in low or '"' in low:
                    words.update(SIGNED.findall(low))
                words.update(p for w in found if "-" in w for p in w.split("-"))
                edges.update(k for _, _, k, alone in standing_out(lines) if k and alone)
            if len(words) > 500_000:
                out.append(flush())
                yield out.pop()
        if words or edges:
            yield flush()

    return chunks.select("text").mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(wrong, right, n, n_right)``: each rare word with its most frequent confusable word.

    Each word gives a row per confusion it may hold; an equi-join on the anagram hash shifted by the confusion's
    difference finds the words it may stand for, then an exact check that one replacement turns the right word
    into the wrong one."""

    @F.pandas_udf("bigint")
    def hashed(s):
        return s.map(anagram_hash)

    pairs = F.array(*[F.struct(F.lit(a).alias("good"), F.lit(b).alias("bad"), F.lit((anagram_hash(a) - anagram_hash(b)) % PRIME).cast("bigint").alias("delta")) for a, b in CONFUSIONS])
    w = words.where((F.length("key") >= 3) & F.col("key").rlike(r"\p{L}")).select("key", "n", hashed("key").alias("h"))
    frequent = w.where(F.col("n") >= LEAST).select(F.col("key").alias("right"), F.col("n").alias("n_right"), F.col("h").alias("h_right"))
    held = w.select(F.col("key").alias("wrong"), "n", "h", F.inline(F.filter(pairs, lambda x: F.contains(F.col("key"), x["bad"]))))
    rare = held.select("wrong", "n", "good", "bad", F.expr(f"pmod(h + delta, {PRIME}L)").alias("h_right"))
    met = rare.join(frequent, "h_right").where(F.col("n_right") >= ratio * F.col("n"))
    places = F.sequence(F.lit(1), F.length("wrong"))
    made = F.exists(
        places,
        lambda i: (F.substr("wrong", i, F.length("bad")) == F.col("bad"))
        & (F.concat(F.substr("wrong", F.lit(1), i - 1), F.col("good"), F.substr("wrong", i + F.length("bad"))) == F.col("right")),
    )
    best = F.max_by(F.struct("right", "n_right"), F.struct("n_right", "right"))
    return met.where(made).groupBy("wrong").agg(best.alias("b"), F.first("n").alias("n")).select("wrong", "b.right", "n", "b.n_right")


def line_break(line: str) -> re.Match | None:
    """The word that a hyphen at the line's end cuts; looked for only where there is one."""
    return BREAK.search(line) if line.rstrip()[-1:] in HYPHENS else None


class Evidence:
    """What a worker looks up in its entries: ``f`` wrong word to count and right word, ``c`` counts of words, ``e``
    skeletons of furniture."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.fixes: dict[str, tuple[int, str]] = {}
        self.counts: dict[str, int] = {}
        self.edges: set[str] = set()
        for k, v in entries.items():
            if k[0] == "f":
                n, right = v.split(" ", 1)
                self.fixes[k[1:]] = int(n), right
            elif k[0] == "c":
                self.counts[k[1:]] = int(v)
            else:
                self.edges.add(k[1:])

    def right(self, word: str) -> str | None:
        got = self.fixes.get(word)
        return got[1] if got else None

    def count(self, word: str) -> int:
        """Uses of the word, or of the one it was misread from."""
        got = self.fixes.get(word)
        return got[0] if got else self.counts.get(word, 0)

    def furniture(self, lines: list[str]) -> set[int]:
        out = set()
        for i, paged, skeleton, alone in standing_out(lines):
            if ((alone or paged or skeleton.count(PLACE) == 1) and skeleton in self.edges) or (paged and (not skeleton or PAGE.fullmatch(lines[i].strip()))):
                out.add(i)
        return out

    def wrong_word(self, text: str) -> bool:
        low = text.lower()
        known = self.fixes.keys()
        return not known.isdisjoint(PLAIN.findall(low)) or (("'" in low or '"' in low) and not known.isdisjoint(SIGNED.findall(low)))

    def suspect(self, text: str) -> bool:
        """May any line of the text be misread?"""
        return "†" in text or MIXED.search(text) is not None or self.wrong_word(text)

    def misread(self, line: str) -> bool:
        if "†" in line:
            return True
        plain = ADDRESS.sub(" ", line)
        return self.wrong_word(plain) or (MIXED.search(plain) is not None and any(wrong_number(m.group()) for m in DIGIT_WORD.finditer(plain)))

    def broken(self, line: str, following: str) -> bool:
        """Is the last word of ``line`` continued by ``following``, with a hyphen that is not its own?"""
        m = line_break(line)
        nxt = following.lstrip()
        if not m or not nxt or not LETTER.match(nxt):
            return False
        last = line.rstrip().split()[-1]
        first = nxt.split()[0]
        if GLUE.search(last) or "@" in first or "_" in first:
            return False
        if last[-1] == "¬":
            return True
        head = m.group(1).lower()
        tail = WORD.match(nxt)
        tail = tail.group().lower().split("-")[0] if tail else ""
        joined, whole = (max(map(self.count, x)) for x in break_words(head, tail))
        if joined or whole:
            return joined >= whole
        if first[0].isupper():
            return first.isupper() and len(first) > 1 and last.isupper()
        return tail not in ("und", "oder", "bzw", "et", "ou", "e", "o", "and", "or")


def break_words(head: str, tail: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """The words that a broken one may be: joined, and with its hyphen."""
    stem = head.rsplit("-", 1)[-1]
    return (head + tail, stem + tail), (head + "-" + tail, stem + "-" + tail)


_LAST: dict = {}


def evidence_of(entries: dict[str, str]) -> Evidence:
    """The evidence of a mapping; batches that share one share the evidence too."""
    got = _LAST.get("of")
    if got is None or got[0] is not entries:
        got = _LAST["of"] = (entries, Evidence(entries))
    return got[1]


def wrong_number(token: str) -> bool:
    """Digits with a letter that looks like one; short labels such as S13 are none."""
    digits = sum(c.isdigit() for c in token)
    if not digits or digits == len(token) or not re.search("[OolISB|]", token):
        return False
    if re.fullmatch(r"[SBIO]\d{1,2}", token):
        return False
    return digits >= 2 or (len(token) == 2 and token[-1] in "OolISB" and token[0].isdigit()) or re.search(r"\d[.,:][OolISB]|[OolISB][.,:]\d", token) is not None


def keys_of(text: str) -> set[str]:
    """All that ``Evidence`` may look up for a text."""
    lines = clean_lines(text)
    out = {"f" + w for t in TOKEN.findall("\n".join(lines).lower()) for w in (t, *t.split("-"))}
    out |= {"e" + k for _, _, k, _ in standing_out(lines) if k}
    ends = [(line_break(s), k) for k, s in enumerate(lines)]
    for m, k in ends:
        if m:
            # A line of furniture may stand between the parts of a word.
            for following in [x for x in lines[k + 1 :] if x.strip()][:4]:
                tail = WORD.match(following.lstrip())
                if tail:
                    for x in break_words(m.group(1).lower(), tail.group().lower().split("-")[0]):
                        out |= {p + w for w in x for p in "cf"}
    return out


def evidence(chunks: DataFrame) -> DataFrame:
    """``(key, value)`` over the whole corpus: corrections, counts of words and skeletons of furniture."""
    counts = cut(corpus_counts(chunks))
    words = counts.where("kind = 'w'").select("key", "n")
    fixes = corrections(words).select(F.concat(F.lit("f"), "wrong").alias("key"), F.concat_ws(" ", "n_right", "right").alias("value"))
    frequent = words.where((F.col("n") >= LEAST) & F.col("key").rlike(r"\p{L}")).select(F.concat(F.lit("c"), "key").alias("key"), F.col("n").cast("string").alias("value"))
    edges = counts.where((F.col("kind") == "e") & (F.col("n") >= EDGE_LEAST)).select(F.concat(F.lit("e"), "key").alias("key"), F.col("n").cast("string").alias("value"))
    return cut(fixes.unionByName(frequent).unionByName(edges))


def judge(text: str, e: Evidence) -> list[tuple[int, str]]:
    """``(line_no, kind)`` of one text."""
    lines = clean_lines(text)
    suspect = e.suspect("\n".join(lines))
    if len(lines) == 1:
        return [(1, "misread")] if suspect and e.misread(lines[0]) else []
    gone = e.furniture(lines)
    out = [(i + 1, "furniture") for i in sorted(gone)]
    kept = [i for i, s in enumerate(lines) if i not in gone and s.strip()]
    for i, j in zip(kept, kept[1:]):
        if e.broken(lines[i], lines[j]):
            out.append((i + 1, "broken"))
            head, tail = lines[i].rstrip()[:-1].split()[-1], lines[j].split()[0]
            cut_word = WORD.findall((head + tail).lower())
            right = e.right(cut_word[0]) if cut_word else None
            if right:
                # The character stands in one of the two lines.
                a = len(head)
                same = 0
                while same < min(len(right), a) and right[same] == cut_word[0][same]:
                    same += 1
                out.append((i + 1 if same < a else j + 1, "misread"))
    if suspect:
        out += [(i + 1, "misread") for i in kept if e.misread(lines[i])]
    return list(dict.fromkeys(out))


def damaged_lines(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """``(record_key, line_no, kind)`` with kind furniture, broken or misread, for ``chunks(id, text)``."""
    chunks = chunks.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows, entries = deliver(chunks, "text", evidence(chunks), keys_of, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = evidence_of(entries(b))
            keys, nos, kinds = [], [], []
            for k, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                for no, kind in judge(t, e):
                    keys.append(k)
                    nos.append(no)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int64()), pa.array(kinds, pa.string())], names=["record_key", "line_no", "kind"])

    return rows.mapInArrow(run, "record_key string, line_no bigint, kind string").distinct()


def repair(text: str, e: Evidence) -> str:
    """Running paragraphs: furniture removed, words joined, misreadings replaced, lines joined."""
    lines = clean_lines(text)
    gone = e.furniture(lines)
    paragraphs: list[str] = []
    now = ""
    kept = [(i, s) for i, s in enumerate(lines) if i not in gone]
    for k, (_, s) in enumerate(kept):
        if not s.strip():
            # A blank line inside a sentence is page layout, after its end a paragraph.
            if now and CLOSED.search(now):
                paragraphs.append(now)
                now = ""
            continue
        following = next((x for _, x in kept[k + 1 :] if x.strip()), "")
        s = s.strip()
        now += s[:-1] if e.broken(s, following) else s if line_break(s) and LETTER.match(following.lstrip() or "0") else s + " "
    if now:
        paragraphs.append(now)
    return corrected("\n\n".join(p.strip() for p in paragraphs), e)


def corrected(text: str, e: Evidence) -> str:
    """Misread words and numbers replaced, each where ``Evidence.misread`` finds it; addresses stay as they are."""

    def number(m: re.Match) -> str:
        return m.group().translate(DIGIT_FORMS) if wrong_number(m.group()) else m.group()

    def word(m: re.Match) -> str:
        w = _fixed(m.group(), e)
        return w.replace("†", "T" if w.isupper() else "t")

    at, out = 0, []
    for m in [*ADDRESS.finditer(text), None]:
        plain = text[at : m.start()] if m else text[at:]
        if MIXED.search(plain):
            plain = DIGIT_WORD.sub(number, plain)
        out.append(TOKEN.sub(word, plain))
        if m:
            out.append(m.group().replace("†", "t"))
            at = m.end()
    return "".join(out)


def _fixed(word: str, e: Evidence) -> str:
    right = e.right(word.lower())
    if right is None:
        if "-" in word:
            return "-".join(_fixed(p, e) for p in word.split("-"))
        return word
    return right.upper() if word.isupper() and len(word) > 1 else right[0].upper() + right[1:] if word[0].isupper() or (word[0].isdigit() and len(word) > 1 and word[1:].islower() and right[0] in "bs") else right


def repaired(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """``(record_key, text)``: list blocks keep their lines, all else comes out as running paragraphs."""
    chunks = chunks.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text", F.coalesce(F.col("metadata.content_type") == "list_block", F.lit(False)).alias("listed"))
    rows, entries = deliver(chunks, "text", evidence(chunks), keys_of, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = evidence_of(entries(b))
            out = [
                "\n".join(corrected(s, e) for s in clean_lines(t)) if listed else repair(t, e)
                for t, listed in zip(b.column("text").to_pylist(), b.column("listed").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["record_key", "text"])

    return rows.mapInArrow(run, "record_key string, text string").distinct()
