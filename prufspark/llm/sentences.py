"""Problem 4: sentence units in every language of the collection.

Characters at which a sentence may start are tagged boundary or inside by a linear-chain model
with Viterbi decoding; all other characters are inside. The model is an averaged structured
perceptron over the words, shapes and signs around the place, fitted on list blocks, whose lines
are one sentence each: their items are joined again with spaces, line breaks or nothing, and for
scripts without sentence punctuation with spaces only.

Defined results: null and blank texts have no sentences; a text without a boundary is one; a
repeated row counts once. The fit takes about ``FIT_BLOCKS`` list blocks (chosen by id hash);
with none the prior weights decide.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prufspark.llm.unify import transducer

FIT_BLOCKS = 2_000
EPOCHS = 4
OPEN_FAR = 160

ENDERS = ".!?…。！？؟"
CLOSERS = "\"'»”“’)]」』›"
CANDIDATE = re.compile(
    rf"\s*\n\s*|[{ENDERS}]+(?:[\s]?[»›]|[{CLOSERS}])*(?=(\s*))\1|(?<=[Ͱ-Ͽ\d.%)»])\s?[;\u037e](?=\s|$|[Α-Ω])\s*|(?<=[฀-๿\d.)”\"…])[^\S\n]+(?=[฀-๿\d(“\"A-ZÀ-Ý])"
)
LEFT = re.compile(r"[^\s«»„“”\"()\[\]「」]*$")
RIGHT = re.compile(r"[^\W\d_]+|\d+|\S")
MAIL_AHEAD = re.compile(r"[\w.+-]{1,64}(?:@|\[at\]|\(at\))", re.I)
THAI = re.compile(r"[฀-๿]")
GREEK_END = re.compile(r"[Ͱ-Ͽἀ-῿][^A-Za-z]*$")
QUOTE = re.compile(r"[«»„“”‘’「」『』\"\n]")
MARKER = re.compile(r"^\s*(?:[-•*–]|\d+[.)])\s+")
PAIRS = {"«": "»", "„": "“", "“": "”", "‘": "’", "「": "」", "『": "』"}
SHUT = {"»": "«", "”": "“„", "’": "‘", "」": "「", "』": "『", "“": "„"}


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans inside quotation marks, line by line; a missing mark at a line's start or end is made up for."""
    spans, stack = [], []
    start = 0

    def close_line(at: int) -> None:
        for _, i in stack:
            if at - i <= OPEN_FAR:
                spans.append((i, at))
        stack.clear()

    for m in QUOTE.finditer(text):
        c, i = m.group(), m.start()
        if c == "\n":
            close_line(i)
            start = i + 1
            continue
        if c == '"':
            if stack and stack[-1][0] == c:
                spans.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
            continue
        if c in "‘’" and i and text[i - 1].isalpha() and i + 1 < len(text) and text[i + 1].isalpha():
            continue
        if c in SHUT and stack and stack[-1][0] in SHUT[c]:
            spans.append((stack.pop()[1], i))
        elif c in PAIRS and (c != "“" or stack or opens(text, i)):
            stack.append((c, i))
        elif c in SHUT and not stack and c != "’" and i - start <= OPEN_FAR:
            spans.append((start, i))
    close_line(len(text))
    return spans


def opens(text: str, i: int) -> bool:
    """Does a mark that opens in some languages and closes in others open here?"""
    before = text[max(0, i - 4) : i].rstrip("\u00ad\u200b\u200c\u200d\u2060\ufeff")[-1:]
    return not before or before.isspace() or before in "(:,–—-" or ord(before) > 0x2E80


def candidates(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """``(start, features)`` of every place where a sentence may start; start is the first character after the gap."""
    spans = quoted_spans(text) if QUOTE.search(text) else ()
    thai = THAI.search(text) is not None
    one_form = transducer()
    out = []
    n = len(text)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b >= n:
            continue
        g = m.group()
        nl = "\n" in g
        body = g.rstrip()
        sign = body[:1] if body else " "
        gap = "n" if nl else "" if len(body) == len(g) else "s"
        if sign == " " and not nl and not thai:
            continue
        if sign in ";\u037e" and not GREEK_END.search(text[max(0, a - 24) : a + 1]):
            continue
        right = RIGHT.match(text, b).group()
        if not right.isascii():
            right = one_form(right) or right
        r0 = right[0]
        if r0.isalpha():
            kind = "U" if r0.isupper() else "l" if r0.islower() else "o"
        else:
            kind = "#" if r0.isdigit() else "q" if r0 in "«„“‘「『\"¿¡(" else "p"
        if not gap and kind in "l#" and sign in ".…":
            continue
        left_text = LEFT.search(text, max(0, a - 24), a).group()
        if not gap and ("@" in left_text or MAIL_AHEAD.match(text, b) or "www" in left_text.lower() or "://" in left_text):
            continue
        inside = any(i < a < j for i, j in spans) if spans else False
        if not left_text.isascii():
            left_text = one_form(left_text)
        left = left_text.lower().strip(",;:")
        first = a == 0 or text[a - 1 - len(left_text) : a - len(left_text)] in ("\n", "") if left_text else False
        if left.replace(".", "").replace(",", "").isdigit():
            shape, word = ("#1" if first else "#"), "#"
        else:
            # A capital tells titles and initials from units: "M." and "m.".
            word = left + "^" * left_text[:1].isupper()
            core = left.rsplit(".", 1)[-1]
            shape = "." if "." in left and len(core) <= 3 else "I" if len(core) == 1 and left_text[-1].isupper() else "1" if len(core) <= 1 else "s" if len(core) <= 4 else "w"
        closing = "c" if len(body) > 1 and body[-1] in CLOSERS else ""
        wide = "t" if thai else ""
        base = sign + gap + closing + wide
        f = (
            "b" + base,
            f"q{int(inside)}{closing}",
            f"k{base}{kind}",
            f"s{shape}{kind}{sign}",
            f"l{word}",
            f"L{word}{kind}",
            f"r{right.lower()}" if kind in "Uo" else f"r{kind}",
            f"n{int(nl)}",
            f"d{int(text[a - 1].isdigit()) if a else 2}{int(r0.isdigit())}{wide}{sign == ' '}",
        )
        out.append((b, f))
    return out


# Prior weights: what holds before any list block was seen.
PRIOR = {"n1": 12.0, "q1": -8.0, "q1c": -6.0, "d10tTrue": -6.0, "d01tTrue": -6.0, "d11tTrue": -6.0}
PRIOR |= {f"k{s}{g}{k}": v for s in ENDERS for g, k, v in (("s", "U", 2.0), ("s", "l", -3.0), ("", "U", 1.0), ("s", "q", 1.0), ("s", "#", 0.5), ("", "o", 2.0), ("s", "o", 2.0))}
# Titles and forms of address, which a name follows.
TITLES = "m mm mme dr prof hr hrn fr frl sig dott avv st ste me mr mrs ms jr sr nr no ing dipl".split()
SMALL_TITLES = "dr prof sig dott avv st str lic iur med dipl ing nr no".split()
PRIOR |= {f"L{t}^U": -6.0 for t in TITLES} | {f"L{t}U": -6.0 for t in SMALL_TITLES}
PRIOR |= {"sIU.": -6.0, "s1U.": -0.5}
# Month names, which follow an ordinal.
MONTHS = """januar februar märz april mai juni juli august september oktober november dezember jänner janvier février mars avril juin juillet août
septembre octobre novembre décembre gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre""".split()
PRIOR |= {f"r{m}": -9.0 for m in MONTHS}
PRIOR |= {f"s{s}{k}.": -3.0 for s in ("1", ".") for k in "Ul#" if s + k != "1U"}
PRIOR |= {f"s#1{k}.": -6.0 for k in "Ulo#"}
# In Greek this sign asks a question.
PRIOR |= {f"k{s}s{k}": v for s in ";\u037e" for k, v in (("U", 3.0), ("l", -3.0), ("q", 1.0))}
PRIOR |= {"b ": -0.5, "b st": 1.0, "k stU": 1.0, "k sto": 1.0}


class BoundaryModel:
    """Weights of place features and of neighbouring tags; scores of whole feature tuples are kept."""

    def __init__(self, weights: dict[str, float] | None = None, follow: float = 0.0) -> None:
        self.w = dict(PRIOR) if weights is None else weights
        self.follow = follow
        self._known: dict[tuple[str, ...], float] = {}

    def score(self, f: tuple[str, ...]) -> float:
        got = self._known.get(f)
        if got is None:
            get = self.w.get
            got = sum(get(x, 0.0) for x in f)
            if len(self._known) > 400_000:
                self._known.clear()
            self._known[f] = got
        return got

    def tags(self, places: list[tuple[int, tuple[str, ...]]]) -> list[bool]:
        """Viterbi over the places; inside scores 0, a boundary right behind a boundary ``follow`` more."""
        if self.follow == 0.0:
            return [self.score(f) > 0 for _, f in places]
        inside = boundary = 0.0
        back = []
        last = None
        for at, f in places:
            s = self.score(f)
            close = self.follow if last is not None and at - last < 4 else 0.0
            from_b = boundary + close
            to_b, pick_b = (from_b + s, True) if last is not None and from_b > inside else (inside + s, False)
            to_i, pick_i = (boundary, True) if last is not None and boundary > inside else (inside, False)
            back.append((pick_b, pick_i))
            boundary, inside, last = to_b, to_i, at
        out = []
        state = boundary > inside
        for pick_b, pick_i in reversed(back):
            out.append(state)
            state = pick_b if state else pick_i
        return out[::-1]

    def starts(self, text: str) -> list[int]:
        """Offsets of the first characters of all sentences."""
        begin = len(text) - len(text.lstrip())
        if begin == len(text):
            return []
        places = candidates(text)
        return [begin] + [at for (at, _), b in zip(places, self.tags(places)) if b and at > begin]


def fit(blocks: list[str], seed: int = 3) -> BoundaryModel:
    """Averaged perceptron on rejoined list items."""
    rng = random.Random(seed)
    texts: list[tuple[list[tuple[int, tuple[str, ...]]], list[bool]]] = []
    for block in sorted(blocks):
        items = [x for x in (MARKER.sub("", s).strip() for s in block.split("\n")) if x]
        if len(items) < 2:
            continue
        text, truth = items[0], set()
        for x in items[1:]:
            thai = THAI.search(x) is not None and x[-1] not in ENDERS
            wide = not x[0].isascii() and not x[0].isupper() and not x[0].islower()
            gap = rng.choices([" ", "", "  ", "\n", "\n\n"], [82, 0, 8, 6, 4] if thai else [4, 84, 2, 6, 4] if wide and text[-1] in "。！？" else [74, 10, 6, 6, 4])[0]
            text += gap
            truth.add(len(text))
            text += x
        places = candidates(text)
        texts.append((places, [at in truth for at, _ in places]))
    w: dict[str, float] = defaultdict(float, PRIOR)
    total: dict[str, float] = defaultdict(float)
    follow = follow_total = 0.0
    step = 1
    for _ in range(EPOCHS):
        rng.shuffle(texts)
        for places, truth in texts:
            model = BoundaryModel(w, follow)
            for k, ((at, f), want, got) in enumerate(zip(places, truth, model.tags(places))):
                if want != got:
                    d = 1.0 if want else -1.0
                    for x in f:
                        w[x] += d
                        total[x] += step * d
                    if k and at - places[k - 1][0] < 4 and truth[k - 1]:
                        follow += d
                        follow_total += step * d
                step += 1
    return BoundaryModel({k: v - total[k] / step for k, v in w.items()}, follow - follow_total / step)


def fitted(chunks: DataFrame, limit: int = FIT_BLOCKS) -> BoundaryModel:
    """The model fitted on about ``limit`` list blocks: those whose id hash is below a share, so no task sorts them all."""
    rows = chunks.where((F.col("metadata.content_type") == "list_block") & F.col("text").isNotNull()).select("id", "text")
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < (limit << 40) // n)
    return fit([r["text"] for r in rows.collect()])


def sentence_starts(values: DataFrame, model: BoundaryModel) -> DataFrame:
    """``(tbl, record_key, value)`` to one row ``(tbl, record_key, start_pos)`` per sentence, 1-based."""
    shared = values.sparkSession.sparkContext.broadcast((model.w, model.follow))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = BoundaryModel(*shared.value)
        for b in batches:
            rows, starts = [], []
            for i, t in enumerate(b.column("value").to_pylist()):
                s = m.starts(t) if t else []
                rows += [i] * len(s)
                starts += s
            out = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([out.column("tbl"), out.column("record_key"), pa.array([s + 1 for s in starts], pa.int64())], names=["tbl", "record_key", "start_pos"])

    return values.select("tbl", "record_key", "value").mapInArrow(run, "tbl string, record_key string, start_pos bigint")


def sentence_values(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Paragraph chunks and gold spans as ``(tbl, record_key, value)``."""
    c = chunks.where((F.col("metadata.content_type") == "paragraph") & F.col("id").isNotNull() & F.col("text").isNotNull())
    g = gold.select(F.explode("gold_findings").alias("f")).where(F.col("f.finding_id").isNotNull() & F.col("f.span_text").isNotNull())
    return c.select(F.lit("chunks").alias("tbl"), F.col("id").alias("record_key"), F.col("text").alias("value")).unionByName(
        g.select(F.lit("gold").alias("tbl"), F.col("f.finding_id").alias("record_key"), F.col("f.span_text").alias("value"))
    )


def sentences(text: Column, model: BoundaryModel) -> Column:
    """The sentences of a text column as an array, null for null."""
    weights, follow = model.w, model.follow

    @F.pandas_udf("array<string>")
    def run(s):
        m = BoundaryModel(weights, follow)

        def cut(t):
            if t is None:
                return None
            at = m.starts(t)
            return [t[a:b].strip() for a, b in zip(at, at[1:] + [len(t)])]

        return s.map(cut)

    return run(text)
