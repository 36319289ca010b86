"""Problem 9: language and confidence of documents and of each stretch of mixed ones.

Text likelihoods come from letter trigrams whose counts per language are grouped aggregates over
all documents: first by declared label, then by the language that a first model gives each document
of one language. They are fused with the declared label (reliability learned by counting) and with
priors of source and of case within source, smoothed case to source to whole; the priors are grouped
counts joined to the documents, never collected. Documents are scored in batches, piece by piece
between all signs that may end a sentence. Where no run of pieces could gain from another language
what a change costs, the document is of one language; the others go through a Viterbi pass over the
pieces between possible sentence starts. Markup languages and addresses are not in the tables:
``lang`` stands for the declared language, ``source`` and ``case_id`` for the levels of a host.

Defined results: null, empty and wordless texts have no language; a text whose evidence is level
takes the prior; foreign quotations inside a sentence do not count as stretches. A language takes
part with its words once ``LEAST_TRIGRAMS`` trigrams of it are known, however many others there are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.llm.sentences import ENDERS, QUOTE, BoundaryModel, candidates, quoted_spans
from prufspark.plans.lineage import cut

# ISO 639-1 code and the other notations of each language.
NOTATIONS = {
    "de": "deu ger german deutsch allemand tedesco", "fr": "fra fre french français francais französisch francese", "it": "ita italian italiano italienisch italien",
    "en": "eng english englisch anglais inglese", "nl": "nld dut dutch nederlands niederländisch", "es": "spa spanish español espanol spanisch espagnol",
    "el": "ell gre greek ελληνικά griechisch grec", "ar": "ara arabic العربية arabisch arabe", "ru": "rus russian русский russisch russe",
    "zh": "zho chi chinese 中文 chinesisch cmn chinois", "th": "tha thai ไทย thailändisch", "ja": "jpn japanese 日本語 japanisch japonais",
    "pt": "por portuguese português", "pl": "pol polish polski", "tr": "tur turkish türkçe", "sv": "swe swedish svenska", "da": "dan danish dansk", "ko": "kor korean 한국어", "uk": "ukr ukrainian українська", "cs": "ces cze czech čeština",
}
LANGS = list(NOTATIONS)
POS = {lang: k for k, lang in enumerate(LANGS)}
CANON = {x: k for k, v in NOTATIONS.items() for x in [k, *v.split()]}
# Frequent short words, a start for languages with few labelled documents.
SEEDS = {
    "de": "der die das und ist nicht mit auf den dem ein eine wird wurde bei nach von zu im am ob sich durch für", "fr": "le la les des une est dans sur par pour que qui pas avec au aux du été selon après en",
    "it": "il lo gli della delle che non con per una sono nel alla dei di è stato secondo dopo", "en": "the and of to in is was with that for on by at from are not which this has",
    "nl": "de het een van en is niet met op voor dat aan bij door naar werd volgens omdat", "es": "el los las una del que en es con por para no se fue según porque después al",
    "pt": "o os as uma do da que não com para por em foi", "pl": "i w na z nie się do jest że po", "tr": "ve bir bu için ile da de", "sv": "och att det som en på är av för med", "da": "og at det som en på er af for med", "cs": "a se na je že v s do",
}
# Scripts that settle a language by themselves.
SCRIPTS = [("el", 0x370, 0x3FF), ("el", 0x1F00, 0x1FFF), ("ru", 0x400, 0x4FF), ("ar", 0x600, 0x6FF), ("th", 0xE00, 0xE7F), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF)]
SCRIPT_WEIGHT = {"zh": 1.5, "ja": 6.0}

# Languages that the seed words alone may decide.
CORE = ("de", "fr", "it", "en", "nl", "es")

BITS = 16
CELLS = 1 << BITS
TEMPER = 0.35
LEAST_TRIGRAMS = 1_000
NEVER = -1e4
SMOOTH = 20.0  # How many documents a level's parent counts for in its prior.
STEP = 2_000
FEW = 50_000
STAY = np.log(0.995)
SWITCH = np.log(2e-3)
ENDS = np.array(sorted(map(ord, ENDERS + "\n;\u037e")), dtype=np.uint32)
WORD = re.compile(r"[^\W\d_]{2,}|[぀-ヿ一-鿿฀-๿]")
INVISIBLE = re.compile(r"[\s­​-‏‪-‮⁠-⁤﻿]*")


def canonical(label: str | None) -> str | None:
    """ISO 639-1 code of a label in any notation; None for missing or unknown ones."""
    if not label or not label.strip():
        return None
    s = label.strip().lower()
    return CANON.get(s) or CANON.get(re.split(r"[-_\s]", s)[0])


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code point of letters and marks, a space for all else."""
    t = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    # Blocks of signs without case are letters as a whole; nothing is assigned above them.
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):
        t[lo:hi] = np.arange(lo, hi)
    for cp in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0x20000)):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            t[cp] = ord(c.lower()[0])
    return t


def trigram_cells(codes: np.ndarray) -> np.ndarray:
    """Cell of the trigram that starts at each character, -1 where it holds no two letters side by side."""
    c = letter_table()[codes]
    n = len(c)
    out = np.full(n, -1, dtype=np.int64)
    if n < 3:
        return out
    a, b, d = (c[i : n - 2 + i].astype(np.uint64) for i in range(3))
    h = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + d
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    out[: n - 2] = np.where((b != 32) & ((a != 32) | (d != 32)), (h >> np.uint64(64 - BITS)).astype(np.int64), -1)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Fusion:
    """log P(trigram | language), log P(label | language), the prior of the whole, and counts of documents per language
    as ``(source, counts)`` and ``(source, case_id, counts)``; without those two the whole's prior holds everywhere."""

    logp: np.ndarray
    langs: np.ndarray
    label: dict[str | None, np.ndarray]
    whole: np.ndarray
    sources: DataFrame | None = None
    cases: DataFrame | None = None


def taking_part(counts: np.ndarray) -> np.ndarray:
    """Numbers of the languages that can win: those with documents, with seed words of the core, or with a script."""
    own = {k for k, _, _ in SCRIPTS}
    return np.array([k for k, lang in enumerate(LANGS) if counts[k].sum() >= LEAST_TRIGRAMS or lang in CORE or lang in own])


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Smoothed log shares, with the seed words as pseudo-counts."""
    c = counts.astype(np.float64)
    for k, lang in enumerate(LANGS):
        if lang in SEEDS:
            cells = trigram_cells(code_points(f" {SEEDS[lang]} "))
            np.add.at(c[k], cells[cells >= 0], 2.0)
    back = (c.sum(0) + 0.5) / (c.sum() + 0.5 * CELLS)
    weight = 0.02 * c.sum(1, keepdims=True) + 50
    logp = np.log((c + weight * back) / (c.sum(1, keepdims=True) + weight))
    # A language without documents of its own can win by its script only.
    absent = counts.sum(1) < LEAST_TRIGRAMS
    absent &= np.array([k not in CORE for k in LANGS]) | (counts.sum() > 0) & np.array([k not in SEEDS for k in LANGS])
    logp[absent] = logp[~absent].min(0) - 1.0 if (~absent).any() else logp[absent]
    return np.maximum(logp, logp.max(0) - 6.0).astype(np.float32)


def pieces(text: str) -> tuple[list[int], list[float]]:
    """Offsets at which a stretch may start, and the log-cost of a change of language there."""
    begin = INVISIBLE.match(text).end()
    keep = [(at, _MODEL.score(f)) for at, f in candidates(text) if at > begin and not any(x.startswith("q1") for x in f)]
    return [begin, *(a for a, _ in keep)], [SWITCH, *(SWITCH + max(-12.0, min(0.0, s - 5.0)) for _, s in keep)]


_MODEL = BoundaryModel()


def piece_scores(text: str, starts: list[int], logp: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of each piece under each language; quotations inside a sentence are left out."""
    codes = code_points(text)
    if QUOTE.search(text):
        bare = codes.copy()
        for i, j in quoted_spans(text):
            bare[i:j] = 32
        left = letter_table()[bare] != 32
        if left.sum() >= 12:
            codes = bare
    cells = trigram_cells(codes)
    at = np.flatnonzero(cells >= 0)
    owner = np.searchsorted(starts, at, side="right") - 1
    # A trigram counts once per piece, so runs of odd characters weigh little.
    pairs = np.unique(owner[owner >= 0] * CELLS + cells[at[owner >= 0]])
    out = np.zeros((len(starts), len(LANGS)), dtype=np.float64)
    if len(pairs):
        own = pairs // CELLS
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[cut]] = np.add.reduceat(logp[:, pairs % CELLS].T.astype(np.float64), cut, axis=0) * TEMPER
    _add_scripts(out, np.searchsorted(starts, np.arange(len(codes)), side="right") - 1, letter_table()[codes])
    return out


def stretches(text: str, base: np.ndarray, logp: np.ndarray) -> list[tuple[int, str, float]]:
    """``(offset, language, confidence)`` per stretch of one language; none for a wordless text."""
    if not WORD.search(text):
        return []
    starts, cost = pieces(text)
    score = piece_scores(text, starts, logp)
    n, k = score.shape
    best = base + score[0]
    back = np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] + cost[i]
        stay = best + STAY
        switch = jump > stay
        back[i] = np.where(switch, top, np.arange(k))
        best = np.where(switch, jump, stay) + score[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out = []
    i = 0
    while i < n:
        j = i
        while j < n and path[j] == path[i]:
            j += 1
        s = base + score[i:j].sum(0)
        out.append((starts[i], LANGS[path[i]], float(1 / np.exp(s - s[path[i]]).sum())))
        i = j
    return out


class Batch:
    """Texts scored together: flat code points and trigram cells, pieces between all signs that may end a sentence."""

    def __init__(self, texts: list[str]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.cumsum(size) - size
        codes = code_points("\n".join(texts) + "\n")
        self.letters = letter_table()[codes]
        cells = trigram_cells(codes)
        at = np.flatnonzero(cells >= 0)
        # The middle letter says whose a trigram is.
        self.cells, self.middle = cells[at], at + 1
        self.codes = codes
        self.doc_of = self.owners(self.begin)

    def owners(self, starts: np.ndarray) -> np.ndarray:
        """Number of the last start at or before each position."""
        mark = np.zeros(len(self.codes), dtype=np.int32)
        mark[starts] = 1
        return np.cumsum(mark, dtype=np.int32) - 1

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all pieces, and of each document the place of its first piece."""
        ends = np.flatnonzero(np.isin(self.codes, ENDS)) + 1
        starts = np.union1d(ends[ends < len(self.codes)], self.begin)
        return starts, np.searchsorted(starts, self.begin)

    def scores(self, starts: np.ndarray, table: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Tempered log-likelihood of each piece under each language, ``table`` having those of ``langs``, and none under
        the others; a trigram counts once per piece."""
        out = np.full((len(starts), len(LANGS)), NEVER)
        out[:, langs] = 0
        owner = self.owners(starts)
        pairs = np.sort((owner[self.middle] * np.int64(CELLS) + self.cells).astype(np.uint32 if len(starts) < CELLS else np.int64))
        if len(pairs):
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])].astype(np.int64)
            own = pairs // CELLS
            cut_at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[np.ix_(own[cut_at], langs)] = np.add.reduceat(table[pairs % CELLS], cut_at, axis=0) * TEMPER
        _add_scripts(out, owner, self.letters)
        return out

    def mixed_scripts(self) -> np.ndarray:
        """Documents with several letters of Latin and of another script."""
        at = np.flatnonzero(self.letters != 32)
        doc = self.doc_of[at]
        other = self.letters[at] > 0x36F
        n = len(self.begin)
        return (np.bincount(doc[other], minlength=n) >= 4) & (np.bincount(doc[~other], minlength=n) >= 4)


def _add_scripts(out: np.ndarray, owner: np.ndarray, letters: np.ndarray) -> None:
    """Adds what the letters of a script say to the pieces they own (-1: none)."""
    place = np.flatnonzero((letters > 0x36F) & (owner >= 0))
    if not len(place):
        return
    n = len(out)
    total = np.bincount(owner[(letters != 32) & (owner >= 0)], minlength=n)
    for lang, a, b in SCRIPTS:
        hit = place[(letters[place] >= a) & (letters[place] <= b)]
        if len(hit):
            got = np.bincount(owner[hit], minlength=n)
            out[:, LANGS.index(lang)] += np.where(got >= 0.3 * total, got, 0) * SCRIPT_WEIGHT.get(lang, 3.0)


def of_one_language(b: Batch, base: np.ndarray, table: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of the batch: surely of one language, which one, and its confidence.

    Surely means that no run of pieces gains by other languages, whatever they are, what one change costs; then the
    best path of the Viterbi pass never changes. ``base`` holds the log-prior of each text, ``table`` log P by cell."""
    starts, first = b.pieces()
    score = b.scores(starts, table, langs)
    n = np.diff(np.append(first, len(starts)))
    every = np.arange(len(n))
    total = base + np.add.reduceat(score, first, axis=0)
    lang = total.argmax(1)
    sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    score[first] += base
    own = np.repeat(every, n)
    kept = score[np.arange(len(score)), lang[own]]
    score[np.arange(len(score)), lang[own]] = -np.inf
    gain = score.max(1) - kept
    now, most = np.zeros(len(n)), np.full(len(n), -np.inf)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        d = order[: np.searchsorted(-sizes, -t, side="left")]
        now[d] = np.maximum(now[d], 0) + gain[first[d] + t]
        most[d] = np.maximum(most[d], now[d])
    return (most <= STAY - SWITCH) & ~b.mixed_scripts(), lang, sure


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small batches of the rows that have words, with their texts."""
    for i in range(0, b.num_rows, STEP):
        part = b.slice(i, STEP)
        worded = [t is not None and WORD.search(t) is not None for t in part.column("text").to_pylist()]
        part = part.filter(pa.array(worded, pa.bool_()))
        if part.num_rows:
            yield part, part.column("text").to_pylist()


def _count_pass(docs: DataFrame, model: np.ndarray | None, langs: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame]:
    """Trigram counts by language (declared at first, then of each document surely of one language), and the counts
    ``(label, source, case_id, lang, n)`` of those documents."""
    sc = docs.sparkSession.sparkContext
    langs = np.arange(len(LANGS)) if langs is None else langs
    shared = sc.broadcast(None if model is None else np.ascontiguousarray(model[langs].T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        counts = np.zeros(len(LANGS) * CELLS, dtype=np.int64)
        seen: Counter = Counter()
        for big in batches:
            for b, texts in _slices(big):
                known = [canonical(x) for x in b.column("lang").to_pylist()]
                batch = Batch(texts)
                if table is None:
                    lang = np.array([POS[x] if x else -1 for x in known])
                else:
                    sure, lang, conf = of_one_language(batch, np.zeros((len(texts), len(LANGS))), table, langs)
                    sources, cases = b.column("source").to_pylist(), b.column("case_id").to_pylist()
                    for i in np.flatnonzero(sure).tolist():
                        seen[(known[i] or "", sources[i], cases[i], LANGS[lang[i]])] += 1
                    lang = np.where(sure & (conf > 0.9), lang, -1)
                whose = lang[batch.doc_of[batch.middle]]
                counts += np.bincount((whose * CELLS + batch.cells)[whose >= 0], minlength=len(counts))
            if len(seen) > 200_000:
                yield _counted(seen)
                seen.clear()
        if seen:
            yield _counted(seen)
        for k, lang in enumerate(LANGS):
            part = counts[k * CELLS : (k + 1) * CELLS]
            if part.any():
                yield _row("t", "", None, None, lang, int(part.sum()), np.minimum(part, 2**31 - 1).astype(np.int32).tobytes())

    schema = "kind string, label string, source string, case_id string, lang string, n bigint, cells binary"

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype=np.int32).astype(np.int64) for c in table.column("cells").to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "cells": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    rows = cut(docs.select("text", "lang", "source", "case_id").mapInArrow(run, schema))
    counts = np.zeros((len(LANGS), CELLS), dtype=np.int64)
    for r in rows.where("kind = 't'").groupBy("lang").applyInArrow(add, "lang string, cells binary").collect():
        counts[POS[r["lang"]]] = np.frombuffer(r["cells"], dtype=np.int32)
    joint = rows.where("kind = 'd'").groupBy("label", "source", "case_id", "lang").agg(F.sum("n").alias("n"))
    return counts, joint


def _row(kind, label, source, case, lang, n, cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([label], pa.string()), pa.array([source], pa.string()), pa.array([case], pa.string()), pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([cells], pa.binary())],
        names=["kind", "label", "source", "case_id", "lang", "n", "cells"],
    )


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    cols = [pa.array(c, pa.string()) for c in zip(*keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(["d"] * len(keys)), *cols, pa.array([seen[k] for k in keys], pa.int64()), pa.nulls(len(keys), pa.binary())], names=["kind", "label", "source", "case_id", "lang", "n", "cells"]
    )


def fit(docs: DataFrame) -> Fusion:
    """Two counting passes over all documents; what is collected has a fixed size (languages times cells, languages
    times labels). Counts of sources and cases stay tables."""
    first, _ = _count_pass(docs, None)
    second, joint = _count_pass(docs, trigram_model(first), taking_part(first))
    by_label = np.ones((len(LANGS), len(LANGS) + 1)) * 0.5 + np.pad(np.eye(len(LANGS)) * 4, ((0, 0), (0, 1)))
    for r in joint.groupBy("label", "lang").agg(F.sum("n").alias("n")).collect():
        by_label[POS[r["lang"]], POS.get(r["label"], len(LANGS))] += r["n"]
    whole = by_label.sum(1)
    whole = whole / whole.sum()
    label = {lang: np.log(by_label[:, k] / by_label.sum(1)) for lang, k in POS.items()}
    label[None] = np.log(by_label[:, -1] / by_label.sum(1))
    counted = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("float") for x in LANGS]).alias("counts")
    return Fusion(trigram_model(second), taking_part(second), label, np.log(whole), cut(joint.groupBy("source").agg(counted)), cut(joint.groupBy("source", "case_id").agg(counted)))


def with_priors(docs: DataFrame, f: Fusion) -> DataFrame:
    """``docs`` with ``prior``, the log-priors of the languages. Counts of sources and cases are joined: a side of at most
    ``FEW`` rows (some 10 MB) is broadcast, a larger one is left to the planner, which splits hot keys."""
    whole = F.array(*[F.lit(float(np.exp(x))) for x in f.whole])
    if f.sources is None or f.cases is None:
        return docs.withColumn("prior", F.transform(whole, lambda x: F.log(x)))
    src = f.sources.select(F.col("source").alias("_s"), F.col("counts").alias("_cs"))
    case = f.cases.select(F.col("source").alias("_s2"), F.col("case_id").alias("_c2"), F.col("counts").alias("_cc"))
    small = lambda df: F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
    src, case = small(src), small(case)
    out = docs.join(src, F.col("source").eqNullSafe(F.col("_s")), "left").join(case, F.col("source").eqNullSafe(F.col("_s2")) & F.col("case_id").eqNullSafe(F.col("_c2")), "left")
    none = F.array_repeat(F.lit(0.0).cast("float"), len(LANGS))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda own, parent: F.zip_with(own, parent, lambda n, p: (n + SMOOTH * p) / (total(own) + SMOOTH))
    out = out.withColumn("_p", smooth(F.coalesce("_cs", none), whole))
    out = out.withColumn("prior", F.transform(smooth(F.coalesce("_cc", none), F.col("_p")), lambda x: F.log(x)))
    return out.drop("_s", "_cs", "_s2", "_c2", "_cc", "_p")


def language_stretches(docs: DataFrame, fusion: Fusion | None = None) -> DataFrame:
    """``(doc_id, start_pos, lang, confidence, declared, n_stretches)``, one row per stretch; wordless documents give none."""
    docs = docs.select("doc_id", "text", "lang", "source", "case_id")
    f = fusion or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((f.logp, f.label, f.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, label, langs = shared.value
        table = np.ascontiguousarray(logp[langs].T)
        for big in batches:
            for b, texts in _slices(big):
                known = [canonical(x) for x in b.column("lang").to_pylist()]
                prior = np.asarray(b.column("prior").flatten().to_numpy(zero_copy_only=False)).reshape(len(texts), len(LANGS))
                base = prior + np.array([label[x] for x in known])
                sure, lang, conf = of_one_language(Batch(texts), base, table, langs)
                docs_ = b.column("doc_id").to_pylist()
                out = []
                for i, text in enumerate(texts):
                    if sure[i]:
                        out.append((docs_[i], INVISIBLE.match(text).end() + 1, LANGS[lang[i]], float(conf[i]), known[i], 1))
                    else:
                        found = stretches(text, base[i], logp)
                        out += [(docs_[i], at + 1, x, p, known[i], len(found)) for at, x, p in found]
                c = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.int32())],
                    names=["doc_id", "start_pos", "lang", "confidence", "declared", "n_stretches"],
                )

    rows = with_priors(docs, f).select("doc_id", "text", "lang", "prior")
    return rows.mapInArrow(run, "doc_id bigint, start_pos bigint, lang string, confidence double, declared string, n_stretches int")


def label_errors(found: DataFrame) -> DataFrame:
    """Stretches of documents that are mixed or whose label is missing or wrong."""
    return found.where((F.col("n_stretches") > 1) | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))).select("doc_id", "start_pos", "lang")
