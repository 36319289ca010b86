"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation runs on code points of a whole batch: a class array, and an automaton
whose per-character transition functions are composed associatively (block-wise scan), so
token starts come from array operations and no regular expression. The slices feed pair
merging behind a per-process cache of pieces.

Defined results: null and empty texts give an empty list; text that looks like a special
token is plain text; every text is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

# Character classes of the automaton.
C_L, C_N, C_P, C_SP, C_WS, C_A1, C_A2, C_START = range(8)
# States: what the last character left open.
S_OPEN, S_L, S_N, S_P, S_SP, S_C1, S_C2 = range(7)
N_STATES = 7
BLOCK = 512
CACHE_PIECES = 400_000
LONG_PIECE = 24


def default_vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point: letter, number, white space, plain space or other."""
    t = np.full(sys.maxunicode + 1, C_P, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            t[cp] = C_L
        elif k == "N":
            t[cp] = C_N
    # The characters of the White_Space property.
    for cp in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        t[cp] = C_WS
    t[0x20] = C_SP
    return t


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, class]`` and ``starts[state, class]``: does a piece start at this character?"""
    nxt = np.zeros((N_STATES, 8), dtype=np.uint8)
    new = np.zeros((N_STATES, 8), dtype=bool)
    kind = {C_L: S_L, C_N: S_N, C_P: S_P, C_A1: S_P, C_A2: S_P}
    for s in range(N_STATES):
        for c in range(8):
            if s in (S_C1, S_C2) and c not in (C_SP, C_WS, C_START):
                nxt[s, c], new[s, c] = (S_OPEN if s == S_C1 else S_C1), False
            elif c in (C_SP, C_WS, C_START):
                # White space is settled by its own run rule; here only what it leaves open.
                nxt[s, c], new[s, c] = (S_SP if c == C_SP else S_OPEN), True
            elif s == S_SP:
                nxt[s, c], new[s, c] = kind[c], False
            elif c in (C_A1, C_A2) and s in (S_OPEN, S_L, S_N):
                nxt[s, c], new[s, c] = (S_C1 if c == C_A1 else S_C2), True
            else:
                nxt[s, c], new[s, c] = kind[c], s != kind[c]
    return nxt, new


def scan_states(classes: np.ndarray) -> np.ndarray:
    """State before each character. Blocks compose their transition functions side by side,
    the block functions are chained, then every block replays from its known start state."""
    nxt, _ = automaton()
    n = len(classes)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, C_START, dtype=np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    fn = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    if rows > 1:
        for col in grid:
            fn = nxt[fn, col[:, None]]
    start = np.zeros(rows, dtype=np.uint8)
    s = S_OPEN
    for i in range(rows):
        start[i] = s
        s = fn[i, s]
    out = np.empty_like(grid)
    state = start
    for j, col in enumerate(grid):
        out[j] = state
        state = nxt[state, col]
    return out.T.reshape(-1)[:n]


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Sorted offsets at which a piece starts, over texts laid end to end (``text_starts``: offset of each)."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = class_table()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    nx1 = np.append(codes[1:], 0)
    nx2 = np.append(nx1[1:], 0)
    same1 = ~first[1:]
    same2 = same1 & np.append(same1[1:], False)
    apos = np.flatnonzero((codes == 0x27) & same1)
    if len(apos):
        a, b = nx1[apos], nx2[apos]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = same2[apos] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        cls[apos[one]] = C_A1
        cls[apos[two]] = C_A2
    # A sentinel in front of every text resets the automaton.
    k = len(text_starts)
    where = text_starts + np.arange(k)
    wide = np.empty(n + k, dtype=np.uint8)
    real = np.ones(n + k, dtype=bool)
    real[where] = False
    wide[where] = C_START
    wide[real] = cls
    before = scan_states(wide)[real]
    new = automaton()[1][before, cls]
    # White space: a run is one piece, except that its last character leaves it when more text follows.
    ws = (cls == C_WS) | (cls == C_SP)
    head = np.empty(n, dtype=bool)
    head[0] = True
    head[1:] = ~ws[:-1]
    head |= first[:n]
    last_before_text = np.zeros(n, dtype=bool)
    last_before_text[:-1] = ~ws[1:] & same1[:-1]
    new = np.where(ws, head | last_before_text, new)
    new |= first[:n]
    return np.flatnonzero(new)


class Merger:
    """Pair merging by rank, with a bounded cache of whole pieces."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        got = self.ranks.get(raw)
        if got is not None:
            return [got]
        if len(raw) > LONG_PIECE:
            return self._merge_long(raw)
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges with a heap over a linked list: n log n for pieces of any length."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def piece(self, s: str) -> list[int]:
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        out = self.merge(s.encode("utf-8", "surrogatepass"))
        if len(s) <= 64:
            self.cache[s] = out
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def _code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    return whole, codes, ends


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and the offset of each text's first id (one more than texts)."""
    return encode_pieces(texts, path)[:2]


def encode_pieces(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``encode_texts``, and for the pieces end to end the character each starts at in its own text, the place of its
    first id among the text's ids, and the offset of each text's first piece (one more than texts)."""
    m = merger(path)
    clean = [t or "" for t in texts]
    whole, codes, ends = _code_points(clean)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    filled = begins < ends
    starts = piece_starts(codes, begins[filled])
    cuts = starts.tolist() + [len(whole)]
    get, miss = m.cache.get, m.piece
    pieces = [get(p) or miss(p) for p in (whole[a:b] for a, b in zip(cuts, cuts[1:]))]
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    total = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((i for p in pieces for i in p), dtype=np.int32, count=int(total[-1]))
    bounds = np.searchsorted(starts, np.concatenate([begins, [len(whole)]]))
    offsets = total[bounds]
    per_text = np.diff(bounds)
    return ids, offsets, starts - np.repeat(begins, per_text), total[:-1] - np.repeat(offsets[:-1], per_text), bounds


def _slices(b: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch in runs of about ``chars`` characters, so that memory is bounded by one text."""
    texts = b.column("text").to_pylist()
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield b.slice(i, j - i), texts[i:j]
        i = j


def encode_corpus(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, ids)``; other columns are dropped."""
    path = vocabulary or default_vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b):
                ids, offsets = encode_texts(texts, path)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def encode_with_offsets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, piece_chars, piece_ids)``: with the ids the offsets that decoding a part needs. Piece ``i`` begins at
    the 0-based character ``piece_chars[i]`` with the id at ``piece_ids[i]``; pieces never share an id."""
    path = vocabulary or default_vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b):
                ids, offsets, chars, firsts, bounds = encode_pieces(texts, path)
                lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(offsets, ids), lists(bounds, chars), lists(bounds, firsts)], names=["doc_id", "ids", "piece_chars", "piece_ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, piece_chars array<int>, piece_ids array<int>")


def ids_between(ids: Column, piece_chars: Column, piece_ids: Column, start: Column, stop: Column) -> Column:
    """The ids of the whole pieces that begin at the 0-based characters from ``start`` up to ``stop``."""
    n = lambda at: F.size(F.filter(piece_chars, lambda c: c < at))
    first = lambda k: F.coalesce(F.try_element_at(piece_ids, k + 1), F.size(ids))
    return F.slice(ids, first(n(start)) + 1, F.greatest(first(n(stop)) - first(n(start)), F.lit(0)))


def count_tokens(docs: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; the ids never leave the worker."""
    path = vocabulary or default_vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b):
                _, offsets = encode_texts(texts, path)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(np.diff(offsets), pa.int64())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, n_tokens bigint")


def decode_ids(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of an id list: the exact inverse of the encoding."""
    path = vocabulary or default_vocabulary_path()

    @F.pandas_udf("string")
    def run(s):
        back = _inverse(path)
        return s.map(lambda v: None if v is None else b"".join(back[int(i)] for i in v).decode("utf-8", "replace"))

    return run(ids)


@lru_cache(maxsize=4)
def _inverse(path: str) -> dict[int, bytes]:
    return {i: b for b, i in merger(path).ranks.items()}
