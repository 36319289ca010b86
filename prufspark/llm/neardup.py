"""Problem 1: near-duplicate texts over word shingles, exact above the threshold.

1. A count sketch of shingle hashes orders shingles from rare to frequent. Its cells follow the
   size of the input between two bounds (4 and 64 MB); beyond, the order among rare ones is left to chance.
2. Every text sends its rare shingles (the prefix that any partner above the threshold must
   meet) to the partitions that own them, with its size and a token bitmap. Copies of one
   shingle set travel as one: the set's hash is the key of the class. Partitions follow the input.
   A shingle of many texts is split: its texts form blocks, and each two blocks meet in a group
   of their own.
3. Per shingle, a signature tree: nodes hold OR-combined bitmaps and size ranges; a dual
   traversal drops node pairs whose greatest possible overlap is below the need.
4. Surviving pairs of classes are checked on the texts themselves.

The filters are exact, so no pair above the threshold is lost. Defined results: null texts and
texts with fewer than ``width`` words have no shingles and no links; copies of a text under
different ids are links of each other; repeated rows of one id count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.llm.shingles import mix, shingle_hashes
from prufspark.plans.lineage import cut

SKETCH_BITS = 20
MOST_SKETCH_BITS = 24
SHINGLES_PER_CELL = 16
SHINGLES_PER_PART = 4_000_000
HOT = 20_000  # Texts of a shingle from which on they are split into blocks.
FEW = 200_000  # Rows of some 100 bytes that are broadcast.
COPIES = 1_000  # Members of a class that meet all others in one task.
SKETCH_CHUNK = 1 << 14
BITMAP_WORDS = 3
FANOUT = 8
FRONTIER = 2_000_000


def _rows(b: pa.RecordBatch, step: int = 4000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def shingle_sketch(texts: DataFrame, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of shingle hashes in ``2**bits`` cells; a text repeated within a task counts once."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, dtype=np.int64)
        seen: set[int] = set()
        for big in batches:
            for b in _rows(big):
                fresh = []
                for t in b.column("text").to_pylist():
                    k = hash(t)
                    if k not in seen:
                        seen.add(k)
                        fresh.append(t)
                if len(seen) > 500_000:
                    seen.clear()
                h, _ = shingle_hashes(fresh, width)
                cells += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if cells.any():
            low = np.minimum(cells, 2**31 - 1).astype(np.int32)
            parts = range(0, size, SKETCH_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([i // SKETCH_CHUNK for i in parts], pa.int32()), pa.array([low[i : i + SKETCH_CHUNK].tobytes() for i in parts], pa.binary())], names=["part", "cells"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype=np.int32).astype(np.int64) for c in table.column("cells").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    out = np.zeros(size, dtype=np.int32)
    for r in texts.select("text").mapInArrow(count, "part int, cells binary").groupBy("part").applyInArrow(add, "part int, cells binary").toLocalIterator():
        got = np.frombuffer(r["cells"], dtype=np.int32)
        out[r["part"] * SKETCH_CHUNK : r["part"] * SKETCH_CHUNK + len(got)] = got
    return out


def text_sets(texts: list[str | None], width: int, cells: np.ndarray | None):
    """Distinct shingles per text, rare first: flat hashes, sizes, and the hash of each whole set."""
    h, owner = shingle_hashes(texts, width)
    cost = cells[(h & np.uint64(len(cells) - 1)).astype(np.int64)].astype(np.int64) if cells is not None else np.zeros(len(h), np.int64)
    order = np.lexsort((h, (owner << 32) | cost))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner, cost = h[first], owner[first], cost[order][first]
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    keys = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        at = (np.cumsum(n) - n)[filled]
        keys[filled] = mix(np.add.reduceat(mix(h), at) + n[filled].astype(np.uint64))
    return h, owner, cost, n, keys


def _least(t: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


def prefix_rows(texts: DataFrame, width: int, threshold: float, parts: int, cells) -> DataFrame:
    """One row per class and partition that owns some of its prefix shingles."""
    schema = "part int, doc bigint, n int, sig binary, n_index int, keys binary"
    n_bits = BITMAP_WORDS * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = cells.value
        seen: set[int] = set()
        for big in batches:
            for b in _rows(big):
                h, owner, cost, n, keys = text_sets(b.column("text").to_pylist(), width, sketch)
                fresh = np.zeros(len(n), dtype=bool)
                for i, k in enumerate(keys.tolist()):
                    if n[i] and k not in seen:
                        fresh[i] = True
                        seen.add(k)
                if len(seen) > 500_000:
                    seen.clear()
                bitmap = np.zeros((len(n), n_bits), dtype=bool)
                bitmap[owner, ((h >> np.uint64(40)) % np.uint64(n_bits)).astype(np.int64)] = True
                sig = np.packbits(bitmap, axis=1)
                place = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
                probe = n - _least(threshold, n) + 1
                index = n - _least(2 * threshold / (1 + threshold), n) + 1
                keep = (place < probe[owner]) & (cost > 1) & fresh[owner]
                h, owner, is_index, cost = h[keep], owner[keep], (place < index[owner])[keep], cost[keep]
                if not len(h):
                    continue
                h, owner, is_index = split_hot(h, owner, is_index, cost, keys)
                part = (h % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((~is_index, owner * parts + part))
                h, owner, part, is_index = h[order], owner[order], part[order], is_index[order]
                at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])))
                ends = np.append(at[1:], len(h))
                own = owner[at]
                raw = pa.py_buffer(h.tobytes())
                offs = pa.py_buffer((np.append(at, len(h)) * 8).astype(np.int32).tobytes())
                sigs = pa.py_buffer(np.ascontiguousarray(sig[own]).tobytes())
                step = pa.py_buffer((np.arange(len(at) + 1) * (n_bits // 8)).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[at].astype(np.int32)),
                        pa.array(keys[own].view(np.int64)),
                        pa.array(n[own].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, step, sigs]),
                        pa.array(np.add.reduceat(is_index.astype(np.int32), at).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, offs, raw]),
                    ],
                    names=["part", "doc", "n", "sig", "n_index", "keys"],
                )
                del ends

    return texts.select("text").mapInArrow(run, schema)


def split_hot(h: np.ndarray, owner: np.ndarray, is_index: np.ndarray, cost: np.ndarray, keys: np.ndarray):
    """Shingles of over ``HOT`` texts become a shingle per pair of blocks; a text belongs to one block, so any two texts
    of the shingle meet, and no group holds more than two blocks."""
    blocks = -(-cost // HOT)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return h, owner, is_index
    times = blocks[hot]
    row = np.repeat(hot, times)
    other = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    mine = mix(keys[owner[row]]) % blocks[row].astype(np.uint64)
    pair = np.minimum(mine, other) * np.uint64(1 << 20) + np.maximum(mine, other) + np.uint64(1)
    cold = np.flatnonzero(blocks <= 1)
    return (
        np.concatenate([h[cold], mix(h[row] ^ mix(pair))]),
        np.concatenate([owner[cold], owner[row]]),
        np.concatenate([is_index[cold], is_index[row]]),
    )


class SignatureTree:
    """Trees over all groups of one partition, level by level.

    Items are sorted by (group, size); a node covers up to FANOUT nodes below it of one group.
    """

    def __init__(self, group: np.ndarray, sig: np.ndarray, n: np.ndarray, indexed: np.ndarray, threshold: float) -> None:
        self.t = threshold
        slack = n - np.bitwise_count(sig).sum(1).astype(np.int64)
        self.levels = [(group, sig, n, n, slack, indexed, None, None)]
        while len(group) and (group[1:] == group[:-1]).any():
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(begin, len(group)))
            place = np.arange(len(group)) - np.repeat(begin, size)
            at = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.append(at, len(group)))
            _, sig, lo, hi, slack, indexed, *_ = self.levels[-1]
            group = group[at]
            sig = np.bitwise_or.reduceat(sig, at, axis=0)
            self.levels.append((group, sig, np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), np.logical_or.reduceat(indexed, at), at, count))

    def _possible(self, level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """May a pair below (u, v), u's item the smaller one, reach the threshold?"""
        _, sig, lo, hi, slack, indexed, *_ = self.levels[level]
        ok = indexed[u] & (hi[u] >= self.t * lo[v] - 1e-9)
        u, v = u[ok], v[ok]
        most = np.bitwise_count(sig[u] & sig[v]).sum(1, dtype=np.int64) + np.minimum(slack[u], slack[v])
        ok[ok] = most >= self.t / (1 + self.t) * (lo[u] + lo[v]) - 1e-9
        return ok

    def _expand(self, level: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, count = self.levels[level][6:]
        cu, cv = count[u], count[v]
        total = cu * cv
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        w = np.repeat(cv, total)
        a = np.repeat(at[u], total) + k // w
        b = np.repeat(at[v], total) + k % w
        keep = a <= b if level > 1 else a < b
        return a[keep], b[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item pairs (smaller, larger) that no bound rules out."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)] if top else []
        while stack:
            level, u, v = stack.pop()
            if len(u) > 1 and len(u) * FANOUT * FANOUT > FRONTIER * 2:
                half = len(u) // 2
                stack += [(level, u[half:], v[half:]), (level, u[:half], v[:half])]
                continue
            a, b = self._expand(level, u, v)
            ok = self._possible(level - 1, a, b)
            a, b = a[ok], b[ok]
            if level == 1:
                if len(a):
                    yield a, b
            elif len(a):
                stack.append((level - 1, a, b))


def _partition_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    doc = table.column("doc").to_numpy()
    _, first = np.unique(doc, return_index=True)
    table = table.take(pa.array(first))
    doc, n = table.column("doc").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint64).reshape(len(doc), BITMAP_WORDS)
    blobs = table.column("keys").to_pylist()
    size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 8
    key = np.frombuffer(b"".join(blobs), dtype=np.uint64)
    row = np.repeat(np.arange(len(doc)), size)
    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    indexed = place < table.column("n_index").to_numpy()[row]
    del table, blobs
    rank = np.empty(len(doc), dtype=np.int64)
    rank[np.lexsort((doc, n))] = np.arange(len(doc))
    order = np.lexsort((rank[row], key))
    key, row, indexed = key[order], row[order], indexed[order]
    same = key[1:] == key[:-1]
    several = np.append(same, False) | np.append(False, same)
    key, row, indexed = key[several], row[several], indexed[several]
    if not len(key):
        return
    found: list[np.ndarray] = []
    held = 0
    tree = SignatureTree(key, sig[row], n[row], indexed, threshold)
    for a, b in tree.pairs():
        found.append(np.unique(row[a] * len(doc) + row[b]))
        held += len(found[-1])
        if held > FRONTIER:
            found = [np.unique(np.concatenate(found))]
            held = 0
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    for i in range(0, len(pairs), 100_000):
        a, b = doc[pairs[i : i + 100_000] // len(doc)], doc[pairs[i : i + 100_000] % len(doc)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def classes(texts: DataFrame, width: int) -> DataFrame:
    """``(id, text)`` to ``(doc, id, th)``: the class key of every text that has a shingle, and the text's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _rows(big):
                _, _, _, n, keys = text_sets(b.column("text").to_pylist(), width, None)
                out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("id"), b.column("th")], names=["doc", "id", "th"])
                yield out.filter(pa.array(n > 0))

    return texts.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc bigint, id string, th bigint")


def _shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    w = [x for x in text.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    return set(zip(*(w[i:] for i in range(width))))


def _similar(width: int, threshold: float):
    @F.pandas_udf("boolean")
    def run(a, b):
        out = []
        for x, y in zip(a, b):
            s, t = _shingle_set(x, width), _shingle_set(y, width)
            both = len(s & t)
            out.append(both >= threshold * (len(s) + len(t) - both) - 1e-12)
        import pandas as pd

        return pd.Series(out, dtype=bool)

    return run


def _linked(texts: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Class pairs above the threshold and the members ``(doc, id)`` of all classes."""
    spark = texts.sparkSession
    texts = texts.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")
    shingles = (texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // 6
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // SHINGLES_PER_PART)
    bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, (shingles // SHINGLES_PER_CELL).bit_length()))
    cells = spark.sparkContext.broadcast(shingle_sketch(texts, width, bits))
    rows = prefix_rows(texts, width, threshold, parts, cells)
    candidates = (
        rows.repartitionById(parts, F.col("part"))
        .select("doc", "n", "sig", "n_index", "keys")
        .mapInArrow(lambda it: _partition_pairs(it, threshold), "a bigint, b bigint")
        .distinct()
    )
    candidates = cut(candidates)
    members = cut(classes(texts, width).distinct())
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    # Each class in a pair is looked at by one of its texts.
    chosen = members.join(wanted, "doc", "left_semi").groupBy("doc").agg(F.min(F.struct("id", "th")).alias("m")).select("doc", "m.*")
    chosen = cut(chosen)
    if chosen.limit(FEW + 1).count() <= FEW:
        # Few enough to go to the texts instead of the texts to them.
        chosen = F.broadcast(chosen)
    one = texts.withColumn("th", F.xxhash64("text")).join(chosen, ["id", "th"]).groupBy("doc").agg(F.min("text").alias("text"))
    pairs = (
        candidates.join(one.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
        .join(one.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
        .where(_similar(width, threshold)("text_a", "text_b"))
        .select("a", "b")
    )
    return pairs, members.select("doc", "id").distinct()


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """All pairs ``(id_a, id_b)``, ``id_a < id_b``, of ``texts(id, text)`` with Jaccard similarity of at least ``threshold``."""
    pairs, members = _linked(texts, threshold, width)
    members = cut(members)
    # All members of a class are linked; each meets the others of a large class part by part.
    far = pairs.join(members.select(F.col("doc").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("doc").alias("b"), F.col("id").alias("y")), "b").where("x <> y").select("x", "y")
    several = members.groupBy("doc").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("salts"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = members.join(several, "doc")
    one = copies.select("doc", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("x"))
    two = copies.select("doc", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("y"))
    near = one.join(two, ["doc", "salt"]).where("x < y").select("x", "y")
    return far.unionByName(near).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def connected(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(a, b)`` to ``(node, root)``, root the least node reached: label propagation with pointer jumping.

    Labels halve their distance to the root each round, so rounds grow with the logarithm of a
    chain's length; each round is written to the shared checkpoint folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = step.alias("s").join(step.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        new = cut(jump.select("node", F.least("root", F.coalesce("far", "root")).alias("root")))
        moved = new.join(labels.select("node", F.col("root").alias("old")), "node").where("root <> old").limit(1).count()
        labels, done = new, done + 1
        if not moved:
            break
    return labels


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """One row ``(id, group_id, n_copies, n_links)`` per id: groups are closed over links, ``group_id`` is the least id.

    ``n_copies`` counts ids with the same shingle set, ``n_links`` linked classes. Ids without shingles are groups of their own.
    """
    pairs, members = _linked(texts, threshold, width)
    pairs, members = cut(pairs), cut(members)
    roots = connected(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("doc").agg(F.count("*").alias("n_copies"), F.min("id").alias("least"))
    sizes = sizes.join(degree, "doc", "left").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    sizes = sizes.select("doc", "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "least", F.coalesce("root", "doc").alias("root"))
    group = sizes.groupBy("root").agg(F.min("least").alias("group_id"))
    known = members.join(sizes.join(group, "root"), "doc").select("id", "group_id", "n_copies", "n_links")
    ids = texts.where("id is not null").select("id").distinct()
    return ids.join(known, "id", "left").select(
        "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")
    )
