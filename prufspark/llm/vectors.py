"""Problem 5: the most similar vectors of every vector.

A hierarchical k-means tree is fitted on a bounded sample. Every vector is filed in the leaf
that a best-bin-first traversal reaches first; as a query it visits further leaves in the order
of the priority queue, as many as the recall calibrated on the sample asks for, but none whose
greatest angle rules out any similar vector. Leaves that lie close together share a partition, so
a vector travels once per partition it visits. A leaf that holds many rows (the sample bounds the
leaves, not the rows) gets a tree of its own where it is searched, with its own calibration.

Equal vectors are one class: as many of its ids as a list can need are filed, the class asks once,
and its members get the answer by a join, so a vector that a third of all ids have is no hot spot.

Defined results: null vectors, vectors of another length, all-zero and non-finite ones are left
out; an id given several times counts once; cosines equal to nine decimals are ordered by id.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIT_SAMPLE = 16_000
SAMPLE_PER_LEAF = 8
CALIBRATION_QUERIES = 2_000
TARGET_RECALL = 0.99
LEAST_VISITS = 8
ROWS_PER_PARTITION = 40_000
LEAF_ROWS = 256
SUB_ROWS = 4_096  # A leaf of more rows is searched by a tree of its own.
BRANCH = 16
BLOCK_ROWS = 50_000
PRODUCT = 4_000_000
HELD = 2_000_000
SEED = 7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; returns unit centres."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        lost = norm < 1e-9
        total[lost], norm[lost] = x[rng.choice(len(x), lost.sum())], 1
        centres = total / norm[:, None]
    return centres.astype(np.float32)


@dataclass
class KMeansTree:
    """Nodes in depth-first order: ``centres[i]``, its ``children``; ``leaf[i]`` numbers leaves, -1 inside."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    roots: np.ndarray
    n_leaves: int

    @staticmethod
    def fit(x: np.ndarray, leaves: int, seed: int = SEED) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centres: list[np.ndarray] = []
        children: list[np.ndarray] = []
        leaf: list[int] = []

        def grow(part: np.ndarray, want: int) -> np.ndarray:
            k = min(BRANCH, want, max(1, len(part) // 4))
            if k <= 1:
                c = part.mean(0) if len(part) else np.ones(x.shape[1])
                cs = (c / max(np.linalg.norm(c), 1e-9))[None].astype(np.float32)
            else:
                cs = _kmeans(part, k, rng)
            near = (part @ cs.T).argmax(1) if len(part) else np.zeros(0, int)
            out = []
            for i, c in enumerate(cs):
                at = len(centres)
                centres.append(c)
                children.append(np.zeros(0, int))
                leaf.append(-1)
                out.append(at)
                own = part[near == i]
                share = round(want * len(own) / max(1, len(part)))
                if share > 1 and len(own) >= 8 and k > 1:
                    children[at] = grow(own, share)
                else:
                    leaf[at] = sum(v >= 0 for v in leaf)
            return np.array(out)

        roots = grow(x.astype(np.float32), max(1, leaves))
        leaf_no = np.array(leaf)
        return KMeansTree(np.stack(centres), children, leaf_no, roots, int((leaf_no >= 0).sum()))

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` leaves of each row in best-bin-first order, -1 where there are fewer.

        All rows run their queues side by side: a row of ``queue`` holds the open nodes' priorities."""
        n = min(n, self.n_leaves)
        out = np.full((len(x), n), -1, dtype=np.int32)
        score = x.astype(np.float32) @ self.centres.T
        queue = np.full_like(score, -np.inf)
        queue[:, self.roots] = score[:, self.roots]
        got = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            best = queue[todo].argmax(1)
            alive = np.isfinite(queue[todo, best])
            todo, best = todo[alive], best[alive]
            queue[todo, best] = -np.inf
            is_leaf = self.leaf[best] >= 0
            r = todo[is_leaf]
            out[r, got[r]] = self.leaf[best[is_leaf]]
            got[r] += 1
            inner_rows, inner = todo[~is_leaf], best[~is_leaf]
            for node in np.unique(inner):
                rows = inner_rows[inner == node]
                kids = self.children[node]
                queue[np.ix_(rows, kids)] = score[np.ix_(rows, kids)]
            todo = todo[got[todo] < n]
        return out


def calibrate(tree: KMeansTree, sample: np.ndarray, k: int, least: float, recall: float, queries: int = CALIBRATION_QUERIES) -> int:
    """The number of leaf visits at which that share of the sample's own exact neighbours is met."""
    rng = np.random.default_rng(SEED)
    q = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    home = np.concatenate([tree.visits(sample[i : i + 4096], 1)[:, 0] for i in range(0, len(sample), 4096)])
    ranks = []
    for i in range(0, len(q), 500):
        rows = q[i : i + 500]
        s = sample[rows] @ sample.T
        s[np.arange(len(rows)), rows] = -2
        top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        r, c = np.nonzero(np.take_along_axis(s, top, 1) >= least)
        order = tree.visits(sample[rows], tree.n_leaves)
        where = np.argsort(order, axis=1)
        ranks.append(where[r, home[top[r, c]]])
    got = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    if not len(got):
        return min(8, tree.n_leaves)
    return int(got[min(len(got) - 1, int(np.ceil(recall * len(got))) - 1)]) + 1


def vector_rows(tables: list[DataFrame], dim: int) -> DataFrame:
    """``(id, vec)`` of usable vectors from tables with those two columns."""
    out = None
    for t in tables:
        t = t.select("id", "vec").where(F.col("id").isNotNull() & (F.size("vec") == dim))
        out = t if out is None else out.unionByName(t)
    return out.where(F.exists("vec", lambda v: v != 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _fit(vectors: DataFrame, dim: int, k: int, least: float, recall: float, sample_rows: int) -> tuple[KMeansTree | None, int, int]:
    """Tree, visits and number of rows; the sample is the rows whose id hash is below a share, about ``sample_rows``."""
    total = vectors.count()
    if not total:
        return None, 0, 0
    share = min(1.0, sample_rows / total)
    chosen = vectors if share == 1.0 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = (chosen if share == 1.0 or chosen.limit(1).count() else vectors.limit(1)).select("id", "vec").toArrow()
    ids = np.array(rows.column("id").to_pylist(), dtype=object)
    seen = np.unique(ids, return_index=True)[1]
    sample = unit(_matrix(rows.column("vec"), dim)[seen].astype(np.float64)).astype(np.float32)
    tree = KMeansTree.fit(sample, max(1, min(total // LEAF_ROWS, len(sample) // SAMPLE_PER_LEAF)))
    return tree, max(LEAST_VISITS, calibrate(tree, sample, k, least, recall)), total


def allowed_visits(tree: KMeansTree, x: np.ndarray, n: int, cosines: np.ndarray, least: float) -> np.ndarray:
    """``visits`` with -1 for leaves in which no vector can reach ``least``: ``cosines`` holds each leaf's smallest
    cosine between its centre and a row."""
    seen = tree.visits(x, n)
    at = np.flatnonzero(tree.leaf >= 0)
    node = np.zeros(tree.n_leaves, dtype=np.int64)
    node[tree.leaf[at]] = at
    angle = np.arccos(np.clip(np.einsum("ij,ikj->ik", x.astype(np.float32), tree.centres[node[np.maximum(seen, 0)]]), -1, 1))
    reach = np.arccos(np.clip(cosines, -1, 1))[np.maximum(seen, 0)] + np.arccos(least) + 2e-3
    seen[angle > reach] = -1
    return seen


def nearest_vectors(tables: list[DataFrame], k: int = 10, least: float = 0.8, dim: int = 96, recall: float = TARGET_RECALL, sample_rows: int = FIT_SAMPLE) -> DataFrame:
    """``(id, other, cosine)``: up to ``k`` others of largest cosine, at least ``least``, for every id."""
    schema = "id string, other string, cosine double"
    vectors = vector_rows(tables, dim)
    spark = vectors.sparkSession
    tree, n_visits, total = _fit(vectors, dim, k, least, recall, sample_rows)
    if tree is None:
        return spark.createDataFrame([], schema)
    # Equal vectors share two independent hashes.
    vectors = vectors.select("id", "vec", F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2"))
    shared = spark.sparkContext.broadcast(tree)
    counts, cosines = np.zeros(tree.n_leaves, dtype=np.int64), np.ones(tree.n_leaves)

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        at = np.flatnonzero(t.leaf >= 0)
        node = np.zeros(t.n_leaves, dtype=np.int64)
        node[t.leaf[at]] = at
        got, low = np.zeros(t.n_leaves, dtype=np.int64), np.ones(t.n_leaves)
        for b in batches:
            x = unit(_matrix(b.column("vec"), dim).astype(np.float64)).astype(np.float32)
            for i in range(0, len(x), 4096):
                home = t.visits(x[i : i + 4096], 1)[:, 0]
                got += np.bincount(home, minlength=len(got))
                np.minimum.at(low, home, np.einsum("ij,ij->i", x[i : i + 4096], t.centres[node[home]]))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at]), pa.array(low[at].astype(np.float64))], names=["leaf", "n", "low"])

    for r in vectors.select("vec").mapInArrow(leaf_counts, "leaf int, n bigint, low double").groupBy("leaf").agg(F.sum("n").alias("n"), F.min("low").alias("low")).collect():
        counts[r["leaf"]], cosines[r["leaf"]] = r["n"], r["low"]
    # Leaves side by side in the tree share a partition; a leaf of more than BLOCK_ROWS rows is spread over several.
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_PARTITION, int(blocks.sum()) if (blocks > 1).any() else 0)
    first = np.floor(np.concatenate([[0], np.cumsum(counts)[:-1]]) / max(1, counts.sum()) * parts).astype(np.int64)
    layout = spark.sparkContext.broadcast((first, blocks, cosines))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, n_blocks, low = layout.value
        held: dict[tuple[int, int], list[str]] = {}
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                # Of a class, only ids that are among its first k + 1 so far are filed.
                keep = []
                for i, (id_, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "k1", "k2")))):
                    firsts = held.setdefault(tuple(key), [])
                    if id_ not in firsts and (len(firsts) <= k or id_ < firsts[-1]):
                        insort(firsts, id_)
                        del firsts[k + 1 :]
                        keep.append(i)
                if len(held) > 300_000:
                    held.clear()
                b = b.take(pa.array(keep, pa.int32()))
                if not b.num_rows:
                    continue
                raw = _matrix(b.column("vec"), dim).astype(np.float32)
                seen = allowed_visits(shared.value, unit(raw.astype(np.float64)), n_visits, low, least)
                ids = b.column("id").to_pylist()
                rows, parts_, leaves, homes = [], [], [], []
                for i, order in enumerate(seen.tolist()):
                    to: dict[int, list[int]] = {}
                    home = -1
                    for j, leaf in enumerate(order):
                        if leaf < 0:
                            continue
                        m = int(n_blocks[leaf])
                        if j == 0:
                            home = (int(begin[leaf]) + (hash_id(ids[i]) % m if m > 1 else 0)) % parts
                            to.setdefault(home, [])
                        for z in range(m):
                            to.setdefault((int(begin[leaf]) + z) % parts, []).append(leaf)
                    for p, ls in to.items():
                        rows.append(i)
                        parts_.append(p)
                        leaves.append(ls)
                        homes.append(order[0] if p == home else -1)
                out = b.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts_, pa.int32()), out.column("id"), out.column("k1"), out.column("k2"), pa.array(homes, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(rows), [None, pa.py_buffer(raw[rows].tobytes())]).cast(pa.binary())],
                    names=["part", "id", "k1", "k2", "home", "leaves", "vec"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _search(pa.Table.from_batches(held), dim, k + 1, least, recall)

    sent = vectors.mapInArrow(send, "part int, id string, k1 bigint, k2 int, home int, leaves array<int>, vec binary")
    near = sent.repartitionById(parts, F.col("part")).mapInArrow(search, "k1 bigint, k2 int, other string, cosine double")
    order = Window.partitionBy("k1", "k2").orderBy(F.round("cosine", 9).desc(), "other")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = ranked.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "cosine"))).alias("found"))
    members = vectors.select("id", "k1", "k2").distinct()
    own = members.join(lists, ["k1", "k2"]).select("id", F.inline(F.slice(F.filter("found", lambda x: x["other"] != F.col("id")), 1, k)))
    return own.select("id", "other", "cosine")


def hash_id(s: str) -> int:
    return zlib.crc32(s.encode())


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest of each ``q``; positions ``c`` are in order of id, so the smaller id comes first among equals."""
    order = np.lexsort((c, -np.round(s, 9), q))
    q, c, s = q[order], c[order], s[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return q[place < k], c[place < k], s[place < k]


def _groups(low: np.ndarray, rows: np.ndarray, qs: np.ndarray, k: int, least: float, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(queries, rows)`` to compare in one leaf: all at once, or along a tree of the leaf's own."""
    if len(rows) <= SUB_ROWS:
        yield qs, rows
        return
    rng = np.random.default_rng(SEED)
    sample = low[rng.choice(rows, min(len(rows), 2 * SUB_ROWS), replace=False)]
    tree = KMeansTree.fit(sample, max(1, min(len(rows) // LEAF_ROWS, len(sample) // SAMPLE_PER_LEAF)))
    n = max(LEAST_VISITS, calibrate(tree, sample, k, least, recall, 500))
    home = np.concatenate([tree.visits(low[rows[i : i + 4096]], 1)[:, 0] for i in range(0, len(rows), 4096)])
    seen = np.concatenate([tree.visits(low[qs[i : i + 4096]], n) for i in range(0, len(qs), 4096)])
    who, to = np.nonzero(seen >= 0)
    leaf = seen[who, to]
    order, filed = np.argsort(leaf, kind="stable"), np.argsort(home, kind="stable")
    who, leaf, own = who[order], leaf[order], home[filed]
    for v in np.unique(leaf):
        r = rows[filed[np.searchsorted(own, v) : np.searchsorted(own, v, side="right")]]
        if len(r):
            yield qs[who[np.searchsorted(leaf, v) : np.searchsorted(leaf, v, side="right")]], r


def _search(t: pa.Table, dim: int, k: int, least: float, recall: float) -> Iterator[pa.RecordBatch]:
    """Exact cosines between the classes that visit a leaf and its rows, in blocks; only the best ``k`` of each are held."""
    ids = np.array(t.column("id").to_pylist(), dtype=object)
    home = t.column("home").to_numpy()
    rank = np.lexsort((-home, ids))
    keep = rank[np.append(True, ids[rank][1:] != ids[rank][:-1])]
    ids, home = ids[keep], home[keep]
    t = t.take(pa.array(keep))
    k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
    x = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64))
    low = x.astype(np.float32)
    # One row per class asks.
    by_class = np.lexsort((k2, k1))
    asks = np.zeros(len(ids), dtype=bool)
    asks[by_class[np.append(True, (k1[by_class][1:] != k1[by_class][:-1]) | (k2[by_class][1:] != k2[by_class][:-1]))]] = True
    lists = t.column("leaves").combine_chunks()
    visitor = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    leaf = lists.flatten().to_numpy()
    leaf, visitor = leaf[asks[visitor]], visitor[asks[visitor]]
    order = np.argsort(leaf, kind="stable")
    leaf, visitor = leaf[order], visitor[order]
    own = np.argsort(home, kind="stable")
    filed = home[own]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for v in np.unique(leaf):
        rows = own[np.searchsorted(filed, v) : np.searchsorted(filed, v, side="right")]
        if not len(rows):
            continue
        for qs, rs in _groups(low, rows, visitor[np.searchsorted(leaf, v) : np.searchsorted(leaf, v, side="right")], k, least, recall):
            step = max(1, PRODUCT // len(rs))
            for i in range(0, len(qs), step):
                q = qs[i : i + step]
                s = low[q] @ low[rs].T
                # Of many near rows only those that may be among the first are worked out exactly.
                floor = np.full(len(q), least - 1e-5, dtype=np.float32)
                if len(rs) > 4 * k:
                    floor = np.maximum(floor, np.partition(s, len(rs) - k, axis=1)[:, len(rs) - k] - np.float32(1e-5))
                a, b = np.nonzero(s >= floor[:, None])
                a, b = q[a], rs[b]
                exact = np.einsum("ij,ij->i", x[a], x[b])
                ok = np.round(exact, 9) >= least
                out.append(_best(a[ok], b[ok], exact[ok], k))
                held += len(out[-1][0])
                if held > HELD:
                    out = [_best(*(np.concatenate(z) for z in zip(*out)), k)]
                    held = len(out[0][0])
    if not out:
        return
    q, c, s = _best(*(np.concatenate(z) for z in zip(*out)), k)
    for i in range(0, len(q), 50_000):
        z = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(k1[q[z]]), pa.array(k2[q[z]]), pa.array(ids[c[z]], pa.string()), pa.array(s[z])], names=["k1", "k2", "other", "cosine"])


def similar_pairs(near: DataFrame) -> DataFrame:
    """Pairs in which either id is in the other's list."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
