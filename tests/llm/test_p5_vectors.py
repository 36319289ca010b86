from __future__ import annotations

import numpy as np
import pyarrow as pa

from prufspark.llm import vectors


def data(n=900, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 12, dim))
    x = centre[rng.integers(0, len(centre), n)] + 0.25 * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


def brute(ids, x, k, least):
    u = vectors.unit(x.astype(np.float64))
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(ids)):
        c = [j for j in range(len(ids)) if j != i and s[i, j] >= least]
        c.sort(key=lambda j: (-s[i, j], ids[j]))
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in c[:k]}
    return out


def test_recall_and_exact_cosines(spark):
    x = data()
    x[5] = x[4]
    ids = [f"v{i:04d}" for i in range(len(x))]
    a = spark.createDataFrame([(i, v.tolist(), "q") for i, v in zip(ids, x)], "id string, vec array<float>, other string")
    odd = spark.createDataFrame([("n", None), ("e", []), ("z", [0.0] * 12), ("s", [1.0] * 11), (ids[0], x[0].tolist()), ("f", [float("nan")] + [1.0] * 11)], "id string, vec array<float>")
    got = {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(vectors.nearest_vectors([a, odd], dim=12)).collect()}
    want = brute(ids, x, 10, 0.8)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)


def test_small_and_empty(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, vec array<float>")
    assert [tuple(r) for r in vectors.similar_pairs(vectors.nearest_vectors([df], dim=2)).collect()] == [("a", "b")]
    assert vectors.nearest_vectors([df.limit(0)], dim=2).count() == 0


def test_large_leaf_is_spread_without_loss(spark, monkeypatch):
    x = data(300)
    ids = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    got = {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(vectors.nearest_vectors([df], dim=12)).collect()}
    assert got == brute(ids, x, 10, 0.8)


def test_visits_follow_the_queue():
    x = vectors.unit(data(400).astype(np.float64)).astype(np.float32)
    t = vectors.KMeansTree.fit(x, 40)
    order = t.visits(x[:20], t.n_leaves)
    assert all(sorted(o) == list(range(t.n_leaves)) for o in order.tolist())


def test_a_vector_that_many_ids_have(spark):
    x = data(300)
    x[::3] = x[0]
    ids = [f"v{(i * 7) % 300:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>").repartition(6)
    got = {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(vectors.nearest_vectors([df, df], dim=12)).collect()}
    assert got == brute(ids, x, 10, 0.8)


def test_a_leaf_of_many_rows_gets_a_tree_of_its_own(spark, monkeypatch):
    x = data(2400)
    ids = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    t = pa.table({"id": ids, "k1": list(range(len(x))), "k2": [0] * len(x), "home": [0] * len(x), "leaves": [[0]] * len(x), "vec": [v.tobytes() for v in x]})
    monkeypatch.setattr(vectors, "SUB_ROWS", 300)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 32)
    got = {(ids[q], o) for b in vectors._search(t, 12, 11, 0.8, 0.99) for q, o in zip(b.column("k1").to_pylist(), b.column("other").to_pylist()) if ids[q] != o}
    pairs = {(min(p), max(p)) for p in got}
    want = brute(ids, x, 10, 0.8)
    assert len(pairs & want) / len(want) >= 0.95


def test_no_leaf_that_may_hold_a_similar_vector_is_left_out():
    x = vectors.unit(data(800).astype(np.float64)).astype(np.float32)
    t = vectors.KMeansTree.fit(x, 40)
    home = t.visits(x, 1)[:, 0]
    node = {t.leaf[i]: i for i in np.flatnonzero(t.leaf >= 0)}
    low = np.array([min((x[home == v] @ t.centres[node[v]]).tolist(), default=1.0) for v in range(t.n_leaves)])
    seen = vectors.allowed_visits(t, x, t.n_leaves, low, 0.8)
    assert (seen < 0).any()
    for i, j in zip(*np.nonzero(x @ x.T >= 0.8)):
        assert home[j] in seen[i]
