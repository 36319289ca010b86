from __future__ import annotations

import itertools
import random

import pytest

from prufspark.llm import neardup
from prufspark.llm.neardup import _shingle_set


def brute(rows, t, w):
    sets = {i: _shingle_set(x, w) for i, x in rows if i and x}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = [rng.choice(words)]
        rows.append((f"id{i:03d}", rng.choice([" ", "\n", "  \t"]).join(t)))
    rows += [("dup", rows[0][1]), ("dup", rows[0][1]), ("short", "zwei wörter"), ("empty", ""), ("null", None), (None, "a b c d"), ("long", "sehr langer text " * 3000)]
    return rows


@pytest.mark.parametrize("t, w", [(0.6, 3), (0.8, 5)])
def test_pairs_equal_brute_force(spark, t, w):
    rows = corpus()
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "id string, text string, doc int").repartition(3)
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(df, t, w).collect()}
    assert got == brute(rows, t, w) and got


def test_hot_group_of_copies_and_edits(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(30)]
    rows = [(f"c{i}", " ".join(base)) for i in range(30)]
    for i in range(30):
        e = list(base)
        e[rng.randrange(30)] = f"neu{i}"
        rows.append((f"e{i}", " ".join(e)))
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == brute(rows, 0.6, 3)


def test_groups_close_over_links(spark):
    rows = corpus(60, 9)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(df).collect()}
    parent = {i: i for i, _ in rows if i}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 0.6, 3):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in parent}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.near_duplicate_pairs(df).count() == 0 and neardup.near_duplicate_groups(df).count() == 0


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r["root"] for r in neardup.connected(edges).collect()} == {0}


def test_a_large_class_is_paired_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 4)
    rows = [(f"c{i:02d}", "eins zwei drei vier fünf sechs") for i in range(30)] + [("x", "eins zwei drei vier fünf acht")]
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string")).collect()]
    assert set(got) == brute(rows, 0.6, 3) and len(got) == len(set(got))


def test_blocks_of_a_hot_shingle_all_meet(monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "HOT", 10)
    keys = neardup.mix(np.arange(1, 61, dtype=np.uint64))
    owner = np.repeat(np.arange(60), 2)
    h = np.tile(np.array([5, 9], dtype=np.uint64), 60)
    cost = np.tile(np.array([60, 3]), 60)
    nh, no, ni = neardup.split_hot(h, owner, np.ones(120, bool), cost, keys)
    groups: dict = {}
    for g, o in zip(nh.tolist(), no.tolist()):
        groups.setdefault(g, set()).add(o)
    met = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    assert len(met) == 60 * 59 // 2 and 9 in groups and max(len(g) for k, g in groups.items() if k != 9) < 40 and ni.all()
