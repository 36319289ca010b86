from __future__ import annotations

import itertools
import random

import pytest

import prufspark.operators as operators
from __spark_entry__ import queries

GOLD = (
    "case_id string, segment_id string, gold_findings array<struct<finding_id: string, subclass_id: string, change_type_id: string, severity_id: string, span_text: string, "
    "correction: string, rationale: string, source: string, source_refs: array<string>, agent_scope: string, detection_finding_id: string>>"
)


def similar(spark, folder, spans):
    rows = [("c", f"s{k}", [(i, None, None, None, s, None, None, None, [], None, None)]) for k, (i, s) in enumerate(spans)]
    spark.createDataFrame(rows, GOLD).write.parquet(f"{folder}/gold.parquet")
    df = queries()["token_jaccard_pairs"](spark, str(folder))
    return df, sorted((r["id_a"], r["id_b"]) for r in df.collect())


def brute(spans):
    sets = sorted((i, set(s.split())) for i, s in spans if i and s and s.split())
    return [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) / len(x | y) >= 0.6 - 1e-12]


def rows_joined(df) -> int:
    """Most rows that a join of the executed plan gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in kind:
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


@pytest.mark.parametrize("part", [None, 16])
def test_pairs_that_are_not_similar_are_no_rows(spark, tmp_path, monkeypatch, part):
    if part:
        monkeypatch.setattr(operators.tokensets, "PART", part)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    spans = [(f"f{k:03d}", " ".join(rng.sample(words, 8))) for k in range(400)]
    spans += [(f"g{k:03d}", f"{spans[k][1]} x{k % 3}") for k in range(30)]
    df, got = similar(spark, tmp_path, spans)
    assert got == brute(spans) and len(got) > 30
    most = rows_joined(df)
    assert 0 < most < 15_000, most


def test_sizes_and_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    spans = [(f"f{k:03d}", " ".join(rng.choices(words[: rng.choice([3, 8, 25])], k=rng.choice([1, 2, 3, 5, 8, 40, 90])))) for k in range(200)]
    spans += [("n1", ""), ("n2", None), ("n3", "  "), ("n4", "allein"), ("z", " ".join(words))]
    df, got = similar(spark, tmp_path, [*spans, (None, spans[0][1]), (None, spans[0][1] + " w0 w1")])
    assert got == brute(spans) and len(got) > 1_000


def test_no_pair_at_all(spark, tmp_path):
    assert similar(spark, tmp_path, [("a", "eins zwei"), ("b", "drei"), ("c", "")])[1] == []
