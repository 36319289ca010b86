from __future__ import annotations

import random

from prufspark.llm import mixing


def setup(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["wort"] * rng.randint(1, 30)), "de" if i % 3 else "fr", rng.choice(["a"] * 9 + ["b", None])) for i in range(400)]
    docs += [(1000, None, "de", "a"), (1001, "", "de", "b")]
    t = [("p", "a", 0.5, 1, 0.9), ("p", "b", 0.5, 3, 0.9), ("q", "a", 1.0, 1, 9.0), ("q", "fehlt", 1.0, 2, 9.0), ("z", "a", 0.0, 2, 0.5), ("n", "a", None, None, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(t, "plan_name string, source string, target_weight double, max_repeats int, size_ratio double")


def test_budgets_shares_and_repeats(spark):
    docs, targets = setup(spark)
    rows = mixing.mixture(docs, targets, domains={}).collect()
    rep = {(r["plan_name"], r["source"]): r for r in mixing.mixture_report(docs, targets, domains={}).collect()}
    for (plan, s), r in rep.items():
        mine = [x for x in rows if (x["plan_name"], x["source"]) == (plan, s)]
        assert r["actual_tokens"] == sum(x["n_tokens"] * x["copies"] for x in mine) and r["n_docs"] == len(mine)
        assert all(1 <= x["copies"] <= r["max_repeats"] for x in mine) and len({x["doc_id"] for x in mine}) == len(mine)
    assert rep[("q", "a")]["actual_tokens"] == rep[("q", "a")]["available_tokens"] and rep[("q", "fehlt")]["actual_tokens"] == 0
    assert rep[("z", "a")]["actual_tokens"] == 0 and rep[("n", "a")]["actual_tokens"] == 0
    assert rep[("p", "b")]["most_copies"] == 3
    # What b lacks goes to its sibling: the plan is met to within one document per leaf.
    total = sum(r["n_tokens"] for r in mixing.token_sizes(docs).collect())
    got = rep[("p", "a")]["actual_tokens"] + rep[("p", "b")]["actual_tokens"]
    assert abs(got - total * 0.9) <= 2 * 40
    assert sorted(map(tuple, mixing.mixture(docs.repartition(7), targets, domains={}).collect())) == sorted(map(tuple, rows))


def test_siblings_come_before_ancestors():
    t = [{"plan_name": "p", "source": s, "target_weight": w, "max_repeats": 1, "size_ratio": 0.5} for s, w in (("a", 1.0), ("b", 1.0), ("c", 2.0))]
    out = mixing.budgets(t, {("a", "de"): 10, ("b", "de"): 1000, ("c", "de"): 1000}, 800, {"a": "x", "b": "x", "c": "y"})
    got = {r[1]: r[4] for r in out}
    assert got == {"a": 10, "b": 190, "c": 200}
    short = mixing.budgets(t, {("a", "de"): 10, ("b", "de"): 20, ("c", "de"): 1000}, 800, {"a": "x", "b": "x", "c": "y"})
    assert {r[1]: r[4] for r in short} == {"a": 10, "b": 20, "c": 370}


def test_open_tokens_of_leaves_are_passed_on():
    rows = [("p", "s", "de", 1, 10, 9), ("p", "s", "fr", 2, 30, 14), ("p", "s", "it", 3, 50, 14), ("p", "t", "de", 4, 9, 4)]
    assert mixing.crossing(rows) == [("p", "s", "de", 1), ("p", "s", "fr", 2)]


def test_languages_may_come_from_the_texts(spark):
    docs, targets = setup(spark)
    langs = spark.createDataFrame([(i, "it") for i in range(400)], "doc_id bigint, lang string")
    assert {r["language"] for r in mixing.mixture(docs, targets, languages=langs).select("language").distinct().collect()} == {"it"}


def test_empty(spark):
    docs, targets = setup(spark)
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.mixture_report(docs.limit(0), targets).count() == 6
    assert mixing.mixture_report(docs, targets.limit(0)).count() == 0
