"""Problem 8: mix sources to target weights, sizes in tokens.

Weights go down a tree of domains, languages and sources. A leaf (source in one language) can give
at most ``max_repeats`` times its tokens; what it lacks goes to its siblings first, then to the
siblings of its ancestors. Each leaf then gives whole epochs of its documents and the token-prefix
of one more, in the seeded order of that epoch. What the prefixes of a source's leaves leave open,
less than a document each, is passed on between them: leaves take the document that their prefix
ends in as long as that brings the source nearer to its budget.

Defined results: documents without tokens are never taken; a source without documents gives a row
of zeros; weights are normalised per plan, weights of zero or null get nothing; a plan beyond what
all its leaves can give comes out as large as they allow; a plan without positive weights is empty.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prufspark.llm.langid import canonical
from prufspark.llm.tokens import count_tokens
from prufspark.plans.lineage import cut

BUCKETS = 4096
SEED = 17

def token_sizes(docs: DataFrame, vocabulary: str | None = None, languages: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, language, n_tokens)``; the language is that of ``languages(doc_id, lang)`` where given (such as
    the stretches of problem 9, the first of each document), else the declared one in ISO 639-1; ``und`` where unknown."""

    @F.pandas_udf("string")
    def language(s: pd.Series) -> pd.Series:
        return s.map(lambda x: canonical(x) or "und")

    if languages is not None:
        one = languages.groupBy("doc_id").agg(F.min("lang").alias("lang"))
        docs = docs.drop("lang").join(one, "doc_id", "left")
    return count_tokens(docs.select("doc_id", "source", language("lang").alias("language"), "text"), ["doc_id", "source", "language"], vocabulary)


class Node:
    """A tree node with its wanted tokens and what its leaves can still take."""

    def __init__(self, name: str, want: float = 0.0, room: float = 0.0) -> None:
        self.name, self.want, self.room, self.kids = name, want, room, []
        self.given = 0.0

    def capacity(self) -> float:
        return sum(k.capacity() for k in self.kids) if self.kids else self.room

    def weight(self) -> float:
        return sum(k.weight() for k in self.kids) if self.kids else self.want

    def give(self, tokens: float) -> float:
        """Spread tokens over the children in proportion to their weights, a full child's share over its
        siblings; returns what fits nowhere below."""
        if not self.kids:
            taken = min(tokens, self.room - self.given)
            self.given += taken
            return tokens - taken
        left = tokens
        open_ = [k for k in self.kids if k.weight() > 0]
        while left > 1e-6 and open_:
            total = sum(k.weight() for k in open_)
            rest = sum(k.give(left * k.weight() / total) for k in open_)
            if rest >= left - 1e-9:
                return rest
            left, open_ = rest, [k for k in open_ if k.capacity() - k.taken() > 1e-6]
        return left

    def taken(self) -> float:
        return sum(k.taken() for k in self.kids) if self.kids else self.given


def budgets(targets: list[dict], available: dict[tuple[str, str], int], total: int, domains: dict[str, str]) -> list[tuple]:
    """``(plan, source, language, wanted, budget, available, max_repeats)`` per leaf; a source without documents has one leaf ``und``."""
    plans: dict[str, list[dict]] = defaultdict(list)
    for t in targets:
        plans[t["plan_name"]].append(t)
    by_source: dict[str, dict[str, int]] = defaultdict(dict)
    for (s, lang), n in available.items():
        by_source[s][lang] = n
    out = []
    for plan, rows in sorted(plans.items()):
        weights = {r["source"]: max(0.0, r["target_weight"] or 0.0) for r in rows}
        norm = sum(weights.values())
        size = total * max((r["size_ratio"] or 0.0) for r in rows)
        root, at = Node(plan), {}
        leaves = []
        for r in sorted(rows, key=lambda r: r["source"]):
            s = r["source"]
            langs = {k: v for k, v in by_source.get(s, {}).items() if v > 0} or {"und": 0}
            have = sum(langs.values())
            repeats = max(0, r["max_repeats"] or 0)
            for lang, n in sorted(langs.items()):
                want = size * weights[s] / norm * (n / have if have else 1.0) if norm else 0.0
                leaf = Node(s, want, float(n * repeats))
                parent = root
                for step in (("d", domains.get(s, s)), ("l", lang)):
                    path = (parent.name, *step)
                    if path not in at:
                        at[path] = Node("/".join(map(str, path)))
                        parent.kids.append(at[path])
                    parent = at[path]
                parent.kids.append(leaf)
                leaves.append((s, lang, leaf, n, repeats))
        root.give(size if norm else 0.0)
        out += [(plan, s, lang, float(leaf.want), int(math.floor(leaf.given + 1e-6)), int(n), int(m)) for s, lang, leaf, n, m in leaves]
    return out


def _parts(docs: DataFrame, targets: DataFrame, vocabulary: str | None, domains: dict[str, str], languages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents (cut) and the leaves of all plans. The leaves number at most the rows of ``targets`` times the languages."""
    spark = docs.sparkSession
    sizes = cut(token_sizes(docs, vocabulary, languages))
    plan_rows = [r.asDict() for r in targets.where("plan_name is not null and source is not null").groupBy("plan_name", "source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio")).collect()]
    named = sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source", "language").agg(F.sum("n_tokens").alias("n")).collect()
    total = sizes.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    rows = budgets(plan_rows, {(r["source"], r["language"]): r["n"] for r in named}, total, domains)
    leaves = spark.createDataFrame(rows, "plan_name string, source string, language string, wanted double, budget bigint, available bigint, max_repeats int")
    return sizes, leaves


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, domains: dict[str, str] | None = None, seed: int = SEED, languages: DataFrame | None = None) -> DataFrame:
    """``(plan_name, source, language, doc_id, n_tokens, copies)``: the documents of each plan and how often each is taken.

    ``domains`` names the domain of sources; others are domains of their own."""
    return _select(*_parts(docs, targets, vocabulary, domains or {}, languages), seed)


def crossing(rows: list[tuple]) -> list[tuple]:
    """Of ``(plan, source, language, doc_id, tokens, open)``, one row per leaf whose prefix ends inside a document, those
    whose document is taken: smallest first, while that brings the source's open tokens nearer to none."""
    by_source: dict[tuple, list[tuple]] = defaultdict(list)
    for r in rows:
        by_source[r[:2]].append(r)
    out = []
    for rs in by_source.values():
        left = sum(r[5] for r in rs)
        for r in sorted(rs, key=lambda r: (r[4], r[2])):
            if 2 * left >= r[4] > 0:
                out.append(r[:4])
                left -= r[4]
    return out


def _select(sizes: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    key = ["plan_name", "source", "language"]
    leaf = leaves.where("budget > 0 and available > 0").select(
        *key, F.least(F.expr("budget div available"), F.col("max_repeats").cast("bigint")).alias("epochs"), "budget", "available", "max_repeats"
    )
    leaf = leaf.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0))
    rows = sizes.where("n_tokens > 0").join(F.broadcast(leaf), ["source", "language"])
    # The order of the open epoch is a hash; only the one bucket that the prefix ends in is sorted.
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "plan_name", "epochs", "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    ahead = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    rows = rows.join(sums, [*key, "bucket"])
    whole = rows.where("before + s <= rest or before >= rest").withColumn("extra", (F.col("before") + F.col("s") <= F.col("rest")).cast("int"))
    inside = Window.partitionBy(*key, "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("not (before + s <= rest or before >= rest)").withColumn("ends", F.col("before") + F.sum("n_tokens").over(inside))
    # One document per leaf at most: as many rows as there are leaves.
    over = edge.where((F.col("ends") > F.col("rest")) & (F.col("ends") - F.col("n_tokens") <= F.col("rest")))
    over = [tuple(r) for r in over.select(*key, "doc_id", "n_tokens", (F.col("rest") - F.col("ends") + F.col("n_tokens")).alias("open")).collect()]
    doc_type = sizes.schema["doc_id"].dataType.simpleString()
    taken = F.broadcast(sizes.sparkSession.createDataFrame(crossing(over), f"plan_name string, source string, language string, doc_id {doc_type}").withColumn("more", F.lit(1)))
    edge = edge.join(taken, [*key, "doc_id"], "left").withColumn("extra", F.coalesce("more", (F.col("ends") <= F.col("rest")).cast("int"))).drop("more", "ends")
    return whole.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int")).where("copies > 0").select(*key, "doc_id", "n_tokens", "copies")


def mixture_report(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, domains: dict[str, str] | None = None, seed: int = SEED, languages: DataFrame | None = None) -> DataFrame:
    """Per plan and source: target and actual tokens and shares, documents taken and the most often any was taken."""
    sizes, leaves = _parts(docs, targets, vocabulary, domains or {}, languages)
    chosen = _select(sizes, leaves, seed).groupBy("plan_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies")
    )
    wanted = leaves.groupBy("plan_name", "source").agg(F.sum("wanted").alias("w"), F.sum("available").alias("available_tokens"), F.max("max_repeats").alias("max_repeats"))
    plan = Window.partitionBy("plan_name")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = wanted.join(chosen, ["plan_name", "source"], "left").select("plan_name", "source", "w", "available_tokens", "max_repeats", zero("actual_tokens"), zero("n_docs"), zero("most_copies"))
    return out.select(
        "plan_name",
        "source",
        F.round(F.coalesce(F.try_divide("w", F.sum("w").over(plan)), F.lit(0.0)), 6).alias("target_share"),
        F.round(F.coalesce(F.try_divide("actual_tokens", F.sum("actual_tokens").over(plan)), F.lit(0.0)), 6).alias("actual_share"),
        F.round("w").cast("bigint").alias("target_tokens"),
        "actual_tokens",
        "available_tokens",
        "n_docs",
        "max_repeats",
        "most_copies",
    )
