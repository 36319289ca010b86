"""One-to-one matching of predicted with gold findings, and the metrics on top.

Pairs are built inside a scope (``CASE`` in the catalogue; the segment by default), scored,
and taken greedily from the best. Ties go by order of ids, so results are deterministic.
Two rules are there: by spans alone, and strict within one subclass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prufspark.functions.text import simplify
from prufspark.plans.lineage import cut

SCOPE = ("case_id", "segment_id")
CASE = ("case_id",)
BLOCK = 256  # Findings of one side that are scored together; a scope of more is split, so that no task holds all its pairs.
FIELDS = ["finding_id", "subclass", "change_type", "severity", "main_class", "correction", "span"]


def _blocks(df: DataFrame, name: str, scope: Sequence[str]) -> DataFrame:
    """One row per scope and block of about ``BLOCK`` findings, as an array of structs ``name``."""
    texts = {"correction": "correction", "span": "span_text"}
    rows = df.select(*scope, F.struct(*[simplify(F.coalesce(texts[c], F.lit(""))).alias(c) if c in texts else F.col(c) for c in FIELDS]).alias("f"))
    sizes = rows.groupBy(*scope).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    block = F.pmod(F.xxhash64("f.finding_id"), F.col("_blocks")).alias("_block")
    return rows.join(sizes, list(scope)).select(*scope, block, "f").groupBy(*scope, "_block").agg(F.collect_list("f").alias(name)).withColumnRenamed("_block", f"_{name}_block")


def _bigrams(s: str) -> set[str]:
    s = s.replace(" ", "")
    return {s[i : i + 2] for i in range(len(s) - 1)} if len(s) != 1 else {s}


def shared_counts(g: list[set[str]], p: list[set[str]]) -> np.ndarray:
    """Sizes of all intersections: a product of incidence matrices over the elements that both sides have."""
    both = set().union(*g) & set().union(*p)
    place = {x: i for i, x in enumerate(both)}

    def matrix(sets: list[set[str]]) -> np.ndarray:
        at = [(i, place[x]) for i, xs in enumerate(sets) for x in xs if x in place]
        m = np.zeros((len(sets), len(place)), np.float32)
        if at:
            m[tuple(np.array(at).T)] = 1
        return m

    return (matrix(g) @ matrix(p).T).astype(np.float64)


def block_scores(gold: list[str], pred: list[str]) -> np.ndarray:
    """``similarity.span_score`` of every pair of simplified spans.

    Shared tokens and pairs of characters are counted for all pairs at once; of two spans one can hold the other only
    if it has all its pairs (or is too short to have any)."""
    t, b = [[set(filter(None, s.split(" "))) for s in x] for x in (gold, pred)], [[_bigrams(s) for s in x] for x in (gold, pred)]
    size = lambda sets: np.array([len(x) for x in sets], np.float64)
    (gt, pt), (gb, pb) = map(size, t), map(size, b)
    nt, nb = shared_counts(*t), shared_counts(*b)
    any_, total = gt[:, None] + pt - nt, gb[:, None] + pb
    j = np.where(any_ == 0, 1.0, nt / np.maximum(any_, 1))
    d = np.where(total == 0, 1.0, 2.0 * nb / np.maximum(total, 1))
    brief = lambda x: np.array([len(s) < 12 for s in x])
    short = brief(gold)[:, None] | brief(pred) | ((gt <= 2)[:, None] & (pt <= 2))
    out = np.maximum(np.where(short, 0.5 * j, j), d)
    tiny = lambda x: np.array([len(s.replace(" ", "")) < 2 for s in x])
    held = (nb >= np.minimum(gb[:, None], pb)) | tiny(gold)[:, None] | tiny(pred)
    for i, k in zip(*np.nonzero(held)):
        g, p = gold[i], pred[k]
        out[i, k] = 1.0 if g == p else 0.0 if not g or not p else 0.95 if g in p or p in g else out[i, k]
    return out


def candidates(gold: DataFrame, pred: DataFrame, least: float = 0.2, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Pairs in one scope whose span score is at least ``least``, with what agrees. Blocks of a scope meet each other and
    are spread over all tasks, so a hot scope is no single task."""
    met = _blocks(gold, "gold", scope).join(_blocks(pred, "pred", scope), list(scope)).repartition(*scope, "_gold_block", "_pred_block")
    sides = [StructField(f"{n}_{f.name}", f.dataType) for n in ("gold", "pred") for f in met.schema[n].dataType.elementType if f.name != "span"]
    schema = StructType([*[met.schema[c] for c in scope], *sides, StructField("raw", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                sides = {n: b.column(n)[r].values for n in ("gold", "pred")}
                raw = block_scores(*(x.field("span").to_pylist() for x in sides.values()))
                at = dict(zip(sides, np.nonzero(raw >= least - 1e-6)))
                n = len(at["gold"])
                cols = [pa.repeat(b.column(c)[r], n) for c in scope] + [sides[x].field(c).take(pa.array(at[x])) for x in sides for c in FIELDS if c != "span"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(raw[at["gold"], at["pred"]])], schema.names)

    scored = met.select(*scope, "gold", "pred").mapInArrow(score, schema).withColumn("span_score", F.round("raw", 6)).where(F.col("span_score") >= least)
    same = lambda c: F.coalesce(F.col(f"gold_{c}") == F.col(f"pred_{c}"), F.lit(False)).alias(f"{c}_match")
    correction = F.when((F.col("gold_correction") == "") & (F.col("pred_correction") == ""), F.lit(None)).otherwise(F.col("gold_correction") == F.col("pred_correction"))
    out = scored.select(
        *scope, "gold_finding_id", "pred_finding_id", "span_score", same("subclass"), same("change_type"), same("severity"), correction.alias("correction_match"),
        "gold_subclass", "pred_subclass", "gold_main_class", "pred_main_class",
    )
    bonus = 0.5 * F.col("subclass_match").cast("int") + 0.2 * F.col("change_type_match").cast("int") + 0.1 * F.col("severity_match").cast("int")
    return out.withColumn("score", F.round(100 + 100 * F.col("span_score") + bonus, 6))


def strict_candidates(cands: DataFrame) -> DataFrame:
    """Pairs of one subclass, scored by span, change type, severity and correction."""
    agree = lambda c, w: F.coalesce(F.col(f"{c}_match"), F.lit(False)).cast("int") * w
    score = 100 + 20 * F.col("span_score") + agree("change_type", 5.0) + agree("severity", 2.0) + agree("correction", 1.0)
    return cands.where("subclass_match").withColumn("score", F.round(score, 6))


STREAM = 1_000_000
SPAN_FIRST = ("span_score", "score")
SCORE_FIRST = ("score", "span_score", "change_type_match", "severity_match")


def greedy_match(cands: DataFrame, scope: Sequence[str] = SCOPE, best: Sequence[str] = SPAN_FIRST) -> DataFrame:
    """Greedy one-to-one assignment per scope, largest values of ``best`` first, then by ids.

    A pair that is the best of both its ends is taken by the greedy rule, whatever else there is. Such pairs are found by
    two grouped minima and leave with all pairs of their ends, round by round, so that no task sees all pairs of a hot
    scope. Once at most ``STREAM`` pairs are left, those of a scope stream through one worker in order, which holds the
    ids taken in that scope. Narrow rows travel cheaper: see ``without_classes`` and ``with_classes``."""
    names = cands.columns
    order = [(-F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(best)]
    ends = ["gold_finding_id", "pred_finding_id"]
    row = F.struct(*order, *ends, *[c for c in names if c not in ends])
    left, done = cut(cands), []
    while left.limit(STREAM + 1).count() > STREAM:
        of_gold, of_pred = (left.groupBy(*scope, end).agg(F.min(row).alias("r")).select("r.*") for end in ends)
        both = of_pred.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate((*scope, *ends))])
        same = F.lit(True)
        for i, c in enumerate((*scope, *ends)):
            same &= F.col(c).eqNullSafe(F.col(f"_p{i}"))
        taken = cut(of_gold.join(both, same, "left_semi").select(*names))
        done.append(taken)
        for end in ends:
            gone = taken.select(*[F.col(c).alias(f"_t_{c}") for c in (*scope, end)]).distinct()
            free = F.lit(True)
            for c in (*scope, end):
                free &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
            left = left.join(gone, free, "left_anti")
        left = cut(left)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gold, pred = None, set(), set()
        for b in batches:
            keep = []
            for *at, g, p in zip(*(b.column(c).to_pylist() for c in (*scope, *ends))):
                if at != now:
                    now, gold, pred = at, set(), set()
                ok = g not in gold and p not in pred
                keep.append(ok)
                if ok:
                    gold.add(g)
                    pred.add(p)
            yield b.filter(pa.array(keep, pa.bool_()))

    inside = [*[F.col(c).desc() for c in best], *ends]
    out = left.repartition(*scope).sortWithinPartitions(*scope, *inside).mapInArrow(pick, cands.schema)
    for d in done:
        out = out.unionByName(d)
    return out


def without_classes(cands: DataFrame) -> DataFrame:
    return cands.drop("gold_subclass", "pred_subclass", "gold_main_class", "pred_main_class")


def with_classes(matches: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Adds the classes of both findings to matches ``without_classes``."""
    for name, side in (("gold", gold), ("pred", pred)):
        matches = matches.join(side.select(*[F.col(c).alias(f"{name}_{c}") for c in ("finding_id", "subclass", "main_class")]), f"{name}_finding_id")
    return matches


def unmatched(side: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """False positives (``pred``) or negatives (``gold``)."""
    return side.join(matches.select(F.col(f"{name}_finding_id").alias("finding_id")), "finding_id", "left_anti")


def best_counterparts(side: DataFrame, other: DataFrame, top: int = 3, scope: Sequence[str] = CASE) -> DataFrame:
    """``(finding_id, rank, other_finding_id, span_score, same_subclass, same_main_class, same_change_type, same_severity)``:
    of each finding of ``side`` the ``top`` best of ``other`` in its scope, however low their score; ties by id.

    Blocks meet as in ``candidates``; of each pair of blocks only the best ``top`` go on."""
    met = _blocks(side, "side", scope).join(_blocks(other, "other", scope), list(scope)).repartition(*scope, "_side_block", "_other_block")
    same = ("subclass", "main_class", "change_type", "severity")
    schema = "finding_id string, other_finding_id string, raw double, " + ", ".join(f"same_{c} boolean" for c in same)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one, two = b.column("side")[r].values, b.column("other")[r].values
                ids, others = (np.array(x.field("finding_id").to_pylist(), dtype=object) for x in (one, two))
                raw = block_scores(one.field("span").to_pylist(), two.field("span").to_pylist())
                order = np.argsort(others, kind="stable")
                pick = order[np.argsort(-np.round(raw[:, order], 6), axis=1, kind="stable")[:, :top]]
                i, j = np.repeat(np.arange(len(ids)), pick.shape[1]), pick.ravel()
                cols = [pa.array(ids[i], pa.string()), pa.array(others[j], pa.string()), pa.array(raw[i, j])]
                for c in same:
                    x, y = (np.array(z.field(c).to_pylist(), dtype=object) for z in (one, two))
                    cols.append(pa.array(x[i] == y[j], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=["finding_id", "other_finding_id", "raw", *[f"same_{c}" for c in same]])

    found = met.select("side", "other").mapInArrow(score, schema).withColumn("span_score", F.round("raw", 6)).drop("raw")
    w = Window.partitionBy("finding_id").orderBy(F.col("span_score").desc(), "other_finding_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 (0 where undefined), to six decimals."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def class_metrics(gold: DataFrame, pred: DataFrame, matches: DataFrame, level: str = "subclass") -> DataFrame:
    """Counts and rates per class. A match is true for its gold class when both classes agree; otherwise it
    is a false negative of the one and a false positive of the other."""
    cls = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN"))
    g = gold.select(cls(level).alias("class"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("tp"))
    p = pred.select(cls(level).alias("class"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp"))
    t = matches.where(cls(f"gold_{level}") == cls(f"pred_{level}")).select(cls(f"gold_{level}").alias("class"), F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("tp"))
    counts = g.unionAll(p).unionAll(t).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("g", "p", "tp")])
    return rates(counts.select("class", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn")))


def summary(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: span-level counts and rates, and the share of matches that agree on each field."""
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6)
    m = matches.agg(F.count("*").alias("tp"), *[share(f"{c}_match").alias(f"{c}_accuracy") for c in ("subclass", "change_type", "severity", "correction")])
    n = gold.agg(F.count("*").alias("g")).crossJoin(pred.agg(F.count("*").alias("p"))).crossJoin(m)
    out = rates(n.withColumn("fp", F.col("p") - F.col("tp")).withColumn("fn", F.col("g") - F.col("tp")))
    return out.select("tp", "fp", "fn", "precision", "recall", "f1", *[f"{c}_accuracy" for c in ("subclass", "change_type", "severity", "correction")])


def confusion(matches: DataFrame, gold: DataFrame, pred: DataFrame, best: DataFrame) -> DataFrame:
    """``(kind, gold_class, pred_class, n)``: how often a gold class met each predicted class, in pairs that were matched
    and (``unmatched``) with the best counterpart, ``best(finding_id, other_finding_id)``, of findings left over."""
    cls = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN"))
    pairs = matches.select(F.lit("matched").alias("kind"), cls("gold_subclass").alias("gold_class"), cls("pred_subclass").alias("pred_class"))
    g = gold.select("finding_id", cls("subclass").alias("gold_class"))
    p = pred.select(F.col("finding_id").alias("other_finding_id"), cls("subclass").alias("pred_class"))
    left = best.join(g, "finding_id").join(p, "other_finding_id").select(F.lit("unmatched").alias("kind"), "gold_class", "pred_class")
    return pairs.unionByName(left).groupBy("kind", "gold_class", "pred_class").agg(F.count("*").alias("n"))


def consensus(spans: DataFrame, models: Sequence[str], threshold: float = 0.5, scope: Sequence[str] = CASE) -> DataFrame:
    """``(finding_id, models_agreed)``: findings of the first model to which each other model has one in the same scope
    whose token sets are similar enough. ``spans(model, finding_id, span_text)`` and the scope; partners may be used again,
    empty spans agree with none.

    Candidates share one of the tokens, from rare to frequent, that any partner must share; nothing pairs all."""
    from prufspark.functions.similarity import jaccard
    from prufspark.functions.text import simple_tokens

    base, *others = models
    rows = spans.select(*scope, "model", "finding_id", simple_tokens(simplify(F.coalesce("span_text", F.lit("")))).alias("toks")).where(F.size("toks") > 0)
    n = F.size("toks")
    exploded = rows.select(*scope, "model", "finding_id", "toks", F.explode("toks").alias("tok"))
    rare = exploded.groupBy(*scope, "tok").agg(F.count("*").alias("df"))
    w = Window.partitionBy(*scope, "model", "finding_id").orderBy("df", "tok")
    prefix = exploded.join(rare, [*scope, "tok"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n - F.ceil(threshold * n - 1e-9) + 1)
    one = prefix.where(F.col("model") == base).select(*scope, "tok", "finding_id", F.col("toks").alias("a"))
    two = prefix.where(F.col("model").isin(others)).select(*scope, "tok", "model", F.col("toks").alias("b"))
    agreed = one.join(two, [*scope, "tok"]).where(jaccard(F.col("a"), F.col("b")) >= threshold - 1e-12).select("finding_id", "model").distinct()
    full = agreed.groupBy("finding_id").agg(F.count("*").alias("n")).where(F.col("n") == len(others))
    return full.select("finding_id", F.lit(" | ".join(models)).alias("models_agreed"))


def wide_matches(matches: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per matched pair with the fields of both findings and what agrees."""
    fields = ("main_class", "subclass", "change_type", "severity", "span_text")
    kept = matches.select("gold_finding_id", "pred_finding_id", "span_score", "score", *[f"{c}_match" for c in ("subclass", "change_type", "severity", "correction")])
    for name, side in (("gold", gold), ("pred", pred)):
        kept = kept.join(side.select(F.col("finding_id").alias(f"{name}_finding_id"), *[F.col(c).alias(f"{name}_{c}") for c in fields]), f"{name}_finding_id")
    return kept


def count_matrix(rows: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``, zero where there are none, and their ``total``."""
    cells = [F.count_if(F.col(column) == c).alias(c) for c in columns]
    return rows.groupBy(row).agg(*cells, F.count("*").alias("total"))
