"""Findings of segments: flattening, taxonomy, consolidation.

A repeated segment row counts once. Labels and ids in any case resolve to the taxonomy's ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from prufspark.functions.similarity import jaccard
from prufspark.functions.text import bind, fold_case, simplify, squeeze
from prufspark.plans.lineage import cut


# Findings are consolidated within one document (a case), in the order in which they stand in it.
DOCUMENT = ("case_id",)
ORDER = ("segment_id", "pos", "finding_id")


def first_nonblank(*cols: Column) -> Column:
    """The first value that is neither null nor blank, trimmed: aliases of one field."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def label_key(c: Column) -> Column:
    return simplify(c)


def subclasses(taxonomy: DataFrame) -> DataFrame:
    """``(main_id, main_label, subclass_id, subclass_label)``."""
    m = taxonomy.select(F.explode("main_classes").alias("m")).select("m.id", "m.label", F.explode("m.subclasses").alias("s"))
    return m.select(F.col("id").alias("main_id"), F.col("label").alias("main_label"), F.col("s.id").alias("subclass_id"), F.col("s.label").alias("subclass_label"))


def lookup(taxonomy: DataFrame, kind: str) -> DataFrame:
    """``(key, id)`` for kind ``subclass``, ``change`` or ``severity``: every id and label in its comparing form.

    A key given twice keeps the id that comes first; ids go before labels."""
    if kind == "subclass":
        rows = subclasses(taxonomy).select(F.col("subclass_id").alias("id"), F.col("subclass_label").alias("label"))
    else:
        field = {"change": "change_types", "severity": "severity_levels"}[kind]
        rows = taxonomy.select(F.explode(field).alias("x")).select("x.id", "x.label")
    both = rows.select(label_key(F.col("id")).alias("key"), "id", F.lit(0).alias("rank")).unionByName(rows.select(label_key(F.col("label")).alias("key"), "id", F.lit(1).alias("rank")))
    return both.groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def flatten(segments: DataFrame, findings: str) -> DataFrame:
    """One row per finding of each segment, in order ``pos``; segments repeated in full or in part count once.

    A finding is known by its id, without one by its place; the first row of each is kept by a grouped minimum."""
    rows = segments.select("case_id", "segment_id", F.posexplode(findings).alias("pos", "f")).select("case_id", "segment_id", "pos", "f.*")
    known = F.coalesce(F.concat(F.lit("i"), F.col("finding_id")), F.concat_ws("|", F.lit("p"), "case_id", "segment_id", F.col("pos").cast("string")))
    first = F.min_by(F.struct(*rows.columns), F.struct("case_id", "segment_id", "pos"))
    return rows.groupBy(known.alias("_known")).agg(first.alias("r")).select("r.*")


def resolve(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Adds ``subclass``, ``change_type``, ``severity`` (taxonomy ids, null where unknown) and ``main_class``."""
    out = findings
    for col, kind, new in (("subclass_id", "subclass", "subclass"), ("change_type_id", "change", "change_type"), ("severity_id", "severity", "severity")):
        keys = F.broadcast(lookup(taxonomy, kind).select(F.col("key").alias("_key"), F.col("id").alias(new)))
        out = out.join(keys, label_key(F.col(col)) == F.col("_key"), "left").drop("_key")
    mains = F.broadcast(subclasses(taxonomy).select(F.col("subclass_id").alias("_sub"), F.col("main_id").alias("main_class")))
    return out.join(mains, F.col("subclass") == F.col("_sub"), "left").drop("_sub")


def agent_scope(main_class: Column) -> Column:
    """The reviewer that a main class belongs to."""
    return (
        F.when(main_class.startswith("HYPOTHESE"), "document_hypothesis")
        .when(main_class.startswith("RECHEN") | main_class.startswith("ZAHL"), "segment_calculation")
        .when(main_class.startswith("FORMALES") | main_class.startswith("SPRACHE"), "segment_language")
        .otherwise("segment_or_document_factual")
    )


def first_per_key(findings: DataFrame, *keys: Column, scope: Sequence[str] = DOCUMENT, order: Sequence[str] = ORDER) -> DataFrame:
    """The first finding per key within its document. A grouped minimum combines on the map side, so a hot key (such as
    an empty one) moves one row per task, and only places come back."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    least = findings.select(*scope, F.struct(*order).alias("_at"), *named).groupBy(*scope, *[f"_k{i}" for i in range(len(keys))]).agg(F.min("_at").alias("_first"))
    least = least.select(*[F.col(c).alias(f"_s_{c}") for c in scope], *[F.col(f"_first.{c}").alias(f"_o_{c}") for c in order])
    same = F.lit(True)
    for kind, cols in (("s", scope), ("o", order)):
        for c in cols:
            same &= F.col(c).eqNullSafe(F.col(f"_{kind}_{c}"))
    return findings.join(least, same, "left_semi")


def dedup_two_stage(findings: DataFrame, scope: Sequence[str] = DOCUMENT, order: Sequence[str] = ORDER) -> DataFrame:
    """First per (sorted references, start of the rationale), then per start of the comparing span; empty spans stay."""
    refs = F.array_join(F.array_sort(F.coalesce("source_refs", F.array().cast("array<string>"))), "|")
    one = first_per_key(findings, refs, F.substring(F.coalesce("rationale", F.lit("")), 1, 80), scope=scope, order=order)
    span = F.substring(F.lower(squeeze(F.coalesce("span_text", F.lit("")))), 1, 120)
    return first_per_key(one, span, *[F.when(span == "", F.col(c)) for c in order], scope=scope, order=order)


def dedup_by_key(findings: DataFrame, *keys: Column, scope: Sequence[str] = DOCUMENT, order: Sequence[str] = ORDER) -> DataFrame:
    """The first finding per key within its document."""
    return first_per_key(findings, *keys, scope=scope, order=order)


def dedup_calculations(findings: DataFrame, right: Column, scope: Sequence[str] = DOCUMENT, order: Sequence[str] = ORDER) -> DataFrame:
    """The first finding per segment, comparing span, subclass and right value."""
    span = F.lower(squeeze(F.coalesce("span_text", F.lit(""))))
    return first_per_key(findings, F.col("segment_id"), span, F.coalesce("subclass_id", F.lit("")), F.coalesce(right, F.lit("")), scope=scope, order=order)


def union_findings(*lists: DataFrame) -> DataFrame:
    """Lists of findings with different columns as one; what a list lacks is null."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def similar_token_pairs(rows: DataFrame, key: str, block: str, threshold: float) -> DataFrame:
    """``(block, a, b)`` of ``rows(key, block, toks)``, a before b, whose token sets reach the threshold.

    Prefix filter on tokens from rare to frequent inside each block: no pair is lost, and none is built
    that shares only frequent tokens."""
    sized = rows.where(F.size("toks") > 0).withColumn("n", F.size("toks"))
    exploded = sized.select(key, block, "n", F.explode("toks").alias("tok"))
    freq = exploded.groupBy(block, "tok").agg(F.count("*").alias("df"))
    ranked = exploded.join(freq, [block, "tok"]).where("df > 1")
    order = Window.partitionBy(block, key).orderBy("df", "tok")
    # Tokens of one row only were dropped: they still take the first places of the prefix.
    kept = ranked.withColumn("place", F.row_number().over(order) + F.col("n") - F.count("*").over(Window.partitionBy(block, key)))
    prefix = kept.where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select(key, block, "n", "tok")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.tok") == F.col("b.tok")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9))
    pairs = met.select(F.col(f"a.{block}").alias(block), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).distinct()
    one, two = (rows.select(block, F.col(key).alias(x), F.col("toks").alias(f"t{x}")) for x in "ab")
    both = pairs.join(one, [block, "a"]).join(two, [block, "b"])
    return both.where(jaccard(F.col("ta"), F.col("tb")) >= threshold - 1e-12).select(block, "a", "b")


def dedup_leaders(findings: DataFrame, threshold: float = 0.85, scope: Sequence[str] = DOCUMENT, order: Sequence[str] = ORDER) -> DataFrame:
    """Ordered fuzzy dedup per document and subclass: a finding goes when an earlier kept one is similar enough.

    Exactly the one-by-one rule, decided in rounds over the graph of similar pairs: a finding is kept once
    all its earlier neighbours are dropped, and dropped once one of them is kept. Equal spans stand for
    their first finding, so copies build no pairs. Findings without span or subclass are kept."""
    span = F.substring(F.lower(squeeze(F.coalesce("span_text", F.lit("")))), 1, 120)
    bare = (F.col("_span") == "") | F.col("subclass_id").isNull() | (F.trim("subclass_id") == "")
    rows = findings.withColumn("_span", span).withColumn("_at", F.struct(*[F.coalesce(F.col(c), F.lit(0 if c == "pos" else "")).alias(c) for c in order]))
    block = F.concat_ws("\x01", *scope, "subclass_id").alias("block")
    held = rows.where(~bare).select("_at", block, F.array_sort(F.array_distinct(F.split("_span", " "))).alias("toks"))
    firsts = cut(held.groupBy("block", "toks").agg(F.min("_at").alias("at")))
    edges = cut(similar_token_pairs(firsts, "at", "block", threshold))
    state = firsts.select("block", "at", F.lit(None).cast("boolean").alias("kept"))
    while True:
        before = edges.join(state.select("block", F.col("at").alias("a"), F.col("kept").alias("ka")), ["block", "a"]).groupBy("block", "b").agg(
            F.bool_or(F.coalesce("ka", F.lit(False))).alias("any_kept"), F.bool_and(F.coalesce(~F.col("ka"), F.lit(False))).alias("all_gone")
        )
        new = state.join(before.withColumnRenamed("b", "at"), ["block", "at"], "left")
        state = cut(new.select("block", "at", F.coalesce("kept", F.when(F.col("all_gone").isNull() | F.col("all_gone"), True).when(F.col("any_kept"), False)).alias("kept")))
        if not state.where("kept is null").limit(1).count():
            break
    keep = state.where("kept").select(F.col("block").alias("_b"), F.col("at").alias("_a"))
    kept = rows.where(~bare).join(keep, (block == F.col("_b")) & (F.col("_at") == F.col("_a")), "left_semi")
    return rows.where(bare).unionByName(kept).drop("_span", "_at")


def protected_spans(facts: DataFrame) -> DataFrame:
    """``(case_id, source_span)``: spans of more than one token with high or medium confidence, of every fact of
    ``facts(case_id, facts)``, those in lists too."""
    entry = lambda f: F.struct(f["source_span"].alias("source_span"), f["confidence"].alias("confidence"))
    lists = [F.transform(F.col(f"facts.{f.name}"), entry) if isinstance(f.dataType, ArrayType) else F.array(entry(F.col(f"facts.{f.name}"))) for f in facts.schema["facts"].dataType]
    rows = facts.select("case_id", F.inline(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))))
    rows = rows.where("lower(trim(confidence)) in ('high', 'medium') and trim(source_span) <> ''").select("case_id", "source_span").distinct()
    return rows.where(F.contains(simplify(F.col("source_span")), F.lit(" ")))


def on_protected_span(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether simplified span ``a`` lies on the protected one: equal, one in the other, or at least that share of the
    span's tokens, repeated ones counted each time; spans of one token never. Both are structs of simplified text ``s``
    and tokens ``t``."""
    share = F.size(F.filter(a["t"], lambda x: F.array_contains(b["t"], x))) / F.size(a["t"])
    return (F.size(a["t"]) >= 2) & (F.contains(a["s"], b["s"]) | F.contains(b["s"], a["s"]) | (share >= least))


def simple_span(span: Column) -> Column:
    """Simplified text and its tokens in order."""
    return bind(simplify(span), lambda s: F.struct(s.alias("s"), F.split(s, " ").alias("t")))


def save_numbered(findings: DataFrame, prefix: str) -> DataFrame:
    """Ids ``PREFIX-case-0001`` in order within each case.

    Rows are numbered inside their segment; only one row per segment is summed up along its case."""
    inside = Window.partitionBy("case_id", "segment_id").orderBy("pos", "finding_id")
    ahead = Window.partitionBy("case_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = findings.groupBy("case_id", "segment_id").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col("case_id").alias("_c"), F.col("segment_id").alias("_s"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    same = F.col("case_id").eqNullSafe(F.col("_c")) & F.col("segment_id").eqNullSafe(F.col("_s"))
    rows = findings.withColumn("_place", F.row_number().over(inside)).join(sizes, same).drop("_c", "_s")
    return rows.withColumn("new_id", F.format_string(prefix + "-%s-%04d", F.col("case_id"), F.col("_before") + F.col("_place"))).drop("_before", "_place")
