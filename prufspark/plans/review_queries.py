"""Queries over the review chain, language filters, lookups and the retrieval chain. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prufspark.functions import text
from prufspark.operators import detectors, findings, language, lookup, models, retrieval, review
from prufspark.plans.lineage import cut
from prufspark.plans.queries import _chunks, _hits, _long, _pred, query, reference_words
from prufspark.plans.samples import LANGUAGE, sample_texts
from prufspark.sources.tables import table

TARGETS = {"AUFBAU": 0.36, "BELEG": 0.29, "AUSSAGE": 0.14, "SPRACHE": 0.14, "ZAHL": 0.07}


def _flat(spark: SparkSession, d: str, side: str = "predictions") -> DataFrame:
    return findings.flatten(table(spark, d, side), "gold_findings" if side == "gold" else "predicted_findings")


@query
def language_filter(spark: SparkSession, d: str) -> DataFrame:
    reason = language.drop_reason(F.col("span_text"), F.col("correction"), F.col("rationale"))
    return _flat(spark, d).select("finding_id", reason.alias("reason")).where("reason is not null")


@query
def language_samples(spark: SparkSession, d: str) -> DataFrame:
    """Each invented finding with why it is dropped; a row per order, so that the plan runs over a table."""
    rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("span", "correction", "rationale"), r)]) for r in LANGUAGE])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(rows, (F.pmod("o_orderkey", F.lit(len(LANGUAGE))) + 1).cast("int")).alias("r"))
    return o.select("id", F.coalesce(language.drop_reason(F.col("r.span"), F.col("r.correction"), F.col("r.rationale")), F.lit("kept")).alias("reason"))


@query
def reference_word_filter(spark: SparkSession, d: str) -> DataFrame:
    return language.without_known_words(_flat(spark, d), reference_words(spark, d)).select("finding_id")


@query
def span_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose span stands in their own rationale."""
    return _flat(spark, d).where(language.in_text(F.col("span_text"), F.coalesce("rationale", F.lit("")))).select("finding_id")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and text is not null and metadata.case_id is not null")
    one = c.groupBy("id").agg(F.min(F.struct("metadata.case_id", "metadata.source_path", "metadata.chunk_index", "text")).alias("c")).select("id", "c.*")
    w = Window.partitionBy("case_id").orderBy("source_path", "chunk_index", "id")
    return one.select("case_id", F.row_number().over(w).alias("segment_index"), "text")


@query
def segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    spans = _flat(spark, d).where("span_text is not null").select("case_id", F.col("span_text").alias("span"))
    return lookup.find_segments(spans, cut(_segments(spark, d)))


@query
def reply_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Replies that list findings in five ways, read again."""
    p = _flat(spark, d).where("finding_id is not null")
    e = F.to_json(F.struct(F.col("subclass_id").alias("subklasse"), F.col("span_text").alias("stelle"), F.col("source_refs").alias("quellen")))
    k = F.pmod("pos", F.lit(5))
    quoted = F.get_json_object(F.to_json(F.struct("span_text")), "$")
    reply = (
        F.when(k == 0, F.concat(F.lit("Gern!\n```json\n{\"errors\": ["), e, F.lit("]}\n```")))
        .when(k == 1, F.concat(F.lit("Hier das Ergebnis: ["), e, F.lit("] Ende.")))
        .when(k == 2, F.concat(F.lit("{\"Fehler\": ["), e, F.lit("]}")))
        .when(k == 3, F.lit("Keine Fehler gefunden."))
        .otherwise(F.regexp_replace(quoted, "\"span_text\"", "\"Fehler_01\""))
    )
    got = review.error_fields(review.parse_replies(p.select(F.col("finding_id").alias("reply_id"), reply.alias("reply"))))
    return _long(got.select("reply_id", "n", "subclass", "span_text", "rationale", F.array_join("source_refs", "|").alias("refs")))


@query
def factual_normalise(spark: SparkSession, d: str) -> DataFrame:
    out = review.normalize_factual(_flat(spark, d), table(spark, d, "taxonomy"))
    return out.select("finding_id", "subclass_id", "main_class_id", "change_type_id", "severity_id", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"))


@query
def statement_link(spark: SparkSession, d: str) -> DataFrame:
    """Replies to statement candidates: by index, by text alone, with a wrong index, or confirming."""
    c = cut(detectors.statement_candidates(sample_texts(spark, d)))
    k = F.pmod("id", F.lit(4))
    e = c.select("id", F.when(k == 1, F.lit(99)).when(k == 2, F.lit(None)).otherwise(F.col("candidate_index")).cast("int").alias("candidate_index"), F.when(k == 0, F.lit("etwas anderes")).otherwise(F.col("sentence")).alias("span_text"), F.when(k == 3, F.lit("Es gibt keine Abweichung.")).otherwise(F.lit("zu sicher")).alias("rationale"))
    return review.link_statements(e, c)


@query
def verified_findings(spark: SparkSession, d: str) -> DataFrame:
    g = _flat(spark, d, "gold").where("finding_id is not null")
    even = F.pmod("pos", F.lit(2)) == 0
    ok = review.is_verified(F.col("span_text"), F.concat(F.lit("Laut [S1_M_1]: "), F.coalesce("correction", F.lit(""))), F.col("source_refs"), F.array(F.when(even, F.coalesce("correction", F.lit(""))).otherwise("")))
    return g.where(ok).select("finding_id")


@query
def severity_cap(spark: SparkSession, d: str) -> DataFrame:
    p = review.labels(_flat(spark, d), table(spark, d, "taxonomy"), "subclass_id", "change_type_id", "severity_id")
    return review.most_severe(p, 2, ["STUFE_3", "STUFE_2", "STUFE_1"], ("case_id", "subclass_id")).select("finding_id")


@query
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    seg = F.regexp_extract("query_id", r"_q(\d+)_", 1).try_cast("int")
    ev = retrieval.number_evidence(retrieval.merge_hits(_hits(spark, d)), seg).select(F.regexp_extract("query_id", r"^(.*)_q\d+_", 1).alias("case_id"), "source_ref", F.col("id").alias("chunk_id"), F.col("source_kind").alias("document"))
    p = _flat(spark, d).withColumn("source_refs", F.when(F.size("source_refs") > 0, F.col("source_refs")).when(F.pmod("pos", F.lit(2)) == 0, F.array(F.lit("DOC_INTERNAL"))))
    out = review.with_evidence(p, ev)
    return out.select("finding_id", F.array_join("valid_refs", "|").alias("refs"), F.array_join("chunk_ids", "|").alias("chunk_ids"), F.array_join("documents", "|").alias("documents"))


@query
def proposal_validation(spark: SparkSession, d: str) -> DataFrame:
    g = review.labels(_flat(spark, d, "gold").where("finding_id is not null"), table(spark, d, "taxonomy"), "subclass_id", "change_type_id", "severity_id")
    g = g.join(review.known_names(table(spark, d, "reference_facts")), "case_id", "left")
    where = F.when(F.pmod("pos", F.lit(2)) == 0, F.concat(F.lit("Vor "), F.coalesce("span_text", F.lit("")), F.lit(" nach"))).otherwise(F.coalesce("correction", F.lit("")))
    kind = F.when(F.col("subclass_id") == "AUFBAU_ANGABEN", "PERSON")
    issues = review.proposal_issues(F.col("span_text"), F.col("correction"), F.col("rationale"), where, kind, F.col("names"))
    return g.select("finding_id", F.array_join(issues, ",").alias("issues"))


@query
def known_persons(spark: SparkSession, d: str) -> DataFrame:
    return review.known_names(table(spark, d, "reference_facts")).select("case_id", F.array_join("names", "|").alias("names"))


@query
def class_budget(spark: SparkSession, d: str) -> DataFrame:
    p = _pred(spark, d).where("main_class is not null")
    return review.select_classes(p.groupBy("case_id", "segment_id").agg(F.array_sort(F.collect_set("main_class")).alias("available")), TARGETS, list(TARGETS))


@query
def report_union(spark: SparkSession, d: str) -> DataFrame:
    """The lists of six reviewers, each with columns of its own, as one numbered list."""
    p = review.labels(_flat(spark, d), table(spark, d, "taxonomy"), "subclass_id", "change_type_id", "severity_id").where("subclass_id is not null")
    keep = ["case_id", "segment_id", "pos", "finding_id", "agent_scope"]
    own = ["correction", "rationale", "source_refs", "span_text", "severity_id", "change_type_id"]
    lists = [p.where(F.col("agent_scope") == f"agent_{i + 1}").select(*keep, c) for i, c in enumerate(own)]
    out = findings.save_numbered(findings.union_findings(*lists), "R")
    return out.select("new_id", "finding_id", "correction", "rationale", "span_text", "severity_id", "change_type_id")


@query
def calculation_dedup(spark: SparkSession, d: str) -> DataFrame:
    return findings.dedup_calculations(_flat(spark, d), F.col("correction")).select("finding_id")


@query
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    q = _hits(spark, d).where("retrieval_query is not null").select("query_id", "retrieval_query").distinct()
    one = q.select("query_id", F.lit("question").alias("mode"), F.posexplode(retrieval.query_variants(F.col("retrieval_query"))).alias("n", "variant"))
    two = q.select("query_id", F.lit("segment").alias("mode"), F.posexplode(retrieval.query_variants(F.col("retrieval_query"), segment=True)).alias("n", "variant"))
    return _long(one.unionByName(two)).distinct()


@query
def retrieval_chain(spark: SparkSession, d: str) -> DataFrame:
    """Hits diversified within rules and material, three and four each, merged, at most six."""
    store = table(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.max_by("metadata.source_path", "metadata.ingested_at_utc").alias("path"))
    h = _hits(spark, d).join(store, "id", "left").withColumn("source", retrieval.source_key(F.col("path"), F.col("id")))
    return _long(retrieval.retrieve_by_kind(h, {"normbasis": 3, "case_material": 4}, 6))


@query
def material_dedup(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.max_by("text", "metadata.ingested_at_utc").alias("text"))
    best = _hits(spark, d).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return retrieval.distinct_material(best.join(store, "id"), 0.4)


@query
def case_listing(spark: SparkSession, d: str) -> DataFrame:
    return _long(retrieval.case_chunks(table(spark, d, "chunks").where("text is not null"), "case_000010"))


@query
def composed_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.sha2(text.composed(F.col("text")).cast("binary"), 256).alias("text_hash"))


@query
def document_header(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", text.first_lines(F.col("text"), 3).alias("header"))


@query
def model_review(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model that reports forbidden phrases: prompts out, replies in, parsed and read."""
    prompts = sample_texts(spark, d).select("id", models.review_prompt(F.lit("Melde verbotene Wendungen."), F.col("text")).alias("prompt"))
    replies = models.ask(prompts, "prompt", models.PhraseReviewer(detectors.FORBIDDEN))
    got = review.error_fields(review.parse_replies(replies.withColumnRenamed("id", "reply_id")))
    return got.where("span_text is not null").select(F.col("reply_id").alias("id"), F.col("span_text").alias("term"))


@query
def model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a stand-in encoder: unit length, equal for equal texts."""
    v = models.embed(_chunks(spark, d), "text", models.HashEncoder(32), "passage: ")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("id", F.size("vec").cast("bigint").alias("dim"), F.round(norm, 4).alias("norm"))
