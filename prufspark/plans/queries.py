"""The query catalogue: name to ``(spark, folder) -> DataFrame``. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prufspark.functions import numbers, text
from prufspark.operators import arithmetic, chunking, detectors, findings, injection, matching, models, retrieval, tokensets
from prufspark.plans.lineage import cut
from prufspark.plans.samples import sample_texts
from prufspark.sources.readers import case_id, document_type
from prufspark.sources.tables import table
from prufspark.streaming.append import new_rows, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(f: Query) -> Query:
    CATALOGUE[f.__name__] = f
    return f


def _long(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines agree on types."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("id is not null and text is not null").select("id", "text").distinct()


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return findings.resolve(findings.flatten(table(spark, d, "gold"), "gold_findings"), table(spark, d, "taxonomy"))


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return findings.resolve(findings.flatten(table(spark, d, "predictions"), "predicted_findings"), table(spark, d, "taxonomy"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved").where("query_id is not null and id is not null")


# Text ------------------------------------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.sha2(text.normalize_document(F.col("text")).cast("binary"), 256).alias("text_hash"))


@query
def simplify_text(spark: SparkSession, d: str) -> DataFrame:
    g = findings.flatten(table(spark, d, "gold"), "gold_findings").where("span_text is not null")
    return g.select("finding_id", text.simplify(F.col("span_text")).alias("simple"))


@query
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    return _long(_chunks(spark, d).select("id", F.size(text.tokens(F.col("text"))).alias("n_tokens")))


@query
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    q = _hits(spark, d).where("retrieval_query is not null").select("query_id", "retrieval_query").distinct()
    return q.select("query_id", F.array_join(text.keywords(F.col("retrieval_query")), " ").alias("keywords")).distinct()


@query
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", text.preview(F.col("text")).alias("preview"))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    m = "metadata"
    c = table(spark, d, "chunks").where("id is not null and text is not null")
    return c.select("id", text.chunk_id(F.col(f"{m}.file_sha256"), F.col(f"{m}.source_path"), F.col(f"{m}.chunk_index"), F.col("text")).alias("address")).distinct()


@query
def path_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("metadata.source_path")
    return table(spark, d, "chunks").select("id", case_id(p).alias("path_case"), document_type(p).alias("path_type")).distinct()


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = text.rule_sentences(F.col("text"))
    return _long(_chunks(spark, d).select("id", F.size(s).alias("n"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest")))


@query
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    p = _chunks(spark, d).select("id", F.posexplode(text.paragraphs(F.col("text"))).alias("n", "p"))
    return _long(p.select("id", "n", F.length("p").alias("n_chars")))


@query
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return _long(chunking.sections(_chunks(spark, d)))


@query
def structural_units(spark: SparkSession, d: str) -> DataFrame:
    return _long(chunking.structural_units(_chunks(spark, d)).select("id", "section", "unit", "kind", F.length("text").alias("n_chars")))


@query
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.semantic_chunks(chunking.structural_units(_chunks(spark, d)), models.HashEncoder(32), size=80, overlap=12, least=20)
    return _long(c.select("id", "section", "unit", "chunk", "kind", F.length("text").alias("n_chars")))


@query
def segment_pack(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.segments(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"))
    return _long(s.select("id", "segment_index", F.length("segment_text").alias("n_chars")))


@query
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunks(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"))
    return _long(c.select("id", "chunk_index", F.length("chunk").alias("n_chars")))


# Findings --------------------------------------------------------------------------------------


@query
def taxonomy_tree(spark: SparkSession, d: str) -> DataFrame:
    return findings.subclasses(table(spark, d, "taxonomy"))


@query
def taxonomy_map(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("finding_id", "subclass", "change_type", "severity", "main_class")


@query
def id_validate(spark: SparkSession, d: str) -> DataFrame:
    g, p = _gold(spark, d).withColumn("side", F.lit("gold")), _pred(spark, d).withColumn("side", F.lit("pred"))
    cols = ["side", "subclass_id", "subclass", "change_type_id", "change_type", "severity_id", "severity"]
    both = g.select(*cols).unionByName(p.select(*cols))
    n = lambda c: F.count_if(F.col(f"{c}_id").isNotNull() & F.col(c).isNull()).alias(f"unknown_{c}")
    return both.groupBy("side").agg(F.count("*").alias("n"), n("subclass"), n("change_type"), n("severity"))


@query
def duplicate_segments(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold").groupBy("case_id", "segment_id").agg(F.count("*").alias("n"))
    return g.where("n > 1")


@query
def two_stage_dedup(spark: SparkSession, d: str) -> DataFrame:
    return findings.dedup_two_stage(findings.flatten(table(spark, d, "predictions"), "predicted_findings")).select("finding_id")


@query
def language_dedup(spark: SparkSession, d: str) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(F.trim(c), F.lit("")))
    return findings.dedup_by_key(findings.flatten(table(spark, d, "predictions"), "predicted_findings"), low("span_text"), low("correction"), low("subclass_id")).select("finding_id")


@query
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = _chunks(spark, d).withColumn("h", F.sha2(text.squeeze(F.col("text")).cast("binary"), 256))
    return g.groupBy("h").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("kept", "n")


@query
def fuzzy_dedup_leader(spark: SparkSession, d: str) -> DataFrame:
    return findings.dedup_leaders(findings.flatten(table(spark, d, "predictions"), "predicted_findings")).select("finding_id")


@query
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = findings.flatten(table(spark, d, "gold"), "gold_findings").where("span_text is not null")
    return tokensets.similar_token_sets(g.select("finding_id", text.tokens(F.col("span_text")).alias("toks")), "finding_id", 0.6).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query
def save_numbering(spark: SparkSession, d: str) -> DataFrame:
    return findings.save_numbered(_pred(spark, d).where("subclass is not null"), "PRED").select("finding_id", "new_id")


@query
def protected_span_filter(spark: SparkSession, d: str) -> DataFrame:
    p = findings.flatten(table(spark, d, "predictions"), "predicted_findings").where("span_text is not null").select("case_id", "finding_id", findings.simple_span(F.col("span_text")).alias("a"))
    # Equal spans of a case are compared once; a part of each case's spans per task keeps a hot case apart.
    parts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")
    spans = findings.protected_spans(table(spark, d, "reference_facts")).select("case_id", findings.simple_span(F.col("source_span")).alias("b")).distinct()
    spans = spans.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    once = p.select("case_id", "a").distinct()
    on = once.select("case_id", "a", parts).join(spans, ["case_id", "part"]).where(findings.on_protected_span(F.col("a"), F.col("b"))).select("case_id", "a").distinct()
    return p.join(on, ["case_id", "a"], "left_semi").select("finding_id")


@query
def facts_long(spark: SparkSession, d: str) -> DataFrame:
    keys = ["auftraggeber", "gutachten_titel", "vorfall", "ereignisdatum", "beschuldigte_person", "ort", "sachverstaendige_person", "hauptsachbearbeitung"]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.trim(f"facts.{k}.value").alias("value"), F.lower(F.trim(f"facts.{k}.confidence")).alias("c")) for k in keys])
    rows = table(spark, d, "reference_facts").select("file_name", "case_id", F.explode(entries).alias("e")).select("file_name", "case_id", "e.*").where("value <> ''")
    return rows.select("file_name", "case_id", "key", "value", F.when(F.col("c").isin("high", "medium", "low"), F.col("c")).otherwise("low").alias("confidence")).distinct()


# Matching and metrics ----------------------------------------------------------------------------


@query
def span_scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.candidates(_gold(spark, d), _pred(spark, d), scope=matching.CASE).select("gold_finding_id", "pred_finding_id", "span_score", "score", F.coalesce(F.col("correction_match").cast("string"), F.lit("none")).alias("correction_match"))


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    g, p = cut(_gold(spark, d)), cut(_pred(spark, d))
    c = matching.without_classes(matching.candidates(g, p, scope=matching.CASE))
    return g, p, c, matching.with_classes(cut(matching.greedy_match(c, matching.CASE)), g, p)


@query
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)[3].select("gold_finding_id", "pred_finding_id", "span_score", "score")


@query
def match_metrics_by_class(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    return matching.class_metrics(g, p, m)


@query
def match_metrics_by_main_class(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    return matching.class_metrics(g, p, m, "main_class")


@query
def micro_summary(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    return matching.summary(g, p, m)


def _left_over(g: DataFrame, p: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cut(matching.unmatched(g, m, "gold")), cut(matching.unmatched(p, m, "pred"))


@query
def confusion(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    ug, up = _left_over(g, p, m)
    return matching.confusion(m, ug, up, matching.best_counterparts(ug, up, 1))


@query
def best_unmatched(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    ug, up = _left_over(g, p, m)
    return _long(matching.best_counterparts(up, ug).withColumnsRenamed({"finding_id": "pred_finding_id", "other_finding_id": "gold_finding_id"}))


@query
def strict_match(spark: SparkSession, d: str) -> DataFrame:
    c = cut(matching.strict_candidates(matching.candidates(_gold(spark, d), _pred(spark, d), scope=matching.CASE)))
    return matching.greedy_match(c, matching.CASE, matching.SCORE_FIRST).select("gold_finding_id", "pred_finding_id", "span_score", "score")


@query
def match_rows(spark: SparkSession, d: str) -> DataFrame:
    g, p, _, m = _matched(spark, d)
    out = matching.wide_matches(m.drop("gold_subclass", "pred_subclass", "gold_main_class", "pred_main_class"), g, p)
    return out.withColumn("correction_match", F.coalesce(F.col("correction_match").cast("string"), F.lit("none")))


@query
def consensus_fp(spark: SparkSession, d: str) -> DataFrame:
    """Predicted findings of agent_2 that agents 4 and 5 have too in the same case."""
    p = findings.flatten(table(spark, d, "predictions"), "predicted_findings").select("case_id", F.col("agent_scope").alias("model"), "finding_id", "span_text")
    return matching.consensus(p, ["agent_2", "agent_4", "agent_5"], 0.1)


@query
def fp_by_agent(spark: SparkSession, d: str) -> DataFrame:
    _, p, _, m = _matched(spark, d)
    fp = matching.unmatched(p, m, "pred").select(F.coalesce("agent_scope", F.lit("none")).alias("agent"), F.coalesce("severity", F.lit("none")).alias("severity_level"))
    c = fp.cube("agent", "severity_level").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return c.select(F.when(F.col("gid") >= 2, "(all)").otherwise(F.col("agent")).alias("agent"), F.when(F.col("gid") % 2 == 1, "(all)").otherwise(F.col("severity_level")).alias("severity_level"), "n")


@query
def fn_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Missed gold findings by the reviewer they belong to, from their main class where they name none."""
    g, _, _, m = _matched(spark, d)
    scope = F.coalesce("agent_scope", findings.agent_scope(F.coalesce("main_class", F.lit("")))).alias("scope")
    return matching.unmatched(g, m, "gold").select(scope).groupBy("scope").agg(F.count("*").alias("n"))


@query
def fp_matrix(spark: SparkSession, d: str) -> DataFrame:
    """False positives of each agent by severity, zero where there are none."""
    _, p, _, m = _matched(spark, d)
    fp = matching.unmatched(p, m, "pred").select(F.coalesce("agent_scope", F.lit("none")).alias("agent"), F.coalesce("severity", F.lit("none")).alias("level"))
    return matching.count_matrix(fp, "agent", "level", ["STUFE_1", "STUFE_2", "STUFE_3", "none"])


@query
def proposal_counts(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d).where("source in ('manual', 'injected')").select(F.coalesce("subclass", F.lit("UNKNOWN")).alias("s"), F.coalesce("change_type", F.lit("UNKNOWN")).alias("c"), "source")
    g = g.groupingSets([["s", "c"], ["s"], ["c"], []], "s", "c").agg(F.count_if(F.col("source") == "manual").alias("n_manual"), F.count_if(F.col("source") == "injected").alias("n_injected"))
    return g.select(F.coalesce("s", F.lit("(all)")).alias("subclass"), F.coalesce("c", F.lit("(all)")).alias("change_type"), "n_manual", "n_injected")


# Retrieval ---------------------------------------------------------------------------------------


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _twentieth(e: DataFrame) -> DataFrame:
    return e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")


@query
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _long(retrieval.topk_cosine(_twentieth(e), e, 12))


@query
def topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _long(retrieval.topk_cosine(_twentieth(e), e, 8, F.col("label") < 5))


@query
def topk_postfiltered(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    hits = retrieval.topk_cosine(_twentieth(e), e, 40).join(e.select("id", "label"), "id").where("label < 5")
    w = Window.partitionBy("query_id").orderBy("rank")
    return _long(hits.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("query_id", "rank", "id", "score"))


@query
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    # One more than is looked at, as a vector may be among its own hits.
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = retrieval.topk_cosine(_twentieth(e), e, 12).where("id <> query_id").withColumn("rank", F.row_number().over(w))
    own = e.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    hits = hits.join(e.select("id", "label"), "id").join(own, "query_id")
    return retrieval.recall_and_mrr(hits, F.col("label") == F.col("wanted"))


@query
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _long(_hits(spark, d).select("query_id", "id", "rank").distinct().groupBy("rank").agg(F.count("*").alias("n")))


@query
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    return _long(retrieval.merge_hits(_hits(spark, d)).select("query_id", "rank", "id", "score"))


@query
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "chunks").groupBy("id").agg(F.max_by("metadata.source_path", "metadata.ingested_at_utc").alias("source"))
    best = _hits(spark, d).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max_by("vec", F.struct("score", -F.col("rank"))).alias("vec"))
    return _long(retrieval.mmr(best.join(store, "id", "left").withColumn("source", F.coalesce("source", "id")), 6))


@query
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    merged = retrieval.merge_hits(_hits(spark, d))
    store = table(spark, d, "chunks").groupBy("id").agg(F.max_by("text", "metadata.ingested_at_utc").alias("body"))
    blocks = merged.join(store, "id").select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("id", 1, 12)).alias("header"), "body")
    return _long(retrieval.context_budget(blocks, 3000))


@query
def evidence_numbering(spark: SparkSession, d: str) -> DataFrame:
    merged = retrieval.merge_hits(_hits(spark, d))
    return retrieval.number_evidence(merged, F.regexp_extract("query_id", r"_q(\d+)_", 1).try_cast("int")).select("query_id", "id", "source_ref")


@query
def store_assembly(spark: SparkSession, d: str) -> DataFrame:
    s = retrieval.assemble_store(table(spark, d, "rag_store"), table(spark, d, "chunks"))
    return s.groupBy("name", F.coalesce("case_id", F.lit("none")).alias("case_id")).agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.sum(F.length("text")).alias("n_chars"))


# Aggregation -------------------------------------------------------------------------------------


def _case_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("metadata.case_id is not null and text is not null").select("id", "metadata.case_id", "text").distinct()


def _case_words(spark: SparkSession, d: str) -> DataFrame:
    return _case_texts(spark, d).select("case_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÄÖÜäöüß]{4,}"), F.lit(0))).alias("word"))


@query
def domain_whitelist(spark: SparkSession, d: str) -> DataFrame:
    return _case_words(spark, d).groupBy("case_id", "word").agg(F.count("*").alias("n")).where("n >= 2")


@query
def reference_words(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "reference_facts")
    names = f.select("case_id", F.explode("facts.personen").alias("p")).select("case_id", F.col("p.name").alias("v"))
    alias = f.select("case_id", F.explode("facts.referenz_entitaeten").alias("e")).select("case_id", F.explode(F.concat(F.array("e.bezeichnung"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("v"))
    w = names.unionByName(alias).where("v is not null").select("case_id", F.explode(F.split(F.trim(F.regexp_replace(F.lower("v"), r"[^0-9a-zäöüß]+", " ")), " ")).alias("word"))
    return w.where(F.length("word") >= 4).distinct()


@query
def reader_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null").select("id", "metadata.pdf_page_text_quality").distinct()
    r = c.select("id", F.explode("pdf_page_text_quality").alias("q")).select("id", "q.page_index", F.posexplode("q.pdf_text_reader_candidates").alias("prio", "c"))
    score = F.col("c.chars") - F.col("c.suspicious_long_runs") * 28 * 6
    w = Window.partitionBy("id", "page_index").orderBy(score.desc(), F.col("c.chars").desc(), "c.suspicious_long_runs", "prio")
    best = r.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "page_index", F.col("c.reader").alias("reader"), score.alias("score"))
    return _long(best)


@query
def reader_vote(spark: SparkSession, d: str) -> DataFrame:
    best = reader_choice(spark, d).groupBy("id", "reader").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.col("n").desc(), "reader")
    return best.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "reader", "n")


@query
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", F.col("metadata.ingested_at_utc").alias("t"))
    store = c.where("t < '2023-06-01'").select("id").distinct()
    return new_rows(c.where("t >= '2023-06-01'"), store, "id", "t").select("id", "t")


@query
def json_alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    value = findings.first_nonblank(*[F.get_json_object("props", p) for p in ("$.key", "$.name", "$.k")])
    return table(spark, d, "events").groupBy(value.alias("key")).agg(F.count("*").alias("n"))


@query
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "6 hours")


# Detectors ---------------------------------------------------------------------------------------


@query
def date_mentions(spark: SparkSession, d: str) -> DataFrame:
    return detectors.date_mentions(detectors.text_rows(table(spark, d, "chunks")))


@query
def date_window(spark: SparkSession, d: str) -> DataFrame:
    day = detectors.event_day(F.col("facts.ereignisdatum.value"), F.coalesce("facts.ereignisdatum.source_span", F.lit("")))
    f = table(spark, d, "reference_facts").select("case_id", day.alias("event_day")).where("event_day is not null").groupBy("case_id").agg(F.min("event_day").alias("event_day"))
    c = table(spark, d, "chunks").where("metadata.case_id is not null").select("id", "metadata.case_id").distinct()
    m = detectors.date_mentions(detectors.text_rows(table(spark, d, "chunks"))).where("day is not null").join(c, "id")
    return detectors.dates_after_window(m, f).select("id", "mention", "day")


@query
def unit_conflict(spark: SparkSession, d: str) -> DataFrame:
    return _long(detectors.unit_conflicts(detectors.text_rows(table(spark, d, "chunks"))))


@query
def unit_conflict_samples(spark: SparkSession, d: str) -> DataFrame:
    return _long(detectors.unit_conflicts(sample_texts(spark, d)))


@query
def time_difference(spark: SparkSession, d: str) -> DataFrame:
    """Two differences a text, the first in whole seconds, the second with a decimal comma."""
    li = table(spark, d, "lineitem")
    a, b = F.col("l_orderkey") % 997, F.col("l_partkey") % 499
    said = F.abs(a - b) + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0)
    word = F.element_at(F.array(*map(F.lit, ("zeitliche Differenz", "Differenz", "Zeitdifferenz", "Zeitdauer"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    c = F.col("l_suppkey") % 97
    second = F.concat(c + F.when(F.col("l_orderkey") % 5 == 0, 2).otherwise(0), F.lit(",5 s ("), c + 10, F.lit(",5 s - 10 s)"))
    t = F.concat(F.lit("Die "), word, F.lit(" von "), said, F.lit(" Sekunden ("), a, F.lit(" Sekunden – "), b, F.lit(" Sekunden) und eine Differenz von "), second, F.lit("."))
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), t.alias("text"))
    return _long(detectors.time_differences(rows).select("id", "n", F.col("said").cast("double").alias("said"), F.col("right").cast("double").alias("right")))


def _calculations(spark: SparkSession, d: str) -> DataFrame:
    """Texts that claim (quantity * price) / 4, cut to two decimals, and a difference; some claims are off."""
    q, k = F.col("l_quantity").cast("bigint"), F.col("l_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    claimed = F.expr("cast((quantity * cents) div 4 + if(l_orderkey % 11 = 0, 700, 0) as decimal(20, 0)) / cast(100 as decimal(3, 0))").cast("decimal(20,2)")
    off = q - F.col("l_linenumber") + F.when(k % 13 == 0, 1).otherwise(0)
    li = table(spark, d, "lineitem").withColumn("quantity", q).withColumn("cents", cents)
    price = (F.col("cents").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")
    t = F.concat(F.lit("Es gilt ("), q, F.lit(" * "), price, F.lit(") / 4 = "), claimed, F.lit(". Dazu "), q, F.lit(" – "), F.col("l_linenumber"), F.lit(" = "), off, F.lit(" Stück."))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), t.alias("text"))


@query
def calc_verify(spark: SparkSession, d: str) -> DataFrame:
    return _long(arithmetic.verify(arithmetic.equations(_calculations(spark, d))).where("status = 'wrong'").select("id", "n", "claimed", "right"))


@query
def calc_status(spark: SparkSession, d: str) -> DataFrame:
    return arithmetic.verify(arithmetic.equations(_calculations(spark, d))).groupBy("n", "status").agg(F.count("*").alias("rows")).transform(_long)


@query
def calc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return arithmetic.injectable(arithmetic.equations(_calculations(spark, d))).where("subtype = 'DIFFERENZ'").select("id", "claimed", "wrong")


@query
def injected_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose difference is right, with a wrong one in its place."""
    t = cut(_calculations(spark, d).groupBy("id").agg(F.min("text").alias("text")))
    p = injection.calculation_proposals(arithmetic.injectable(arithmetic.equations(t)).where("subtype = 'DIFFERENZ'"))
    p = p.withColumn("original_span", F.concat("original_span", F.lit(" Stück"))).withColumn("injected_span", F.concat("injected_span", F.lit(" Stück")))
    return injection.inject(t, injection.one_per_text(p, ["DIFFERENZ"])).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "injected_span")


@query
def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in four ways and read again."""
    k, cents = F.col("l_orderkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole, rest = F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    parted = lambda sign: F.when(whole >= 1000, F.concat(F.floor(whole / 1000), F.lit(sign), F.lpad(F.pmod(whole, F.lit(1000)).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    form = F.when(k % 4 == 0, F.concat(parted("'"), F.lit(","), rest)).when(k % 4 == 1, F.concat(parted("’"), F.lit("."), rest)).when(k % 4 == 2, F.concat(parted("."), F.lit(","), rest)).otherwise(F.concat(whole, F.lit(","), rest))
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), numbers.parse_number(form).alias("value"))


@query
def forbidden_terms(spark: SparkSession, d: str) -> DataFrame:
    return detectors.terms(sample_texts(spark, d), detectors.FORBIDDEN)


@query
def hedging(spark: SparkSession, d: str) -> DataFrame:
    return _long(detectors.reformulation_candidates(detectors.text_rows(table(spark, d, "chunks"))).select("id", "n", "kind", F.length("sentence").alias("n_chars")))


@query
def reformulation_samples(spark: SparkSession, d: str) -> DataFrame:
    return _long(detectors.reformulation_candidates(sample_texts(spark, d)).select("id", "n", "kind", "sentence"))


@query
def hypothesis_texts(spark: SparkSession, d: str) -> DataFrame:
    return detectors.hypothesis_texts(detectors.text_rows(table(spark, d, "chunks"))).select("id")


@query
def statement_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _long(detectors.statement_candidates(sample_texts(spark, d)))


@query
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return detectors.abbreviation_variants(sample_texts(spark, d))


@query
def date_samples(spark: SparkSession, d: str) -> DataFrame:
    return detectors.date_mentions(sample_texts(spark, d))


@query
def name_consistency(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "reference_facts")
    listed = f.select("case_id", F.explode("facts.personen").alias("p")).select("case_id", F.col("p.name").alias("name"))
    single = f.select("case_id", F.explode(F.array(*[F.col(f"facts.{k}") for k in ("sachverstaendige_person", "beschuldigte_person", "hauptsachbearbeitung")])).alias("p"))
    single = single.where("lower(trim(p.confidence)) in ('high', 'medium')").select("case_id", F.substring_index("p.value", ",", 1).alias("name"))
    names = listed.unionByName(single).select("case_id", F.explode(F.split(text.squeeze(F.col("name")), " ")).alias("name")).where(F.length("name") >= 4)
    return detectors.name_slips(detectors.name_words(_case_texts(spark, d)), names)


def queries() -> dict[str, Query]:
    from prufspark.plans import review_queries  # noqa: F401  (adds its own)

    return dict(CATALOGUE)
