"""Queries over the operators of this subpackage: name to ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prufspark.llm import langid, mixing, neardup, pii, scanrepair, sentences, tokens, unify, vectors
from prufspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "chunks"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "chunks"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return unify.all_values(table(spark, d, "chunks"), table(spark, d, "gold"), table(spark, d, "predictions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.changed_values(_values(spark, d))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_values(_values(spark, d)).select("tbl", "record_key", "field", "form").distinct()


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_values(table(spark, d, "chunks"), table(spark, d, "reference_facts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(_personal(spark, d))


def p3_pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    """The key is read from the session; the tests' and the driver's tables are invented, so theirs may be known."""
    return pii.pseudonymised(_personal(spark, d), spark.conf.get("prufspark.surrogate.key", "invented tables need no secret").encode())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    values = sentences.sentence_values(chunks, table(spark, d, "gold"))
    return sentences.sentence_starts(values, sentences.fitted(chunks)).distinct()


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every chunk, numbered."""
    chunks = table(spark, d, "chunks")
    cut = sentences.sentences(F.col("text"), sentences.fitted(chunks))
    rows = chunks.where("id is not null").select("id", cut.alias("s")).distinct()
    return rows.select("id", F.posexplode("s").alias("n", "sentence"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.damaged_lines(table(spark, d, "chunks"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.repaired(table(spark, d, "chunks"))


def _vector_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        table(spark, d, "rag_store").select("id", F.col("emb").alias("vec")),
        table(spark, d, "retrieved").select("id", "vec"),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(vectors.nearest_vectors(_vector_tables(spark, d)))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_vectors(_vector_tables(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ids with the offsets of their pieces."""
    return tokens.encode_with_offsets(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each text as its ids give it back."""
    ids = tokens.encode_corpus(table(spark, d, "documents"))
    return ids.select("doc_id", F.sha2(tokens.decode_ids(F.col("ids")).cast("binary"), 256).alias("text_hash"))


# The domains of these tables' sources.
DOMAINS = {
    "gutachten_archiv": "fallakten", "polizeirapport": "fallakten", "einvernahmen": "fallakten", "rechtshilfe": "fallakten",
    "normbasis": "grundlagen", "schulung": "grundlagen", "glossar": "grundlagen", "korrespondenz": "verkehr", "pressespiegel": "verkehr",
}


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_errors(langid.language_stretches(table(spark, d, "documents")))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and confidence (six decimals)."""
    return langid.language_stretches(table(spark, d, "documents")).withColumn("confidence", F.round("confidence", 6))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


# The cases of problem 2 as they are stated, as classes of a regular expression: spaces, invisible signs, hyphens, joined
# and full-width letters and digits; and the letters a reader takes for Latin ones.
ODD_CLASS = (
    r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
    r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}"
    r"\x{2010}\x{2011}\x{fe63}\x{ff0d}\x{fb00}-\x{fb04}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}"
)
LOOK_CLASS = "АВЕЗКМНОРСТУХЅІЈҮԚԜаеорсухѕіјԁһԛԝӀӏүΑΒΕΖΗΙΚΜΝΟΡΤΥΧονаικρυχγϲϳϹͿёїЁЇα"


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL where a whole table allows it."""
    w = "list_filter(string_split(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda x: x <> '')"
    p1 = f"""WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL), w AS (SELECT id, {w} AS w FROM c),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), o AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM o WHERE k >= 0.6 * (na + nb - k) - 1e-12"""
    odd, look = ODD_CLASS, LOOK_CLASS
    run = "[\\p{L}\\p{M}]*"
    case = f"(nfc_normalize(v) <> v OR regexp_matches(v, '[{odd}]') OR regexp_matches(v, '\\p{{Latin}}{run}[{look}]|[{look}]{run}\\p{{Latin}}'))"
    p2 = f"""WITH g AS (SELECT 'gold' AS tbl, unnest(gold_findings) AS f FROM gold UNION ALL SELECT 'predictions', unnest(predicted_findings) FROM predictions),
v AS (SELECT 'chunks' AS tbl, id AS record_key, 'text' AS field, text AS v FROM chunks UNION ALL SELECT tbl, f.finding_id, 'span_text', f.span_text FROM g UNION ALL SELECT tbl, f.finding_id, 'correction', f.correction FROM g)
SELECT DISTINCT tbl, record_key, field FROM v WHERE v IS NOT NULL AND record_key IS NOT NULL AND {case}"""
    near = """WITH a AS (SELECT id, emb AS v FROM rag_store UNION ALL SELECT id, vec FROM retrieved), u AS (SELECT id, v::DOUBLE[] AS v FROM a WHERE id IS NOT NULL AND len(v) = 96 QUALIFY row_number() OVER (PARTITION BY id) = 1),
n AS (SELECT id, v FROM u WHERE len(list_filter(v, lambda x: x <> 0)) > 0), h AS (SELECT q.id AS id, o.id AS other, round(list_cosine_similarity(q.v, o.v), 9) AS s FROM n q, n o WHERE q.id <> o.id),
k AS (SELECT id, other FROM h WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 10)"""
    p5 = f"{near} SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k"
    p7 = "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents"
    return {"p1_found": p1, "p2_found": p2, "p5_found": p5, "p7_decoded": p7}
