"""Vector search, diversification and evidence assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CORPUS_BLOCK = 20_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def topk_cosine(queries: DataFrame, corpus: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: exact top ``k`` of ``corpus(id, vec)`` for each of ``queries(query_id, vec)``.

    A stated set of queries meets the corpus in blocks: queries travel as packed blocks to every block of the corpus,
    which multiplies them at once and keeps its own best ``k``; nothing comes to the driver. Scores to six decimals,
    equal scores by id. ``keep`` filters the corpus first. Null vectors are skipped."""
    corpus = corpus.where(F.col("vec").isNotNull()) if keep is None else corpus.where(keep & F.col("vec").isNotNull())
    queries = queries.where(F.col("vec").isNotNull()).select("query_id", "vec")
    id_type, q_type = corpus.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    n_corpus, n_queries = corpus.count(), queries.count()
    if not n_corpus or not n_queries:
        return corpus.sparkSession.createDataFrame([], f"query_id {q_type}, rank int, id {id_type}, score double")
    c_blocks, q_blocks = -(-n_corpus // CORPUS_BLOCK), -(-n_queries // QUERY_BLOCK)
    packed = lambda df, key, n: df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col("vec").cast("array<double>").alias("vec"))).alias("rows"))
    c = packed(corpus.select("id", "vec"), "id", c_blocks).select("block", F.col("rows").alias("corpus"))
    q = packed(queries, "query_id", q_blocks).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(c_blocks - 1).cast("bigint"))).alias("block"), F.col("block").alias("part"), F.col("rows").alias("asked"))
    met = c.join(q, "block").repartition("block", "part").select("corpus", "asked")

    def side(col: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
        keys, vec = col.values.field("key"), col.values.field("vec")
        return keys, unit_rows(np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(keys), -1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, x = side(b.column("corpus")[r])
                names, y = side(b.column("asked")[r])
                order = np.argsort(np.array(ids.to_pylist()), kind="stable")
                x, ids = x[order], ids.take(pa.array(order))
                for i in range(0, len(names), 256):
                    s = np.round(y[i : i + 256] @ x.T, 6)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    at, flat = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + at)), ids.take(pa.array(flat)), pa.array(s[at, flat])], names=["query_id", "id", "score"])

    out = met.mapInArrow(search, f"query_id {q_type}, id {id_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def merge_hits(hits: DataFrame) -> DataFrame:
    """One hit per query and id: the best score, on ties the better rank; re-ranked."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min_by("source_kind", F.struct(-F.col("score"), "rank")).alias("source_kind"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("int"))


def mmr(hits: DataFrame, k: int, weight: float = 0.75, per_source: int = 2) -> DataFrame:
    """``(query_id, rank, id)``: greedy choice by weight * score - (1 - weight) * nearest chosen, at most ``per_source``
    of one source until none other is left. ``hits(query_id, id, score, source, vec)``; a missing vector is near to none.

    A query's hits are the few that a search returned, so each group is small."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").drop_duplicates("id").reset_index(drop=True)
        size = max((len(v) for v in pdf["vec"] if v is not None), default=1)
        x = unit_rows(np.array([v if v is not None and len(v) == size else np.zeros(size) for v in pdf["vec"]], dtype=np.float64))
        near = np.full(len(pdf), -np.inf)
        used: dict[object, int] = {}
        chosen: list[int] = []
        left = np.ones(len(pdf), dtype=bool)
        while len(chosen) < min(k, len(pdf)):
            open_ = left.copy()
            if per_source > 0:
                open_ &= np.array([used.get(s, 0) < per_source for s in pdf["source"]])
            if not open_.any():
                open_ = left
            value = weight * pdf["score"].to_numpy() - (1 - weight) * np.where(np.isfinite(near), near, 0.0)
            i = int(np.where(open_, np.round(value, 12), -np.inf).argmax())
            chosen.append(i)
            left[i] = False
            s = pdf["source"][i]
            used[s] = used.get(s, 0) + 1
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(chosen) + 1), "id": pdf["id"].iloc[chosen].to_numpy()})

    types = {f.name: f.dataType.simpleString() for f in hits.schema}
    return hits.groupBy("query_id").applyInPandas(choose, f"query_id {types['query_id']}, rank int, id {types['id']}")


def recall_and_mrr(hits: DataFrame, truth: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: queries, recall at each k and mean reciprocal rank of the first true hit, six decimals."""
    first = hits.groupBy("query_id").agg(F.min(F.when(truth, F.col("rank"))).alias("first"))
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return first.agg(
        F.count("*").alias("n_queries"),
        *[share(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks],
        share(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def context_budget(blocks: DataFrame, most: int = 12_000) -> DataFrame:
    """Blocks ``(query_id, rank, header, body)`` in rank order while they fit ``most`` characters, two for each gap;
    the first that does not is cut with an ellipsis if any of its body fits, and ends the context. Empty bodies cost nothing."""
    b = blocks.withColumn("body", F.trim("body")).where(F.col("body") != "").withColumn("len", F.length("header") + 1 + F.length("body"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("used", F.coalesce(F.sum(F.col("len") + 2).over(w), F.lit(0)))
    room = F.lit(most) - F.col("used") - F.length("header") - 2
    fits = F.col("used") + F.col("len") + 2 <= most
    b = b.withColumn("over", F.sum((~fits).cast("int")).over(w.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = b.where(fits & (F.col("over") == 0) | (~fits & (F.col("over") == 1) & (room > 0)))
    return kept.select("query_id", "rank", F.when(fits, F.col("len")).otherwise(F.length("header") + 1 + room + 2).alias("n_chars"), (~fits).alias("was_cut"))


def number_evidence(hits: DataFrame, segment: Column) -> DataFrame:
    """References ``S{segment}_R_{i}`` for rules and ``S{segment}_M_{i}`` for material, in rank order per query and kind."""
    kind = F.when(F.col("source_kind") == "normbasis", "R").otherwise("M")
    w = Window.partitionBy("query_id", kind).orderBy("rank", "id")
    return hits.withColumn("source_ref", F.concat(F.lit("S"), segment.cast("string"), F.lit("_"), kind, F.lit("_"), F.row_number().over(w).cast("string")))


def assemble_store(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with the text and metadata of their chunk; an unknown id gives an empty text. Repeated rows count once,
    a repeated chunk counts with its latest ingest."""
    v = vectors.groupBy("name", "source_kind", "id").agg(F.first("emb", ignorenulls=True).alias("emb"))
    c = chunks.groupBy("id").agg(F.max_by(F.struct("text", "metadata.case_id", "metadata.source_path"), "metadata.ingested_at_utc").alias("c"))
    return v.join(c, "id", "left").select("name", "source_kind", "id", "emb", F.coalesce("c.text", F.lit("")).alias("text"), "c.case_id", "c.source_path", F.col("c").isNotNull().alias("known"))


# Words of a question about a procedure, and what its keyword variants ask for.
PROCEDURE = ["wie ", "vorgehen", "ablauf", "prozess", "schritte", "checkliste"]
VARIANTS = ["vorgehen", "schritte", "checkliste"]


def query_variants(query: Column, segment: bool = False, most: int = 4) -> Column:
    """The question, its keywords, and for segments and questions about a procedure three keyword variants: distinct
    without regard to case, at most ``most``; none for a blank question."""
    from prufspark.functions.text import bind, keywords, squeeze

    def of(q: Column) -> Column:
        low = F.lower(q)

        def with_words(words: Column) -> Column:
            asked = F.lit(True) if segment else F.exists(F.array(*map(F.lit, PROCEDURE)), lambda x: F.contains(low, x))
            more = F.when((words != "") & asked, F.array(*[F.concat(words, F.lit(f" {v}")) for v in VARIANTS])).otherwise(F.array().cast("array<string>"))
            every = F.concat(F.array(q), F.when((words != "") & (words != low), F.array(words)).otherwise(F.array().cast("array<string>")), more)
            keys = F.transform(every, lambda x: F.lower(x))
            return F.slice(F.filter(every, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)

        return F.when(q == "", F.array().cast("array<string>")).otherwise(bind(F.array_join(keywords(q), " "), with_words))

    return bind(squeeze(F.coalesce(query, F.lit(""))), of)


def source_key(*paths: Column) -> Column:
    """What counts as the source of a hit: the first path that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in paths])


def retrieve_by_kind(hits: DataFrame, per_kind: dict[str, int], top_k: int = 0, weight: float = 0.75, per_source: int = 2) -> DataFrame:
    """``(query_id, rank, id, score, source_kind)``: of the hits of all variants the best per id, diversified within each
    kind of store (so many each), then merged by score; at most ``top_k`` where that is positive."""
    best = hits.groupBy("query_id", "id", "source_kind").agg(F.max("score").alias("score"), F.max_by(F.struct("vec", "source"), F.struct("score", "rank")).alias("b")).select("query_id", "id", "source_kind", "score", "b.vec", "b.source")
    out = None
    for kind, k in sorted(per_kind.items()):
        mine = best.where(F.col("source_kind") == kind)
        chosen = mmr(mine, k, weight, per_source).select("query_id", "id").join(mine.select("query_id", "id", "score", "source_kind"), ["query_id", "id"])
        out = chosen if out is None else out.unionByName(chosen)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source_kind", "id")
    out = out.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "id", "score", "source_kind")
    return out.where(F.col("rank") <= top_k) if top_k > 0 else out


def distinct_material(hits: DataFrame, threshold: float = 0.72) -> DataFrame:
    """``hits(query_id, id, score, text)`` without those that are like a better one of their query (token sets); queries of
    two hits or fewer stay as they are. A query's hits are the few that a search returned."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        if len(pdf) > 2:
            kept: list[set[str]] = []
            mask = []
            for t in pdf["text"]:
                mine = set((t or "").lower().split())
                ok = all(len(mine & k) < threshold * len(mine | k) - 1e-12 or not (mine | k) for k in kept)
                mask.append(ok)
                if ok:
                    kept.append(mine)
            pdf = pdf[mask]
        return pdf[["query_id", "id"]]

    types = {f.name: f.dataType.simpleString() for f in hits.schema}
    return hits.select("query_id", "id", "score", "text").groupBy("query_id").applyInPandas(choose, f"query_id {types['query_id']}, id {types['id']}")


def case_chunks(chunks: DataFrame, case: str, most: int = 80) -> DataFrame:
    """``(source_path, chunk_index, id, preview)`` of one case's chunks, in order."""
    from prufspark.functions.text import preview

    mine = chunks.where(F.col("metadata.case_id") == case).select("metadata.source_path", "metadata.chunk_index", "id", preview(F.col("text"), most).alias("preview")).distinct()
    return mine.orderBy("source_path", "chunk_index", "id")
