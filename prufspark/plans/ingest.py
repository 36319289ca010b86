"""From files to chunks with content addresses, as one plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.functions import text
from prufspark.operators import chunking


def ingest(documents: DataFrame, encoder: Callable[[list[str]], np.ndarray], size: int = 320, overlap: int = 48, least: int = 80) -> DataFrame:
    """``(id, text, rel_path, source_kind, case_id, document_type, section_title, content_type, chunk_index, chunk_len,
    similarity_prev)`` of ``readers.read_documents(readers.source_files(…))``. Files without text give no chunks. Lines are
    sectioned before soft breaks are joined, so no heading is lost to the line after it."""
    d = documents.where(F.trim("text") != "").select(F.col("rel_path").alias("id"), "text", "source_kind", "case_id", "document_type", "file_sha256")
    units = chunking.structural_units(d.select("id", "text"))
    units = units.withColumn("text", text.normalize_document(F.col("text")))
    c = chunking.semantic_chunks(units, encoder, size, overlap, least)
    titles = chunking.sections(d.select("id", "text")).select("id", F.col("section").cast("int").alias("section"), "title")
    place = F.struct("section", "unit", "chunk")
    ranked = c.groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("places"))
    c = c.join(ranked, "id").withColumn("chunk_index", (F.array_position("places", place) - 1).cast("int")).drop("places")
    c = c.join(titles, ["id", "section"], "left").join(d.drop("text"), "id")
    address = text.chunk_id(F.col("file_sha256"), F.col("id"), F.col("chunk_index"), F.col("text"))
    return c.select(
        address.alias("chunk_id"), "text", F.col("id").alias("rel_path"), "source_kind", "case_id", "document_type", F.col("title").alias("section_title"), F.col("kind").alias("content_type"), "chunk_index",
        F.length("text").alias("chunk_len"), "similarity_prev",
    ).withColumnRenamed("chunk_id", "id")
