"""Making mistakes on purpose: candidates become proposals, checked ones change the text and become gold findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_text(proposals: DataFrame, priority: Sequence[str], kind: str = "subtype") -> DataFrame:
    """The proposal of each ``id`` whose kind comes first in ``priority``; others after it, equal ones by ``n``."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    w = Window.partitionBy("id").orderBy(F.when(place == 0, len(priority) + 1).otherwise(place), kind, "n")
    return proposals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_replacement(text: Column, original: Column, injected: Column) -> Column:
    """The text with the first ``original`` replaced; null where it does not stand there."""
    at = F.instr(text, original)
    return F.when((at > 0) & (original != ""), F.concat(F.substring(text, F.lit(1), at - 1), injected, F.substring(text, at + F.length(original), F.length(text))))


def inject(texts: DataFrame, proposals: DataFrame) -> DataFrame:
    """``(id, text, original_span, injected_span, subtype)``: texts with their proposal made, ``proposals(id, original_span,
    injected_span, subtype)``, one of a text. A proposal that changes nothing, or whose span is not there, is left out."""
    made = texts.join(proposals.where("original_span <> injected_span"), "id").withColumn("text", with_replacement(F.col("text"), F.col("original_span"), F.col("injected_span")))
    return made.where("text is not null").select("id", "text", "original_span", "injected_span", "subtype")


def calculation_proposals(candidates: DataFrame) -> DataFrame:
    """Proposals of ``arithmetic.injectable``: the claimed result behind its equals sign, and the near wrong one."""
    eq = lambda c: F.concat(F.lit("= "), F.col(c))
    return candidates.select("id", "n", "subtype", eq("claimed").alias("original_span"), eq("wrong").alias("injected_span"))


def gold_findings(injected: DataFrame, subclass_id: str, prefix: str = "GT") -> DataFrame:
    """``(finding_id, id, subclass_id, span_text, correction, source)``: what a reviewer should find in the changed texts,
    numbered by text id."""
    found = F.concat_ws("-", F.lit(prefix), F.col("id").cast("string"), F.lit("0001"))
    return injected.select(found.alias("finding_id"), "id", F.lit(subclass_id).alias("subclass_id"), F.col("injected_span").alias("span_text"), F.col("original_span").alias("correction"), F.lit("injected").alias("source"))
