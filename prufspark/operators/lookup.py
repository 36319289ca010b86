"""Which segment of a document does a span stand in?"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.functions.text import squeeze
from prufspark.operators.matching import shared_counts

SPANS, TEXTS = 1_024, 256  # Spans and segments of a document that meet at once.
EXACT = 2.0


def find_segments(spans: DataFrame, segments: DataFrame, least: float = 0.5) -> DataFrame:
    """``(case_id, span, segment_index, how)`` for the distinct ``spans(case_id, span)`` of documents with
    ``segments(case_id, segment_index, text)``: the first segment that holds the span (``exact``), else the first of
    those that share most of its tokens, at least the share ``least`` (``tokens``). Spans without one give no row; case
    and white space do not count, blank spans are left out.

    A document's spans and segments are packed in blocks, and each two blocks meet in one row, so a large document is
    spread over the tasks. An automaton of the spans runs once over each segment, shared tokens are counted for all pairs
    at once, and only the best segment of a span leaves a pair of blocks."""
    norm = lambda c: F.lower(squeeze(F.col(c)))
    s = spans.select("case_id", norm("span").alias("key"), "span").where("key <> ''").distinct()
    t = segments.where("text is not null").select("case_id", F.col("segment_index").cast("bigint").alias("segment_index"), norm("text").alias("text"))

    def packed(rows: DataFrame, key: str, size: int, value, name: str) -> DataFrame:
        n = rows.groupBy("case_id").agg(F.ceil(F.count("*") / size).alias("_n"))
        return rows.join(n, "case_id").groupBy("case_id", F.pmod(F.xxhash64(key), F.col("_n")).alias(f"{name}_block")).agg(F.collect_list(value).alias(name))

    one = packed(s.select("case_id", "key").distinct(), "key", SPANS, F.col("key"), "keys")
    two = packed(t, "segment_index", TEXTS, F.struct("segment_index", "text"), "texts")
    met = one.join(two, "case_id").repartition("case_id", "keys_block", "texts_block").select("case_id", "keys", "texts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for case, keys, texts in zip(*(b.column(c).to_pylist() for c in ("case_id", "keys", "texts"))):
                texts.sort(key=lambda x: x["segment_index"])
                found = ahocorasick.Automaton()
                for k in keys:
                    found.add_word(k, k)
                found.make_automaton()
                first: dict[str, int] = {}
                for x in texts:
                    for k in {k for _, k in found.iter(x["text"])}:
                        first.setdefault(k, x["segment_index"])
                toks = [set(k.split(" ")) for k in keys]
                share = shared_counts(toks, [set(x["text"].split(" ")) for x in texts]) / np.array([len(x) for x in toks])[:, None]
                best = share.argmax(1)
                rows = [(k, i, EXACT) for k, i in first.items()]
                rows += [(k, texts[j]["segment_index"], float(share[n, j])) for n, (k, j) in enumerate(zip(keys, best.tolist())) if k not in first and share[n, j] >= least - 1e-12]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([case] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["case_id", "key", "segment_index", "share"])

    near = met.mapInArrow(scan, "case_id string, key string, segment_index bigint, share double").groupBy("case_id", "key")
    best = near.agg(F.min(F.struct((-F.col("share")).alias("worse"), "segment_index")).alias("b"))
    how = F.when(F.col("b.worse") == -EXACT, "exact").otherwise("tokens").alias("how")
    return s.join(best, ["case_id", "key"]).select("case_id", "span", "b.segment_index", how)
