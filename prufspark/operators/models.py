"""Where models plug in: encoders and reviewers are callables from a batch of texts to a batch of results.

They run inside Arrow batches on the workers; equal texts of a batch are sent once. Stand-ins give the same result for the
same text, so that everything around a model can be run and tested without one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Reviewer = Callable[[list[str]], list[str]]
SECTION = "\n\n### Text\n"


def embed(rows: DataFrame, text: str, encoder: Encoder, prefix: str = "", batch: int = 64, out: str = "vec") -> DataFrame:
    """``rows`` without ``text`` and with its unit vector as array<float>; null for a null or blank text, and for a vector
    without length. ``batch`` texts go to the encoder at once."""
    kept = [f for f in rows.schema if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t and t.strip()))
            known: dict[str, list[float] | None] = {}
            for i in range(0, len(distinct), batch):
                part = distinct[i : i + batch]
                for t, v in zip(part, np.asarray(encoder([prefix + t for t in part]), dtype=np.float64)):
                    n = np.linalg.norm(v)
                    known[t] = (v / n).astype(np.float32).tolist() if n > 0 else None
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([known.get(t) for t in texts], pa.list_(pa.float32()))], names=[*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{out} array<float>"])
    return rows.mapInArrow(run, schema)


def ask(rows: DataFrame, prompt: str, reviewer: Reviewer, batch: int = 16, out: str = "reply") -> DataFrame:
    """``rows`` without ``prompt`` and with the reply to it; null for a null prompt. A failing batch gives null replies and
    the error in ``reply_error``, so that one bad reply does not end the job."""
    kept = [f for f in rows.schema if f.name != prompt]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(prompt).to_pylist()
            distinct = list(dict.fromkeys(p for p in prompts if p is not None))
            known: dict[str, tuple[str | None, str | None]] = {}
            for i in range(0, len(distinct), batch):
                part = distinct[i : i + batch]
                try:
                    known.update({p: (r, None) for p, r in zip(part, reviewer(part), strict=True)})
                except Exception as e:
                    known.update({p: (None, f"{type(e).__name__}: {e}"[:200]) for p in part})
            got = [known.get(p, (None, None)) for p in prompts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*names, out, f"{out}_error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{out} string", f"{out}_error string"])
    return rows.mapInArrow(run, schema)


def review_prompt(task: Column, text: Column, facts: Column | None = None, context: Column | None = None) -> Column:
    """A task, what is known, what was retrieved, and the text, under headings; empty parts are left out."""
    part = lambda title, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"\n\n### {title}\n"), c)).otherwise("")
    return F.concat(task, *([part("Bekannt", facts)] if facts is not None else []), *([part("Quellen", context)] if context is not None else []), F.lit(SECTION), F.coalesce(text, F.lit("")))


def facts_block(facts: DataFrame) -> DataFrame:
    """``(case_id, block)``: the facts of a case with a value, one a line, in the order of their names."""
    from pyspark.sql.types import StructType

    names = [f.name for f in facts.schema["facts"].dataType if isinstance(f.dataType, StructType)]
    lines = F.filter(F.array(*[F.when(F.trim(f"facts.{n}.value") != "", F.concat(F.lit(f"{n}: "), F.trim(f"facts.{n}.value"))) for n in sorted(names)]), lambda x: x.isNotNull())
    return facts.groupBy("case_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lines)))), "\n").alias("block"))


def taxonomy_block(taxonomy: DataFrame) -> DataFrame:
    """One row ``block``: main classes and their subclasses as an outline."""
    sub = lambda m: F.array_join(F.transform(m["subclasses"], lambda s: F.concat(F.lit("  - "), s["label"])), "\n")
    return taxonomy.select(F.array_join(F.transform("main_classes", lambda m: F.concat(m["label"], F.lit("\n"), sub(m))), "\n").alias("block"))


def error_schema(taxonomy: dict, fields: Sequence[str] = ("stelle_im_segment", "begruendung", "vorschlag", "source_refs")) -> dict:
    """JSON schema of a list of errors whose labels are those of the taxonomy (a dict as in its file)."""
    text = {"type": "string"}
    names = lambda k: sorted(x["label"] for x in taxonomy[k])
    subs = sorted(s["label"] for m in taxonomy["main_classes"] for s in m["subclasses"])
    labels = {"hauptklasse": names("main_classes"), "subklasse": subs, "aenderungstyp": names("change_types"), "schweregrad": names("severity_levels")}
    own = {f: {"type": "array", "items": text} if f == "source_refs" else text for f in fields}
    item = {"type": "object", "properties": {k: {"type": "string", "enum": v} for k, v in labels.items()} | own, "required": [*labels, "stelle_im_segment"]}
    return {"type": "object", "properties": {"errors": {"type": "array", "items": item}}, "required": ["errors"]}


class HashEncoder:
    """Stand-in: sums of random unit vectors of a text's words, the same in every process."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                seed = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                out[i] += np.random.default_rng(seed).standard_normal(self.dim)
        return out


class PhraseReviewer:
    """Stand-in: a chatty reply that lists the given phrases found in the text of a prompt."""

    def __init__(self, phrases: Sequence[str]) -> None:
        self.phrases = list(phrases)

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.rsplit(SECTION, 1)[-1].lower()
            errors = [{"stelle": x, "begruendung": "verbotene Wendung"} for x in self.phrases if x.lower() in text]
            out.append("Gern, hier das Ergebnis:\n```json\n" + json.dumps({"errors": errors}, ensure_ascii=False) + "\n```\nBei Fragen gern.")
        return out
