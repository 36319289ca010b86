"""Replacing texts inside docx files: as a function on a file's bytes and over a table of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _set(node: ElementTree.Element, text: str) -> None:
    node.text = text
    node.set(SPACE, "preserve")


def replace_in_paragraph(p: ElementTree.Element, old: str, new: str) -> int:
    """Replaces every ``old`` of a paragraph, also one that goes over several runs: the run it starts in takes the new
    text, the others lose their part. Returns how many there were."""
    nodes = [t for t in p.iter(f"{W}t")]
    texts = [t.text or "" for t in nodes]
    whole = "".join(texts)
    if not old or old not in whole:
        return 0
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t))
    parts = ["" for _ in nodes]
    n = at = 0
    while True:
        hit = whole.find(old, at)
        stop = hit if hit >= 0 else len(whole)
        for k in range(len(nodes)):
            parts[k] += whole[max(at, starts[k]) : min(stop, starts[k + 1])] if starts[k] < stop and starts[k + 1] > at else ""
        if hit < 0:
            break
        owner = next(k for k in range(len(nodes)) if starts[k] <= hit < starts[k + 1])
        parts[owner] += new
        n += 1
        at = hit + len(old)
    for node, text in zip(nodes, parts):
        _set(node, text)
    return n


def replace_in_docx(content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, list[int]]:
    """The file with each pair replaced in order, in paragraphs of the body and of tables, and how often each was found."""
    src = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(src.read("word/document.xml"))
    counts = [0] * len(pairs)
    for p in root.iter(f"{W}p"):
        for i, (old, new) in enumerate(pairs):
            counts[i] += replace_in_paragraph(p, old, new)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.infolist():
            z.writestr(item, ElementTree.tostring(root, encoding="utf-8", xml_declaration=True) if item.filename == "word/document.xml" else src.read(item.filename))
    return out.getvalue(), counts


def rewrite_documents(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """``(rel_path, content, n_replaced, missing, error)`` of ``files(rel_path, content)`` that have ``replacements(rel_path,
    pos, old, new)``, made in order of ``pos``; ``missing`` lists texts that were not found."""
    per = replacements.where("old is not null").groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("pos", "old", F.coalesce("new", F.lit("")).alias("new")))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, missing, errors = [], [], [], []
            for content, pairs in zip(b.column("content").to_pylist(), b.column("pairs").to_pylist()):
                try:
                    new, counts = replace_in_docx(content, [(x["old"], x["new"]) for x in pairs])
                    out.append(new)
                    n.append(sum(counts))
                    missing.append([x["old"] for x, c in zip(pairs, counts) if not c])
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    n.append(0)
                    missing.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column("rel_path"), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(missing, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["rel_path", "content", "n_replaced", "missing", "error"])

    return files.select("rel_path", "content").join(per, "rel_path").mapInArrow(run, "rel_path string, content binary, n_replaced bigint, missing array<string>, error string")
