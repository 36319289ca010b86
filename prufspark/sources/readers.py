"""Readers and writers beyond Parquet. Formats that need outer programs are read by callables that the caller gives."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("txt", "md", "docx", "pdf", "pptx")
Reader = Callable[[bytes], str]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object per line; strict fails on a bad line, else it is dropped. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, one array, or one object whose repeated keys hold one record each; trailing commas are forgiven."""
    files = spark.read.text(path, wholetext=True).select("value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [json.dumps(r, ensure_ascii=False) for t in b["value"] for r in parse_any(t)]
            yield pd.DataFrame({"value": rows})

    return files.mapInPandas(parse, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def parse_any(text: str) -> list[dict]:
    """The records of a text in any of the three forms."""
    text = re.sub(r",(\s*[}\]])", r"\1", text.strip())
    if not text:
        return []
    try:
        pairs = json.loads(text, object_pairs_hook=_Pairs)
    except json.JSONDecodeError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(pairs, list):
        return [_plain(x) for x in pairs]
    keys = [k for k, _ in pairs.items_]
    if len(keys) != len(set(keys)) and all(isinstance(v, _Pairs) for _, v in pairs.items_):
        return [_plain(v) for _, v in pairs.items_]
    return [_plain(pairs)]


class _Pairs:
    def __init__(self, items: list[tuple]) -> None:
        self.items_ = items


def _plain(x):
    if isinstance(x, _Pairs):
        return {k: _plain(v) for k, v in x.items_}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def files(spark: SparkSession, root: str, source_kind: str) -> DataFrame:
    """``(path, rel_path, ext, content, source_kind, size_bytes, modified_at)`` of the files of known extensions below
    ``root``; conversion folders are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    clean = raw.withColumn("ext", ext).where(F.col("ext").isin(*EXTENSIONS) & ~F.contains(F.col("path"), F.lit("/.converted/")))
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return clean.select("path", rel.alias("rel_path"), "ext", "content", F.lit(source_kind).alias("source_kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def source_files(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """The files of several roots, ``{source kind: folder}``, with their case and document type where they are case material."""
    out = None
    for kind, root in roots.items():
        one = files(spark, root, kind)
        out = one if out is None else out.unionByName(one)
    material = F.col("source_kind") == "case_material"
    return out.withColumns({"case_id": F.when(material, case_id(F.col("rel_path"))), "document_type": F.when(material, document_type_or_stem(F.col("rel_path"))), "file_sha256": F.sha2("content", 256)})


def case_id(rel_path: Column) -> Column:
    """The first part of the path when it names a case, else null."""
    return F.nullif(F.regexp_extract(F.lower(rel_path), r"^(?:cases/)?(case[_-]?\d+)(?:/|$)", 1), F.lit(""))


def document_type(rel_path: Column) -> Column:
    """The second part of the path, in a safe form; ``unknown`` where there is none."""
    part = F.lower(F.regexp_extract(rel_path, r"^(?:cases/)?[^/]+/([^/]+)/", 1))
    safe = F.trim(F.regexp_replace(F.regexp_replace(part, r"[^a-z0-9äöüß_-]", "_"), r"_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def document_type_or_stem(rel_path: Column) -> Column:
    """The second part of the path where it is a folder, else the name of the file, in a safe form."""
    kind, stem = document_type(rel_path), F.lower(F.regexp_extract(rel_path, r"([^/]+?)(?:\.[^./]*)?$", 1))
    safe = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9äöüß_-]", "_"), r"_+", "_"), F.lit("_"))
    return F.when(kind != "unknown", kind).otherwise(F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown")))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_text(content: bytes) -> str:
    """Body text of a docx in order: headings with marks, list items with dashes, table rows with bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    return "\n".join(x for x in _blocks(body) if x.strip())


def _blocks(node: ElementTree.Element) -> Iterator[str]:
    for child in node:
        if child.tag == f"{W}p":
            text = " ".join("".join(t.text or "" if t.tag == f"{W}t" else " " for t in child.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br")).split())
            style = child.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            level = re.search(r"(?:heading|berschrift|titre)\s*(\d)", name, re.I)
            yield ("#" * int(level.group(1)) + " " if level and text else "- " if re.search(r"list", name, re.I) and text else "") + text
        elif child.tag == f"{W}tbl":
            seen = set()
            for row in child.iter(f"{W}tr"):
                cells = [" // ".join(x for x in _blocks(c) if x.strip()) for c in row.findall(f"{W}tc")]
                line = " | ".join(dict.fromkeys(c for c in cells if c))
                if line and line not in seen:
                    seen.add(line)
                    yield line


def plain_text(content: bytes) -> str:
    """UTF-8, or Latin-1 where that is not valid."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


READERS: dict[str, Reader] = {"txt": plain_text, "md": plain_text, "docx": docx_text}


def read_documents(found: DataFrame, readers: Mapping[str, Reader] | None = None) -> DataFrame:
    """``files`` with their ``text`` in place of ``content``; a file that cannot be read gives a null text and the
    ``error``, as does one without a reader. ``readers`` adds readers by extension, such as one that runs an outer program."""
    by_ext = READERS | dict(readers or {})
    kept = [f for f in found.schema if f.name != "content"]
    names = [f.name for f in kept]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for ext, content in zip(b.column("ext").to_pylist(), b.column("content").to_pylist()):
                try:
                    if ext not in by_ext:
                        raise LookupError(f"no reader for .{ext}")
                    texts.append(by_ext[ext](content))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*names, "text", "error"])

    return found.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, error string")


def page_votes(pages: DataFrame) -> DataFrame:
    """``(id, page_index, text, reader)`` of several readers' texts ``pages(id, page_index, reader, priority, text)``: per page
    the one of best score, which is its characters less 168 for every run of 28 characters or more without white space;
    then more characters, fewer such runs, and the order of readers decide."""
    text = F.coalesce("text", F.lit(""))
    runs = F.size(F.regexp_extract_all(text, F.lit(r"\S{28,}"), F.lit(0)))
    scored = pages.withColumns({"chars": F.length(text), "runs": runs})
    best = F.max_by(F.struct("text", "reader"), F.struct(F.col("chars") - F.col("runs") * 168, F.col("chars"), -F.col("runs"), -F.col("priority")))
    return scored.groupBy("id", "page_index").agg(best.alias("b")).select("id", "page_index", "b.text", "b.reader")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text, expected_source, expected_id)`` of a file with an object that holds ``queries``, a list of objects, or a
    list of texts; queries without a text are left out, missing ids are ``q1``, ``q2`` and so on."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["value"]:
                got = json.loads(t)
                listed = got.get("queries", []) if isinstance(got, dict) else got
                for i, q in enumerate(listed, 1):
                    q = {"text": q} if isinstance(q, str) else q
                    text = str(q.get("text") or q.get("query") or "").strip()
                    src = q.get("expected_source") or []
                    if text:
                        rows.append({"id": str(q.get("id") or f"q{i}"), "text": text, "expected_source": [src] if isinstance(src, str) else list(src), "expected_id": q.get("expected_id")})
            yield pd.DataFrame(rows, columns=["id", "text", "expected_source", "expected_id"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "id string, text string, expected_source array<string>, expected_id string")


def read_by_model(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines called ``name`` in the folders of ``root``, with the ``model`` that a folder is named after (without
    ``aggregated_``). Broken lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/*/{name}").withColumn("_path", F.input_file_name())
    return rows.withColumn("model", F.regexp_replace(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1), "^aggregated_", "")).drop("_path")


def read_proposals(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Proposals of JSON in any form; a blank status is ``pending``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return read_json_any(spark, path, schema).withColumn("status", F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("pending")))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec)`` of an archive with ``ids`` and ``embeddings``; their lengths must agree."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, vec = z["ids"], z["embeddings"]
                if vec.ndim != 2 or len(ids) != len(vec):
                    raise ValueError("ids and embeddings do not agree")
                yield pd.DataFrame({"id": ids.astype(str), "vec": list(vec.astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "id string, vec array<float>")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, sort: list[str], mode: str = "errorifexists") -> None:
    """Sorted, with a header, numbers to four decimals."""
    cols = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).orderBy(*sort).write.mode(mode).option("header", True).csv(path)


def text_report(df: DataFrame, title: str, sort: list[str]) -> DataFrame:
    """``(line_no, line)``: a table as text, a row a line in the given order, doubles to four decimals, under its title. For
    tables of summaries; the lines are numbered by one task."""
    from pyspark.sql import Window

    cells = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if t == "double" else F.col(c).cast("string"), F.lit("-")) for c, t in df.dtypes]
    body = df.select(F.row_number().over(Window.orderBy(*sort)).alias("n"), F.concat_ws(" | ", *cells).alias("line"))
    head = df.sparkSession.createDataFrame([(-1, title), (0, " | ".join(df.columns))], "n int, line string")
    return head.unionByName(body).select((F.col("n") + 2).alias("line_no"), "line")


def write_text_report(df: DataFrame, title: str, sort: list[str], path: str, mode: str = "errorifexists") -> None:
    text_report(df, title, sort).orderBy("line_no").select("line").coalesce(1).write.mode(mode).text(path)
