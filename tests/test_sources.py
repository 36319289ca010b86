from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prufspark.operators.models import HashEncoder
from prufspark.plans.ingest import ingest
from prufspark.sources import readers
from prufspark.sources.docx import rewrite_documents
from prufspark.streaming.append import append_stream, append_vectors, new_rows, windowed_counts

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_and_text_files(spark, tmp_path):
    d = tmp_path / "case_1" / "bericht"
    d.mkdir(parents=True)
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    (d / "x.docx").write_bytes(docx(p("Titel", "Heading2") + p("Punkt", "ListBullet") + table + p("Ende")))
    (d / "y.txt").write_bytes("Größe".encode("latin-1"))
    (d / "z.docx").write_bytes(b"broken")
    (d / "skip.bin").write_bytes(b"1")
    (d / "s.pdf").write_bytes(b"%PDF")
    out = readers.read_documents(readers.files(spark, str(tmp_path), "case_material"))
    got = {r["rel_path"].rsplit("/", 1)[-1]: r for r in out.select("*", readers.case_id(F.col("rel_path")).alias("c"), readers.document_type(F.col("rel_path")).alias("t")).collect()}
    assert got["x.docx"]["text"] == "## Titel\n- Punkt\na | b\nEnde"
    assert got["y.txt"]["text"] == "Größe" and got["z.docx"]["text"] is None and got["z.docx"]["error"]
    assert (got["x.docx"]["c"], got["x.docx"]["t"]) == ("case_1", "bericht") and len(got) == 4
    assert got["s.pdf"]["text"] is None and "no reader" in got["s.pdf"]["error"]
    read = {r["rel_path"].rsplit("/", 1)[-1]: r["text"] for r in readers.read_documents(readers.files(spark, str(tmp_path), "case_material"), {"pdf": lambda c: "Seite"}).collect()}
    assert read["s.pdf"] == "Seite"


@pytest.mark.parametrize(
    "text, n", [('{"a": 1}\n\n{"a": 2}', 2), ('[{"a": 1}, {"a": 2},]', 2), ('{"x": {"a": 1}, "x": {"a": 2}}', 2), ('{"a": 1,}', 1), ("", 0)]
)
def test_parse_any(text, n):
    assert [r["a"] for r in readers.parse_any(text)] == list(range(1, n + 1))


def test_read_json_any_and_npz(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2},]')
    assert readers.read_json_any(spark, str(tmp_path / "a.json"), T.StructType([T.StructField("a", T.LongType())])).count() == 2
    np.savez(tmp_path / "v.npz", ids=np.array(["x", "y"]), embeddings=np.eye(2, dtype=np.float32))
    assert {r["id"]: list(r["vec"]) for r in readers.read_npz(spark, str(tmp_path / "v.npz")).collect()} == {"x": [1.0, 0.0], "y": [0.0, 1.0]}


def test_append_batch_and_stream(spark, tmp_path):
    row = "id string, ingested_at timestamp, v int"
    df = lambda xs: spark.createDataFrame(xs, "id string, t string, v int").select("id", F.to_timestamp("t").alias("ingested_at"), "v")
    a = df([("1", "2024-01-02", 1), ("1", "2024-01-01", 2), ("2", "2024-01-01", 3), (None, "2024-01-01", 4)])
    assert {(r["id"], r["v"]) for r in new_rows(a, df([("2", "2024-01-01", 0)]), "id", "ingested_at").collect()} == {("1", 2)}
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in ([("1", "2024-01-01", 1)], [("1", "2024-01-03", 9), ("2", "2024-01-02", 2)]):
        df(batch).write.mode("append").parquet(src)
        append_stream(spark.readStream.schema(row).parquet(src), store, str(tmp_path / "ck")).awaitTermination()
    assert {(r["id"], r["v"]) for r in spark.read.parquet(store).collect()} == {("1", 1), ("2", 2)}


def test_windowed_counts(spark):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 01:10:00', 'a', 2.0D")
    assert sorted(r["n"] for r in windowed_counts(e).collect()) == [1, 1]


def test_files_to_chunks(spark, tmp_path):
    a, b = tmp_path / "cases" / "case_2" / "gutachten", tmp_path / "regeln"
    a.mkdir(parents=True)
    b.mkdir()
    (a / "x.md").write_text("# Befund\nDer Bus fuhr. Er hielt an.\n- eins\n- zwei\n\n# Leer\n")
    (b / "norm.txt").write_text("Kapitel 1\nEs gilt die Regel.")
    (b / "leer.txt").write_text(" ")
    found = readers.source_files(spark, {"case_material": str(tmp_path / "cases"), "normbasis": str(b)})
    got = ingest(readers.read_documents(found), HashEncoder(16)).orderBy("rel_path", "chunk_index").collect()
    assert [(r["case_id"], r["document_type"], r["section_title"], r["content_type"], r["chunk_index"]) for r in got] == [
        ("case_2", "gutachten", "Befund", "paragraph", 0), ("case_2", "gutachten", "Befund", "list_block", 1), (None, None, "Kapitel 1", "paragraph", 0)
    ]
    assert len({r["id"] for r in got}) == 3 and all(len(r["id"]) == 64 for r in got)


def test_replacing_in_docx(spark):
    runs = "<w:p><w:r><w:t>Der Bus </w:t></w:r><w:r><w:t>fuhr sch</w:t></w:r><w:r><w:t>nell. Der Bus fuhr.</w:t></w:r></w:p>"
    file = docx(runs + f"<w:tbl><w:tr><w:tc>{p('Bus fuhr schnell')}</w:tc></w:tr></w:tbl>")
    f = spark.createDataFrame([("a.docx", bytearray(file)), ("b.docx", bytearray(b"x")), ("c.docx", bytearray(file))], "rel_path string, content binary")
    r = spark.createDataFrame([("a.docx", 0, "fuhr schnell", "hielt an"), ("a.docx", 1, "nie da", "x"), ("b.docx", 0, "a", "b"), ("a.docx", 2, None, "x")], "rel_path string, pos int, old string, new string")
    got = {x["rel_path"]: x for x in rewrite_documents(f, r).collect()}
    assert got["a.docx"]["n_replaced"] == 2 and got["a.docx"]["missing"] == ["nie da"] and got["b.docx"]["error"] and "c.docx" not in got
    assert readers.docx_text(bytes(got["a.docx"]["content"])) == "Der Bus hielt an. Der Bus fuhr.\nBus hielt an"


def test_query_files_models_and_reports(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"queries": [{"id": "a", "text": "wo?", "expected_source": "x.pdf"}, "was?", {"text": " "}]}')
    got = {r["id"]: (r["text"], list(r["expected_source"])) for r in readers.read_queries(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"a": ("wo?", ["x.pdf"]), "q2": ("was?", [])}
    for m, lines in (("aggregated_m1", '{"a": 1}\nkaputt\n'), ("m2", '{"a": 2}\n')):
        (tmp_path / "fps" / m).mkdir(parents=True)
        (tmp_path / "fps" / m / "fp.jsonl").write_text(lines)
    rows = readers.read_by_model(spark, str(tmp_path / "fps"), "fp.jsonl", "a int")
    assert {(r["model"], r["a"]) for r in rows.where("a is not null").collect()} == {("m1", 1), ("m2", 2)}
    t = readers.text_report(spark.createDataFrame([("b", 0.5), ("a", None)], "k string, v double"), "Titel", ["k"]).orderBy("line_no")
    assert [r["line"] for r in t.collect()] == ["Titel", "k | v", "a | -", "b | 0.5000"]
    pages = spark.createDataFrame([("f", 0, "x", 0, "a" * 60), ("f", 0, "y", 1, "kurz aber lesbar"), ("f", 1, "x", 0, None), ("f", 1, "y", 1, "")], "id string, page_index int, reader string, priority int, text string")
    assert {(r["page_index"], r["reader"]) for r in readers.page_votes(pages).collect()} == {(0, "y"), (1, "x")}
    (tmp_path / "p.json").write_text('[{"proposal_id": "1", "status": " "}, {"proposal_id": "2", "status": "Accepted"}]')
    assert {r["status"] for r in readers.read_proposals(spark, str(tmp_path / "p.json"), "proposal_id string, status string").collect()} == {"pending", "accepted"}


def test_vectors_are_appended_once_and_of_one_dimension(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vec array<double>")
    delta = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.5, 0.5]), ("b", [0.4, 0.6]), (None, [1.0, 1.0])], "id string, vec array<double>")
    assert [(r["id"], list(r["vec"])) for r in append_vectors(delta, store).collect()] == [("b", [0.4, 0.6])]
    with pytest.raises(Exception, match="dimension"):
        append_vectors(spark.createDataFrame([("c", [1.0])], "id string, vec array<double>"), store).collect()
