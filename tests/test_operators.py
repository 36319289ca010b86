from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prufspark.functions.similarity import span_features, span_score
from prufspark.operators import arithmetic, chunking, detectors, findings, injection, language, lookup, matching, models, retrieval, review
from prufspark.plans.queries import queries

FINDING = "finding_id string, subclass_id string, change_type_id string, severity_id string, span_text string, correction string, rationale string, source string, source_refs array<string>, agent_scope string, detection_finding_id string"
RESOLVED = "case_id string, segment_id string, finding_id string, subclass string, change_type string, severity string, main_class string, correction string, span_text string"


def rows(spark, data):
    return spark.createDataFrame([("c", s, i, "A", "x", "1", "M", None, t) for s, i, t in data], RESOLVED)


def test_greedy_is_one_to_one_and_best_first(spark, monkeypatch):
    rng = random.Random(5)
    words = "Bremsspur Leitplanke Endlage Kollision Fahrbahn Zeuge".split()
    make = lambda p, n: [(f"s{rng.randrange(3)}", f"{p}{i}", " ".join(rng.choices(words, k=3))) for i in range(n)]
    g, p = rows(spark, make("g", 12)), rows(spark, make("p", 12))
    c = matching.candidates(g, p).cache()
    got = {(r["gold_finding_id"], r["pred_finding_id"]) for r in matching.greedy_match(c).collect()}
    want, used = set(), set()
    for r in sorted(c.collect(), key=lambda r: (-r["span_score"], -r["score"], r["gold_finding_id"], r["pred_finding_id"])):
        if not {r["gold_finding_id"], r["pred_finding_id"]} & used:
            want.add((r["gold_finding_id"], r["pred_finding_id"]))
            used |= {r["gold_finding_id"], r["pred_finding_id"]}
    assert got == want and got
    # Rounds of mutually best pairs give the same as the pass in order.
    monkeypatch.setattr(matching, "STREAM", 0)
    assert {(r["gold_finding_id"], r["pred_finding_id"]) for r in matching.greedy_match(c).collect()} == want
    strict = matching.strict_candidates(c)
    rounds = matching.greedy_match(strict, best=matching.SCORE_FIRST).collect()
    monkeypatch.setattr(matching, "STREAM", 10**6)
    assert sorted(rounds) == sorted(matching.greedy_match(strict, best=matching.SCORE_FIRST).collect())


def test_metrics_of_empty_tables(spark):
    e = rows(spark, [])
    m = matching.greedy_match(matching.candidates(e, e))
    assert matching.class_metrics(e, e, m).collect() == []
    s = matching.summary(e, e, m).first()
    assert (s["tp"], s["f1"], s["correction_accuracy"]) == (0, 0.0, 0.0)


def test_flatten_and_resolve(spark):
    f = lambda i, sub: (i, sub, "Text", None, "span", None, None, "manual", [], None, None)
    seg = spark.createDataFrame(
        [("c", "s1", [f("1", "A_B"), f("2", "label x")]), ("c", "s1", [f("1", "A_B")]), ("c", "s2", None), ("c", "s3", [])], f"case_id string, segment_id string, gold_findings array<struct<{FINDING.replace(' string', ': string').replace(' array', ': array')}>>"
    )
    tax = spark.createDataFrame(
        [([("A", "Alpha", [("A_B", "Label X")])], [("AEND_TEXT", "Text")], [("S1", "Stufe 1")])],
        "main_classes array<struct<id: string, label: string, subclasses: array<struct<id: string, label: string>>>>, change_types array<struct<id: string, label: string>>, severity_levels array<struct<id: string, label: string>>",
    )
    got = {r["finding_id"]: (r["subclass"], r["main_class"], r["change_type"], r["severity"]) for r in findings.resolve(findings.flatten(seg, "gold_findings"), tax).collect()}
    assert got == {"1": ("A_B", "A", "AEND_TEXT", None), "2": ("A_B", "A", "AEND_TEXT", None)}


def test_leader_dedup_equals_the_one_by_one_rule(spark):
    rng = random.Random(2)
    words = [f"wort{i}" for i in range(12)]
    data = [(f"f{i:03d}", rng.choice(["A", "B", None]), " ".join(rng.sample(words, rng.randint(4, 9))) if rng.random() > 0.1 else "") for i in range(120)]
    data += [(f"g{i}", "A", "immer der gleiche text hier") for i in range(40)]
    df = spark.createDataFrame(data, "finding_id string, subclass_id string, span_text string")
    got = {r["finding_id"] for r in findings.dedup_leaders(df, 0.6, scope=(), order=("finding_id",)).collect()}
    kept: dict = {}
    want = set()
    for i, sub, span in sorted(data):
        t = set(span.lower().split())
        if not t or not sub:
            want.add(i)
            continue
        if all(len(t & k) / len(t | k) < 0.6 - 1e-12 for k in kept.setdefault(sub, [])):
            kept[sub].append(t)
            want.add(i)
    assert got == want


def test_similar_pairs_lose_none(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(15)]
    data = [(f"k{i:02d}", "b", sorted(set(rng.choices(words, k=rng.randint(0, 8))))) for i in range(60)]
    df = spark.createDataFrame(data, "key string, block string, toks array<string>")
    got = {(r["a"], r["b"]) for r in findings.similar_token_pairs(df, "key", "block", 0.5).collect()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(data, 2) if x[2] and y[2] and len(set(x[2]) & set(y[2])) >= 0.5 * len(set(x[2]) | set(y[2])) - 1e-12}
    assert got == want


def test_topk_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(50, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id bigint, vec array<double>").repartition(5)
    q = df.where("id < 10").select(F.col("id").alias("query_id"), "vec")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.topk_cosine(q, df, 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(10):
        s = np.round(u[i] @ u.T, 6)
        want = sorted(range(50), key=lambda j: (-s[j], j))[:4]
        assert [got[(i, r)] for r in range(1, 5)] == want
    assert retrieval.topk_cosine(q.limit(0), df, 4).count() == 0


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    hits = [("q", f"d{i}", float(rng.random()), f"s{i % 3}", rng.normal(size=4).tolist()) for i in range(12)] + [("q", "n", 0.5, "s0", None)]
    df = spark.createDataFrame(hits, "query_id string, id string, score double, source string, vec array<double>")
    got = [r["id"] for r in retrieval.mmr(df, 8).orderBy("rank").collect()]
    pool = sorted(hits, key=lambda h: (-h[2], h[1]))
    vec = {h[1]: np.array(h[4]) / np.linalg.norm(h[4]) if h[4] else np.zeros(4) for h in pool}
    out = []
    while len(out) < 8:
        rest = [h for h in pool if h not in out]
        free = [h for h in rest if sum(o[3] == h[3] for o in out) < 2] or rest
        out.append(max(free, key=lambda h: (round(0.75 * h[2] - 0.25 * max([float(vec[h[1]] @ vec[o[1]]) for o in out], default=0.0), 12), -pool.index(h))))
    assert got == [h[1] for h in out]


def test_context_budget_cuts_and_stops(spark):
    df = spark.createDataFrame([("q", 1, "[1]", "a" * 20), ("q", 2, "[2]", " "), ("q", 3, "[3]", "b" * 50), ("q", 4, "[4]", "c")], "query_id string, rank int, header string, body string")
    got = {r["rank"]: (r["n_chars"], r["was_cut"]) for r in retrieval.context_budget(df, 50).collect()}
    assert got[1] == (24, False) and got[3][1] and set(got) == {1, 3}


def test_detectors(spark):
    t = spark.createDataFrame(
        [("1", "Differenz von 11 Sekunden (25.320 Sekunden – 15.320 Sekunden)"), ("2", "Differenz von 10 s (25,320 s - 15,320 s)"), ("3", "10 mm und 5 m lang."), ("4", "10 mm entspricht 1 cm."), ("5", "Am 31.02.2030 und am 2. Mai 2030 und 2.5.2026"), ("6", "Auszug Stpo, ivm Art. 3"), ("7", None)],
        "id string, text string",
    )
    assert [r["id"] for r in detectors.time_differences(t).collect()] == ["1"]
    assert [(r["id"], r["units"]) for r in detectors.unit_conflicts(t).collect()] == [("3", "m,mm")]
    days = {r["mention"]: str(r["day"]) for r in detectors.date_mentions(t).collect()}
    assert days == {"31.02.2030": "None", "2. Mai 2030": "2030-05-02", "2.5.2026": "2026-05-02"}
    assert {r["right"] for r in detectors.abbreviation_variants(t).collect()} == {"StPO", "i.V.m."}
    names = spark.createDataFrame([("c", "Muster")], "case_id string, name string")
    words = spark.createDataFrame([("c", w) for w in ("Mustar", "Muster", "Haus", "Mistet")], "case_id string, word string")
    assert {r["word"] for r in detectors.name_slips(words, names).collect()} == {"Mustar", "Mistet"}


@pytest.mark.parametrize("text", ["", None, "kurz", "Satz eins ist hier. " * 400, "ohnepunkt" * 900, "a\n\n" * 50])
def test_segments_and_chunks_keep_all_text(text):
    s = chunking.pack_segments(text)
    flat = lambda x: "".join((x or "").split())
    assert flat("".join(s)) == flat(text)
    assert all(len(x) <= 2200 for x in s)
    c = chunking.chunk_text(text, size=40, overlap=8, least=10)
    assert flat(text) == "" or all(w in flat("".join(c)) for w in {flat(x) for x in (text or "").split()[:5]})
    with pytest.raises(ValueError):
        chunking.chunk_text("x", size=5, overlap=5)


def test_sections_and_units(spark):
    t = spark.createDataFrame([("1", "Vorab ist hier text.\n# Titel\nText hier.\nBefund und mehr\n====\n- eins\n- zwei\nund weiter\n\nEin Absatz.\nNoch einer.\n\nWas war das?\n3. Ende\nLEERE ZEILE HIER"), ("2", None), ("3", "")], "id string, text string")
    got = [(r["level"], r["title"], r["body"].split("\n")[0]) for r in chunking.sections(t).orderBy("section").collect()]
    assert got == [(0, "", "Vorab ist hier text."), (1, "Titel", "Text hier."), (1, "Befund und mehr", "- eins")]
    units = [(r["kind"], r["text"]) for r in chunking.structural_units(t).orderBy("unit").collect()]
    assert units == [("paragraph", "Vorab ist hier text."), ("paragraph", "Text hier."), ("list_block", "- eins\n- zwei\nund weiter"), ("paragraph", "Ein Absatz.\nNoch einer."), ("question_block", "Was war das?")]


def test_semantic_chunks_end_where_the_topic_changes(spark):
    text = " ".join(["Der Bus fuhr auf der Strasse weiter und weiter."] * 8 + ["Quer lag ein Baum im hohen Gras daneben."] * 8)
    u = spark.createDataFrame([("a", 0, 1, "paragraph", text), ("b", 0, 1, "list_block", "- x\n- y"), ("c", 0, 1, "paragraph", "")], "id string, section int, unit int, kind string, text string")
    got = [r for r in chunking.semantic_chunks(u, models.HashEncoder(64), size=80, overlap=10, least=20, threshold=0.6).orderBy("id", "chunk").collect()]
    assert [r["id"] for r in got] == ["a", "a", "b"] and "Baum" not in got[0]["text"] and got[1]["similarity_prev"] < 0.6
    assert chunking.groups([3, 3, 3, 9, 1], 7, 1) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    runs = chunking.semantic_runs([10] * 9, np.ones(9), 35, 12, 15, 0.3)
    assert runs[0][:2] == (0, 3) and all(10 * (j - i) <= 47 for i, j, _ in runs) and runs[-1][1] == 9


def test_numbering_runs_through_segments(spark):
    df = spark.createDataFrame([("c", "s2", 0, "x"), ("c", "s1", 1, "y"), ("c", "s1", 0, "z"), ("d", "s1", 0, "w"), ("c", None, 0, "n")], "case_id string, segment_id string, pos int, finding_id string")
    got = {r["finding_id"]: r["new_id"] for r in findings.save_numbered(df, "P").collect()}
    assert got == {"n": "P-c-0001", "z": "P-c-0002", "y": "P-c-0003", "x": "P-c-0004", "w": "P-d-0001"}


def test_ordered_dedup_keeps_the_first(spark):
    rows = [("c", "s1", 0, "5", "a b", "r", ["y", "x"]), ("c", "s1", 1, "2", "A  b", "s", ["z"]), ("c", "s2", 0, "3", "q", "r", ["x", "y"]), ("c", "s2", 1, None, None, None, None), ("c", "s3", 0, "1", None, "t", None), ("d", "s1", 0, "7", "a b", "r", ["y", "x"])]
    df = spark.createDataFrame(rows, "case_id string, segment_id string, pos int, finding_id string, span_text string, rationale string, source_refs array<string>")
    # Another document's like finding takes nothing away, and the place decides, not the id.
    assert {(r["case_id"], r["finding_id"]) for r in findings.dedup_two_stage(df).collect()} == {("c", "5"), ("c", None), ("c", "1"), ("d", "7")}
    assert findings.dedup_two_stage(df.limit(0)).count() == 0


def test_block_scores_equal_the_column_score(spark):
    rng = random.Random(3)
    pool = "a b ab abc 12 der bremsweg endlage der endlage kollision zeuge über 7 𝔘x".split()
    spans = ["", "a", "a b", "ab"] + [" ".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s string").select("i", span_features(F.col("s")).alias("f"))
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("k"), span_score(F.col("a.f"), F.col("b.f")).alias("x"))
    got = matching.block_scores(spans, spans)
    assert all(got[r["i"], r["k"]] == r["x"] for r in pairs.collect())


def test_registered_matching_ignores_segments(spark, tmp_path):
    """A partner in another segment of the case counts; a case of more findings than a block loses no pair."""
    rng = random.Random(6)
    words = "Bremsspur Leitplanke Endlage Kollision Fahrbahn Zeuge Radstand Airbag".split()
    side = lambda p, n: [("c", f"{p}{rng.randrange(9)}", f"{p}{i}", " ".join(rng.choices(words, k=3))) for i in range(n)] + [("d", p, p, "Nur im anderen Abschnitt")]
    data = {"gold": side("g", 300), "predictions": side("p", 280)}
    f = FINDING.replace(" string", ": string").replace(" array", ": array")
    for t, field in (("gold", "gold_findings"), ("predictions", "predicted_findings")):
        rows_ = [(c, s, [(i, None, None, None, x, None, None, None, [], None, None)]) for c, s, i, x in data[t]]
        spark.createDataFrame(rows_, f"case_id string, segment_id string, {field} array<struct<{f}>>").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([([], [], [])], "main_classes array<struct<id: string, label: string, subclasses: array<struct<id: string, label: string>>>>, change_types array<struct<id: string, label: string>>, severity_levels array<struct<id: string, label: string>>").write.parquet(f"{tmp_path}/taxonomy.parquet")

    def pairs(x: str) -> set[str]:
        s = x.lower().replace(" ", "")
        return {s[i : i + 2] for i in range(len(s) - 1)}

    def score(a: str, b: str) -> float:
        t, u, v, w = set(a.split()), set(b.split()), pairs(a), pairs(b)
        few = 0.5 if len(t) <= 2 and len(u) <= 2 else 1.0
        return 1.0 if a == b else 0.95 if a in b or b in a else round(max(few * len(t & u) / len(t | u), 2 * len(v & w) / (len(v) + len(w))), 6)

    cands = [(g[2], p[2], s) for g in data["gold"] for p in data["predictions"] if g[0] == p[0] and (s := score(g[3], p[3])) >= 0.2]
    got = queries()["span_scores"](spark, str(tmp_path)).collect()
    assert sorted((r["gold_finding_id"], r["pred_finding_id"], r["span_score"]) for r in got) == sorted(cands)
    want, used = set(), set()
    for g, p, _ in sorted(cands, key=lambda c: (-c[2], c[0], c[1])):
        if f"g{g}" not in used and f"p{p}" not in used:
            want.add((g, p))
            used |= {f"g{g}", f"p{p}"}
    assert {(r["gold_finding_id"], r["pred_finding_id"]) for r in queries()["greedy_match"](spark, str(tmp_path)).collect()} == want
    assert ("g", "p") in want and queries()["micro_summary"](spark, str(tmp_path)).first()["tp"] == len(want)


FACT = "struct<value: string, source_span: string, confidence: string>"
PERSON_FACTS = ("sachverstaendige_person", "beschuldigte_person", "hauptsachbearbeitung")


def facts_table(spark, folder, rows_):
    """``reference_facts`` of dicts per case: single facts as (value, span, confidence), lists of them as (name, role, span, confidence)."""
    single = ("auftraggeber", "gutachten_titel", "vorfall", "ereignisdatum", "ort", *PERSON_FACTS)
    schema = ", ".join([f"{k}: {FACT}" for k in single] + ["personen: array<struct<name: string, rolle: string, source_span: string, confidence: string>>", "referenz_entitaeten: array<struct<bezeichnung: string, source_span: string, confidence: string>>"])
    data = [(case, tuple(f.get(k) for k in (*single, "personen", "referenz_entitaeten"))) for case, f in rows_]
    spark.createDataFrame(data, f"case_id string, facts struct<{schema}>").write.parquet(f"{folder}/reference_facts.parquet")


def test_every_fact_protects_its_span(spark, tmp_path):
    facts_table(
        spark,
        str(tmp_path),
        [
            ("c", {"vorfall": ("", "Unfall auf der Brücke", "high"), "gutachten_titel": ("", "Gutachten zur langen Bremsspur", " Medium "), "beschuldigte_person": ("", "Anna Müller", "low")}),
            ("c", {"personen": [("", "", "Reto Koller Wied", "high"), ("", "", "Reto", "high")], "referenz_entitaeten": [("Fahrzeug 1", "der rote Gelenkbus", "medium")]}),
            ("d", {"personen": None, "referenz_entitaeten": [], "ort": ("", "die Spur und die Tafel am Ort", "high")}),
        ],
    )
    spans = [("c", "Unfall auf der Brücke"), ("c", "lange Spur"), ("c", "langen Bremsspur"), ("c", "Anna Müller"), ("c", "Koller Wied"), ("c", "Reto"), ("c", "rote gelenkbus"), ("d", "rote Gelenkbus"), ("d", "die Spur die Tafel neu"), ("c", None)]
    f = FINDING.replace(" string", ": string").replace(" array", ": array")
    data = [(c, "s", [(str(i), None, None, None, s, None, None, None, [], None, None)]) for i, (c, s) in enumerate(spans)]
    spark.createDataFrame(data, f"case_id string, segment_id string, predicted_findings array<struct<{f}>>").write.parquet(f"{tmp_path}/predictions.parquet")
    got = [r["finding_id"] for r in queries()["protected_span_filter"](spark, str(tmp_path)).collect()]
    assert sorted(got) == ["0", "2", "4", "6", "8"]


def test_names_of_any_letters_are_compared(spark, tmp_path):
    """Against brute force: umlauts, accents, hyphens, four letters, and the facts of one person."""
    facts_table(
        spark,
        str(tmp_path),
        [
            ("c", {"personen": [("Björn Jägerlehn", "", "", "low"), ("Reto Koller-Wied", "", "", "high")], "sachverstaendige_person": ("Élodie Öttenried, Dr.", "", "high")}),
            ("d", {"beschuldigte_person": ("Süssbrunn Max", "", "medium"), "hauptsachbearbeitung": ("Grünacher", "", None)}),
        ],
    )
    texts = {"c": "Bjorn Jägerlehm traf Retto, Koller-Weid und Élodye mit Öttenrid. Björn Reto Koller-Wied Jägerlehn", "d": "Süsbrunn Süssbrunn Grünachr Müll"}
    spark.createDataFrame([(c, (c,), t) for c, t in texts.items()], "id string, metadata struct<case_id: string>, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    names = {"c": {"Björn", "Jägerlehn", "Reto", "Koller-Wied", "Élodie", "Öttenried"}, "d": {"Süssbrunn"}}

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for k, y in enumerate(b, 1):
                row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (x != y)))
        return row[-1]

    want = set()
    for c, t in texts.items():
        words = {w for rx in (r"[A-Za-zÄÖÜäöüß]{4,}", r"[^\W\d_]{4,}", r"[^\W\d_]+(?:-[^\W\d_]+)+") for w in re.findall(rx, t)}
        want |= {(c, w, n) for w in words - names[c] for n in names[c] if abs(len(w) - len(n)) <= 2 and 1 <= edits(w.lower(), n.lower()) <= 3}
    got = {tuple(r) for r in queries()["name_consistency"](spark, str(tmp_path)).select("case_id", "word", "name").collect()}
    assert got == want
    assert {("c", "Bjorn", "Björn"), ("c", "Jägerlehm", "Jägerlehn"), ("c", "Retto", "Reto"), ("c", "Koller-Weid", "Koller-Wied"), ("c", "Élodye", "Élodie"), ("d", "Süsbrunn", "Süssbrunn")} <= got


def test_similar_spans_pair_across_cases(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    spans = [(rng.choice(["c", "d", None]), f"f{i:02d}", " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(70)]
    f = FINDING.replace(" string", ": string").replace(" array", ": array")
    data = [(c, "s", [(i, None, None, None, s, None, None, None, [], None, None)]) for c, i, s in spans]
    spark.createDataFrame(data, f"case_id string, segment_id string, gold_findings array<struct<{f}>>").write.parquet(f"{tmp_path}/gold.parquet")
    sets = [(i, set(s.split())) for _, i, s in spans if s]
    want = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) >= 0.6 * len(x | y) - 1e-12]
    assert sorted(tuple(r) for r in queries()["token_jaccard_pairs"](spark, str(tmp_path)).select("id_a", "id_b").collect()) == want
    assert any(x == y for (_, x), (_, y) in itertools.combinations(sets, 2))


@pytest.mark.parametrize(
    "text, want",
    [("(81/1.7)*3.6", "171.5294"), ("25,320 − 15,320", "10"), ("2*-3", "-6"), ("-(1+2)*3", "-9"), ("1/0", None), ("2**3", None), ("import os", None), ("", None), (None, None), ("(1", None), ("1 2", None), ("7 – 2 × 3", "1"), ("()", None), (")1(", None)],
)
def test_evaluate(text, want):
    got = arithmetic.evaluate(text)
    assert (got is None) if want is None else abs(got - type(got)(want)) < type(got)("0.0001")


def test_calculations_in_texts(spark):
    t = spark.createDataFrame([("1", "Es gilt (81/1,7)*3,6 = 171.4 und 3 + 4 = 7, sowie 10 Sekunden (25.3 s – 15.3 s)."), ("2", "5 * 1000 = 1"), ("3", None)], "id string, text string")
    got = {(r["id"], r["n"]): (r["right"], r["status"]) for r in arithmetic.verify(arithmetic.equations(t)).collect()}
    assert got == {("1", 0): ("171.5", "wrong"), ("1", 1): ("7", "ok"), ("1", 2): ("10", "ok"), ("2", 0): ("5000", "implausible")}
    assert {r["wrong"] for r in arithmetic.injectable(arithmetic.equations(t)).collect()} == {"8", "11"}


def test_segment_lookup_against_a_plain_loop(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    segs = [("c" if i % 3 else "d", i, " ".join(rng.choices(words, k=12))) for i in range(40)]
    spans = [(rng.choice("cd"), " ".join(rng.choices(words, k=rng.randint(1, 6)))) for _ in range(60)] + [("c", segs[4][2][3:20].upper()), ("c", " "), ("d", "niemals hier")]
    got = {(r["case_id"], r["span"]): (r["segment_index"], r["how"]) for r in lookup.find_segments(spark.createDataFrame(spans, "case_id string, span string"), spark.createDataFrame(segs, "case_id string, segment_index int, text string")).collect()}
    want = {}
    for c, s in spans:
        k = " ".join(s.lower().split())
        mine = sorted((i, t) for cc, i, t in segs if cc == c)
        if k and any(k in t for _, t in mine):
            want[(c, s)] = (next(i for i, t in mine if k in t), "exact")
        elif k:
            share = [(len(set(k.split()) & set(t.split())) / len(set(k.split())), -i) for i, t in mine]
            if max(share)[0] >= 0.5:
                want[(c, s)] = (-max(share)[1], "tokens")
    assert got == want and {h for _, h in got.values()} == {"exact", "tokens"}


@pytest.mark.parametrize(
    "reply, n",
    [('```json\n[{"a": 1}]\n```', 1), ('Text {"errors": [{"a": 1}, {"b": 2}]} mehr', 2), ('{"Fehler_1": "x", "Fehler_2": "y"}', 2), ('{"etwas": [{"a": 1}], "n": 2}', 1), ('{"errors": []}', 0), ("nichts", None), (None, None), ('{"a": 1}', None), ("{kaputt [ {", None)],
)
def test_replies(reply, n):
    got = review.errors_of(reply)
    assert (got is None) if n is None else len(got) == n


def test_budgets_follow_the_targets(spark):
    rows = [("c", f"s{i:02d}", ["A", "B"]) for i in range(10)] + [("d", "s0", ["Z"]), ("d", "s1", None)]
    got = {(r["case_id"], r["segment_id"]): r["class"] for r in review.select_classes(spark.createDataFrame(rows, "case_id string, segment_id string, available array<string>"), {"A": 0.7, "B": 0.3}, ["A", "B"]).collect()}
    mine = [got[("c", f"s{i:02d}")] for i in range(10)]
    assert mine.count("A") == 7 and mine[0] == "A" and got[("d", "s0")] is None and got[("d", "s1")] is None


def test_best_counterparts_have_no_threshold_and_consensus_reuses_partners(spark):
    g = rows(spark, [("s", "g1", "ganz anderer text hier"), ("s", "g2", "leitplanke")])
    p = rows(spark, [("s", "p1", "leitplanken"), ("s", "p2", "xyz")])
    best = {(r["finding_id"], r["rank"]): r["other_finding_id"] for r in matching.best_counterparts(p, g).collect()}
    assert best[("p1", 1)] == "g2" and len(best) == 4
    data = [("c", m, f"{m}{i}", t) for m, ts in {"x": ["a b c", "a b c", "", "q"], "y": ["a b c d"], "z": ["a b c", "r s"]}.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "case_id string, model string, finding_id string, span_text string")
    assert {r["finding_id"] for r in matching.consensus(df, ["x", "y", "z"], 0.7).collect()} == {"x0", "x1"}


def test_models_fail_by_batch_and_schemas_hold_the_labels(spark):
    def broken(prompts):
        if any("x" in p for p in prompts):
            raise RuntimeError("aus")
        return ["ja"] * len(prompts)

    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "a")], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["reply"], r["reply_error"]) for r in models.ask(df, "prompt", broken, batch=1).collect()}
    assert got == {1: ("ja", None), 2: (None, "RuntimeError: aus"), 3: (None, None), 4: ("ja", None)}
    tax = {"main_classes": [{"label": "A", "subclasses": [{"label": "b"}]}], "change_types": [{"label": "t"}], "severity_levels": [{"label": "s"}]}
    assert models.error_schema(tax)["properties"]["errors"]["items"]["properties"]["subklasse"]["enum"] == ["b"]
    v = {r["id"]: r["vec"] for r in models.embed(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, t string"), "t", models.HashEncoder(8)).collect()}
    assert v[2] is None and v[3] is None and abs(sum(x * x for x in v[1]) - 1) < 1e-5


def test_injection_changes_what_was_proposed(spark):
    t = spark.createDataFrame([(1, "Es sind 9 - 4 = 5 Stück."), (2, "nichts"), (3, None)], "id int, text string")
    c = injection.calculation_proposals(arithmetic.injectable(arithmetic.equations(t)))
    more = c.unionByName(spark.createDataFrame([(1, 5, "A", "fehlt", "x"), (2, 0, "A", "fehlt", "x"), (2, 1, "A", "nichts", "nichts")], "id int, n int, subtype string, original_span string, injected_span string"))
    got = injection.inject(t, injection.one_per_text(more, ["DIFFERENZ", "A"]))
    assert [(r["id"], r["text"]) for r in got.collect()] == [(1, "Es sind 9 - 4 = 6 Stück.")]
    gold = injection.gold_findings(got, "ZAHL_RECHNUNG").first()
    assert (gold["span_text"], gold["correction"], gold["source"]) == ("= 6", "= 5", "injected")
