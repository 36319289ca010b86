"""The same queries in SQL for an independent engine, written from their definitions."""

from __future__ import annotations

from prufspark.functions.text import STOP_WORDS
from prufspark.operators import detectors
from prufspark.plans.samples import sample_sql


def _words(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


NO_BREAK = "\u00a0\u2007\u202f"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n\\x0B\\f{NO_BREAK}]+', ' ', 'g'))"


def _simplify(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower({_squeeze(x)}), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _tokens(simple: str) -> str:
    return f"list_distinct(list_filter(string_split({simple}, ' '), lambda x: x <> ''))"


def _bigrams(simple: str) -> str:
    s = f"replace({simple}, ' ', '')"
    return f"CASE WHEN length({s}) = 0 THEN []::VARCHAR[] WHEN length({s}) = 1 THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, i, 2))) END"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?:;])\\s+([A-ZÄÖÜ0-9\"„«])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: trim(z)), lambda z: z <> '')"


CHUNKS = "c AS (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL)"
ROWS = f"t AS (SELECT id, {_squeeze('text')} AS text FROM (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL))"
SENT = f"{ROWS}, l AS (SELECT id, {_sentences('text')} AS ss FROM t), s AS (SELECT id, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM l)"


def _flat(table: str, field: str, name: str) -> str:
    return f"""{name}_raw AS (SELECT case_id, segment_id, unnest(range(len({field}))) AS pos, unnest({field}) AS f FROM {table} WHERE len({field}) > 0),
{name}_flat AS (SELECT case_id, segment_id, pos, f.finding_id AS finding_id, f.subclass_id AS subclass_id, f.change_type_id AS change_type_id, f.severity_id AS severity_id,
  f.span_text AS span_text, f.correction AS correction, f.rationale AS rationale, f.source AS source, f.source_refs AS source_refs, f.agent_scope AS agent_scope
  FROM {name}_raw QUALIFY row_number() OVER (PARTITION BY coalesce('i' || f.finding_id, concat_ws('|', 'p', case_id, segment_id, pos)) ORDER BY case_id, segment_id, pos) = 1)"""


TAX = f"""mc AS (SELECT unnest(main_classes) AS m FROM taxonomy), sub AS (SELECT m.id AS main_id, m.label AS main_label, unnest(m.subclasses) AS s FROM mc),
ct AS (SELECT unnest(change_types) AS x FROM taxonomy), sl AS (SELECT unnest(severity_levels) AS x FROM taxonomy),
keys AS (SELECT 'subclass' AS kind, s.id AS id, s.id AS word, 0 AS r FROM sub UNION ALL SELECT 'subclass', s.id, s.label, 1 FROM sub
  UNION ALL SELECT 'change', x.id, x.id, 0 FROM ct UNION ALL SELECT 'change', x.id, x.label, 1 FROM ct UNION ALL SELECT 'severity', x.id, x.id, 0 FROM sl UNION ALL SELECT 'severity', x.id, x.label, 1 FROM sl),
look AS (SELECT kind, {_simplify('word')} AS key, id FROM keys QUALIFY row_number() OVER (PARTITION BY kind, {_simplify('word')} ORDER BY r, id) = 1)"""


def _resolved(name: str) -> str:
    k = lambda col, kind: f"LEFT JOIN look {kind} ON {kind}.kind = '{kind}' AND {kind}.key = {_simplify('g.' + col)}"
    return f"""{name} AS (SELECT g.*, subclass.id AS subclass, change.id AS change_type, severity.id AS severity, sub.main_id AS main_class FROM {name}_flat g
  {k('subclass_id', 'subclass')} {k('change_type_id', 'change')} {k('severity_id', 'severity')} LEFT JOIN sub ON sub.s.id = subclass.id)"""


GOLD = f"{_flat('gold', 'gold_findings', 'g')}, {TAX}, {_resolved('g')}"
PRED = f"{_flat('predictions', 'predicted_findings', 'p')}, {_resolved('p')}"
PRED_FLAT = _flat("predictions", "predicted_findings", "p")


def _features(name: str) -> str:
    s = _simplify("coalesce(span_text, '')")
    return f"""{name}_f AS (SELECT *, {_tokens('s')} AS t, {_bigrams('s')} AS b FROM (SELECT finding_id, case_id, segment_id, subclass, change_type, severity, main_class,
  {_simplify("coalesce(correction, '')")} AS corr, {s} AS s FROM {name}))"""


SCORE = f"""CASE WHEN g.s = p.s THEN 1.0 WHEN g.s = '' OR p.s = '' THEN 0.0 WHEN contains(g.s, p.s) OR contains(p.s, g.s) THEN 0.95
  WHEN length(g.s) < 12 OR length(p.s) < 12 OR (len(g.t) <= 2 AND len(p.t) <= 2) THEN greatest(0.5 * ({_jaccard('g.t', 'p.t')}), {_dice('g.b', 'p.b')})
  ELSE greatest({_jaccard('g.t', 'p.t')}, {_dice('g.b', 'p.b')}) END"""
SCORED = f"""{GOLD}, {PRED}, {_features('g')}, {_features('p')},
scored AS (SELECT case_id, g.finding_id AS gid, p.finding_id AS pid, round(({SCORE})::DOUBLE, 6) AS span_score, coalesce(g.subclass = p.subclass, false) AS sm, coalesce(g.change_type = p.change_type, false) AS cm,
  coalesce(g.severity = p.severity, false) AS vm, CASE WHEN g.corr = '' AND p.corr = '' THEN NULL ELSE g.corr = p.corr END AS om, g.subclass AS gsub, p.subclass AS psub, g.main_class AS gmain, p.main_class AS pmain
  FROM g_f g JOIN p_f p USING (case_id))"""


def _greedy(cand: str, order: str) -> str:
    """Pairs in order, each taken when both ends are free."""
    return f"""WITH RECURSIVE {SCORED}, cand AS ({cand}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}, gid, pid) AS rn FROM cand),
fold AS (SELECT case_id, 0::BIGINT AS rn, []::VARCHAR[] AS gs, []::VARCHAR[] AS ps FROM (SELECT DISTINCT case_id FROM cand)
  UNION ALL SELECT f.case_id, r.rn, CASE WHEN list_contains(f.gs, r.gid) OR list_contains(f.ps, r.pid) THEN f.gs ELSE list_append(f.gs, r.gid) END,
  CASE WHEN list_contains(f.gs, r.gid) OR list_contains(f.ps, r.pid) THEN f.ps ELSE list_append(f.ps, r.pid) END
  FROM fold f JOIN ranked r ON r.case_id = f.case_id AND r.rn = f.rn + 1),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rn DESC) = 1),
pairs AS (SELECT unnest(gs) AS gid, unnest(ps) AS pid FROM last), m AS (SELECT cand.* FROM cand JOIN pairs USING (gid, pid))"""


CAND = "SELECT *, round(100 + 100 * span_score + 0.5 * sm::INT + 0.2 * cm::INT + 0.1 * vm::INT, 6) AS score FROM scored WHERE span_score >= 0.2"
MATCH = _greedy(CAND, "span_score DESC, score DESC")
STRICT = _greedy("SELECT *, round(100 + 20 * span_score + 5 * cm::INT + 2 * vm::INT + coalesce(om, false)::INT, 6) AS score FROM scored WHERE span_score >= 0.2 AND sm", "score DESC, span_score DESC, cm DESC, vm DESC")
# Findings left over, and their counterparts from the best on.
LEFT = f"""{MATCH}, u AS (SELECT s.*, pg.change_type AS pc, gg.change_type AS gc, pg.severity AS pv, gg.severity AS gv FROM scored s JOIN p pg ON pg.finding_id = s.pid JOIN g gg ON gg.finding_id = s.gid
  WHERE pid NOT IN (SELECT pid FROM m) AND gid NOT IN (SELECT gid FROM m))"""


def _metrics(level: str, g: str, p: str) -> str:
    return f"""{MATCH}, n AS (SELECT coalesce({level}, 'UNKNOWN') AS class, 1 AS g, 0 AS p, 0 AS t FROM g UNION ALL SELECT coalesce({level}, 'UNKNOWN'), 0, 1, 0 FROM p
  UNION ALL SELECT coalesce({g}, 'UNKNOWN'), 0, 0, 1 FROM m WHERE coalesce({g}, 'UNKNOWN') = coalesce({p}, 'UNKNOWN')),
k AS (SELECT class, sum(t)::BIGINT AS tp, (sum(p) - sum(t))::BIGINT AS fp, (sum(g) - sum(t))::BIGINT AS fn FROM n GROUP BY class)
SELECT class, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM k"""


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE)"


def _topk(keep: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT id AS query_id, v FROM e WHERE id % 20 = 0),
h AS (SELECT query_id, id, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q, e WHERE {keep}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= {k})"""


HITS = """h AS (SELECT query_id, id, max(score) AS score FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
mh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h)"""
LAST_CHUNK = "lc AS (SELECT id, text, metadata FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY metadata.ingested_at_utc DESC) = 1)"
CASE_WORDS = "cw AS (SELECT case_id, unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]{4,}')) AS word FROM (SELECT DISTINCT id, metadata.case_id AS case_id, text FROM chunks WHERE metadata.case_id IS NOT NULL AND text IS NOT NULL))"
MONTH_WORDS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sept Sep Okt Nov Dez".split()
MONTH_OF = {"Jan": 1, "Feb": 2, "Mär": 3, "Apr": 4, "Mai": 5, "Jun": 6, "Jul": 7, "Aug": 8, "Sep": 9, "Okt": 10, "Nov": 11, "Dez": 12}
MENTIONS = f"list_concat(regexp_extract_all(text, '\\b(\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}})\\b', 1), regexp_extract_all(text, '\\b(\\d{{1,2}}\\. ?(?:{'|'.join(MONTH_WORDS)})\\.? \\d{{4}})\\b', 1))"


def _day(x: str) -> str:
    month = f"CASE substr(regexp_extract({x}, '(\\p{{L}}+)', 1), 1, 3) " + " ".join(f"WHEN '{m}' THEN '{i}'" for m, i in MONTH_OF.items()) + " END"
    return f"""coalesce(CASE WHEN regexp_matches({x}, '^\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}}$') THEN try_strptime(regexp_replace({x}, '[/-]', '.', 'g'), '%d.%m.%Y')::DATE END,
  CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({x}, '%Y-%m-%d')::DATE END,
  CASE WHEN regexp_matches({x}, '^\\d{{1,2}}\\. ?\\p{{L}}+\\.? \\d{{4}}$') THEN try_strptime(regexp_extract({x}, '^(\\d{{1,2}})\\.', 1) || '.' || ({month}) || '.' || right({x}, 4), '%d.%m.%Y')::DATE END)"""


def _dates(rows: str) -> str:
    return f"{rows}, d1 AS (SELECT id, unnest({MENTIONS}) AS mention FROM t), dm AS (SELECT DISTINCT id, mention, {_day('mention')} AS day FROM d1)"


DATES = _dates(ROWS)
STOPS = """s AS (SELECT id, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: z <> '') AS ss FROM t))"""
FACT_KEYS = ["auftraggeber", "gutachten_titel", "vorfall", "ereignisdatum", "beschuldigte_person", "ort", "sachverstaendige_person", "hauptsachbearbeitung"]


def oracle_sql() -> dict[str, str]:
    out = {}
    norm = "text"
    for a, b in ((r"\r\n?", "chr(10)"), (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"'\1\2'"), (r"([\p{L}])\n([\p{L}])", r"'\1 \2'"), (f"[{NO_BREAK}]", "' '"), (r"[ \t]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        norm = f"regexp_replace({norm}, '{a}', {b}, 'g')"
    out["normalize_text"] = f"WITH {CHUNKS} SELECT id, sha256(trim({norm})) AS text_hash FROM c"
    out["simplify_text"] = f"WITH {_flat('gold', 'gold_findings', 'g')} SELECT finding_id, {_simplify('span_text')} AS simple FROM g_flat WHERE span_text IS NOT NULL"
    out["token_sets"] = f"WITH {CHUNKS} SELECT id, len({_tokens(_simplify('text'))})::BIGINT AS n_tokens FROM c"
    kw = f"list_filter(regexp_extract_all(lower(retrieval_query), '[a-zäöüß0-9][a-zäöüß0-9\\-_/]+'), lambda w: length(w) >= 4 AND w NOT IN ({_words(STOP_WORDS)}))"
    out["keyword_extract"] = f"""WITH q AS (SELECT DISTINCT query_id, retrieval_query FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL AND retrieval_query IS NOT NULL), k AS (SELECT query_id, {kw} AS ws FROM q),
u AS (SELECT query_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS ws FROM k) SELECT DISTINCT query_id, array_to_string(ws[1:8], ' ') AS keywords FROM u"""
    out["text_preview"] = f"WITH {CHUNKS}, s AS (SELECT id, {_squeeze('text')} AS s FROM c) SELECT id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 79)) || '…' ELSE s END AS preview FROM s"
    out["chunk_ids"] = "SELECT DISTINCT id, sha256(concat_ws('|', metadata.file_sha256, metadata.source_path, metadata.chunk_index::VARCHAR, sha256(text))) AS address FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL"
    out["path_metadata"] = r"""SELECT DISTINCT id, nullif(regexp_extract(lower(metadata.source_path), '^(?:cases/)?(case[_-]?\d+)(?:/|$)', 1), '') AS path_case,
coalesce(nullif(trim(regexp_replace(regexp_replace(lower(regexp_extract(metadata.source_path, '^(?:cases/)?[^/]+/([^/]+)/', 1)), '[^a-z0-9äöüß_-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown') AS path_type FROM chunks"""
    out["sentence_split"] = f"WITH {CHUNKS}, l AS (SELECT id, {_sentences(_squeeze('text'))} AS ss FROM c) SELECT id, len(ss)::BIGINT AS n, list_max(list_transform(ss, lambda x: length(x)))::BIGINT AS longest FROM l"
    paras = "list_filter(list_transform(string_split(regexp_replace(text, '\\n[ \\t]*\\n\\s*', chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: z <> '')"
    out["paragraph_split"] = f"WITH {CHUNKS}, l AS (SELECT id, {paras} AS ps FROM c), x AS (SELECT id, unnest(range(len(ps)))::BIGINT AS n, unnest(ps) AS p FROM l) SELECT id, n, length(p)::BIGINT AS n_chars FROM x"
    letters, capitals = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))"
    n_words = "len(regexp_split_to_array(line, '\\s+'))"
    level = f"""CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^#+')) WHEN regexp_matches(line, '(?i)^(kapitel|chapter|abschnitt|section|teil|annex|anhang)($|[^\\p{{L}}\\p{{N}}_])') THEN 1
 WHEN regexp_matches(line, '^(\\d+(\\.\\d+){{0,4}}|[A-Z])[.)]\\s+\\S') AND length(line) <= 120 THEN 2
 WHEN length(line) <= 90 AND NOT regexp_matches(line, '[.!?:]$') AND NOT regexp_matches(line, '^([-*•]\\s+|\\d+[.)]\\s+)') AND {n_words} <= 10 AND {letters} > 0
  AND (({capitals} > 0.8 * {letters} AND {n_words} >= 2) OR (NOT regexp_matches(line, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches(line, '\\p{{L}}\\p{{Lu}}'))) THEN 3 ELSE 0 END"""
    rule = "regexp_matches(coalesce({0}, ''), '^[-=]{{3,}}$')"
    lined = f"""{CHUNKS}, l0 AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS n, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM c), l1 AS (SELECT *, lead(line) OVER w AS nx, coalesce(lag(line) OVER w, '') AS pv FROM l0 WINDOW w AS (PARTITION BY id ORDER BY n)),
l2 AS (SELECT *, {rule.format('line')} AND pv <> '' AS ruled, CASE WHEN line <> '' AND {rule.format('nx')} THEN CASE WHEN nx LIKE '=%' THEN 1 ELSE 2 END WHEN {rule.format('line')} AND pv <> '' THEN 0 ELSE {level} END AS lv FROM l1),
l3 AS (SELECT *, sum((lv > 0)::INT) OVER w AS section, coalesce(last_value(CASE WHEN lv > 0 THEN trim(regexp_replace(line, '^#+', '')) END IGNORE NULLS) OVER w, '') AS title, coalesce(last_value(CASE WHEN lv > 0 THEN lv END IGNORE NULLS) OVER w, 0) AS level FROM l2 WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
sl AS (SELECT * FROM l3 WHERE lv = 0 AND NOT ruled)"""
    out["section_split"] = f"WITH {lined} SELECT id, section::BIGINT AS section, level::BIGINT AS level, title, trim(string_agg(line, chr(10) ORDER BY n), ' ' || chr(10)) AS body FROM sl GROUP BY id, section, level, title HAVING trim(string_agg(line, chr(10) ORDER BY n), ' ' || chr(10)) <> ''"
    lk = """CASE WHEN regexp_matches(line, '^([-*•]\\s+|\\d+[.)]\\s+)') THEN CASE WHEN contains(line, '?') THEN 'question_block' ELSE 'list_block' END WHEN line LIKE '%?' OR regexp_matches(line, '(?i)^(frage|fragen)($|[^\\p{L}\\p{N}_])') THEN 'question_block'
 WHEN regexp_matches(line, '(?i)^(checkliste|checklist|todo|to-do)($|[^\\p{L}\\p{N}_])') THEN 'checklist_block' ELSE 'paragraph' END"""
    out["structural_units"] = f"""WITH {lined}, u0 AS (SELECT id, n, line, section, coalesce(lag(line) OVER w = '', true) OR coalesce(lag(section) OVER w, -1) <> section AS gap FROM sl WINDOW w AS (PARTITION BY id ORDER BY n)), u1 AS (SELECT *, {lk} AS own FROM u0 WHERE line <> ''),
u2 AS (SELECT *, own = 'paragraph' AND NOT gap AND regexp_matches(line, '^[a-zäöü0-9]') AS more FROM u1), u3 AS (SELECT *, coalesce(last_value(CASE WHEN NOT more THEN own END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING), own) AS kind FROM u2),
u4 AS (SELECT *, coalesce(lag(section) OVER w, -1) <> section OR coalesce(lag(kind) OVER w, '') <> kind OR (gap AND kind = 'paragraph') AS starts FROM u3 WINDOW w AS (PARTITION BY id ORDER BY n)), u5 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS unit FROM u4)
SELECT id, section::BIGINT AS section, unit::BIGINT AS unit, kind, length(string_agg(line, chr(10) ORDER BY n))::BIGINT AS n_chars FROM u5 GROUP BY ALL"""
    out["taxonomy_tree"] = f"WITH {TAX} SELECT main_id, main_label, s.id AS subclass_id, s.label AS subclass_label FROM sub"
    out["taxonomy_map"] = f"WITH {GOLD} SELECT finding_id, subclass, change_type, severity, main_class FROM g"
    bad = "count(*) FILTER ({0}_id IS NOT NULL AND {0} IS NULL)::BIGINT AS unknown_{0}"
    out["id_validate"] = f"WITH {GOLD}, {PRED}, a AS (SELECT 'gold' AS side, * FROM g UNION ALL SELECT 'pred', * FROM p) SELECT side, count(*) AS n, {bad.format('subclass')}, {bad.format('change_type')}, {bad.format('severity')} FROM a GROUP BY side"
    out["duplicate_segments"] = "SELECT case_id, segment_id, count(*) AS n FROM gold GROUP BY ALL HAVING count(*) > 1"
    span = f"substr(lower({_squeeze(chr(99) + 'oalesce(span_text, ' + chr(39) * 2 + ')')}), 1, 120)"
    out["two_stage_dedup"] = f"""WITH {PRED_FLAT}, a AS (SELECT *, {span} AS sp FROM p_flat QUALIFY row_number() OVER (PARTITION BY case_id, array_to_string(list_sort(coalesce(source_refs, [])), '|'), substr(coalesce(rationale, ''), 1, 80) ORDER BY segment_id, pos, finding_id) = 1)
SELECT finding_id FROM a QUALIFY row_number() OVER (PARTITION BY case_id, sp, CASE WHEN sp = '' THEN finding_id END ORDER BY segment_id, pos, finding_id) = 1"""
    low = lambda c: f"lower(coalesce(trim({c}), ''))"
    out["language_dedup"] = f"WITH {PRED_FLAT} SELECT finding_id FROM p_flat QUALIFY row_number() OVER (PARTITION BY case_id, {low('span_text')}, {low('correction')}, {low('subclass_id')} ORDER BY segment_id, pos, finding_id) = 1"
    out["exact_dedup"] = f"WITH {CHUNKS} SELECT min(id) AS kept, count(*) AS n FROM c GROUP BY {_squeeze('text')} HAVING count(*) > 1"
    near = f"{_jaccard('x', 'r.t')} >= 0.85 - 1e-12"
    out["fuzzy_dedup_leader"] = f"""WITH RECURSIVE {PRED_FLAT}, x AS (SELECT finding_id, case_id, segment_id, pos, subclass_id, {span} AS sp FROM p_flat), free AS (SELECT finding_id FROM x WHERE sp = '' OR subclass_id IS NULL OR trim(subclass_id) = ''),
o AS (SELECT finding_id, case_id, subclass_id, list_sort(list_distinct(string_split(sp, ' '))) AS t, row_number() OVER (PARTITION BY case_id, subclass_id ORDER BY segment_id, pos, finding_id) AS n FROM x WHERE NOT (sp = '' OR subclass_id IS NULL OR trim(subclass_id) = '')),
f AS (SELECT case_id, subclass_id, 0::BIGINT AS n, []::VARCHAR[][] AS kept, []::VARCHAR[] AS ids FROM (SELECT DISTINCT case_id, subclass_id FROM o)
 UNION ALL SELECT r.case_id, r.subclass_id, r.n, CASE WHEN len(list_filter(f.kept, lambda x: {near})) > 0 THEN f.kept ELSE list_append(f.kept, r.t) END, CASE WHEN len(list_filter(f.kept, lambda x: {near})) > 0 THEN f.ids ELSE list_append(f.ids, r.finding_id) END
 FROM f JOIN o r ON r.case_id = f.case_id AND r.subclass_id = f.subclass_id AND r.n = f.n + 1),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY case_id, subclass_id ORDER BY n DESC) = 1) SELECT unnest(ids) AS finding_id FROM l UNION ALL SELECT finding_id FROM free"""
    out["token_jaccard_pairs"] = f"""WITH {_flat('gold', 'gold_findings', 'g')}, x AS (SELECT finding_id, {_tokens(_simplify('span_text'))} AS t FROM g_flat WHERE span_text IS NOT NULL)
SELECT a.finding_id AS id_a, b.finding_id AS id_b FROM x a JOIN x b ON a.finding_id < b.finding_id AND len(a.t) > 0 AND len(b.t) > 0 WHERE {_jaccard('a.t', 'b.t')} >= 0.6 - 1e-12"""
    out["save_numbering"] = f"WITH {GOLD}, {PRED} SELECT finding_id, 'PRED-' || case_id || '-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY segment_id, pos, finding_id)::VARCHAR, 4, '0') AS new_id FROM p WHERE subclass IS NOT NULL"
    facts = " UNION ALL ".join(f"SELECT case_id, facts.{k}.source_span AS span, facts.{k}.confidence AS c FROM reference_facts" for k in FACT_KEYS)
    facts += " UNION ALL " + " UNION ALL ".join(f"SELECT case_id, e.source_span, e.confidence FROM (SELECT case_id, unnest(facts.{k}) AS e FROM reference_facts)" for k in ("personen", "referenz_entitaeten"))
    out["protected_span_filter"] = f"""WITH {PRED_FLAT}, f AS ({facts}), sp AS (SELECT DISTINCT case_id, {_simplify('span')} AS b FROM f WHERE lower(trim(c)) IN ('high', 'medium') AND trim(span) <> ''),
x AS (SELECT finding_id, {_simplify('span_text')} AS a, b FROM p_flat JOIN sp USING (case_id) WHERE span_text IS NOT NULL), y AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM x)
SELECT DISTINCT finding_id FROM y WHERE len(tb) >= 2 AND len(ta) >= 2 AND (contains(a, b) OR contains(b, a) OR len(list_filter(ta, lambda w: list_contains(tb, w)))::DOUBLE / len(ta) >= 0.8)"""
    long = " UNION ALL ".join(f"SELECT file_name, case_id, '{k}' AS key, trim(facts.{k}.value) AS value, lower(trim(facts.{k}.confidence)) AS c FROM reference_facts" for k in FACT_KEYS)
    out["facts_long"] = f"WITH f AS ({long}) SELECT DISTINCT file_name, case_id, key, value, CASE WHEN c IN ('high', 'medium', 'low') THEN c ELSE 'low' END AS confidence FROM f WHERE value <> ''"
    out["span_scores"] = f"{MATCH} SELECT gid AS gold_finding_id, pid AS pred_finding_id, span_score, score, coalesce(om::VARCHAR, 'none') AS correction_match FROM cand"
    out["greedy_match"] = f"{MATCH} SELECT gid AS gold_finding_id, pid AS pred_finding_id, span_score, score FROM m"
    out["match_metrics_by_class"] = _metrics("subclass", "gsub", "psub")
    out["match_metrics_by_main_class"] = _metrics("main_class", "gmain", "pmain")
    acc = lambda c: f"(SELECT round(coalesce(avg({c}::INT), 0.0), 6)::DOUBLE FROM m)"
    out["micro_summary"] = f"""{MATCH}, k AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(CASE WHEN np = 0 THEN 0 ELSE tp / np END, 6)::DOUBLE AS precision, round(CASE WHEN ng = 0 THEN 0 ELSE tp / ng END, 6)::DOUBLE AS recall, round(CASE WHEN np + ng = 0 THEN 0 ELSE 2.0 * tp / (np + ng) END, 6)::DOUBLE AS f1,
{acc('sm')} AS subclass_accuracy, {acc('cm')} AS change_type_accuracy, {acc('vm')} AS severity_accuracy, {acc('om')} AS correction_accuracy FROM k"""
    out["confusion"] = f"""{LEFT}, b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY gid ORDER BY span_score DESC, pid) = 1),
x AS (SELECT 'matched' AS kind, gsub, psub FROM m UNION ALL SELECT 'unmatched', gsub, psub FROM b) SELECT kind, coalesce(gsub, 'UNKNOWN') AS gold_class, coalesce(psub, 'UNKNOWN') AS pred_class, count(*) AS n FROM x GROUP BY ALL"""
    same = lambda a, b, n: f"({a} IS NOT DISTINCT FROM {b}) AS same_{n}"
    out["best_unmatched"] = f"""{LEFT} SELECT pid AS pred_finding_id, gid AS gold_finding_id, span_score, row_number() OVER (PARTITION BY pid ORDER BY span_score DESC, gid) AS rank,
{same('gsub', 'psub', 'subclass')}, {same('gmain', 'pmain', 'main_class')}, {same('gc', 'pc', 'change_type')}, {same('gv', 'pv', 'severity')} FROM u QUALIFY rank <= 3"""
    out["strict_match"] = f"{STRICT} SELECT gid AS gold_finding_id, pid AS pred_finding_id, span_score, score FROM m"
    fields = ", ".join(f"{t}.{c} AS {n}_{c}" for t, n in (("g", "gold"), ("p", "pred")) for c in ("main_class", "subclass", "change_type", "severity", "span_text"))
    out["match_rows"] = f"""{MATCH} SELECT gid AS gold_finding_id, pid AS pred_finding_id, span_score, score, sm AS subclass_match, cm AS change_type_match, vm AS severity_match, coalesce(om::VARCHAR, 'none') AS correction_match, {fields}
FROM m JOIN g ON g.finding_id = gid JOIN p ON p.finding_id = pid"""
    out["consensus_fp"] = f"""WITH {PRED_FLAT}, x AS (SELECT case_id, agent_scope AS a, finding_id, {_tokens(_simplify('span_text'))} AS t FROM p_flat WHERE span_text IS NOT NULL),
k AS (SELECT DISTINCT b.finding_id, o.a FROM x b JOIN x o USING (case_id) WHERE b.a = 'agent_2' AND o.a IN ('agent_4', 'agent_5') AND len(b.t) > 0 AND len(o.t) > 0 AND {_jaccard('b.t', 'o.t')} >= 0.1 - 1e-12)
SELECT finding_id, 'agent_2 | agent_4 | agent_5' AS models_agreed FROM k GROUP BY finding_id HAVING count(*) = 2"""
    out["fp_by_agent"] = f"""{MATCH}, f AS (SELECT coalesce(agent_scope, 'none') AS a, coalesce(severity, 'none') AS s FROM p WHERE finding_id NOT IN (SELECT pid FROM m))
SELECT coalesce(a, '(all)') AS agent, coalesce(s, '(all)') AS severity_level, count(*) AS n FROM f GROUP BY CUBE (a, s)"""
    cells = ", ".join(f"count(*) FILTER (s = '{x}') AS {x}" for x in ("STUFE_1", "STUFE_2", "STUFE_3", "none"))
    out["fp_matrix"] = f"""{MATCH}, f AS (SELECT coalesce(agent_scope, 'none') AS agent, coalesce(severity, 'none') AS s FROM p WHERE finding_id NOT IN (SELECT pid FROM m)) SELECT agent, {cells}, count(*) AS total FROM f GROUP BY agent"""
    scope = "coalesce(agent_scope, CASE WHEN main_class LIKE 'HYPOTHESE%' THEN 'document_hypothesis' WHEN main_class LIKE 'RECHEN%' OR main_class LIKE 'ZAHL%' THEN 'segment_calculation' WHEN main_class LIKE 'FORMALES%' OR main_class LIKE 'SPRACHE%' THEN 'segment_language' ELSE 'segment_or_document_factual' END)"
    out["fn_by_scope"] = f"{MATCH} SELECT {scope} AS scope, count(*) AS n FROM g WHERE finding_id NOT IN (SELECT gid FROM m) GROUP BY ALL"
    out["proposal_counts"] = f"""WITH {GOLD}, f AS (SELECT coalesce(subclass, 'UNKNOWN') AS s, coalesce(change_type, 'UNKNOWN') AS c, source FROM g WHERE source IN ('manual', 'injected'))
SELECT coalesce(s, '(all)') AS subclass, coalesce(c, '(all)') AS change_type, count(*) FILTER (source = 'manual') AS n_manual, count(*) FILTER (source = 'injected') AS n_injected FROM f GROUP BY GROUPING SETS ((s, c), (s), (c), ())"""
    out["topk_cosine"] = f"{_topk('true', 12)} SELECT query_id, rank, id, score FROM r"
    out["topk_filtered"] = f"{_topk('label < 5', 8)} SELECT query_id, rank, id, score FROM r"
    out["topk_postfiltered"] = f"{_topk('true', 40)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, score FROM r WHERE label < 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8"
    rec = ", ".join(f"round(avg(coalesce((first <= {k})::INT, 0)), 6)::DOUBLE AS recall_{k}" for k in (1, 3, 5, 10))
    out["recall_mrr"] = f"""{_topk('true', 12)}, x AS (SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS rank, r.label = w.label AS ok FROM r JOIN e w ON w.id = r.query_id WHERE r.id <> r.query_id),
f AS (SELECT query_id, min(CASE WHEN ok THEN rank END) AS first FROM x GROUP BY query_id) SELECT count(*) AS n_queries, {rec}, round(avg(coalesce(1.0 / first, 0.0)), 6)::DOUBLE AS mrr FROM f"""
    out["rank_histogram"] = "SELECT rank::BIGINT AS rank, count(*) AS n FROM (SELECT DISTINCT query_id, id, rank FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL) GROUP BY rank"
    out["multi_query_merge"] = f"WITH {HITS} SELECT query_id, rank, id, score FROM mh"
    out["context_budget"] = f"""WITH {HITS}, {LAST_CHUNK}, b AS (SELECT query_id, rank, '[' || rank || '] ' || substr(id, 1, 12) AS header, trim(text) AS body FROM mh JOIN lc USING (id)),
k AS (SELECT *, length(header) + 1 + length(body) AS len FROM b WHERE body <> ''), u AS (SELECT *, coalesce(sum(len + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k),
v AS (SELECT *, used + len + 2 <= 3000 AS fits, 3000 - used - length(header) - 2 AS room, sum((used + len + 2 > 3000)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS over FROM u)
SELECT query_id, rank, (CASE WHEN fits THEN len ELSE length(header) + 1 + room + 2 END)::BIGINT AS n_chars, NOT fits AS was_cut FROM v WHERE (fits AND over = 0) OR (NOT fits AND over = 1 AND room > 0)"""
    out["evidence_numbering"] = f"""WITH {HITS}, kinds AS (SELECT query_id, id, source_kind FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, rank) = 1),
z AS (SELECT mh.*, CASE WHEN source_kind = 'normbasis' THEN 'R' ELSE 'M' END AS k FROM mh JOIN kinds USING (query_id, id))
SELECT query_id, id, 'S' || try_cast(regexp_extract(query_id, '_q(\\d+)_', 1) AS INT) || '_' || k || '_' || row_number() OVER (PARTITION BY query_id, k ORDER BY rank, id) AS source_ref FROM z"""
    out["store_assembly"] = f"""WITH {LAST_CHUNK}, v AS (SELECT DISTINCT name, source_kind, id FROM rag_store) SELECT name, coalesce(lc.metadata.case_id, 'none') AS case_id, count(*) AS n, count(lc.id) AS n_known, sum(length(coalesce(lc.text, '')))::BIGINT AS n_chars
FROM v LEFT JOIN lc USING (id) GROUP BY ALL"""
    out["domain_whitelist"] = f"WITH {CASE_WORDS} SELECT case_id, word, count(*) AS n FROM cw GROUP BY ALL HAVING count(*) >= 2"
    out["reference_words"] = """WITH p AS (SELECT case_id, unnest(facts.personen) AS p FROM reference_facts), e AS (SELECT case_id, unnest(facts.referenz_entitaeten) AS e FROM reference_facts),
v AS (SELECT case_id, p.name AS v FROM p UNION ALL SELECT case_id, e.bezeichnung FROM e UNION ALL SELECT case_id, unnest(e.aliases) FROM e),
w AS (SELECT case_id, unnest(string_split(trim(regexp_replace(lower(v), '[^0-9a-zäöüß]+', ' ', 'g')), ' ')) AS word FROM v WHERE v IS NOT NULL) SELECT DISTINCT case_id, word FROM w WHERE length(word) >= 4"""
    reader = """c AS (SELECT DISTINCT id, metadata.pdf_page_text_quality AS q FROM chunks WHERE id IS NOT NULL), p AS (SELECT id, unnest(q) AS q FROM c), r AS (SELECT id, q.page_index AS page_index, unnest(q.pdf_text_reader_candidates) AS c, unnest(range(len(q.pdf_text_reader_candidates))) AS prio FROM p),
best AS (SELECT id, page_index::BIGINT AS page_index, c.reader AS reader, (c.chars - c.suspicious_long_runs * 168)::BIGINT AS score FROM r QUALIFY row_number() OVER (PARTITION BY id, page_index ORDER BY c.chars - c.suspicious_long_runs * 168 DESC, c.chars DESC, c.suspicious_long_runs, prio) = 1)"""
    out["reader_choice"] = f"WITH {reader} SELECT * FROM best"
    out["reader_vote"] = f"WITH {reader}, v AS (SELECT id, reader, count(*) AS n FROM best GROUP BY ALL) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, reader) = 1"
    out["incremental_append"] = """WITH c AS (SELECT id, metadata.ingested_at_utc AS t FROM chunks) SELECT id, min(t) AS t FROM c WHERE t >= '2023-06-01' AND id IS NOT NULL AND id NOT IN (SELECT id FROM c WHERE t < '2023-06-01' AND id IS NOT NULL) GROUP BY id"""
    alias = lambda k: f"nullif(trim(json_extract_string(props, '$.{k}')), '')"
    out["json_alias_coalesce"] = f"SELECT coalesce({alias('key')}, {alias('name')}, {alias('k')}) AS key, count(*) AS n FROM events GROUP BY ALL"
    out["hourly_events"] = "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL"
    out["date_mentions"] = f"WITH {DATES} SELECT id, mention, day FROM dm"
    out["date_window"] = f"""WITH {DATES}, ev AS (SELECT case_id, min(day) AS event_day FROM (SELECT case_id, coalesce({_day('trim(facts.ereignisdatum.value)')}, {_day("m[1]")}) AS day FROM (SELECT *, {MENTIONS.replace("(text,", "(coalesce(facts.ereignisdatum.source_span, ''),")} AS m FROM reference_facts)) WHERE day IS NOT NULL GROUP BY case_id),
cc AS (SELECT DISTINCT id, metadata.case_id AS case_id FROM chunks WHERE metadata.case_id IS NOT NULL) SELECT id, mention, day FROM dm JOIN cc USING (id) JOIN ev USING (case_id) WHERE day > event_day + INTERVAL 36 MONTH"""
    dims = {"length": "mm cm dm m km", "time": "s ms sekunde sekunden minute minuten stunde stunden h", "mass": "g kg mg t", "freq": "hz khz mhz", "angle": "grad °", "concentration": "promille %", "data": "bit byte kb mb"}
    alternatives = "|".join(sorted((u for us in dims.values() for u in us.split()), key=len, reverse=True))
    dim = "CASE " + " ".join(f"WHEN u IN ({_words(us.split())}) THEN '{k}'" for k, us in dims.items()) + " END"

    def units(rows: str) -> str:
        return f"""WITH {rows}, {STOPS}, f AS (SELECT id, n, substr(s, 1, 120) AS span, list_transform(regexp_extract_all(s, '(?i)\\d(?:[.,]\\d+)?\\s*({alternatives})(?:$|[^\\p{{L}}\\p{{N}}/²³])', 1), lambda x: lower(x)) AS us FROM s
 WHERE NOT regexp_matches(s, '(?i)entspricht|gleich|entsprechen|umgerechnet|ergibt|bzw\\.|d\\.h\\.|=\\s*\\d')), e AS (SELECT id, n, span, unnest(us) AS u, unnest(range(len(us))) AS pl FROM f),
k AS (SELECT id, n, span, {dim} AS dimension, u, count(*) AS c, min(pl) AS pl FROM e GROUP BY ALL),
g AS (SELECT id, n, span, dimension, list(u ORDER BY u) AS us, first(u ORDER BY c DESC, pl) AS most FROM k GROUP BY id, n, span, dimension HAVING count(*) >= 2)
SELECT id, n::BIGINT AS n, dimension, array_to_string(us, ',') AS units, most AS majority, array_to_string(list_filter(us, lambda x: x <> most), ',') AS outliers, span FROM g"""

    out["unit_conflict"], out["unit_conflict_samples"] = units(ROWS), units(sample_sql())
    out["date_samples"] = f"WITH {_dates(sample_sql())} SELECT id, mention, day FROM dm"
    out["time_difference"] = """WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS id, abs(l_orderkey % 997 - l_partkey % 499)::DOUBLE AS r, l_suppkey % 7 = 0 AS e, l_suppkey % 97 + 0.5 AS c, l_orderkey % 5 = 0 AS f FROM lineitem)
SELECT id, 0::BIGINT AS n, r + 1 AS said, r AS right FROM x WHERE e UNION ALL SELECT id, 1, (c + 2)::DOUBLE, c::DOUBLE FROM x WHERE f"""
    calc = "x AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS k, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS l, (l_quantity::BIGINT * round(l_extendedprice * 100)::BIGINT) // 4 AS c FROM lineitem)"
    money = lambda c: f"(({c})::DECIMAL(20, 0) / 100)::DECIMAL(20, 2)::VARCHAR"
    out["calc_verify"] = f"""WITH {calc} SELECT id, 0::BIGINT AS n, {money('c + 700')} AS claimed, {money('c')} AS right FROM x WHERE k % 11 = 0 AND c + 700 <= 100 * c UNION ALL
SELECT id, 1, (q - l + 1)::VARCHAR, (q - l)::VARCHAR FROM x WHERE k % 13 = 0 AND NOT (q - l + 1 <> 0 AND (abs(q - l) > 100 * abs(q - l + 1) OR 100 * abs(q - l) < abs(q - l + 1)))"""
    out["calc_status"] = f"""WITH {calc}, y AS (SELECT 0 AS n, c AS v, c + CASE WHEN k % 11 = 0 THEN 700 ELSE 0 END AS said FROM x UNION ALL SELECT 1, q - l, q - l + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END FROM x)
SELECT n::BIGINT AS n, CASE WHEN said <> 0 AND (abs(v) > 100 * abs(said) OR 100 * abs(v) < abs(said)) THEN 'implausible' WHEN v <> said THEN 'wrong' ELSE 'ok' END AS status, count(*) AS rows FROM y GROUP BY ALL"""
    out["calc_candidates"] = f"WITH {calc} SELECT id, (q - l)::VARCHAR AS claimed, (q - l + 1)::VARCHAR AS wrong FROM x WHERE k % 13 <> 0"
    cents = "(x.c + CASE WHEN k % 11 = 0 THEN 700 ELSE 0 END)"
    price = "((round(l_extendedprice * 100)::BIGINT)::DECIMAL(20, 0) / 100)::DECIMAL(20, 2)::VARCHAR"
    text = lambda last: f"'Es gilt (' || q || ' * ' || {price} || ') / 4 = ' || {money(cents)} || '. Dazu ' || q || ' – ' || l || ' = ' || {last} || ' Stück.'"
    out["injected_texts"] = f"""WITH {calc.replace('FROM lineitem', ', l_extendedprice FROM lineitem')}, y AS (SELECT id, k, {text('(q - l + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END)')} AS old, {text('(q - l + 1)')} AS new, '= ' || (q - l + 1) || ' Stück' AS injected_span FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY old) = 1) SELECT id, sha256(new) AS text_hash, injected_span FROM z WHERE k % 13 <> 0"""
    out["number_forms"] = "SELECT l_orderkey || '-' || l_linenumber AS id, (round(l_extendedprice * 100) / 100)::DOUBLE AS value FROM lineitem"
    banned = ["zweifelsfrei", "ohne Zweifel", "begründete Zweifel", "Restzweifel", "keine Zweifel mehr", "Zweifel säen", "Zweifel ausräumen", "räumt Zweifel aus", "bestehen keine Zweifel", "ist zweifelsfrei bewiesen"]
    out["forbidden_terms"] = f"WITH {sample_sql()}, b AS (SELECT unnest([{_words(banned)}]) AS term) SELECT id, term FROM t, b WHERE contains(lower(text), lower(term))"
    word = lambda ws: f"regexp_matches(s, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{ws})(?:$|[^\\p{{L}}\\p{{N}}_])')"

    def kinds(rows: str, last: str) -> str:
        h, k, b = word(detectors.HEDGES), word(detectors.SUBJUNCTIVES), word(detectors.JUDGEMENTS)
        return f"""WITH {rows}, {STOPS}, l AS (SELECT * FROM s WHERE length(s) > 20), k AS (SELECT id, n, s, 'HEDGING' AS kind FROM l WHERE {h} UNION ALL SELECT id, n, s, CASE WHEN {k} THEN 'KONJUNKTIV' ELSE 'BEWERTUNG' END FROM l WHERE {k} OR ({b} AND {h}))
SELECT id, n::BIGINT AS n, kind, {last} FROM k"""

    out["hedging"], out["reformulation_samples"] = kinds(ROWS, "length(s)::BIGINT AS n_chars"), kinds(sample_sql(), "s AS sentence")
    out["hypothesis_texts"] = f"WITH {ROWS}, s AS (SELECT id, text AS s FROM t) SELECT id FROM s WHERE {word(detectors.HYPOTHESES)}"
    out["statement_candidates"] = f"""WITH {sample_sql()}, {STOPS}, k AS (SELECT id, n, s, CASE WHEN {word(detectors.SURE)} THEN 0 WHEN {word(detectors.INTENT)} THEN 1 WHEN {word(detectors.MODAL)} THEN 2
 WHEN regexp_matches(s, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{detectors.CONDITION})[^,;.!?]{{5,120}},?\\s*(?:{detectors.INDICATIVE})[^.!?]{{0,180}}[.!?]') AND NOT {word(detectors.OPEN)} THEN 3 END AS r FROM s),
f AS (SELECT * FROM k WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, lower(s) ORDER BY r, n) = 1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY r, n) AS candidate_index, (['absolute_source_assertion', 'intent_or_will_attribution', 'modal_counterfactual_as_fact', 'conditional_indikativ'])[r + 1] AS kind, s AS sentence FROM f"""
    # Which of the invented sentences hold which wrong form, and whether a word of law is near in the text.
    law = "regexp_matches(text, 'Art\\.|Urteil|Gesetz')"
    held = [("Stpo", "StPO", "true"), ("Stgb", "StGB", "true"), ("Bge", "BGE", law), ("not", "Not.", law), ("ivm", "i.V.m.", "true")]
    places = " UNION ALL ".join(f"SELECT id, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(w) + 2}) = ' {w} ')) + 1 AS start_pos, '{w}' AS wrong, '{r}' AS right FROM t WHERE {c}" for w, r, c in held)
    out["abbreviations"] = f"WITH {sample_sql()} {places}"
    # This engine counts bytes: letters with marks are written as one byte, which no word holds otherwise.
    marked = "äöüéèêëàâáåãçñîïíìôóòõøûúùýßасеорухіѕјһԁԛԝӏүανικουχγρ"
    plain = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "!#$%&()*+,./:;<=>?@[]^_`{|}~")[: len(marked)]
    low = lambda c: f"translate(lower({c}), '{marked}', '{plain}')"
    single = " UNION ALL ".join(f"SELECT case_id, string_split(facts.{k}.value, ',')[1] AS name FROM reference_facts WHERE lower(trim(facts.{k}.confidence)) IN ('high', 'medium')" for k in ("sachverstaendige_person", "beschuldigte_person", "hauptsachbearbeitung"))
    runs = " UNION ALL ".join(f"SELECT case_id, unnest(regexp_extract_all(text, '{rx}')) AS word FROM ct" for rx in ("[A-Za-zÄÖÜäöüß]{4,}", "\\p{L}{4,}", "\\p{L}+(?:-\\p{L}+)+"))
    out["name_consistency"] = f"""WITH ct AS (SELECT DISTINCT id, metadata.case_id AS case_id, text FROM chunks WHERE metadata.case_id IS NOT NULL AND text IS NOT NULL), w AS (SELECT DISTINCT case_id, word FROM ({runs})),
nn AS (SELECT case_id, p.name AS name FROM (SELECT case_id, unnest(facts.personen) AS p FROM reference_facts) UNION ALL {single}),
nm AS (SELECT DISTINCT case_id, name FROM (SELECT case_id, unnest(string_split({_squeeze('name')}, ' ')) AS name FROM nn) WHERE length(name) >= 4)
SELECT case_id, word, name FROM w JOIN nm USING (case_id) WHERE abs(length(word) - length(name)) <= 2 AND levenshtein({low('word')}, {low('name')}) BETWEEN 1 AND 3 AND NOT EXISTS (SELECT 1 FROM nm x WHERE x.case_id = w.case_id AND x.name = w.word)"""
    from prufspark.plans import review_oracle

    return out | review_oracle.oracle_sql(out)
