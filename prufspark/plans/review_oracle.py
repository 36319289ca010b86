"""SQL of the queries in ``review_queries``, for an independent engine."""

from __future__ import annotations

from prufspark.plans.samples import LANGUAGE, sample_sql


def oracle_sql(base: dict[str, str]) -> dict[str, str]:
    """``base`` holds the SQL of the other queries, of which some are used here."""
    from prufspark.plans import oracle as o

    out = {}
    pred, gold = o.PRED_FLAT, o._flat("gold", "gold_findings", "g")
    sq, words = o._squeeze, o._words
    nn = lambda c: f"coalesce({c}, '')"
    # Language filters.
    s, v, w = "s", "v", "w"
    pieces = lambda c: f"regexp_extract_all({c}, '[A-Za-zÄÖÜäöüß0-9-]+|[^\\p{{L}}\\p{{N}}_\\s]')"
    added = f"list_filter({pieces(v)}, lambda x: NOT list_contains({pieces(s)}, x))"
    articles = words("der die das dem den des ein eine einer einem einen".split())
    case_only = "(contains(w, 'attributives adjektiv') OR (v <> '' AND lower(s) = lower(v) AND s <> v))"
    sharp = lambda c: f"lower(replace({c}, 'ß', 'ss'))"
    n_words = lambda c: f"len(list_filter(string_split({sq(c)}, ' '), lambda x: x <> ''))"
    letters = "regexp_extract_all(s, '[A-Za-zÄÖÜäöüß]+')"
    named = "regexp_matches(w, 'orthograf|rechtschreib|grammatik|zeichensetzung|komma|adjektiv|einheit|abkürzung|abbildung|referenz|tippfehler|inkonsistent|nummer|falsch|ungültig|schreibweise')"
    rules = [
        ("no_span", "s = ''"), ("no_change", "v <> '' AND v = s"), ("unknown_word", "v = '' AND starts_with(w, 'möglicher tippfehler')"), ("stop_is_there", "contains(w, 'punkt') AND regexp_matches(s, '[.!?]$')"),
        ("quotation", "regexp_matches(s, '[«»„“‚'']')"), ("sharp_s", f"NOT {case_only} AND {sharp(s)} = {sharp(v)}"),
        ("capitals", f"NOT {case_only} AND len({letters}) > 0 AND len(list_filter({letters}, lambda t: NOT (length(t) >= 2 AND t = upper(t)))) = 0"),
        ("taste", "contains(w, 'konsistent') OR contains(lower(v), 'konsistenter gebrauch')"),
        ("article", f"v <> '' AND len({added}) BETWEEN 1 AND 2 AND len(list_filter({added}, lambda t: lower(t) NOT IN ({articles}))) = 0"),
        ("short_replacement", f"{n_words(s)} <= 3 AND {n_words(v)} <= 3 AND lower(s) <> lower(v) AND NOT {case_only} AND NOT {named}"),
        ("hyphenated", "v <> '' AND regexp_matches(s, '[\\p{L}\\p{N}_]-[\\p{L}\\p{N}_]') AND NOT contains(s, ' ') AND replace(s, '-', '') = replace(v, '-', '')"),
        ("cut_word", "regexp_matches(s, '^[A-Za-zÄÖÜäöüß]{2,}-$')"), ("scrap", "regexp_matches(s, '^[a-zäöüß]{2,5}$') AND starts_with(w, 'möglicher tippfehler') AND v <> '' AND length(v) <= 8"),
        ("foreign", "regexp_matches(s, '^[a-z]{1,4}$') AND v = ''"),
    ]
    reason = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules) + " END"
    out["language_filter"] = f"WITH {pred}, x AS (SELECT finding_id, trim({nn('span_text')}) AS s, trim({nn('correction')}) AS v, lower(trim({nn('rationale')})) AS w FROM p_flat), y AS (SELECT finding_id, {reason} AS reason FROM x) SELECT * FROM y WHERE reason IS NOT NULL"
    # The reasons are those the invented findings were made for.
    out["language_samples"] = f"SELECT o_orderkey AS id, ([{words(r[3] for r in LANGUAGE)}])[o_orderkey % {len(LANGUAGE)} + 1] AS reason FROM orders"
    out["reference_word_filter"] = f"""WITH {pred}, known AS ({base['reference_words']}), x AS (SELECT case_id, finding_id, unnest(regexp_extract_all(lower({nn('span_text')}), '[\\p{{L}}\\p{{N}}_-]+')) AS word FROM p_flat)
SELECT finding_id FROM p_flat WHERE NOT EXISTS (SELECT 1 FROM x JOIN known k ON k.case_id = x.case_id AND k.word = x.word WHERE x.case_id = p_flat.case_id AND x.finding_id = p_flat.finding_id AND length(x.word) >= 4)"""
    out["span_in_text"] = f"WITH {pred} SELECT finding_id FROM p_flat WHERE {sq(nn('span_text'))} <> '' AND contains({sq(nn('rationale'))}, {sq(nn('span_text'))})"
    toks = lambda c: f"list_distinct(string_split({c}, ' '))"
    share = f"len(list_intersect({toks('s.k')}, {toks('g.t')}))::DOUBLE / len({toks('s.k')})"
    out["segment_lookup"] = f"""WITH {pred}, c AS (SELECT id, metadata.case_id AS case_id, metadata.source_path AS p, metadata.chunk_index AS i, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL AND metadata.case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY metadata.case_id, metadata.source_path, metadata.chunk_index, text) = 1),
g AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY p, i, id) AS n, lower({sq('text')}) AS t FROM c), s AS (SELECT DISTINCT case_id, span_text AS span, lower({sq('span_text')}) AS k FROM p_flat WHERE span_text IS NOT NULL),
x AS (SELECT s.case_id, span, n, contains(g.t, s.k) AS e, {share} AS q FROM s JOIN g USING (case_id) WHERE s.k <> '')
SELECT case_id, span, n AS segment_index, CASE WHEN e THEN 'exact' ELSE 'tokens' END AS how FROM x WHERE e OR q >= 0.5 - 1e-12 QUALIFY row_number() OVER (PARTITION BY case_id, span ORDER BY e DESC, CASE WHEN e THEN 0 ELSE -q END, n) = 1"""
    # Replies and findings.
    out["reply_parsing"] = f"""WITH {pred} SELECT finding_id AS reply_id, (CASE WHEN pos % 5 = 3 OR (pos % 5 = 4 AND span_text IS NULL) THEN -1 ELSE 0 END)::BIGINT AS n, CASE WHEN pos % 5 < 3 THEN nullif(trim(subclass_id), '') END AS subclass, CASE WHEN pos % 5 < 3 THEN nullif(trim(span_text), '') END AS span_text,
CASE WHEN pos % 5 = 4 THEN nullif(trim(span_text), '') END AS rationale, CASE WHEN pos % 5 < 3 THEN array_to_string(coalesce(source_refs, []), '|') ELSE '' END AS refs FROM p_flat WHERE finding_id IS NOT NULL"""
    confirms = ["ist konsistent", "stimmt überein", "korrekt beschrieben", "entspricht den", "übereinstimmend", "keine abweichung", "ist korrekt", "keine fehler", "kein fehler", "ist richtig", "ist vollständig", "ist nachvollziehbar", "ist plausibel"]
    formulas = ["art. 307 stgb", "in kenntnis von", "nach bestem wissen", "gemäss auftrag", "mit schreiben", "wurde beauftragt"]
    has = lambda c, xs: "(" + " OR ".join(f"contains({c}, '{x}')" for x in xs) + ")"
    low, refs = f"lower({nn('rationale')})", "coalesce(source_refs, [])"
    drop = f"""CASE WHEN {sq(nn('span_text'))} = '' THEN 'no_span' WHEN {has(low, confirms)} THEN 'confirms' WHEN len({refs}) = 0 THEN 'no_reference'
 WHEN len(list_filter({refs}, lambda r: r <> 'DOC_INTERNAL')) = 0 AND ({has(f"lower({sq(nn('span_text'))})", formulas)} OR {has(low, formulas)}) THEN 'formula' WHEN subclass IS NULL THEN 'unknown_class' ELSE 'kept' END"""
    full = f"{pred}, {o.TAX}, {o._resolved('p')}"
    out["factual_normalise"] = f"""WITH {full} SELECT finding_id, subclass AS subclass_id, main_class AS main_class_id, coalesce(change_type, (SELECT min(x.id) FROM ct)) AS change_type_id, coalesce(severity, 'STUFE_2') AS severity_id, {drop} AS drop_reason FROM p"""
    cand = base["statement_candidates"].removeprefix("WITH ")
    head, tail = cand.rsplit("\nSELECT ", 1)
    # Of four orders one confirms; the others are linked by index or by text.
    out["statement_link"] = f"WITH {head}, cc AS (SELECT {tail}) SELECT id, sentence AS span_text, kind, 'zu sicher' AS rationale FROM cc WHERE id % 4 <> 3"
    tk = lambda c: f"list_distinct(string_split(lower({sq(c)}), ' '))"
    counter = r"nullif(trim(regexp_extract('Laut [S1_M_1]: ' || coalesce(correction, ''), ':\s*([^:]{3,80})$', 1)), '')"
    out["verified_findings"] = f"""WITH {gold}, x AS (SELECT *, {counter} AS cv FROM g_flat WHERE finding_id IS NOT NULL) SELECT finding_id FROM x
WHERE cv IS NULL OR (contains(lower(CASE WHEN pos % 2 = 0 THEN {nn('correction')} ELSE '' END), substr(lower(cv), 1, 60)) AND 1 - ({o._jaccard(tk(nn('span_text')), tk('cv'))}) >= 0.25)"""
    rank = "CASE severity WHEN 'STUFE_3' THEN 1 WHEN 'STUFE_2' THEN 2 WHEN 'STUFE_1' THEN 3 ELSE 4 END"
    out["severity_cap"] = f"WITH {full} SELECT finding_id FROM p QUALIFY row_number() OVER (PARTITION BY case_id, subclass ORDER BY {rank}, segment_id, pos, finding_id) <= 2"
    ev = base["evidence_numbering"].removeprefix("WITH ")
    head, tail = ev.rsplit("\nSELECT ", 1)
    out["evidence_join"] = f"""WITH {pred}, {head}, n AS (SELECT {tail}), ev AS (SELECT DISTINCT regexp_extract(z.query_id, '^(.*)_q\\d+_', 1) AS case_id, n.source_ref, z.id AS chunk_id, kinds.source_kind AS document FROM z JOIN n ON n.query_id = z.query_id AND n.id = z.id JOIN kinds ON kinds.query_id = z.query_id AND kinds.id = z.id WHERE n.source_ref IS NOT NULL),
f AS (SELECT case_id, finding_id, unnest(CASE WHEN len(source_refs) > 0 THEN source_refs WHEN pos % 2 = 0 THEN ['DOC_INTERNAL'] END) AS r FROM p_flat),
a AS (SELECT f.case_id, finding_id, r, chunk_id, document FROM f JOIN ev ON ev.case_id = f.case_id AND ev.source_ref = f.r WHERE r <> 'DOC_INTERNAL' UNION ALL SELECT case_id, finding_id, r, NULL, 'Dokumentinterner Widerspruch' FROM f WHERE r = 'DOC_INTERNAL')
SELECT finding_id, string_agg(DISTINCT r, '|' ORDER BY r) AS refs, coalesce(string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id), '') AS chunk_ids, string_agg(DISTINCT document, '|' ORDER BY document) AS documents FROM a GROUP BY case_id, finding_id"""
    names = "kn AS (SELECT case_id, list_sort(list_distinct(list(trim(p.name)))) AS names FROM (SELECT case_id, unnest(facts.personen) AS p FROM reference_facts) WHERE lower(trim(p.confidence)) IN ('high', 'medium') AND trim(p.name) <> '' GROUP BY case_id)"
    out["known_persons"] = f"WITH {names} SELECT case_id, array_to_string(names, '|') AS names FROM kn"
    touch = lambda c: f"len(list_filter(k, lambda n: contains(lower({c}), lower(n)) OR contains(lower(n), lower({c})))) > 0"
    issues = [
        ("original_empty", "o = ''"), ("original_not_in_text", "o <> '' AND NOT contains(t, o)"), ("injected_empty", "i = ''"), ("nothing_changed", "o <> '' AND o = i"), ("no_rationale", f"trim({nn('rationale')}) = ''"),
        ("no_known_persons", "person AND len(k) = 0"), ("person_unknown", f"person AND len(k) > 0 AND NOT ({touch('o')})"), ("injected_is_known", f"person AND len(k) > 0 AND {touch('i')}"),
    ]
    listed = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in issues) + "], lambda x: x IS NOT NULL)"
    out["proposal_validation"] = f"""WITH {gold}, {o.TAX}, {o._resolved('g')}, {names}, x AS (SELECT finding_id, rationale, trim({nn('span_text')}) AS o, trim({nn('correction')}) AS i, CASE WHEN pos % 2 = 0 THEN 'Vor ' || {nn('span_text')} || ' nach' ELSE {nn('correction')} END AS t,
coalesce(subclass = 'AUFBAU_ANGABEN', false) AS person, coalesce(kn.names, []) AS k FROM g LEFT JOIN kn USING (case_id) WHERE finding_id IS NOT NULL) SELECT finding_id, array_to_string({listed}, ',') AS issues FROM x"""
    targets = [("AUFBAU", 0.36), ("BELEG", 0.29), ("AUSSAGE", 0.14), ("SPRACHE", 0.14), ("ZAHL", 0.07)]
    of = lambda c, xs: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in xs) + " END"
    have = "(len(list_filter(f.made, lambda z: z = c))::DOUBLE / greatest(len(f.made), 1))"
    bonus = of("c", [(k, round((len(targets) - i) * 0.001, 3)) for i, (k, _) in enumerate(targets)])
    free = f"list_filter(r.av, lambda c: {have} <= 2 * {of('c', targets)})"
    worth = f"list_transform({free}, lambda c: round(({of('c', targets)} - {have} + {bonus})::DOUBLE, 12))"
    pick = f"({free})[list_position({worth}, list_max({worth}))]"
    out["class_budget"] = f"""WITH RECURSIVE {full}, a AS (SELECT case_id, segment_id, list_sort(list_distinct(list(main_class))) AS av FROM p WHERE main_class IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY segment_id) AS n FROM a),
f AS (SELECT case_id, 0::BIGINT AS n, NULL::VARCHAR AS segment_id, NULL::VARCHAR AS class, []::VARCHAR[] AS made FROM (SELECT DISTINCT case_id FROM r)
 UNION ALL SELECT r.case_id, r.n, r.segment_id, {pick}, CASE WHEN len({free}) = 0 THEN f.made ELSE list_append(f.made, {pick}) END FROM f JOIN r ON r.case_id = f.case_id AND r.n = f.n + 1)
SELECT case_id, segment_id, class FROM f WHERE n > 0"""
    own = ["correction", "rationale", "source_refs", "span_text", "severity", "change_type"]
    col = lambda c, i, n: f"CASE WHEN agent_scope = 'agent_{i}' THEN {c} END AS {n}"
    cols = ", ".join(col(c, i + 1, {"severity": "severity_id", "change_type": "change_type_id"}.get(c, c)) for i, c in enumerate(own) if c != "source_refs")
    out["report_union"] = f"WITH {full} SELECT 'R-' || case_id || '-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY segment_id, pos, finding_id)::VARCHAR, 4, '0') AS new_id, finding_id, {cols} FROM p WHERE subclass IS NOT NULL AND agent_scope IN ('agent_1', 'agent_2', 'agent_3', 'agent_4', 'agent_5', 'agent_6')"
    out["calculation_dedup"] = f"WITH {pred} SELECT finding_id FROM p_flat QUALIFY row_number() OVER (PARTITION BY case_id, segment_id, lower({sq(nn('span_text'))}), {nn('subclass_id')}, {nn('correction')} ORDER BY segment_id, pos, finding_id) = 1"
    # Retrieval.
    stop = words("""als am an auch aus bei bis dabei das dass dem den der des die dies diese dieser doch durch ein eine einem einen einer eines er es für habe haben hat hinter ich im in ist ja kann können mich mir mit muss
müssen nach noch nun oder sehr sein sind so soll sollen tue tun und unter vom von vor war was welche welcher welches wenn wer wie wir wird wo zu zum zur""".split())
    kws = f"list_filter(regexp_extract_all(lower(q), '[a-zäöüß0-9][a-zäöüß0-9\\-_/]+'), lambda x: length(x) >= 4 AND x NOT IN ({stop}))"
    asks = "regexp_matches(lower(q), 'wie |vorgehen|ablauf|prozess|schritte|checkliste')"
    out["query_variants"] = f"""WITH r AS (SELECT DISTINCT query_id, {sq('retrieval_query')} AS q FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL AND retrieval_query IS NOT NULL), m AS (SELECT *, unnest(['question', 'segment']) AS mode FROM r WHERE q <> ''), k AS (SELECT *, {kws} AS ks FROM m),
w AS (SELECT query_id, mode, q, array_to_string((list_filter(ks, lambda x, i: list_position(ks, x) = i))[1:8], ' ') AS kw FROM k),
v AS (SELECT query_id, mode, list_concat([q], CASE WHEN kw <> '' AND kw <> lower(q) THEN [kw] ELSE [] END, CASE WHEN kw <> '' AND (mode = 'segment' OR {asks}) THEN [kw || ' vorgehen', kw || ' schritte', kw || ' checkliste'] ELSE [] END) AS vs FROM w),
l AS (SELECT query_id, mode, (list_filter(vs, lambda x, i: list_position(list_transform(vs, lambda y: lower(y)), lower(x)) = i))[1:4] AS vs FROM v)
SELECT DISTINCT query_id, mode, unnest(range(len(vs)))::BIGINT AS n, unnest(vs) AS variant FROM l"""

    def mmr(pool: str, key: str, k: str) -> str:
        """Steps of a greedy choice over ``pool(key, id, score, source, vec)``; at most two of a source while others are left."""
        free = "list_filter(f.p, lambda x: len(list_filter(f.sel, lambda y: y.source = x.source)) < 2)"
        open_ = f"CASE WHEN len({free}) > 0 THEN {free} ELSE f.p END"
        sim = "coalesce(list_max(list_transform(f.sel, lambda y: CASE WHEN x.vec IS NULL OR y.vec IS NULL OR list_dot_product(x.vec, x.vec) = 0 OR list_dot_product(y.vec, y.vec) = 0 THEN 0.0 ELSE list_cosine_similarity(x.vec, y.vec) END)), 0.0)"
        return f"""pl AS (SELECT {key}, list({{'id': id, 'score': score, 'source': source, 'vec': vec}} ORDER BY score DESC, id) AS p FROM ({pool}) GROUP BY {key}),
st AS (SELECT {key}, p, p[1:0] AS sel, 0 AS n FROM pl UNION ALL
 SELECT {key}, list_filter(e.p, lambda x: x.id <> pick.id) AS p, list_append(e.sel, pick) AS sel, n + 1 AS n FROM (SELECT *, o[list_position(vs, list_max(vs))] AS pick FROM (SELECT *, list_transform(o, lambda x: round(0.75 * x.score - 0.25 * {sim.replace('f.sel', 'sel')}, 12)) AS vs FROM
 (SELECT *, {open_} AS o FROM st f WHERE len(f.p) > 0 AND n < {k}) f)) e),
ch AS (SELECT {key}, unnest(range(len(sel))) + 1 AS rank, unnest(sel) AS c FROM st QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC) = 1)"""

    vec = "CASE WHEN len(vec) = 96 THEN vec::DOUBLE[] END"
    best = f"""lc AS (SELECT id, metadata.source_path AS path FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY metadata.ingested_at_utc DESC) = 1),
b AS (SELECT query_id, id, source_kind, score, {vec} AS vec FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id{{}} ORDER BY score DESC, rank) = 1),
h AS (SELECT b.*, coalesce(nullif(trim(path), ''), b.id) AS source FROM b LEFT JOIN lc USING (id))"""
    out["mmr_select"] = f"WITH RECURSIVE {best.format('')}, {mmr('SELECT query_id, id, score, source, vec FROM h', 'query_id', '6')} SELECT query_id, rank::BIGINT AS rank, c.id AS id FROM ch"
    per = "CASE source_kind WHEN 'normbasis' THEN 3 ELSE 4 END"
    out["retrieval_chain"] = f"""WITH RECURSIVE {best.format(', source_kind')}, {mmr("SELECT * FROM h WHERE source_kind IN ('normbasis', 'case_material')", 'query_id, source_kind', per)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c.score DESC, source_kind, c.id) AS rank, c.id AS id, c.score AS score, source_kind FROM ch QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c.score DESC, source_kind, c.id) <= 6"""
    t = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))"
    near = f"len(list_filter(f.kept, lambda x: len(list_intersect(x, r.t)) >= 0.4 * (len(x) + len(r.t) - len(list_intersect(x, r.t))) - 1e-12 AND len(x) + len(r.t) > 0)) > 0 AND r.m > 2"
    out["material_dedup"] = f"""WITH RECURSIVE {o.LAST_CHUNK}, hh AS (SELECT query_id, id, max(score) AS score FROM retrieved WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
r AS (SELECT query_id, id, {t} AS t, count(*) OVER (PARTITION BY query_id) AS m, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM hh JOIN lc USING (id)),
f AS (SELECT query_id, 0::BIGINT AS n, []::VARCHAR[][] AS kept, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM r)
 UNION ALL SELECT r.query_id, r.n, CASE WHEN {near} THEN f.kept ELSE list_append(f.kept, r.t) END, CASE WHEN {near} THEN f.ids ELSE list_append(f.ids, r.id) END FROM f JOIN r ON r.query_id = f.query_id AND r.n = f.n + 1),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1) SELECT query_id, unnest(ids) AS id FROM l"""
    pv = sq("text")
    out["case_listing"] = f"SELECT DISTINCT metadata.source_path AS source_path, metadata.chunk_index::BIGINT AS chunk_index, id, CASE WHEN length({pv}) > 80 THEN rtrim(substr({pv}, 1, 79)) || '…' ELSE {pv} END AS preview FROM chunks WHERE metadata.case_id = 'case_000010' AND text IS NOT NULL"
    white = "[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    out["composed_text"] = f"WITH {o.CHUNKS} SELECT id, sha256(trim(regexp_replace(nfc_normalize(replace(text, chr(173), '')), '{white}', ' ', 'g'))) AS text_hash FROM c"
    out["document_header"] = f"WITH {o.CHUNKS} SELECT id, array_to_string((list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))[1:3], chr(10)) AS header FROM c"
    out["model_review"] = base["forbidden_terms"]
    out["model_vectors"] = f"WITH {o.CHUNKS} SELECT id, CASE WHEN trim(text) <> '' THEN 32 END::BIGINT AS dim, CASE WHEN trim(text) <> '' THEN 1.0 END::DOUBLE AS norm FROM c"
    return out
