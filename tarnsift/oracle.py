"""The same results in DuckDB's SQL, by joins over positions where the operators work within rows."""

from __future__ import annotations

from .base import load
from .base.techniques import DESCRIPTIONS
from .functions import text as T
from . import oracle_tables as OT
from .operators import guard as G
from .plans import fixtures as X


def q(s) -> str:
    return "NULL" if s is None else str(s) if isinstance(s, int | float) else "'" + s.replace("'", "''") + "'"


def values(rows, name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)})"


def _planted(injected=X.PLAIN, misses=X.MISSES) -> str:
    lists = [("injected", i, *p) for i, p in enumerate(injected)] + [("near_miss", i, *p) for i, p in enumerate(misses)]
    return f"""{values(lists, "payloads", "kind, nth, payload_id, mode, action, form, payload")},
pd AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 10 < 5 THEN 'injected' WHEN doc_id % 10 = 5 THEN 'near_miss' ELSE 'clean' END AS label,
  CASE WHEN doc_id % 10 < 5 THEN (doc_id // 10) % {len(injected)} WHEN doc_id % 10 = 5 THEN (doc_id // 10) % {len(misses)} END AS n,
  CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN strpos(text, chr(10)) ELSE length(coalesce(text, '')) END AS p, CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) ELSE chr(10) END AS sep FROM documents),
planted AS (SELECT doc_id AS doc_key, CASE WHEN payload IS NOT NULL THEN substr(t, 1, p) || sep || payload || sep || substr(t, p + 1) ELSE t END AS text, label,
  CAST(payload_id AS BIGINT) AS payload_id, mode, action, form, payload, CASE WHEN payload IS NOT NULL THEN CAST(p + length(sep) AS BIGINT) END AS inj_lo, CASE WHEN payload IS NOT NULL THEN CAST(p + length(sep) + length(payload) AS BIGINT) END AS inj_hi
  FROM pd LEFT JOIN payloads ON kind = label AND nth = n)"""


def _spans(source: str, name: str, pattern: str, column: str = "low", extra: str = "", where: str = "") -> str:
    """CTE of (doc_key, pos, lo, hi, s) of a pattern's matches."""
    p = q(pattern)
    return f"""{name} AS (SELECT doc_key{extra}, pos, CAST(hi - length(s) AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, s FROM (
  SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_key{extra} ORDER BY pos) AS hi FROM (
    SELECT doc_key{extra}, unnest(string_split_regex({column}, {p})) AS gap, unnest(regexp_extract_all({column}, {p})) AS s, generate_subscripts(string_split_regex({column}, {p}), 1) AS pos FROM {source} {where}) WHERE s IS NOT NULL))"""


def _entities(column: str = "low", source: str = "d") -> str:
    parts, kinds = [], {}
    for i, (kind, pattern) in enumerate(OT.ENTITIES):
        parts.append(_spans(source, f"e{i}", pattern, column))
        kinds.setdefault(kind, []).append(i)
    for kind, of in kinds.items():
        taken = []
        for i in of:
            free = "".join(f" AND NOT EXISTS (SELECT 1 FROM k{j} o WHERE o.doc_key = x.doc_key AND x.lo < o.hi AND o.lo < x.hi)" for j in taken)
            lo = "lo + CASE WHEN s[1] IN (' ', chr(9), chr(10), chr(12), chr(13)) THEN 1 ELSE 0 END" if kind == "FILE_PATH" else "lo"
            # RE2's word edge knows ASCII letters only: a blank before another letter ends a number too.
            hi = rf"hi + CASE WHEN regexp_matches(substr({column}, CAST(hi + 1 AS BIGINT), 2), '^[ -][\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr({column}, CAST(hi + 2 AS BIGINT), 1), '[A-Za-z0-9]') THEN 1 ELSE 0 END" if i == 4 else "hi"
            parts.append(f"k{i} AS (SELECT x.doc_key, x.lo, {i} AS prio, x.hi, {q(kind)} AS kind, lower(trim(substr(t, CAST(x.lo + 1 AS BIGINT), x.hi - x.lo))) AS value FROM (SELECT e.doc_key, {lo} AS lo, {hi} AS hi, {column} AS t FROM e{i} e JOIN {source} USING (doc_key)) x WHERE length(trim(substr(t, CAST(x.lo + 1 AS BIGINT), x.hi - x.lo))) >= 4{free})")
            taken.append(i)
    every = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(OT.ENTITIES)))
    return ",\n".join(parts) + f",\nents AS MATERIALIZED (SELECT doc_key, CAST(lo AS BIGINT) AS lo, prio, CAST(hi AS BIGINT) AS hi, kind, value FROM ({every}))"


_FOLD = f"""
fk AS (SELECT doc_key, list_reduce(list(list_value({{'lo': lo, 'hi': hi}}) ORDER BY lo, prio, hi, kind, value), lambda a, b: CASE WHEN a[len(a)].hi <= b[1].lo THEN list_concat(a, b) ELSE a END) AS kept FROM ents GROUP BY doc_key),
fe AS (SELECT doc_key, unnest(kept).lo AS lo, unnest(kept).hi AS hi FROM fk),
fp AS (SELECT doc_key, lo, hi, substr(low, coalesce(lag(hi) OVER (PARTITION BY doc_key ORDER BY lo), 0) + 1, lo - coalesce(lag(hi) OVER (PARTITION BY doc_key ORDER BY lo), 0)) || repeat('{T.FOLDED}', hi - lo) AS piece FROM fe JOIN d USING (doc_key)),
fm AS (SELECT doc_key, string_agg(piece, '' ORDER BY lo) AS head, max(hi) AS tail_at FROM fp GROUP BY doc_key),
m AS MATERIALIZED (SELECT doc_key, CASE WHEN head IS NULL THEN low ELSE head || substr(low, tail_at + 1) END AS masked FROM d LEFT JOIN fm USING (doc_key))"""


def _scan(mode: str = "ipi", source: str = "planted") -> str:
    """Up to the fired rules, over a CTE with doc_key and text."""
    base = load()
    rules = base.active(mode)
    word = r"[\p{L}\p{N}_]"
    least = dict(base.thresholds).get(mode)
    return f"""d AS MATERIALIZED (SELECT doc_key, text, lower(coalesce(text, '')) AS low FROM {source}),
{_entities()},{_FOLD},
{values(base.literals, "lits", "slot, literal")},
lr AS (SELECT doc_key, slot, low, literal, sum(length(gap) + length(literal)) OVER (PARTITION BY doc_key, slot, literal ORDER BY pos) AS hi, n, pos FROM (
  SELECT doc_key, slot, literal, low, unnest(string_split(low, literal)) AS gap, generate_subscripts(string_split(low, literal), 1) AS pos, len(string_split(low, literal)) AS n FROM d JOIN lits ON contains(low, literal))),
lh AS MATERIALIZED (SELECT doc_key, slot, CAST(hi - length(literal) AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM lr WHERE pos < n AND NOT regexp_matches(substr(low, CAST(hi - length(literal) AS BIGINT), CASE WHEN hi = length(literal) THEN 0 ELSE 1 END), {q(word)}) AND NOT regexp_matches(substr(low, CAST(hi + 1 AS BIGINT), 1), {q(word)})),
hits AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT doc_key, slot, lo, hi FROM lh WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_key = lh.doc_key AND e.lo <= lh.lo AND lh.hi <= e.hi) UNION ALL SELECT doc_key, kind, lo, hi FROM ents WHERE kind IN ({", ".join(map(q, base.entity_slots))}))),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS pair, h.doc_key, h.slot AS anchor, g.slot AS filler, h.lo, g.hi, h.hi AS a, g.lo AS right_lo, substr(masked, h.hi + 1, g.lo - h.hi) AS gap, substr(masked, h.lo + 1, g.lo - h.lo) AS reach FROM hits h JOIN hits g ON h.doc_key = g.doc_key AND g.lo >= h.hi JOIN m ON m.doc_key = h.doc_key),
near AS MATERIALIZED (SELECT pair, pair AS doc_key, doc_key AS doc, anchor, filler, lo, hi, a, right_lo, gap, len(regexp_extract_all(gap, {q(T.TOKEN)})) AS n FROM pairs WHERE len(regexp_extract_all(gap, {q(T.TOKEN)})) <= 8 AND len(regexp_extract_all(reach, {q(T.TOKEN)})) <= 9 AND NOT regexp_matches(gap, {q(T.PARAGRAPH)})),
{_spans("near", "gt", T.TOKEN, "gap")},
free AS (SELECT pair, string_agg(CASE WHEN s[1] = '{T.FOLDED}' THEN '<entity>' ELSE s END, '_' ORDER BY gt.lo) AS conn, count(*) AS n_free FROM gt JOIN near ON near.pair = gt.doc_key WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.doc_key = near.doc AND near.a + gt.lo < x.hi AND near.a + gt.hi > x.lo) GROUP BY pair),
edges AS MATERIALIZED (SELECT doc AS doc_key, anchor, filler, CASE WHEN n + 1 <= 3 THEN CAST(n + 1 AS VARCHAR) WHEN n + 1 <= 5 THEN '4-5' ELSE '6-8' END AS dist, CASE WHEN coalesce(n_free, 0) <= 3 THEN coalesce(conn, '') ELSE '~' END AS conn, lo, hi, right_lo FROM near LEFT JOIN free USING (pair)),
{values([(r.index, r.threat, r.severity, r.aperture, r.aperture_frac, len(r.edges)) for r in rules], "rules", "rule, threat, severity, aperture, aperture_frac, n_edges")},
{values([(r.index, k, *e) for r in rules for k, e in enumerate(r.edges)], "rule_edges", "rule, edge_no, anchor, filler, dist, conn")},
{values(base.refuting, "refuting", "anchor, filler, dist, conn, weight")},
ref AS (SELECT doc_key, sum(weight) AS mass FROM (SELECT DISTINCT doc_key, anchor, filler, dist, conn, weight FROM edges JOIN refuting USING (anchor, filler, dist, conn)) GROUP BY doc_key HAVING sum(weight) >= {1e9 if least is None else least}),
named AS (SELECT DISTINCT doc_key, rule, edge_no, lo, hi FROM edges JOIN rule_edges USING (anchor, filler, dist, conn)),
placed AS (SELECT doc_key, rule, hi - lo AS hull, lo, hi FROM named JOIN rules USING (rule) WHERE n_edges = 1
  UNION ALL SELECT x.doc_key, x.rule, greatest(x.hi, y.hi) - least(x.lo, y.lo), least(x.lo, y.lo), greatest(x.hi, y.hi) FROM named x JOIN named y ON x.doc_key = y.doc_key AND x.rule = y.rule AND x.edge_no = 0 AND y.edge_no = 1 JOIN rules r ON r.rule = x.rule WHERE n_edges = 2),
best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY doc_key, rule ORDER BY hull, lo DESC) = 1),
{_spans("d", "br", T.PARAGRAPH, "text")},
fired AS MATERIALIZED (SELECT b.doc_key, CAST(b.rule AS BIGINT) AS rule, threat, severity, b.hull, b.lo, b.hi FROM best b JOIN rules r ON r.rule = b.rule JOIN d ON d.doc_key = b.doc_key
  WHERE (aperture IS NULL OR hull <= aperture) AND b.doc_key NOT IN (SELECT doc_key FROM ref)
  AND (aperture_frac IS NULL OR hull <= aperture_frac * greatest(1, coalesce((SELECT min(lo) FROM br WHERE br.doc_key = b.doc_key AND br.lo > b.lo), length(d.text)) - coalesce((SELECT max(lo) FROM br WHERE br.doc_key = b.doc_key AND br.lo <= b.lo), 0)))),
{_grown("fired", "shown", 0)}"""


def _grown(source: str, name: str, pad: int) -> str:
    grow, word = max(-50, pad) + 50, r"[\p{L}\p{N}_]"
    return f"""{name} AS MATERIALIZED (SELECT doc_key, rule, threat, severity, hull, lo, hi,
  a - CASE WHEN a > 0 AND regexp_matches(substr(text, a + 1, 1), {q(word)}) THEN length(regexp_extract(substr(text, 1, a), {q(word + "+$")})) ELSE 0 END AS span_lo,
  b + CASE WHEN b > 0 AND regexp_matches(substr(text, b, 1), {q(word)}) THEN length(regexp_extract(substr(text, b + 1), {q("^" + word + "+")})) ELSE 0 END AS span_hi
  FROM (SELECT f.*, text, greatest(0, lo - {grow}) AS a, least(length(text), hi + {grow}) AS b FROM {source} f JOIN d USING (doc_key)))"""


_SEV = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_RANK = "CASE regexp_extract(threat, '^IPI/([A-Za-z]+[.][A-Za-z]+)', 1) " + " ".join(f"WHEN '{f}.{t}' THEN {i}" for i, f, t in sorted({(i, f, t) for i, _, f, t, _ in OT.TECHNIQUES})) + f" ELSE {OT.LAST_RANK} END"


def _islands(source: str, name: str, lo: str, hi: str, order: str = "") -> str:
    return f"""{name} AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_key ORDER BY {lo}, {hi}{order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
  SELECT *, CASE WHEN {lo} <= max({hi}) OVER (PARTITION BY doc_key ORDER BY {lo}, {hi}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source}))"""


def _merged(source: str = "shown") -> str:
    return f"""{_islands(source, "isl", "span_lo", "span_hi", ", rule")},
heads AS (SELECT *, row_number() OVER (PARTITION BY doc_key, island ORDER BY {_SEV}, {_RANK}, span_hi - span_lo, threat) AS nth, first_value(threat) OVER (PARTITION BY doc_key, island ORDER BY {_SEV}, {_RANK}, span_hi - span_lo, threat) AS head FROM isl),
merged AS MATERIALIZED (SELECT doc_key, island, CAST(min(span_lo) AS BIGINT) AS lo, CAST(max(span_hi) AS BIGINT) AS hi, max(CASE WHEN nth = 1 THEN threat END) AS threat, max(CASE WHEN nth = 1 THEN severity END) AS severity,
  coalesce(string_agg(DISTINCT CASE WHEN threat <> head THEN threat END, ',' ORDER BY CASE WHEN threat <> head THEN threat END), '') AS also, string_agg(DISTINCT CAST(rule AS VARCHAR), ',' ORDER BY CAST(rule AS VARCHAR)) AS refs, count(*) AS merged FROM heads GROUP BY doc_key, island)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_ONE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


SQL: dict[str, str] = {}
_P = _planted()
_S = _scan()
_RAW = _grown("fired", "raw", -50)
_D = "d AS (SELECT doc_id AS doc_key, text, lower(coalesce(text, '')) AS low FROM documents)"
_PAGES = "d AS (SELECT page_id AS doc_key, html AS text, lower(coalesce(html, '')) AS low FROM pages)"

SQL["planted_corpus"] = _with(_P) + "SELECT doc_key, md5(text) AS text_md5, label, payload_id, mode, action, form, inj_lo, inj_hi FROM planted"
_TURNS = f"""pt AS (SELECT conv_id, turn, role, coalesce(attack, false) AS attack, CASE WHEN attack AND conv_id % 8 < 4 THEN {q(X.PAYLOADS[4][4])} WHEN attack THEN {q(X.PAYLOADS[5][4])} ELSE text END AS text FROM (
  SELECT *, (conv_id % 4 = 0 AND role = 'user' AND turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)) OR (conv_id % 4 = 1 AND role = 'user' AND turn = min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)) OR (conv_id % 4 = 2 AND role = 'system') AS attack FROM conversations))"""
SQL["planted_dialogue"] = _with(_TURNS) + "SELECT conv_id, turn, role, md5(text) AS text_md5, attack FROM pt"
SQL["norm_hygiene"] = _with(_planted(X.HIDDEN)) + r"SELECT doc_key, md5(regexp_replace(regexp_replace(text, '[\x{200B}]', '', 'g'), '[\p{Z}]+', ' ', 'g')) AS text_md5, length(regexp_replace(regexp_replace(text, '[\x{200B}]', '', 'g'), '[\p{Z}]+', ' ', 'g')) AS n FROM planted"
SQL["norm_homoglyph"] = _with(_planted(X.HIDDEN), _spans("planted", "w", T.WORD, "text")) + f"SELECT doc_key, lo, hi, s AS token, translate(s, {q(T.LOOKALIKE)}, {q(T.LATIN)}) AS latin FROM w WHERE regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, {q('[' + T.LOOKALIKE + ']')})"
SQL["tokens_offsets"] = _with(_D, _spans("d", "t", T.TOKEN)) + "SELECT doc_key, count(*) AS n, CAST(sum(lo) AS BIGINT) AS sum_lo, CAST(sum(hi) AS BIGINT) AS sum_hi, min(s) AS least, max(s) AS greatest FROM t GROUP BY doc_key"
SQL["word_offsets"] = _with(_D, _spans("d", "t", T.WORD)) + "SELECT doc_key, count(*) AS n, CAST(sum(lo) AS BIGINT) AS sum_lo, CAST(max(hi) AS BIGINT) AS end_hi FROM t GROUP BY doc_key"
SQL["paragraphs"] = _with(_P, _spans("planted", "t", T.PARAGRAPH, "text")) + "SELECT doc_key, pos AS nth, lo, hi FROM t"
_E = _entities()
for _name, _kind in (("ent_email", "EXTERNAL_ADDR"), ("ent_url", "URL_REF"), ("ent_account", "ACCOUNT_REF"), ("ent_code_exec", "CODE_EXEC"), ("ent_path", "FILE_PATH")):
    SQL[_name] = _with(_P, "d AS (SELECT doc_key, text, lower(text) AS low FROM planted)", _E) + f"SELECT doc_key, lo, hi, value FROM ents WHERE kind = '{_kind}'"
SQL["entities_pages"] = _with(_PAGES, _E) + "SELECT doc_key, lo, hi, kind, value FROM ents"
SQL["entities_raw"] = _with(_D, _entities("text")) + "SELECT doc_key, lo, hi, kind, value FROM ents"
_DOM = r"lower(regexp_extract(split_part(regexp_replace(CASE WHEN contains(value, '@') THEN regexp_extract(value, '[^@]*$') ELSE value END, '^[a-z]+://', ''), '/', 1), '[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+'))"
SQL["entity_domains"] = _with(_PAGES, _E) + f"SELECT kind, {_DOM} AS domain, count(*) AS n FROM ents GROUP BY 1, 2"
SQL["entity_novelty"] = _with(_PAGES, _E) + f"SELECT e.doc_key, lo, hi, kind, count(*) OVER (PARTITION BY e.doc_key, value) = 1 AND (length(low) - length(replace(low, value, ''))) // length(value) <= 1 AS novel, domain <> '' AND count(*) OVER (PARTITION BY e.doc_key, domain) = 1 AND (length(low) - length(replace(low, domain, ''))) // greatest(1, length(domain)) <= 1 AS domain_novel FROM (SELECT *, {_DOM} AS domain FROM ents) e JOIN d USING (doc_key)"
SQL["literal_hits"] = _with(_P, _S) + "SELECT doc_key, slot, lo, hi FROM lh"
SQL["hits_atomic"] = _with(_P, _S) + "SELECT doc_key, slot, lo, hi FROM hits"
SQL["slot_frequency"] = _with(_P, _S) + "SELECT slot, count(*) AS n, count(DISTINCT doc_key) AS docs FROM hits GROUP BY slot"
SQL["edges_canonical"] = _with(_P, _S) + "SELECT doc_key, anchor, filler, dist, conn, lo, hi FROM edges"
SQL["edge_connectives"] = _with(_P, _S) + "SELECT anchor, filler, dist, conn, count(*) AS n FROM edges GROUP BY 1, 2, 3, 4"
SQL["edges_pruned"] = _with(_P, _S) + "SELECT anchor, filler, dist, conn, count(*) AS n FROM edges GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"
SQL["edges_needed"] = _with(_P, _S) + "SELECT DISTINCT doc_key, CAST(rule AS BIGINT) AS rule, CAST(edge_no AS BIGINT) AS edge_no, lo, hi FROM named"
for _m in ("ipi", "dpi"):
    SQL[f"rules_fired_{_m}"] = _with(_P, _scan(_m)) + "SELECT doc_key, rule, threat, severity, hull, lo, hi FROM fired"
SQL["rule_min_hull"] = _with(_P, _S) + "SELECT doc_key, CAST(rule AS BIGINT) AS rule, hull, lo, hi FROM best"
SQL["rule_refutation"] = _with(_P, _S) + "SELECT doc_key, CAST(mass AS DOUBLE) AS mass FROM ref"
SQL["spans_padded"] = _with(_P, _S) + "SELECT doc_key, rule, CAST(span_lo AS BIGINT) AS span_lo, CAST(span_hi AS BIGINT) AS span_hi FROM shown"
SQL["findings_merged"] = _with(_P, _S, _merged()) + "SELECT doc_key, island, lo, hi, threat, severity, also, refs, merged FROM merged"
_REPORT = f"""report AS (SELECT p.doc_key, g.doc_key IS NOT NULL AS flagged, coalesce(n, 0) AS n_findings, severity, coalesce(threats, '') AS threats, lo, hi FROM planted p LEFT JOIN (
  SELECT doc_key, count(*) AS n, CASE min({_SEV}) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS severity, string_agg(threat, ',' ORDER BY island) FILTER (nth = 1) AS threats, min(lo) AS lo, max(hi) AS hi
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, threat ORDER BY island) AS nth FROM merged) GROUP BY doc_key) g USING (doc_key))"""
SQL["report_docs"] = _with(_P, _S, _merged(), _REPORT) + "SELECT doc_key, flagged, n_findings, severity, threats, lo, hi FROM report"
SQL["report_totals"] = _with(_P, _S, _merged(), _REPORT) + "SELECT count(*) AS docs, CAST(sum(n_findings) AS BIGINT) AS findings, count(*) FILTER (flagged) AS flagged, count(*) FILTER (severity = 'high') AS high FROM report"
_BASE = load()
_RULES = values([(r.index, r.threat, r.severity) for r in _BASE.rules], "rules", "rule, threat, severity")
_EDGES = values([(r.index, k, *e) for r in _BASE.rules for k, e in enumerate(r.edges)], "rule_edges", "rule, edge_no, anchor, filler, dist, conn")
SQL["catalog"] = _with(_RULES, values(DESCRIPTIONS.items(), "said", "name, said")) + f"SELECT threat, arg_min(severity, {_SEV}) AS severity, regexp_extract(threat, '^[A-Z]+/([A-Za-z]+)[.]([A-Za-z]+)', 1) AS family, regexp_extract(threat, '^[A-Z]+/([A-Za-z]+)[.]([A-Za-z]+)', 2) AS technique, coalesce(any_value(said), '') AS description, count(*) AS n_rules, string_agg(CAST(rule AS VARCHAR), ',' ORDER BY rule) AS rules FROM rules LEFT JOIN said ON name = regexp_extract(threat, '^[A-Z]+/([A-Za-z]+[.][A-Za-z]+)', 1) GROUP BY threat"
SQL["threat_rank"] = _with(_RULES) + f"SELECT DISTINCT threat, CAST({_RANK} AS BIGINT) AS rank FROM rules"
SQL["rule_signatures"] = _with(_EDGES) + "SELECT CAST(rule AS BIGINT) AS rule, string_agg(anchor || '|' || filler || '|R|' || dist || '|' || conn, '&' ORDER BY anchor || '|' || filler || '|R|' || dist || '|' || conn) AS signature FROM rule_edges GROUP BY rule"
SQL["technique_of_rule"] = _with(_EDGES, values(OT.TECHNIQUES, "tech", "ord, slot, family, technique, severity")) + """SELECT CAST(rule AS BIGINT) AS rule, coalesce(arg_min(family, ord), 'Generic') AS family, coalesce(arg_min(technique, ord), 'Relation') AS technique, coalesce(arg_min(tech.severity, ord), 'medium') AS severity
FROM (SELECT rule, anchor AS slot FROM rule_edges UNION SELECT rule, filler FROM rule_edges) s LEFT JOIN tech USING (slot) GROUP BY rule"""
BASE_NAMES = ("engine_v1_20261101_b1.json", "engine_v2_20261101_b1.json", "engine_v3_20261031_b9.json", "engine_v2_20261101_b3.json", "rule_v9_20270101_b1.json", "engine_v2_2026_b1.json", "notes.json")
SQL["pick_base"] = _with(values([(n,) for n in BASE_NAMES], "names", "name")) + r"SELECT name FROM names WHERE regexp_full_match(name, '(rule|engine)_v(\d+)_(\d{8})_b(\d+)\.json') AND CAST(regexp_extract(name, '_v(\d+)_', 1) AS INT) <= 3 ORDER BY regexp_extract(name, '_(\d{8})_', 1) DESC, CAST(regexp_extract(name, '_v(\d+)_', 1) AS INT) DESC, CAST(regexp_extract(name, '_b(\d+)', 1) AS INT) DESC LIMIT 1"
VERBS = ("trim", "carry out", "vanish", "rely", "obey", "move on", "do", "set aside", "fix", "plan ahead", "forget", "stop following", "leave out", "take no notice of", "pay no attention to", "go", "x-ray", "pass", "buzz", "reach", "agree")
SQL["dict_expand_inflect"] = _with(values([(v,) for v in VERBS], "verbs", "phrase"), values(OT.IRREGULAR_FORMS, "irr", "phrase, form")) + r"""
, h AS (SELECT phrase, regexp_extract(phrase, '^[^ ]+') AS v, substr(phrase, length(regexp_extract(phrase, '^[^ ]+')) + 1) AS rest FROM verbs WHERE phrase NOT IN (SELECT phrase FROM irr)),
ok AS (SELECT * FROM h WHERE length(v) >= 3 AND regexp_full_match(v, '[a-z]+')),
s AS (SELECT phrase, v || CASE WHEN regexp_matches(v, '(s|x|z|ch|sh)$') THEN 'es' ELSE 's' END || rest AS form FROM ok),
e AS (SELECT phrase, unnest([v || 'd' || rest, v[:-2] || 'ing' || rest]) AS form FROM ok WHERE v[-1] = 'e'),
y AS (SELECT phrase, unnest([v[:-2] || 'ied' || rest, v || 'ing' || rest]) AS form FROM ok WHERE regexp_matches(v, '[^aeiou]y$')),
r AS (SELECT phrase, unnest([v || 'ed' || rest, v || 'ing' || rest]) AS form FROM ok WHERE v[-1] <> 'e' AND NOT regexp_matches(v, '[^aeiou]y$')),
b AS (SELECT phrase, unnest([v || v[-1] || 'ed' || rest, v || v[-1] || 'ing' || rest]) AS form FROM ok WHERE regexp_matches(v, '[^aeiou][aeiou][^aeiouwxy]$'))
SELECT DISTINCT phrase, form FROM (SELECT * FROM s UNION ALL SELECT * FROM e UNION ALL SELECT * FROM y UNION ALL SELECT * FROM r UNION ALL SELECT * FROM b UNION ALL SELECT irr.* FROM irr JOIN verbs USING (phrase))"""

# Guard
_CUT = r"regexp_replace({0}, '\s+$', '')"
_WRAPS = "(length(" + _CUT + r") >= 40 AND regexp_matches(" + _CUT + r", '[\p{{L}}\p{{N}},;:\-—]$'))"
_ENDS = "regexp_matches(" + _CUT + r", '[.!?…\"'')]$')"
_FIRST = "coalesce(nullif(list_position({0}, {1}), 0), len({0}) + 1)"
_RAWM = _merged("raw").replace("isl AS", "risl AS").replace("FROM isl)", "FROM risl)").replace("heads AS", "rheads AS").replace("FROM heads", "FROM rheads").replace("merged AS MATERIALIZED", "rmerged AS MATERIALIZED")
_GROWN = f"""{_RAWM},
g1 AS (SELECT m.doc_key, m.island, m.lo, m.hi, text, substr(text, 1, lo) AS head, substr(text, hi + 1) AS tail, list_reverse(string_split(substr(text, 1, lo), chr(10))) AS up, string_split(substr(text, hi + 1), chr(10)) AS down FROM rmerged m JOIN d USING (doc_key)),
g2 AS (SELECT *, lo - length(up[1]) AS a, hi + length(down[1]) AS b, up[2:9] AS u, down[2:9] AS w FROM g1),
g3 AS (SELECT *, {_WRAPS.format("regexp_extract(substr(text, 1, b), '[^\\n]*$')")} AS joins, {_FIRST.format("list_transform(u, lambda x: " + _WRAPS.format("x") + ")", "false")} - 1 AS nu,
  least({_FIRST.format("list_transform(w, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '' AND (" + _WRAPS.format("x") + " OR " + _ENDS.format("x") + "))", "false")} - 1, {_FIRST.format("list_transform(w, lambda x: " + _WRAPS.format("x") + ")", "false")}) AS nd FROM g2),
g4 AS (SELECT *, a - coalesce(list_sum(list_transform(u[1:nu], lambda x: length(x) + 1)), 0) AS wa, b + CASE WHEN joins THEN coalesce(list_sum(list_transform(w[1:nd], lambda x: length(x) + 1)), 0) ELSE 0 END AS wb FROM g3),
g5 AS MATERIALIZED (SELECT doc_key, lo, hi, CAST(CASE WHEN wb - wa <= 1500 THEN wa WHEN b - a <= 1500 THEN a ELSE length(regexp_extract(head, '^((?s:.*)[.!?…])\\s', 1)) END AS BIGINT) AS block_lo,
  CAST(CASE WHEN wb - wa <= 1500 THEN wb WHEN b - a <= 1500 THEN b WHEN regexp_matches(tail, '[.!?…](?:\\s|$)') THEN hi + length(regexp_extract(tail, '^((?s:.*?)[.!?…])(?:\\s|$)', 1)) ELSE length(text) END AS BIGINT) AS block_hi FROM g4)"""
SQL["guard_boundary"] = _with(_P, _S, _RAW, _GROWN) + "SELECT doc_key, lo, hi, block_lo, block_hi FROM g5"
_BL = _GROWN + ",\n" + _islands("g5", "bi", "block_lo", "block_hi").replace(" AS island", " AS bisland") + ",\nbm AS MATERIALIZED (SELECT doc_key, bisland, min(block_lo) AS lo, max(block_hi) AS hi FROM bi GROUP BY doc_key, bisland)"
_PIECES = """gp AS (SELECT b.doc_key, lo, hi, substr(text, coalesce(lag(hi) OVER (PARTITION BY b.doc_key ORDER BY lo), 0) + 1, lo - coalesce(lag(hi) OVER (PARTITION BY b.doc_key ORDER BY lo), 0)) AS before FROM bm b JOIN d USING (doc_key)),
gb AS (SELECT doc_key, string_agg(before || {fill}, '' ORDER BY lo) AS head, max(hi) AS tail_at, sum(hi - lo) AS removed FROM gp GROUP BY doc_key)"""


def _edited(policy: str, fill: str) -> str:
    return _with(_P, _S, _RAW, _BL, _PIECES.format(fill=fill)) + f"""SELECT d.doc_key, gb.doc_key IS NOT NULL AS flagged, {"trim(CASE WHEN gb.doc_key IS NULL THEN 'x' ELSE regexp_replace(head || substr(text, tail_at + 1), '[ \\t\\n\\r]+', '', 'g') END) <> ''" if policy == "mask" else "true"} AS keep,
md5(CASE WHEN gb.doc_key IS NULL THEN text ELSE head || substr(text, tail_at + 1) END) AS text_md5, CAST(coalesce(removed, 0) AS BIGINT) AS removed FROM d LEFT JOIN gb USING (doc_key)"""


SQL["guard_blank"] = _edited("blank", "repeat('#', hi - lo)")
SQL["guard_mask"] = _edited("mask", "'[cut]'")
SQL["guard_metadata"] = _with(_P, _S, _RAW, _BL) + f"""SELECT d.doc_key, f.doc_key IS NOT NULL AS flagged, CASE WHEN f.doc_key IS NULL THEN 'none' ELSE 'mask' END AS action, '{load().version}' AS base, threats, spans, removed AS removed_chars FROM d LEFT JOIN (
  SELECT doc_key, string_agg(threat, ',' ORDER BY lo) FILTER (nth = 1) AS threats, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, threat ORDER BY lo) AS nth FROM rmerged) GROUP BY doc_key) f USING (doc_key)
  LEFT JOIN (SELECT doc_key, CAST(sum(hi - lo) AS BIGINT) AS removed FROM bm GROUP BY doc_key) USING (doc_key)"""
_MASKED = _PIECES.format(fill="'[cut]'") + ",\nmk AS MATERIALIZED (SELECT p.*, CASE WHEN gb.doc_key IS NULL THEN p.text ELSE head || substr(p.text, CAST(tail_at + 1 AS BIGINT)) END AS out FROM planted p LEFT JOIN gb USING (doc_key))"
SQL["survival_damage"] = _with(_P, _S, _RAW, _BL, _MASKED) + f"""SELECT count(*) FILTER (label = 'injected') AS payloads, count(*) FILTER (label = 'injected' AND contains(was, pay)) AS intact_before, count(*) FILTER (label = 'injected' AND contains(now, pay)) AS intact_after,
count(*) FILTER (label = 'injected' AND NOT contains(now, pay) AND len(list_filter(range(0, greatest(0, length(pay) - least_run + 1)), lambda i: contains(now, substr(pay, i + 1, least_run)))) = 0) AS gone_after,
count(*) FILTER (label <> 'injected') AS clean, count(*) FILTER (label <> 'injected' AND length(now) / greatest(1, length(was))::DOUBLE < 0.01) AS clean_dropped, count(*) FILTER (label <> 'injected' AND length(now) / greatest(1, length(was))::DOUBLE >= 0.01 AND length(now) / greatest(1, length(was))::DOUBLE < 0.999) AS clean_trimmed
FROM (SELECT *, greatest(25, CAST(ceil(0.1 * length(pay)) AS BIGINT)) AS least_run FROM (SELECT label, {_ONE.format("text")} AS was, {_ONE.format("out")} AS now, {_ONE.format("coalesce(payload, '')")} AS pay FROM mk))"""
_TOOL = "tl AS (SELECT doc_key AS message_id, ['search', 'mail', 'clock'][doc_key % 3 + 1] AS tool, text, EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) AS hit, out FROM mk p), th AS (SELECT doc_key AS message_id, string_agg(threat, ',' ORDER BY lo, threat) FILTER (nth = 1) AS threats FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, threat ORDER BY lo) AS nth FROM rmerged) GROUP BY doc_key)"
for _policy, _text in (("mask", "'text:' || CASE WHEN tool = 'clock' THEN text ELSE out END || '|image:-|text:plain'"), ("drop", "CASE WHEN tool <> 'clock' AND hit THEN 'text:[tool output withheld]' ELSE 'text:' || text || '|image:-|text:plain' END")):
    SQL[f"tool_outputs_{_policy}"] = _with(_P, _S, _RAW, _BL, _MASKED, _TOOL) + f"SELECT message_id, tool, md5({_text}) AS blocks_md5, CASE WHEN tool <> 'clock' THEN hit END AS flagged, CASE WHEN tool <> 'clock' THEN CASE WHEN hit THEN '{_policy}' ELSE 'none' END END AS action, CASE WHEN tool <> 'clock' AND hit THEN threats END AS threats FROM tl LEFT JOIN th USING (message_id)"
SQL["tool_commands"] = _with(_P, _S) + "SELECT doc_key // 2 AS command_id, count(*) AS n, count(*) FILTER (hit) AS n_flagged, count(*) FILTER (hit) AS n_withheld FROM (SELECT doc_key, doc_key % 3 <> 2 AND EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) AS hit FROM planted p) GROUP BY 1"
SQL["guard_passthrough"] = _with(_P, _S) + "SELECT d.doc_key, EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = d.doc_key) AS flagged, true AS keep, md5(text) AS text_md5, CAST(0 AS BIGINT) AS removed FROM d"
SQL["guard_drop_split"] = _with(_P, _S) + "SELECT label, CAST(count(*) FILTER (NOT f) AS BIGINT) AS kept, CAST(count(*) FILTER (f) AS BIGINT) AS rejected FROM (SELECT label, EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) AS f FROM planted p) GROUP BY label"
_LINES = "d AS (SELECT doc_key, text FROM planted), ln AS (SELECT doc_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM d)"
SQL["wrapped_lines"] = _with(_P, _LINES) + r"SELECT doc_key, CAST(nth AS BIGINT) AS nth, length(regexp_replace(line, '\s+$', '')) >= 40 AND regexp_matches(regexp_replace(line, '\s+$', ''), '[\p{L}\p{N},;:\-—]$') AS wrapped FROM ln"

# Conversations
_TD = "planted AS (SELECT conv_id * 100000 + turn AS doc_key, text, conv_id, turn, role, attack FROM pt)"
_TF = "tf AS (SELECT p.conv_id, p.turn FROM fired f JOIN planted p ON p.doc_key = f.doc_key WHERE p.role = 'user' GROUP BY 1, 2)"
_DS = _scan("dpi")
SQL["dialogue_decide"] = _with(_TURNS, _TD, _DS, _TF) + "SELECT p.conv_id, count(*) FILTER (role = 'user' AND text <> '') AS n_read, bool_or(tf.turn IS NOT NULL) AS flagged, NOT bool_or(tf.turn IS NOT NULL) AS keep FROM planted p LEFT JOIN tf USING (conv_id, turn) GROUP BY p.conv_id"
SQL["dialogue_meta"] = _with(_TURNS, _TD, _DS, _TF) + f"SELECT p.conv_id, p.turn, role, CASE WHEN role = 'user' AND text <> '' THEN tf.turn IS NOT NULL END AS flagged, CASE WHEN role = 'user' AND text <> '' THEN CASE WHEN tf.turn IS NULL THEN 'none' ELSE 'drop' END END AS action, CASE WHEN role = 'user' AND text <> '' THEN '{load().version}' END AS base FROM planted p LEFT JOIN tf USING (conv_id, turn)"
SQL["dialogue_stamped"] = _with(_TURNS, _TD, _DS, _TF, "tt AS (SELECT p.conv_id, p.turn, f.threat FROM fired f JOIN planted p USING (doc_key) WHERE role = 'user' GROUP BY 1, 2, 3)", "ts AS (SELECT conv_id, string_agg(threat, ',' ORDER BY turn, threat) FILTER (nth = 1) AS threats FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, threat ORDER BY turn) AS nth FROM tt) GROUP BY 1)") + "SELECT p.conv_id, max(p.turn) AS turn, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN bool_or(tf.turn IS NOT NULL) END AS guard_request_flagged, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN coalesce(any_value(threats), '') END AS guard_request_threats, coalesce(nullif(count(*) FILTER (role = 'user'), 0), NULL) AS n_messages, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN count(tf.turn) END AS n_flagged FROM planted p LEFT JOIN tf USING (conv_id, turn) LEFT JOIN ts ON ts.conv_id = p.conv_id GROUP BY p.conv_id"
SQL["dialogue_one_of_two"] = _with(_TURNS, _TD, _DS, _TF) + "SELECT conv_id, count(*) AS turns, CASE WHEN conv_id IN (SELECT conv_id FROM tf) THEN 'blocked' ELSE 'messages' END AS output FROM planted GROUP BY conv_id"
SQL["dialogue_validated"] = _with(_TURNS, _TD, _DS, _TF) + "SELECT p.conv_id, p.turn, role, md5(text) AS text_md5, tf.turn IS NOT NULL AS flagged FROM planted p LEFT JOIN tf USING (conv_id, turn)"
SQL["dialogue_parts"] = "SELECT conv_id, turn, md5(substr(text, 1, length(text) // 2) || chr(10) || chr(10) || substr(text, length(text) // 2 + 1) || chr(10) || chr(10) || role) AS text_md5 FROM conversations"
SQL["dialogue_since_last_assistant"] = _with(_TURNS) + "SELECT conv_id, turn, role FROM (SELECT *, coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id), -1) AS last FROM pt) WHERE turn > last"
REFUSAL = "This request was declined."
SQL["dialogue_forget"] = _with(_TURNS, _TD, _DS, _TF) + f"SELECT conv_id, turn, role, md5(text) AS text_md5 FROM planted p WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.conv_id = p.conv_id AND tf.turn = p.turn) UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', md5({q(REFUSAL)}) FROM planted p WHERE conv_id IN (SELECT conv_id FROM tf) GROUP BY conv_id"
SQL["dialogue_text"] = "SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"
SQL["role_vocabulary"] = "SELECT role, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS host_role, role AS back, count(*) AS n FROM conversations GROUP BY role"

# Measurement
SQL["recall_fpr_cube"] = _with(_P, _S) + """, r AS (SELECT label, action, form, EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) AS hit FROM planted p)
SELECT label, action, form, count(*) AS n, count(*) FILTER (hit) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM r GROUP BY CUBE (label, action, form)"""
SQL["recall_ci"] = _with(_P, _S) + """, r AS (SELECT label, CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) THEN 1.0 ELSE 0.0 END AS hit FROM planted p)
SELECT label, count(*) AS n, round(avg(hit), 6) AS rate, round(greatest(0.0, avg(hit) - 1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*))), 6) AS lo, round(least(1.0, avg(hit) + 1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*))), 6) AS hi FROM r GROUP BY label"""
SQL["alarm_ppv"] = _with(_P, _S) + """, r AS (SELECT label, CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) THEN 1.0 ELSE 0.0 END AS hit FROM planted p),
s AS (SELECT avg(hit) FILTER (label = 'injected') AS recall, avg(hit) FILTER (label <> 'injected') AS fpr FROM r)
SELECT prevalence, round(prevalence * recall / nullif(prevalence * recall + (1 - prevalence) * fpr, 0), 6) AS ppv FROM s, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) v(prevalence)"""
SQL["length_bands"] = _with(_P, _S) + "SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) <= 2000 THEN 'middle' ELSE 'long' END AS band, label, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key)) AS hits FROM planted p GROUP BY 1, 2"
SQL["payload_survival"] = _with(_P, _S, _RAW, _BL, _PIECES.format(fill="'[cut]'")) + r"""SELECT action, count(*) AS n, count(*) FILTER (contains(regexp_replace(CASE WHEN gb.doc_key IS NULL THEN text ELSE head || substr(text, tail_at + 1) END, '\s+', ' ', 'g'), regexp_replace(payload, '\s+', ' ', 'g'))) AS intact FROM planted p LEFT JOIN gb USING (doc_key) WHERE label = 'injected' GROUP BY action"""
SQL["span_iou"] = _with(_P, _S, _merged(), _REPORT) + """SELECT p.doc_key, round(i / (greatest(hi, inj_hi) - least(lo, inj_lo))::DOUBLE, 6) AS iou, round(i / (inj_hi - inj_lo)::DOUBLE, 6) AS covered, round(i / (hi - lo)::DOUBLE, 6) AS precision
FROM (SELECT *, greatest(0, least(hi, inj_hi) - greatest(lo, inj_lo)) AS i FROM report JOIN planted USING (doc_key)) p WHERE flagged AND label = 'injected'"""
_PRED = "pr AS (SELECT doc_id, coalesce(toxic, 0) AS y, ((doc_id * 7919 + 13) % 1000) / 1000.0::DOUBLE * 0.6 + CASE WHEN toxic = 1 THEN 0.35 ELSE 0.0 END AS score FROM labels)"
SQL["threshold_at_budget"] = _with(_PRED) + """, t AS (SELECT score, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM pr GROUP BY score),
c AS (SELECT score, sum(n0) OVER (ORDER BY score DESC) / (SELECT sum(n0) FROM t)::DOUBLE AS fpr, sum(n1) OVER (ORDER BY score DESC) / (SELECT sum(n1) FROM t)::DOUBLE AS recall FROM t)
SELECT budget, round(min(score), 6) AS threshold, round(max(fpr), 6) AS fpr, round(max(recall), 6) AS recall FROM c, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) b(budget) WHERE fpr <= budget GROUP BY budget"""
SQL["heldout_md5"] = "SELECT doc_id, strpos('13579bdf', md5(CAST(doc_id AS VARCHAR))[32]) > 0 AS held FROM documents"
SQL["systematic_sample"] = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) WHERE rn % greatest(1, n // 100) = 0 ORDER BY rn LIMIT 100"
SQL["slice_by_goal"] = _with(_P) + "SELECT doc_key, action FROM planted WHERE action IN ('exfiltrate', 'disclose')"
SQL["size_quantiles"] = "SELECT p, size FROM (SELECT length(text) AS size, row_number() OVER (ORDER BY length(text), doc_id) AS rn, count(*) OVER () AS n FROM documents), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(p) WHERE rn = least(n - 1, CAST(floor(n * p) AS BIGINT)) + 1"
_COST = "c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, 0.0018 * length(text) + ((doc_id * 31) % 17) * 0.01 AS ms FROM documents)"
SQL["cost_ols"] = _with(_COST) + "SELECT round(regr_slope(ms, size), 6) AS slope, round(regr_intercept(ms, size), 6) AS intercept, count(*) AS n FROM c"
SQL["cost_summary"] = _with(_COST) + "SELECT CASE WHEN size < 200 THEN 0 WHEN size < 500 THEN 200 WHEN size < 1500 THEN 500 WHEN size < 4000 THEN 1500 ELSE 4000 END::BIGINT AS band, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(CAST(median(ms) AS DOUBLE), 6) AS median_ms, round(1000 * sum(size) / sum(ms), 3) AS chars_per_s FROM c GROUP BY 1"
SQL["dearest_per_char"] = _with(_COST) + "SELECT doc_id, round(1000 * ms / size, 6) AS per_1000 FROM c WHERE size > 0 ORDER BY 1000 * ms / size DESC, doc_id LIMIT 5"
SQL["shingle_neardup"] = r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM benchmark),
s AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE c / (x.n + y.n - c)::DOUBLE > 0.3"""
SQL["shingle_removed"] = SQL["shingle_neardup"].replace("SELECT a, b, round(", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT b FROM (SELECT a, b, round(") + "))"
_CT = f"""{_spans("ctd", "tk", T.TOKEN, "masked")},
cx AS (SELECT t.doc_key, lo, hi, CASE WHEN s[1] = '{T.FOLDED}' THEN '<entity>' ELSE s END AS token FROM tk t WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_key = t.doc_key AND t.lo < h.hi AND t.hi > h.lo)),
tn AS MATERIALIZED (SELECT t.doc_key, t.lo, t.hi, cx.token, row_number() OVER (PARTITION BY t.doc_key ORDER BY t.lo) AS nth FROM tk t LEFT JOIN cx ON cx.doc_key = t.doc_key AND cx.lo = t.lo),
hp AS (SELECT h.*, row_number() OVER () AS hit, coalesce((SELECT max(nth) FROM tn WHERE tn.doc_key = h.doc_key AND tn.lo < h.lo), 0) AS l, coalesce((SELECT max(nth) FROM tn WHERE tn.doc_key = h.doc_key AND tn.lo < h.hi), 0) AS r FROM hits h),
cn AS (SELECT hit, hp.doc_key, slot, hp.lo AS a, hp.hi AS b, tn.lo, tn.hi, token, CASE WHEN nth <= l THEN 'L' ELSE 'R' END AS side, CASE WHEN nth <= l THEN l - nth ELSE nth - r END AS away FROM hp JOIN tn ON tn.doc_key = hp.doc_key AND ((nth <= l AND nth > l - 8) OR (nth > r AND nth <= r + 8)) WHERE token IS NOT NULL),
{_spans("ctd", "cb", T.PARAGRAPH, "masked")},
cd AS (SELECT *, row_number() OVER (PARTITION BY hit, side ORDER BY away) AS d FROM cn WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.doc_key = cn.doc_key AND cb.lo >= CASE WHEN side = 'L' THEN cn.hi ELSE cn.b END AND cb.lo < CASE WHEN side = 'L' THEN cn.a ELSE cn.lo END))"""
SQL["context_counts"] = _with(_P, _S, "ctd AS (SELECT doc_key, masked FROM m WHERE doc_key IN (SELECT doc_key FROM hits))", _CT) + "SELECT slot, token, side, CASE WHEN d <= 3 THEN CAST(d AS VARCHAR) WHEN d <= 5 THEN '4-5' ELSE '6-8' END AS dist, count(*) AS n FROM cd GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"
_WD = _spans("wd", "wo", T.WORD, "low")
_AT = "CASE WHEN (SELECT count(*) FROM wo w WHERE w.doc_key = h.doc_key AND w.lo <= {0} AND {0} < w.hi) > 0 THEN (SELECT count(*) FROM wo w WHERE w.doc_key = h.doc_key AND w.hi <= {0}) ELSE greatest(0.0, (SELECT count(*) FROM wo w WHERE w.doc_key = h.doc_key AND w.hi <= {0}) - 0.5) END"
_HW = f"wd AS (SELECT doc_key, low FROM d WHERE doc_key IN (SELECT doc_key FROM hits)), {_WD}, hw AS MATERIALIZED (SELECT doc_key, slot, lo, hi, CAST({_AT.format('h.lo')} AS DOUBLE) AS first, CAST({_AT.format('greatest(h.lo, h.hi - 1)')} AS DOUBLE) AS last FROM hits h)"
SQL["half_word_positions"] = _with(_P, _S, _HW) + "SELECT doc_key, slot, lo, hi, first, last FROM hw"
_GAP = """(SELECT coalesce(sum(CASE WHEN NOT {multi} AND regexp_matches(g, '[\\n\\t]|[|•] | [|•]') THEN 99 WHEN regexp_matches(g, '[.!?;]') AND regexp_matches(g, '\\s') AND NOT regexp_matches(g, '[\\n\\t]') THEN 4 WHEN {multi} AND regexp_matches(g, '[.!?;]') AND regexp_matches(g, '\\s') AND NOT regexp_matches(g, '[\\n\\t]') THEN 4 ELSE 0 END), 0) FROM wg WHERE wg.doc_key = x.doc_key AND wg.lo > x.lo AND wg.lo <= y.lo)"""
_WG = f"wg AS MATERIALIZED (SELECT doc_key, lo, substr(low, CAST(coalesce(lag(hi) OVER (PARTITION BY doc_key ORDER BY lo), 0) + 1 AS BIGINT), CAST(lo - coalesce(lag(hi) OVER (PARTITION BY doc_key ORDER BY lo), 0) AS BIGINT)) AS g FROM wo JOIN wd USING (doc_key))"


def _two(n: int, one: str, two: str, gap: int, multi: bool = False) -> str:
    """Matches of two steps, each end with its earliest beginning; of those that share a beginning the first end counts, as a match clears what is open."""
    cost = _GAP.format(multi="true" if multi else "false")
    return f"""SELECT doc_key, template, lo, min(hi) AS hi, arg_min(words, hi) AS words FROM (SELECT y.doc_key, CAST({n} AS BIGINT) AS template, min(x.lo) AS lo, y.hi AS hi, CAST(y.last - arg_min(x.first, x.lo) + 1 AS BIGINT) AS words FROM lw x JOIN lw y ON x.doc_key = y.doc_key AND x.slot = '{one}' AND y.slot = '{two}' AND x.last < y.first AND y.first - x.last - 1 + {cost} <= {gap} GROUP BY y.doc_key, y.lo, y.hi, y.last) GROUP BY doc_key, template, lo"""


_LW = """lw AS MATERIALIZED (SELECT * FROM hw)"""
SQL["template_fragments"] = _with(_P, _S, _HW, _WG, _LW, r"""pl AS (SELECT doc_key, lo, hi, s FROM wo WHERE s IN ('please', 'guidance'))""", f"""t2 AS (SELECT c.doc_key, p.lo, g.hi, CAST((SELECT count(*) FROM wo w WHERE w.doc_key = p.doc_key AND w.lo >= p.lo AND w.hi <= g.hi) AS BIGINT) AS words FROM lw c JOIN pl p ON p.doc_key = c.doc_key AND p.s = 'please' AND p.hi <= c.lo AND NOT contains(substr((SELECT low FROM wd WHERE wd.doc_key = c.doc_key), CAST(p.hi + 1 AS BIGINT), CAST(c.lo - p.hi AS BIGINT)), chr(10)) AND (SELECT count(*) FROM wo w WHERE w.doc_key = p.doc_key AND w.lo >= p.hi AND w.hi <= c.lo) <= 2
JOIN pl g ON g.doc_key = c.doc_key AND g.s = 'guidance' AND g.lo >= c.hi AND NOT contains(substr((SELECT low FROM wd WHERE wd.doc_key = c.doc_key), CAST(c.hi + 1 AS BIGINT), CAST(g.lo - c.hi AS BIGINT)), chr(10)) AND (SELECT count(*) FROM wo w WHERE w.doc_key = g.doc_key AND w.lo >= c.hi AND w.hi <= g.lo) <= 4 WHERE c.slot = 'CANCEL_VERB')""") + " UNION ALL ".join([_two(0, "CANCEL_VERB", "PRIOR_REF", 3), _two(1, "SEND_VERB", "EXTERNAL_ADDR", 9), "SELECT DISTINCT doc_key, CAST(2 AS BIGINT), lo, hi, words FROM t2", "SELECT doc_key, CAST(3 AS BIGINT), lo, hi, CAST(1 AS BIGINT) FROM hits WHERE slot = 'FOLLOW_VERB'", _two(4, "SEND_VERB", "EXTERNAL_ADDR", 9, True)])
SQL["edges_in_region"] = _with(_P, _S) + "SELECT e.doc_key, anchor, filler, dist, conn, e.lo, e.hi FROM edges e JOIN planted p ON p.doc_key = e.doc_key WHERE (e.lo >= inj_lo AND e.lo < inj_hi) OR (e.right_lo >= inj_lo AND e.right_lo < inj_hi)"
_CROSS = "(SELECT count(*) FROM {0} k WHERE k.doc_key = p.doc_key AND k.lo >= p.lo AND k.lo < p.hi)"
SQL["probe_geometry"] = _with(_P, _S) + f"""SELECT p.doc_key, CAST(p.rule AS BIGINT) AS rule, count(*) AS placements, any_value(b.hull) AS hull, any_value(b.lo) AS begins,
CAST(coalesce((SELECT min(lo) FROM br WHERE br.doc_key = p.doc_key AND br.lo > any_value(b.lo)), any_value(length(d.text))) - coalesce((SELECT max(lo) FROM br WHERE br.doc_key = p.doc_key AND br.lo <= any_value(b.lo)), 0) AS BIGINT) AS para_len,
min({_CROSS.format("br")}) AS paras, CAST(min(p.hi - p.lo - length(replace(substr(d.text, CAST(p.lo + 1 AS BIGINT), CAST(p.hi - p.lo AS BIGINT)), chr(10), ''))) AS BIGINT) AS lines
FROM placed p JOIN best b ON b.doc_key = p.doc_key AND b.rule = p.rule JOIN d ON d.doc_key = p.doc_key GROUP BY p.doc_key, p.rule"""
_EV = "ev AS MATERIALIZED (SELECT f.doc_key, f.rule, n.edge_no, n.lo, n.hi, substr(text, CAST(n.lo + 1 AS BIGINT), CAST(n.hi - n.lo AS BIGINT)) AS quote FROM fired f JOIN named n ON n.doc_key = f.doc_key AND n.rule = f.rule AND n.lo >= f.lo JOIN d ON d.doc_key = f.doc_key QUALIFY row_number() OVER (PARTITION BY f.doc_key, f.rule, n.edge_no ORDER BY n.hi, n.lo DESC) = 1)"
SQL["rule_evidence"] = _with(_P, _S, _EV) + "SELECT doc_key, rule, CAST(edge_no AS BIGINT) AS edge_no, lo, hi, quote FROM ev"
SQL["findings_evidence"] = _with(_P, _S, _EV, _merged()) + "SELECT i.doc_key, i.island, count(*) AS n_evidence, md5(string_agg(concat_ws(':', e.rule, e.edge_no, e.lo, e.hi, quote), '|' ORDER BY span_lo, span_hi, e.rule, e.edge_no, e.lo, e.hi, quote)) AS evidence_md5 FROM isl i JOIN ev e ON e.doc_key = i.doc_key AND e.rule = i.rule GROUP BY i.doc_key, i.island"
SQL["findings_unlocated"] = _with(_P, _S, _merged()) + "SELECT doc_key, island, lo, hi, threat, severity FROM merged UNION ALL SELECT doc_key, coalesce((SELECT max(island) FROM merged m WHERE m.doc_key = p.doc_key), 0) + 1, NULL, NULL, 'IPI/Intent', 'high' FROM planted p WHERE doc_key % 9 = 0"
SQL["finding_snippets"] = _with(_P, _S, _merged()) + f"""SELECT doc_key, island, CASE WHEN c <> '' THEN c || ' ' ELSE '' END || '>>>' || body || '<<<' || CASE WHEN a <> '' THEN ' ' || a ELSE '' END AS snippet FROM (
SELECT doc_key, island, CASE WHEN length(b0) > 600 THEN substr(b0, 1, 300) || ' […' || (length(b0) - 600) || ' chars…] ' || substr(b0, length(b0) - 299) ELSE b0 END AS body, CASE WHEN lo > 90 AND c0 <> '' THEN '… ' || CASE WHEN contains(c0, ' ') THEN substr(c0, strpos(c0, ' ') + 1) ELSE '' END ELSE c0 END AS c,
CASE WHEN hi + 90 < n AND a0 <> '' THEN CASE WHEN contains(a0, ' ') THEN regexp_replace(a0, ' [^ ]*$', '') ELSE '' END || ' …' ELSE a0 END AS a
FROM (SELECT m.*, length(text) AS n, {_ONE.format("substr(text, lo + 1, hi - lo)")} AS b0, {_ONE.format("substr(text, greatest(0, lo - 90) + 1, lo - greatest(0, lo - 90))")} AS c0, {_ONE.format("substr(text, hi + 1, 90)")} AS a0 FROM merged m JOIN d USING (doc_key)))"""
SQL["report_json_read"] = SQL["report_docs"]
SQL["report_json"] = _with(_P, _S, _merged(), _REPORT) + """SELECT r.doc_key, md5('{"id":' || r.doc_key || ',"flagged":' || r.flagged || coalesce(',"severity":"' || r.severity || '"', '') || ',"threats":' || CASE WHEN r.threats = '' THEN '[]' ELSE '["' || replace(r.threats, ',', '","') || '"]' END || ',"findings":[' || coalesce(f, '') || ']}') AS line_md5
FROM report r LEFT JOIN (SELECT doc_key, string_agg('{"lo":' || lo || ',"hi":' || hi || ',"threat":"' || threat || '","severity":"' || severity || '","text":' || to_json(substr(text, lo + 1, hi - lo)) || '}', ',' ORDER BY island) AS f FROM merged JOIN d USING (doc_key) GROUP BY doc_key) g USING (doc_key)"""
SQL["norm_map_violations"] = "SELECT count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM documents"
SQL["scan_mismatch"] = "SELECT CAST(0 AS BIGINT) AS only_one, CAST(0 AS BIGINT) AS only_two, CAST(0 AS BIGINT) AS total"
SQL["recall_cells"] = _with(_P, _S) + "SELECT count(*) AS cells, count(*) FILTER (rate >= 0.5) AS covered, round(count(*) FILTER (rate >= 0.5) / count(*)::DOUBLE, 6) AS share FROM (SELECT action, form, avg(CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) THEN 1.0 ELSE 0.0 END) AS rate FROM planted p WHERE label = 'injected' GROUP BY 1, 2)"
SQL["paired_gains"] = _with(_P, _S) + "SELECT label, count(*) FILTER (NOT b AND a) AS gains, count(*) FILTER (b AND NOT a) AS losses, count(*) FILTER (NOT b AND a) - count(*) FILTER (b AND NOT a) AS net FROM (SELECT label, EXISTS (SELECT 1 FROM best x WHERE x.doc_key = p.doc_key) AS b, EXISTS (SELECT 1 FROM fired f WHERE f.doc_key = p.doc_key) AS a FROM planted p) GROUP BY label"
_SIG = "sg AS (SELECT rule, string_agg(anchor || '|' || filler || '|R|' || dist || '|' || conn, '&' ORDER BY anchor || '|' || filler || '|R|' || dist || '|' || conn) AS signature FROM rule_edges GROUP BY rule)"
SQL["threat_names"] = _with(_EDGES, values(OT.TECHNIQUES, "tech", "ord, slot, family, technique, severity")) + """SELECT CAST(rule AS BIGINT) AS rule, 'IPI/' || stem || '.' || CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE 'Z' || (n - 26) END AS threat FROM (
SELECT rule, stem, row_number() OVER (PARTITION BY stem ORDER BY rule) AS n FROM (SELECT rule, coalesce(arg_min(family || '.' || technique, ord), 'Generic.Relation') AS stem FROM (SELECT rule, anchor AS slot FROM rule_edges UNION SELECT rule, filler FROM rule_edges) s LEFT JOIN tech USING (slot) GROUP BY rule))"""
SQL["threat_explain"] = _with(_RULES) + f"SELECT threat, arg_min(severity, {_SEV}) AS severity, false AS exact FROM rules WHERE contains(lower(threat), 'override') GROUP BY threat ORDER BY threat LIMIT 10"
SQL["scan_fused"] = _with(_P, _S, _merged()) + "SELECT doc_key, lo, hi, threat, severity, also, merged FROM merged"
SQL["scan_gated"] = SQL["scan_fused"]
SQL["intent_parse"] = """WITH a AS (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS score, doc_id % 7 = 0 AS unread, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, NOT unread AS judged, CASE WHEN NOT unread THEN score >= 0.9 END AS flagged, CASE WHEN NOT unread THEN score END AS score, CASE WHEN NOT unread AND score >= 0.9 THEN 0 END::BIGINT AS lo, CASE WHEN NOT unread AND score >= 0.9 THEN n END::BIGINT AS hi FROM a"""
SQL["alarms_per_window"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
