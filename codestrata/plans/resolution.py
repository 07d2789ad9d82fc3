"""Queries on resolved edges and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import files as fl, overview as o, parse, resolution as r, symbols as y
from codestrata.plans.files import _F, _KIND, _RESOLVED
from codestrata.plans.registry import query
from codestrata.plans.structure import _REF
from codestrata.plans.symbols import _CALLABLE, _CALLS, _INHERIT, _S, _TYPE
from codestrata.tables import materialize, read


def _edges(s, d):
    return materialize(fl.import_edges(read(s, d, "files"), read(s, d, "source_texts")), "imports")


query("e_hint_edges")(lambda s, d: r.hint_edges(parse.parse_files(read(s, d, "files"), read(s, d, "source_texts")), read(s, d, "files")))
query("e_type_usage", f"""WITH {_S}, t AS (SELECT DISTINCT project, file_id, sid, name FROM s WHERE {_TYPE}), g AS (SELECT DISTINCT sid, signature FROM symbols WHERE signature IS NOT NULL),
c AS (SELECT DISTINCT project, file_id, s.sid, unnest(regexp_extract_all(signature, '\\b([A-Z]\\w{{2,}})\\b', 1)) ref FROM s JOIN g USING (sid) WHERE {_CALLABLE}),
l AS (SELECT file_id, name, min(sid) x FROM t GROUP BY 1, 2), u AS (SELECT project, name, min(sid) x FROM t GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT c.project, c.sid src, coalesce(l.x, u.x) dst FROM c LEFT JOIN l ON l.file_id = c.file_id AND l.name = c.ref LEFT JOIN u ON u.project = c.project AND u.name = c.ref WHERE coalesce(l.x, u.x) IS NOT NULL""")(
    lambda s, d: r.type_usage(read(s, d, "symbols")))
query("e_interface_candidates", _F + f""", {_RESOLVED}, {_S}, ty AS (SELECT * FROM s WHERE {_TYPE}), bs AS (SELECT DISTINCT project, name, file target FROM ty),
rf0 AS (SELECT project, file source, name "of", unnest(bases) ref FROM ty), rf AS (SELECT DISTINCT project, source, "of", {_REF.format('ref')} AS name FROM rf0)
SELECT rf.project, source, target, 'interface' signal, CAST(0.85 AS DOUBLE) confidence, min('class ' || "of" || '(' || rf.name || ')') evidence FROM rf JOIN bs ON bs.project = rf.project AND bs.name = rf.name WHERE source <> target
AND NOT EXISTS (SELECT 1 FROM bs own WHERE own.project = rf.project AND own.name = rf.name AND own.target = source)
AND NOT EXISTS (SELECT 1 FROM ie WHERE ie.project = rf.project AND ie.s = source AND ie.t = target) GROUP BY 1, 2, 3""")(lambda s, d: r.interface_candidates(read(s, d, "symbols"), _edges(s, d)))
query("e_candidates")(lambda s, d: r.candidates(read(s, d, "files"), read(s, d, "source_texts"), read(s, d, "symbols"), _edges(s, d)))
query("e_unreached", _F + f""", {_RESOLVED}, c AS (SELECT DISTINCT project, path, ext, regexp_extract(path, '^(.*/)?[^/]*$', 1) folder, regexp_extract(path, '([^/]+?)(?:\\.[^./]*)?$', 1) stem FROM f WHERE {_KIND} NOT IN {fl.NON_CODE}),
pk AS (SELECT project, folder, ext FROM c WHERE ext IN ('.go', '.java', '.kt', '.swift') GROUP BY 1, 2, 3 HAVING count(*) > 1), hd AS (SELECT DISTINCT c.project, folder, stem FROM c JOIN ie ON ie.project = c.project AND ie.t = c.path WHERE ext IN ('.h', '.hpp', '.hh', '.hxx'))
SELECT c.project, c.path, CASE WHEN EXISTS (SELECT 1 FROM ie WHERE ie.project = c.project AND ie.s = c.path) THEN 'entry' ELSE 'isolated' END AS role FROM c
WHERE NOT EXISTS (SELECT 1 FROM ie WHERE ie.project = c.project AND ie.t = c.path) AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.project = c.project AND pk.folder = c.folder AND pk.ext = c.ext)
AND NOT (coalesce(c.ext, '') IN ('.c', '.cpp', '.cc', '.cxx') AND EXISTS (SELECT 1 FROM hd WHERE hd.project = c.project AND hd.folder = c.folder AND hd.stem = c.stem))""")(lambda s, d: r.unreached(read(s, d, "files"), _edges(s, d)))
_SYSTEM = " ".join(f"WHEN lower(callee) = '{n}' THEN 'system:{c}'" for n, c in r.SYSTEM.items())
_LEADS = f"""h AS (SELECT DISTINCT file_id, name FROM s WHERE {_CALLABLE}), p AS (SELECT project, name, count(DISTINCT file_id) places FROM s WHERE {_CALLABLE} GROUP BY 1, 2),
cf AS (SELECT cl.project, cl.file_id, cl.sid, cl.callee, CASE WHEN h.name IS NOT NULL THEN 'internal' WHEN places = 1 THEN 'external' WHEN places > 1 THEN 'ambiguous' {_SYSTEM} ELSE 'unknown' END leads_to
FROM cl LEFT JOIN h ON h.file_id = cl.file_id AND h.name = cl.callee LEFT JOIN p ON p.project = cl.project AND p.name = cl.callee)"""


def _calls(s, d):
    return y.calls(read(s, d, "symbols"), read(s, d, "source_texts"))


query("e_classify_calls", f"WITH {_S}, {_CALLS}, {_LEADS} SELECT * FROM cf")(lambda s, d: r.classify_calls(_calls(s, d), read(s, d, "symbols")))
query("e_central_definitions", _F + f""", {_RESOLVED}, {_S}, {_CALLS}, df AS (SELECT DISTINCT project, name callee, file_id fid, file target FROM s WHERE {_CALLABLE} AND file IS NOT NULL), dg AS (SELECT project, t, count(DISTINCT s) links FROM ie GROUP BY 1, 2),
ce AS (SELECT df.project, callee, arg_min(target, (-coalesce(links, 0), target)) central FROM df LEFT JOIN dg ON dg.project = df.project AND dg.t = df.target GROUP BY 1, 2), ow AS (SELECT project, fid, callee, min(target) own FROM df GROUP BY 1, 2, 3)
SELECT DISTINCT cl.project, cl.file_id, cl.callee, coalesce(own, central) target FROM cl JOIN ce ON ce.project = cl.project AND ce.callee = cl.callee LEFT JOIN ow ON ow.project = cl.project AND ow.fid = cl.file_id AND ow.callee = cl.callee""")(
    lambda s, d: r.central_definitions(_calls(s, d), read(s, d, "symbols"), _edges(s, d)))
query("e_call_flows", f"WITH {_S}, {_CALLS}, {_LEADS} SELECT project, leads_to, count(*) calls, count(DISTINCT callee) callees FROM cf GROUP BY 1, 2")(
    lambda s, d: r.call_flows(r.classify_calls(_calls(s, d), read(s, d, "symbols"))))
_USAGE = lambda s, d: r.type_usage(read(s, d, "symbols"))
query("e_file_symbol_graph", f"""WITH {_S}, t AS (SELECT DISTINCT project, file_id, sid, name FROM s WHERE {_TYPE}), g AS (SELECT DISTINCT sid, signature FROM symbols WHERE signature IS NOT NULL),
c AS (SELECT DISTINCT project, file_id, s.sid, unnest(regexp_extract_all(signature, '\\b([A-Z]\\w{{2,}})\\b', 1)) ref FROM s JOIN g USING (sid) WHERE {_CALLABLE}),
l AS (SELECT file_id, name, min(sid) x FROM t GROUP BY 1, 2), u AS (SELECT project, name, min(sid) x FROM t GROUP BY 1, 2 HAVING count(*) = 1),
us AS (SELECT DISTINCT c.sid src, coalesce(l.x, u.x) dst FROM c LEFT JOIN l ON l.file_id = c.file_id AND l.name = c.ref LEFT JOIN u ON u.project = c.project AND u.name = c.ref WHERE coalesce(l.x, u.x) IS NOT NULL),
a AS (SELECT sid, min(file_id) f FROM s GROUP BY 1), e AS (SELECT sf.f sf, df.f df FROM us JOIN a sf ON sf.sid = src JOIN a df ON df.sid = dst), x AS (SELECT sf file_id, sf, df FROM e UNION ALL SELECT df, sf, df FROM e WHERE sf <> df)
SELECT file_id, count(*) FILTER (sf = df) AS inside, count(*) FILTER (sf <> df AND file_id = df) incoming, count(*) FILTER (sf <> df AND file_id = sf) outgoing FROM x GROUP BY 1""")(lambda s, d: r.file_symbol_graph(_USAGE(s, d), read(s, d, "symbols")))
query("e_neighbours", f"""WITH {_S}, {_INHERIT}, n AS (SELECT src, dst, count(*) edges FROM (SELECT DISTINCT * FROM i) GROUP BY 1, 2), b AS (SELECT src sid, 'out' direction, dst other, edges FROM n UNION ALL SELECT dst, 'in', src, edges FROM n)
SELECT *, row_number() OVER (PARTITION BY sid, direction ORDER BY edges DESC, other) AS rank FROM b QUALIFY rank <= 80""")(lambda s, d: r.neighbours(y.inheritance(read(s, d, "symbols"))))
query("o_project", _F + f""", {_RESOLVED}, m AS (SELECT project, count(DISTINCT module) modules, count(*) files FROM f GROUP BY 1), cr AS (SELECT project, count(*) n FROM ie WHERE split_part(s, '/', 1) <> split_part(t, '/', 1) GROUP BY 1),
en AS (SELECT DISTINCT project, path FROM f WHERE {_KIND} NOT IN {fl.NON_CODE} AND EXISTS (SELECT 1 FROM ie WHERE ie.project = f.project AND ie.s = f.path) AND NOT EXISTS (SELECT 1 FROM ie WHERE ie.project = f.project AND ie.t = f.path)),
ne AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) nth FROM en), e AS (SELECT project, count(*) n, string_agg(path, ', ' ORDER BY path) FILTER (nth <= 10) entries FROM ne GROUP BY 1)
SELECT m.*, coalesce(cr.n, 0) cross_edges, coalesce(e.n, 0) n_entries, coalesce(entries, '') entries FROM m LEFT JOIN cr ON cr.project = m.project LEFT JOIN e ON e.project = m.project""")(lambda s, d: o.project_overview(read(s, d, "files"), _edges(s, d)))
query("o_module", _F + f""", {_RESOLVED}, e AS (SELECT project, CASE WHEN contains(s, '/') THEN split_part(s, '/', 1) ELSE '_root' END a, CASE WHEN contains(t, '/') THEN split_part(t, '/', 1) ELSE '_root' END b FROM ie),
m AS (SELECT project, module, count(*) FILTER ({_KIND} NOT IN ('binary', 'other')) file_count, CAST(coalesce(sum(func_count) FILTER ({_KIND} NOT IN ('binary', 'other')), 0) AS BIGINT) func_count, count(*) FILTER ({_KIND} IN ('binary', 'other')) other_count FROM f GROUP BY 1, 2),
c AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY module) - 1) % 15 colour FROM m)
SELECT c.*, (SELECT count(*) FROM e WHERE e.project = c.project AND a = module AND b = module) AS within, (SELECT count(*) FROM e WHERE e.project = c.project AND a = module AND b <> module) AS "out",
(SELECT count(*) FROM e WHERE e.project = c.project AND b = module AND a <> module) AS "into" FROM c""")(lambda s, d: o.module_overview(read(s, d, "files"), _edges(s, d)))
query("o_file", f"WITH {_S}, {_CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY callee) n FROM cl) SELECT project, file_id, sid, count(*) callees, string_agg(callee, ', ' ORDER BY n) FILTER (n <= 10) AS names FROM n GROUP BY 1, 2, 3")(
    lambda s, d: o.file_overview(_calls(s, d)))
query("o_symbol", f"""WITH {_S}, d AS (SELECT sid, max(coalesce(length(doc) > 0, FALSE)) documented FROM symbols GROUP BY 1), q AS (SELECT DISTINCT sid, project, file_id, kind, parent FROM s)
SELECT project, file_id, count(*) FILTER (NOT {_CALLABLE}) AS "types", count(*) FILTER ({_CALLABLE} AND coalesce(length(parent) > 0, FALSE)) members, count(*) FILTER ({_CALLABLE} AND NOT coalesce(length(parent) > 0, FALSE)) AS free,
count(*) FILTER (documented) documented, count(*) symbols FROM q JOIN d USING (sid) GROUP BY 1, 2""")(lambda s, d: o.symbol_overview(read(s, d, "symbols")))
query("o_answer_budget", """SELECT project, count(DISTINCT file_id) files, CASE WHEN count(DISTINCT file_id) < 1500 THEN 1.0 WHEN count(DISTINCT file_id) < 6000 THEN 1.5 ELSE 2.0 END factor
FROM files WHERE path IS NOT NULL AND project IS NOT NULL AND file_id IS NOT NULL GROUP BY 1""")(lambda s, d: o.answer_budget(read(s, d, "files")))
