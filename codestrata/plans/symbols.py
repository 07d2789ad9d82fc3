"""Queries on symbols and quality."""

from __future__ import annotations

from codestrata.operators import graph, quality, symbols as y
from codestrata.plans.files import _TEST
from codestrata.plans.registry import query
from codestrata.plans.structure import _REF
from codestrata.tables import read

_S = """s AS (SELECT DISTINCT sid, project, file_id, file, name, lower(trim(coalesce(kind, ''))) kind, line, end_line, bases, parent, is_public, complexity FROM symbols WHERE sid IS NOT NULL)"""
_CALLABLE = "kind IN ('function', 'method', 'constructor', 'func', 'def', 'fn')"
_TYPE = "kind IN ('class', 'struct', 'interface', 'mixin')"


def _sym(fn):
    return lambda s, d: fn(read(s, d, "symbols"))


def _both(fn):
    return lambda s, d: fn(read(s, d, "symbols"), read(s, d, "source_texts"))


query("s_name_index", f"WITH {_S} SELECT project, name, count(DISTINCT file) files, min(file) first_file, count(*) definitions, count(DISTINCT file) > 1 AS ambiguous FROM s WHERE {_CALLABLE} AND name IS NOT NULL GROUP BY 1, 2")(_sym(y.name_index))
query("s_complexity_histogram", f"""WITH {_S}, r AS (SELECT DISTINCT sid, project, complexity FROM s WHERE kind IN ('function', 'method') AND complexity IS NOT NULL),
b AS (SELECT * FROM (VALUES ('1-5', 1, 5), ('6-10', 6, 10), ('11-15', 11, 15), ('16-20', 16, 20), ('21+', 21, 1000000000)) v(bucket, lo, hi)), p AS (SELECT DISTINCT project FROM r)
SELECT p.project, bucket, (SELECT count(*) FROM r WHERE r.project = p.project AND complexity BETWEEN lo AND hi) functions, (SELECT round(avg(complexity), 4) FROM r WHERE r.project = p.project) mean,
(SELECT count(*) FROM r WHERE r.project = p.project AND complexity > 15) high FROM p, b""")(_sym(y.complexity_histogram))
query("s_length_stats", f"""WITH {_S}, r AS (SELECT DISTINCT sid, project, name, end_line - line + 1 AS lines FROM s WHERE {_CALLABLE} AND end_line >= line)
SELECT *, round(avg(lines) OVER (PARTITION BY project), 4) mean, row_number() OVER (PARTITION BY project ORDER BY lines DESC, sid) AS rank FROM r QUALIFY rank <= 10""")(_sym(y.length_stats))
_INHERIT = f"""t AS (SELECT * FROM s WHERE {_TYPE}), r0 AS (SELECT project, file_id, sid src, unnest(bases) ref FROM t), r AS (SELECT DISTINCT project, file_id, src, {_REF.format('ref')} AS name FROM r0),
h AS (SELECT r.project, r.src, r.name, t.sid dst, t.kind dk, r.file_id = t.file_id same FROM r JOIN t ON t.project = r.project AND t.name = r.name AND t.sid <> r.src WHERE r.name <> ''),
ha AS (SELECT project, src, name, min(dst) FILTER (same) here, min(dst) only_one, count(DISTINCT dst) n FROM h GROUP BY 1, 2, 3), hb AS (SELECT project, src, coalesce(here, only_one) dst FROM ha WHERE here IS NOT NULL OR n = 1),
i AS (SELECT DISTINCT hb.project, hb.src, hb.dst, CASE WHEN dk IN ('interface', 'mixin') THEN 'implements' ELSE 'inherit' END AS type FROM hb JOIN h ON h.src = hb.src AND h.dst = hb.dst)"""
query("s_inheritance", f"WITH {_S}, {_INHERIT} SELECT DISTINCT * FROM i")(_sym(y.inheritance))
query("s_overrides", f"""WITH {_S}, {_INHERIT}, m AS (SELECT DISTINCT a.project, a.sid, a.name, o.sid "owner" FROM s a JOIN s o ON o.file_id = a.file_id AND o.name = {_REF.format('a.parent')} AND NOT o.{_CALLABLE} WHERE a.{_CALLABLE} AND o.name <> '')
SELECT DISTINCT m.project, m.sid src, b.sid dst FROM m JOIN i ON i.src = m."owner" JOIN m b ON b."owner" = i.dst AND b.name = m.name AND b.project = m.project""")(_sym(y.overrides))
_CALLS = f"""l AS (SELECT file_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS lines FROM source_texts WHERE text IS NOT NULL),
r AS (SELECT DISTINCT project, file_id, sid, name, line, end_line FROM s WHERE {_CALLABLE} AND line > 0 AND end_line >= line),
b AS (SELECT r.*, regexp_replace(array_to_string(lines[line + 1:end_line], chr(10)), '"[^"\\n]*"|''[^''\\n]*''|//[^\\n]*|(?m:^\\s*#[^\\n]*)', '', 'g') body FROM r JOIN l USING (file_id) WHERE line < len(lines)),
cl AS (SELECT DISTINCT project, file_id, sid, callee FROM (SELECT project, file_id, sid, name, unnest(regexp_extract_all(body, '([A-Za-z_]\\w+)\\s*\\(', 1)) callee FROM b) WHERE callee <> name AND callee NOT IN ({', '.join(f"'{w}'" for w in (*y.BUILTIN_CALLS, *y.NOT_CALLS))}))"""
query("s_calls", f"WITH {_S}, {_CALLS} SELECT * FROM cl")(_both(y.calls))
_EDGES = f"""tg AS (SELECT project, file_id, sid, name callee FROM s WHERE {_CALLABLE} AND name IS NOT NULL), lc AS (SELECT file_id, callee, max(sid) "local" FROM tg GROUP BY 1, 2),
un AS (SELECT project, callee, min(sid) "only" FROM tg GROUP BY 1, 2 HAVING count(DISTINCT sid) = 1),
ce AS (SELECT DISTINCT cl.project, cl.sid src, coalesce("local", "only") dst, CASE WHEN "local" IS NOT NULL THEN 'file' ELSE 'project' END AS scope FROM cl LEFT JOIN lc ON lc.file_id = cl.file_id AND lc.callee = cl.callee
  LEFT JOIN un ON un.project = cl.project AND un.callee = cl.callee WHERE coalesce("local", "only") <> cl.sid)"""
query("s_call_edges", f"WITH {_S}, {_CALLS}, {_EDGES} SELECT * FROM ce")(_both(y.call_edges))
query("s_dead_code", f"""WITH {_S}, {_CALLS} SELECT DISTINCT project, sid, file, name FROM s WHERE {_CALLABLE} AND name IS NOT NULL AND file IS NOT NULL AND name NOT IN {y.ENTRY_NAMES} AND NOT regexp_matches(name, '^__.+__$')
AND NOT {_TEST.format('file')} AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.project = s.project AND cl.callee = s.name)""")(_both(y.dead_code))
query("s_hotspots", f"""WITH {_S}, {_CALLS}, {_EDGES}, n AS (SELECT project, dst sid, count(DISTINCT src) callers FROM ce GROUP BY 1, 2 HAVING count(DISTINCT src) > 1), q AS (SELECT DISTINCT sid, name, file FROM s)
SELECT n.project, sid, name, callers, row_number() OVER (PARTITION BY n.project ORDER BY callers DESC, sid) AS rank FROM n JOIN q USING (sid) WHERE lower(name) <> lower(regexp_extract(file, '([^/.]+)(?:\\.[^/]*)?$', 1)) QUALIFY rank <= 10""")(
    lambda s, d: y.symbol_hotspots(y.call_edges(read(s, d, "symbols"), read(s, d, "source_texts")), read(s, d, "symbols")))
query("s_top_callers", f"""WITH {_S}, {_CALLS}, n AS (SELECT project, file_id, count(DISTINCT callee) calls FROM cl GROUP BY 1, 2), rr AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY calls DESC, file_id) AS rank, count(*) OVER (PARTITION BY project) c FROM n)
SELECT project, file_id, calls, rank, rank <= greatest(1, floor(c * 0.05 + 0.5)) AND calls >= 100 AS god_file FROM rr WHERE rank <= 50""")(_both(y.top_callers))
query("s_members", f"""WITH {_S}, o AS (SELECT project, file_id, name, sid FROM s WHERE NOT {_CALLABLE}), m AS (SELECT DISTINCT o.project, o.sid owner_sid, a.sid, a.name, a.line FROM s a JOIN o ON o.file_id = a.file_id AND o.name = {_REF.format('a.parent')} WHERE a.{_CALLABLE} AND o.name <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_sid ORDER BY line, sid) n FROM m) SELECT project, owner_sid, count(*) members, coalesce(string_agg(name, ', ' ORDER BY n) FILTER (n <= 20), '') AS names FROM r GROUP BY 1, 2""")(_sym(y.members))
_LINES = """ln AS (SELECT file_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) raw, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) line FROM source_texts WHERE text IS NOT NULL),
cd AS (SELECT file_id, line, regexp_replace(trim(regexp_replace(raw, '[\\t\\f\\x0B]', ' ', 'g')), '\\s+', ' ', 'g') code, length(trim(regexp_replace(raw, '[\\t\\f\\x0B]', ' ', 'g'))) n FROM ln),
kp AS (SELECT file_id, line, code FROM cd WHERE n >= 8 AND NOT (code LIKE '#%' OR code LIKE '//%' OR code LIKE '--%' OR code LIKE '/*%' OR code LIKE '*%' OR code LIKE ';%')),
wd AS (SELECT file_id, line, lead(code, 5) OVER w IS NOT NULL AS whole, substr(md5(concat_ws(chr(10), code, lead(code, 1) OVER w, lead(code, 2) OVER w, lead(code, 3) OVER w, lead(code, 4) OVER w, lead(code, 5) OVER w)), 1, 16) AS hash
  FROM kp WINDOW w AS (PARTITION BY file_id ORDER BY line)), dw AS (SELECT hash, file_id, line FROM wd WHERE whole QUALIFY count(*) OVER (PARTITION BY hash) > 1)"""
query("q_duplicate_windows", f"""WITH {_LINES}, fp AS (SELECT hash, min((file_id, line)) p FROM dw GROUP BY 1) SELECT p[1] || ':' || p[2] block, file_id, line FROM dw JOIN fp USING (hash)""")(lambda s, d: quality.duplicate_windows(read(s, d, "source_texts")))
query("q_duplication", f"""WITH {_LINES}, ow AS (SELECT DISTINCT file_id, project FROM files WHERE path IS NOT NULL), tt AS (SELECT project, count(*) AS lines FROM kp JOIN ow USING (file_id) GROUP BY 1),
x AS (SELECT project, file_id, hash, line FROM dw JOIN ow USING (file_id)), c AS (SELECT project, count(*) duplicated FROM (SELECT DISTINCT project, file_id, unnest(range(line, line + 6)) FROM x) GROUP BY 1), b AS (SELECT project, count(DISTINCT hash) blocks FROM x GROUP BY 1)
SELECT project, lines, coalesce(duplicated, 0) duplicated, coalesce(blocks, 0) blocks, round(coalesce(duplicated, 0) / lines, 6) percent FROM tt LEFT JOIN c USING (project) LEFT JOIN b USING (project)""")(
    lambda s, d: quality.duplication(read(s, d, "source_texts"), read(s, d, "files")))


@query("q_health")
def q_health(spark, d):
    edges = graph.module_edges(read(spark, d, "module_edges"))
    return quality.health(read(spark, d, "files"), read(spark, d, "symbols"), read(spark, d, "source_texts"), graph.strong_components(edges), graph.modularity(edges, graph.communities(edges)))
