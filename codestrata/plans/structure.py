"""Queries on hierarchies and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import hierarchy, orphans
from codestrata.plans.registry import query
from codestrata.tables import read

_REF = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
 '<[^<>]*>|\[[^\[\]]*\]', '', 'g'), '<[^<>]*>|\[[^\[\]]*\]', '', 'g'), '[*&^]', ' ', 'g'), '(^|\s)((public|private|protected|virtual)\s+)+', ' ', 'g'),
 '\s+', ' ', 'g'), '^.*(::|->|[.\\/#])\s*', ''))"""
_HIERARCHY = f"""
WITH RECURSIVE sy AS MATERIALIZED (SELECT DISTINCT sid, project, file_id, name, lower(trim(coalesce(kind, ''))) k, bases, parent FROM symbols),
p AS (SELECT c.sid, min(u.sid) upper FROM sy c JOIN sy u ON u.file_id = c.file_id AND u.name = {_REF.format("c.parent")}
      AND u.k NOT IN ('function','method','constructor','func','def','fn') WHERE u.name <> '' GROUP BY 1),
r AS (SELECT sid, project, unnest(bases) ref, generate_subscripts(bases, 1) pos FROM sy WHERE k IN ('class','struct','interface','mixin')),
b AS (SELECT r.sid, arg_min(u.sid, r.pos) upper FROM r JOIN sy u ON u.project = r.project AND u.name = {_REF.format("r.ref")}
      AND u.k IN ('class','struct','interface','mixin') WHERE u.name <> '' GROUP BY 1),
l AS MATERIALIZED (SELECT 'parent' link, * FROM p UNION ALL SELECT 'bases', * FROM b),
up(link, sid, top, depth) AS (SELECT link, sid, upper, 1 FROM l
  UNION ALL SELECT up.link, up.sid, l.upper, up.depth + 1 FROM up JOIN l ON l.link = up.link AND l.sid = up.top WHERE up.depth < 200),
tops AS (SELECT link, sid, arg_max(top, depth) root, max(depth) depth FROM up GROUP BY 1, 2)
"""
_ROOTS = _HIERARCHY + "SELECT link, sid, CASE WHEN depth >= 200 THEN 'cycle' ELSE root END root, CASE WHEN depth >= 200 THEN -1 ELSE depth END depth FROM tops"
_PAIRS = _HIERARCHY + "SELECT up.link, up.top AS sid, up.sid AS descendant, up.depth AS distance FROM up JOIN tops ON tops.link = up.link AND tops.sid = up.sid WHERE tops.depth < 200"


@query("p2_found", _ROOTS)
def p2_found(spark, d):
    return hierarchy.symbol_hierarchy(read(spark, d, "symbols"), paths=False)


_PATHS = _HIERARCHY + """, pa AS (SELECT link, sid, list_append(list(top ORDER BY depth DESC), sid) AS path FROM up GROUP BY 1, 2)
SELECT link, sid, CASE WHEN depth >= 200 THEN 'cycle' ELSE root END root, CASE WHEN depth >= 200 THEN -1 ELSE depth END depth, CASE WHEN depth < 200 THEN array_to_string(path, ' > ') END AS path FROM tops JOIN pa USING (link, sid)"""


@query("p2_hierarchy", _PATHS)
def p2_hierarchy(spark, d):
    return hierarchy.symbol_hierarchy(read(spark, d, "symbols")).withColumn("path", F.array_join("path", " > "))


@query("p2_descendants", _PAIRS)
def p2_descendants(spark, d):
    return hierarchy.descendants(hierarchy.symbol_hierarchy(read(spark, d, "symbols")))


_ORPHAN = """
WITH e AS (SELECT DISTINCT edge_id, project, s, t, recorded_at FROM module_edges),
x AS (SELECT edge_id, project, recorded_at, 's' side, s id FROM e UNION ALL SELECT edge_id, project, recorded_at, 't', t FROM e)
SELECT {} FROM x WHERE id <> '' AND NOT EXISTS (SELECT 1 FROM modules m WHERE m.project = x.project AND m.id = x.id
  AND m.added_at <= x.recorded_at AND (m.removed_at IS NULL OR x.recorded_at < m.removed_at)) {}
"""


@query("p5_found", _ORPHAN.format("DISTINCT edge_id, side", ""))
def p5_found(spark, d):
    return orphans.orphan_edge_ends(read(spark, d, "module_edges"), read(spark, d, "modules")).select("edge_id", "side").distinct()


@query("p5_report", _ORPHAN.format(
    "'module_edges' table_name, side, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) orphans, count(DISTINCT (project, id)) missing_keys",
    "GROUP BY 2, 3"))
def p5_report(spark, d):
    return orphans.orphan_report(read(spark, d, "module_edges"), read(spark, d, "modules"))
