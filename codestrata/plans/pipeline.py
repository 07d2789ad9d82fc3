"""Queries on parsing, reports, calibration and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import calibration, parse
from codestrata.plans.registry import query
from codestrata.sources import reports
from codestrata.streaming import activity
from codestrata.tables import materialize, read


def _parsed(s, d):
    return parse.parse_files(read(s, d, "files"), read(s, d, "source_texts"))


@query("r_parse")
def r_parse(s, d):
    p = _parsed(s, d)
    return p.select("file_id", "path", "sha", "code", "comment", "blank", F.size("imports").alias("imports"), F.size("functions").alias("functions"), F.size("calls").alias("calls"), F.size("symbols").alias("symbols"), F.size("hints").alias("hints"), "diag")


@query("r_parsed_symbols")
def r_parsed_symbols(s, d):
    return parse.symbol_rows(_parsed(s, d), read(s, d, "files"))


@query("r_functions")
def r_functions(s, d):
    return parse.function_rows(_parsed(s, d))


@query("r_parse_again")
def r_parse_again(s, d):
    """A second run over a cache of the first: nothing is parsed again, and the result is the same."""
    first = materialize(_parsed(s, d), "parsed")
    again = parse.parse_files(read(s, d, "files"), read(s, d, "source_texts"), first)
    return again.groupBy("diag").agg(F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"))


_FILES = """WITH f AS (SELECT DISTINCT file_id, project, path, coalesce(loc.code, 0) + coalesce(loc."comment", 0) + coalesce(loc.blank, 0) AS lines,
CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END module FROM files WHERE path IS NOT NULL)"""


@query("r_module_pages", _FILES + """, p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project, module) > 50 AND regexp_extract(path, '^[^/]+/([^/]+)/', 1) <> '' THEN module || '/' || regexp_extract(path, '^[^/]+/([^/]+)/', 1) ELSE module END page FROM f)
SELECT project, page, count(*) files, CAST(sum(lines) AS BIGINT) AS lines, '# ' || page || chr(10) || chr(10) || string_agg('- `' || path || '` ' || lines || ' lines', chr(10) ORDER BY '- `' || path || '` ' || lines || ' lines') body FROM p GROUP BY project, page""")
def r_module_pages(s, d):
    return reports.module_pages(read(s, d, "files"))


@query("r_file_pages", _FILES + """, s AS (SELECT DISTINCT file_id, sid, name, line FROM symbols WHERE lower(trim(coalesce(kind, ''))) IN ('function', 'method', 'constructor', 'func', 'def', 'fn')),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, sid) nth FROM s), l AS (SELECT file_id, count(*) functions, string_agg('- ' || name || ' (line ' || line || ')', chr(10) ORDER BY nth) FILTER (nth <= 60) top FROM n GROUP BY 1)
SELECT project, path page, coalesce(functions, 0) functions, '# ' || path || chr(10) || chr(10) || coalesce(top, 'no functions') body FROM (SELECT DISTINCT file_id, project, path FROM f) LEFT JOIN l USING (file_id)""")
def r_file_pages(s, d):
    return reports.file_pages(read(s, d, "files"), read(s, d, "symbols"))


@query("r_symbol_pages", _FILES + """, s AS (SELECT DISTINCT file_id, sid, name, lower(trim(coalesce(kind, ''))) kind, line FROM symbols WHERE sid IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, sid) nth FROM s),
l AS (SELECT file_id, count(*) symbols, string_agg('- ' || kind || ' ' || coalesce(name, '?') || ' ' || coalesce(CAST(line AS VARCHAR), '?'), chr(10) ORDER BY nth) FILTER (nth <= 120) top FROM n GROUP BY 1)
SELECT project, path page, symbols, '# ' || path || chr(10) || chr(10) || top body FROM (SELECT DISTINCT file_id, project, path FROM f) JOIN l USING (file_id)""")
def r_symbol_pages(s, d):
    return reports.symbol_pages(read(s, d, "files"), read(s, d, "symbols"))


@query("h_window_days", """SELECT i - 100 AS asked, i % 97 * 60 AS configured, coalesce(CASE WHEN i % 3 > 0 THEN greatest(7, least(3650, i - 100)) END, CASE WHEN i % 97 * 60 BETWEEN 7 AND 3650 THEN i % 97 * 60 END, 180) AS days FROM range(5000) t(i)""")
def h_window_days(s, d):
    rows = s.range(5000).select((F.col("id") - 100).alias("asked"), (F.col("id") % 97 * 60).alias("configured"), F.when(F.col("id") % 3 > 0, F.col("id") - 100).alias("given"))
    return rows.select("asked", "configured", reports.window_days(F.col("given"), F.col("configured")).cast("long").alias("days"))


_KEPT = [(e, f"regexp_matches(path, '{e.path}')" + (f" AND regexp_matches(coalesce(text, ''), '{e.text}')" if e.text else f" AND NOT regexp_matches(coalesce(text, ''), '{e.unless}')" if e.unless else "")) for e in calibration.EVIDENCE]
_HITS = " UNION ALL ".join(f"SELECT project, '{e.dimension}' dim, {e.points} * least(count(*), {e.times}) points FROM f WHERE {cond} GROUP BY 1" for e, cond in _KEPT)
_LEVEL = f"WHEN score >= 8 AND memory_learning >= {calibration.MEMORY_NEEDED} THEN 'self_improving' " + " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in calibration.LEVELS[1:])


@query("r_maturity", f"""WITH f AS (SELECT DISTINCT f.file_id, project, path, text FROM files f LEFT JOIN source_texts USING (file_id) WHERE path IS NOT NULL AND project IS NOT NULL), h AS ({_HITS} UNION ALL SELECT project, 'safety_governance', 1.0 FROM f GROUP BY 1 HAVING NOT bool_or(path = '.env')),
d AS (SELECT project, {', '.join(f"CAST(least(10, coalesce(sum(points) FILTER (dim = '{d}'), 0)) AS DOUBLE) AS {d}" for d in calibration.WEIGHTS)} FROM h GROUP BY 1), p AS (SELECT DISTINCT project FROM f),
s AS (SELECT p.project, {', '.join(f"coalesce({d}, 0) {d}" for d in calibration.WEIGHTS)}, round({' + '.join(f"coalesce({d}, 0) * {w}" for d, w in calibration.WEIGHTS.items())}, 1) score FROM p LEFT JOIN d USING (project)) SELECT *, CASE {_LEVEL} END AS level FROM s""")
def r_maturity(s, d):
    return calibration.maturity(read(s, d, "files"), read(s, d, "source_texts"))


@query("a_daily_events", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", event_type, count(*) events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""")
def a_daily_events(s, d):
    return activity.windowed(read(s, d, "events")).withColumn("value", F.round("value", 4))


@query("a_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 90 SECOND > ts THEN 0 ELSE 1 END fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 90 SECOND AS "end", count(*) events FROM n GROUP BY user_id, k""")
def a_sessions(s, d):
    return activity.sessions(read(s, d, "events"))
