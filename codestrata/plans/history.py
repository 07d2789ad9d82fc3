"""Queries on version history."""

from __future__ import annotations

from codestrata.operators import history as h
from codestrata.plans.registry import query
from codestrata.tables import read

_C = r"""WITH c AS (SELECT DISTINCT sha, project, date, CASE WHEN length(trim(author)) > 0 THEN trim(author) ELSE 'Unknown' END author FROM commits),
k AS (SELECT DISTINCT sha, regexp_replace(replace(path, '\', '/'), '^\./', '') path, coalesce("add", 0) "add", coalesce(del, 0) del FROM commit_files),
f AS (SELECT * FROM k WHERE path <> ''), x AS (SELECT f.*, project, date, author FROM f JOIN c USING (sha)),
p AS (SELECT sha, CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del, count(*) files FROM f GROUP BY 1),
t AS (SELECT c.*, coalesce(p."add", 0) "add", coalesce(p.del, 0) del, coalesce(files, 0) files FROM c LEFT JOIN p USING (sha)),
w AS (SELECT project, CAST(date_trunc('week', date) AS DATE) AS week, count(*) commits, CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del FROM t GROUP BY 1, 2),
d AS (SELECT project, date, count(*) commits, CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del FROM t GROUP BY 1, 2)
"""
_SUMS = 'CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del'


def _two(f):
    return lambda s, d: f(read(s, d, "commits"), read(s, d, "commit_files"))


query("h_author_activity", _C + """, a AS (SELECT project, author, count(*) commits, CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del FROM t GROUP BY 1, 2)
SELECT *, round(commits / sum(commits) OVER (PARTITION BY project), 3) share, row_number() OVER (PARTITION BY project ORDER BY commits DESC, author) AS rank FROM a QUALIFY rank <= 20""")(_two(h.author_activity))
query("h_timeline", _C + "SELECT * FROM w")(_two(h.timeline))
query("h_daily", _C + "SELECT * FROM d")(_two(h.daily))
query("h_file_churn", _C + f"SELECT project, path, count(*) changes, {_SUMS} FROM x GROUP BY 1, 2")(_two(h.file_churn))
query("h_file_timeline", _C + f"""SELECT project, path, CAST(date_trunc('week', date) AS DATE) AS week, count(DISTINCT sha) commits, {_SUMS} FROM x
WHERE (project, path) IN (SELECT (project, path) FROM files) GROUP BY 1, 2, 3""")(
    lambda s, d: h.file_timeline(read(s, d, "commits"), read(s, d, "commit_files"), read(s, d, "files")))
query("h_commits_by_day", _C + """, n AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path, "add", del) nth FROM f),
l AS (SELECT sha, count(*) n_files, string_agg(path, chr(10) ORDER BY nth) FILTER (nth <= 60) files FROM n GROUP BY 1)
SELECT project, date, c.sha, author, coalesce(n_files, 0) n_files, coalesce(files, '') files, coalesce(n_files, 0) > 60 capped FROM c LEFT JOIN l USING (sha)""")(_two(h.commits_by_day))
query("h_change_groups", _C + f"""SELECT CASE WHEN grouping(author) = 0 THEN 'author' WHEN grouping(week) = 0 THEN 'week' ELSE 'day' END grain, project, author, week, date, path,
count(*) changes, {_SUMS} FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM x) GROUP BY GROUPING SETS ((project, author, path), (project, week, path), (project, date, path))""")(_two(h.change_groups))
query("h_bus_factor", _C + """, a AS (SELECT project, path, author, count(DISTINCT sha) n FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY project, path) total, row_number() OVER o AS rank, sum(n) OVER (PARTITION BY project, path ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) upto
  FROM a WINDOW o AS (PARTITION BY project, path ORDER BY n DESC, author)),
b AS (SELECT project, path, CAST(max(total) AS BIGINT) commits, max(rank) authors, min(CASE WHEN upto * 2 > total THEN rank END) bus_factor, max(CASE WHEN rank = 1 THEN author END) primary_author,
  round(max(CASE WHEN rank = 1 THEN n / total END), 3) primary_share FROM r WHERE total >= 3 GROUP BY 1, 2)
SELECT *, CASE WHEN primary_share >= 0.8 THEN 'high' WHEN primary_share >= 0.5 THEN 'medium' ELSE 'low' END risk FROM b""")(_two(h.bus_factor))
_CX = """cx AS (SELECT project, file path, avg(complexity) complexity FROM (SELECT DISTINCT sid, project, file, complexity FROM symbols
  WHERE lower(trim(kind)) IN ('function', 'method') AND complexity IS NOT NULL) GROUP BY 1, 2)"""
query("h_file_complexity", f"WITH {_CX} SELECT * FROM cx")(lambda s, d: h.file_complexity(read(s, d, "symbols")))
query("h_hotspots", _C + f""", {_CX}, a AS (SELECT project, path, count(*) changes FROM x GROUP BY 1, 2),
j AS (SELECT a.*, complexity, max(changes) OVER (PARTITION BY project) tc, max(complexity) OVER (PARTITION BY project) tx FROM a LEFT JOIN cx USING (project, path)),
s AS (SELECT *, round(100 * (changes / tc) * coalesce(complexity / tx, 0.5), 4) score FROM j)
SELECT project, path, changes, round(complexity, 4) complexity, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, changes DESC, path) AS rank FROM s QUALIFY rank <= 20""")(
    lambda s, d: h.hotspots(read(s, d, "commits"), read(s, d, "commit_files"), read(s, d, "symbols")))
query("h_peak_week", _C + """SELECT project, CAST(sum(commits) AS BIGINT) commits, CAST(sum("add") AS BIGINT) "add", CAST(sum(del) AS BIGINT) del, count(*) AS weeks,
arg_min(week, (-commits, week)) peak_week, max(commits) peak_commits FROM w GROUP BY 1""")(_two(h.peak_week))
query("h_heatmap", _C + """, s AS (SELECT project, CAST(date_trunc('week', min(date)) AS DATE) a, max(date) b, max(commits) most FROM d GROUP BY 1),
g AS (SELECT project, most, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT g.project, g.date, coalesce(commits, 0) commits, most FROM g LEFT JOIN d USING (project, date)""")(_two(h.heatmap))
query("h_initial_range", _C + "SELECT project, max(date) - min(date) + 1 span, CASE WHEN max(date) - min(date) + 1 > 180 THEN 180 ELSE max(date) - min(date) + 1 END AS days FROM c GROUP BY 1")(
    lambda s, d: h.initial_range(read(s, d, "commits")))
query("h_recent", _C + "SELECT * FROM d QUALIFY date >= max(date) OVER (PARTITION BY project) - 90")(_two(h.recent))
for _bucket, _at in (("week", "CAST(date_trunc('week', date) AS DATE)"), ("day", "date")):
    query(f"h_newest_per_{_bucket}", _C + f"""SELECT project, {_at} AS bucket, sha, date, author FROM c QUALIFY row_number() OVER (PARTITION BY project, {_at} ORDER BY date DESC, sha DESC) = 1""")(
        lambda s, d, b=_bucket: h.newest_per_bucket(read(s, d, "commits"), b))
query("h_window_fallback", _C + """, a AS (SELECT project, DATE '2026-12-31' - date age FROM c WHERE date <= DATE '2026-12-31'),
n AS (SELECT project, CASE WHEN min(age) <= 180 THEN 180 WHEN min(age) <= 365 THEN 365 WHEN min(age) <= 730 THEN 730 WHEN min(age) <= 1460 THEN 1460 ELSE 3650 END AS days FROM a GROUP BY 1)
SELECT project, days, count(*) FILTER (age <= days) commits FROM a JOIN n USING (project) GROUP BY 1, 2""")(lambda s, d: h.window_fallback(read(s, d, "commits"), "2026-12-31"))
query("h_top_coupling", _C + """, q AS (SELECT DISTINCT sha, path FROM f), z AS (SELECT sha FROM q GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), o AS (SELECT DISTINCT sha, project FROM c),
b AS (SELECT project, sha, path FROM q JOIN z USING (sha) JOIN o USING (sha)),
g AS (SELECT a.project, a.path file_a, e.path file_b, count(*) together FROM b a JOIN b e ON a.sha = e.sha AND a.project = e.project AND a.path < e.path GROUP BY 1, 2, 3 HAVING count(*) >= 3),
n AS (SELECT project, count(*) commits FROM o GROUP BY 1)
SELECT project, file_a, file_b, together, round(together / commits, 3) support, row_number() OVER (PARTITION BY project ORDER BY together DESC, file_a, file_b) AS rank
FROM g JOIN n USING (project) QUALIFY rank <= 30""")(_two(h.top_coupling))
query("h_daily_snapshots", _C + """, a AS (SELECT project, date bucket, sha, date, author FROM c QUALIFY row_number() OVER (PARTITION BY project, date ORDER BY sha DESC) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY project ORDER BY bucket DESC) <= 500""")(lambda s, d: h.daily_snapshots(read(s, d, "commits")))
