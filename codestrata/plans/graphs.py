"""Queries on the module graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import files as fl, flows, graph as g, search
from codestrata.plans.files import _F, _RESOLVED
from codestrata.plans.registry import query
from codestrata.tables import read

_E = """e AS (SELECT DISTINCT edge_id, project AS scope, s, t, coalesce(weight, 1) weight, coalesce(kind, '') kind FROM module_edges WHERE project IS NOT NULL AND s <> '' AND t <> ''),
y AS (SELECT * FROM e WHERE s <> t QUALIFY row_number() OVER (PARTITION BY scope, s, t, kind ORDER BY edge_id) = 1),
dg AS (SELECT scope, node, CAST(sum(i) AS BIGINT) in_degree, CAST(sum(o) AS BIGINT) out_degree, count(*) degree FROM
  (SELECT scope, s node, 1 o, 0 i FROM y UNION ALL SELECT scope, t, 0, 1 FROM y) GROUP BY 1, 2)"""
_W = "WITH " + _E
_R = "WITH RECURSIVE " + _E


def _edges(fn):
    return lambda s, d: fn(g.module_edges(read(s, d, "module_edges")))


query("g_undirected_weights", _W + " SELECT scope, least(s, t) a, greatest(s, t) b, CAST(sum(weight) AS BIGINT) weight, count(*) edges FROM e WHERE s <> t GROUP BY 1, 2, 3")(_edges(g.undirected_weights))
query("g_typed_edges", _W + " SELECT * FROM y")(_edges(g.typed_edges))
query("g_degrees", _W + " SELECT *, CASE WHEN max(in_degree) OVER (PARTITION BY scope) > 0 THEN round(in_degree / max(in_degree) OVER (PARTITION BY scope), 4) ELSE 0 END centrality FROM dg")(_edges(g.degrees))
query("g_top_targets", _W + """, n AS (SELECT scope, t node, count(*) edges FROM y GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY edges DESC, node) AS rank, count(*) OVER (PARTITION BY scope) c FROM n)
SELECT scope, node, edges, rank, CASE WHEN rank / c <= 0.1 THEN 'critical' WHEN rank / c <= 0.25 THEN 'warn' ELSE 'info' END tier FROM r WHERE rank <= 50""")(_edges(g.top_targets))
query("g_mutual", _W + " SELECT DISTINCT x.scope, x.s a, x.t b FROM e x JOIN e z ON x.scope = z.scope AND x.s = z.t AND x.t = z.s WHERE x.s < x.t")(_edges(g.mutual))
query("g_flows", _W + """, n AS (SELECT scope, node, sum(weight) total FROM (SELECT scope, s node, weight FROM e WHERE s <> t UNION ALL SELECT scope, t, weight FROM e WHERE s <> t) GROUP BY 1, 2),
k AS (SELECT scope, node FROM n QUALIFY row_number() OVER (PARTITION BY scope ORDER BY total DESC, node) <= 15)
SELECT e.scope, coalesce(a.node, 'others') s, coalesce(b.node, 'others') t, CAST(sum(weight) AS BIGINT) weight FROM e LEFT JOIN k a ON a.scope = e.scope AND a.node = e.s LEFT JOIN k b ON b.scope = e.scope AND b.node = e.t
WHERE e.s <> e.t GROUP BY 1, 2, 3""")(_edges(g.flows))
query("g_concentration", _W + """, n AS (SELECT scope, t node, count(*) edges FROM y GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY edges DESC, node) k FROM n)
SELECT scope, CAST(sum(edges) FILTER (k <= 3) AS BIGINT) top_edges, CAST(sum(edges) AS BIGINT) edges, CAST(floor(100 * sum(edges) FILTER (k <= 3) / sum(edges) + 0.5) AS BIGINT) percent FROM r GROUP BY 1""")(_edges(g.concentration))
query("g_trust_summary", _W + """, l AS (SELECT scope, CASE WHEN lower(kind) LIKE '%deriv%' THEN 'DERIVED' WHEN lower(kind) LIKE '%infer%' OR lower(kind) = 'semantic' THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS label FROM e),
a AS (SELECT DISTINCT scope, unnest(['EXTRACTED', 'DERIVED', 'INFERRED', 'AMBIGUOUS']) AS label FROM e)
SELECT a.scope, a.label, count(l.scope) edges FROM a LEFT JOIN l ON a.scope = l.scope AND a.label = l.label GROUP BY 1, 2""")(_edges(g.trust_summary))


def _file_edges(s, d):
    return fl.import_edges(read(s, d, "files"), read(s, d, "source_texts")).select(F.col("project").alias("scope"), "s", "t", F.lit("import").alias("kind"))


query("g_surprising", _F + f""", {_RESOLVED}, n AS (SELECT project, node, count(*) c FROM (SELECT project, s node FROM ie UNION ALL SELECT project, t FROM ie) GROUP BY 1, 2),
j AS (SELECT ie.project AS scope, s, t, split_part(s, '/', 1) <> split_part(t, '/', 1) dir, regexp_extract(s, '[^/](\\.[^./]*)$', 1) xs, regexp_extract(t, '[^/](\\.[^./]*)$', 1) xt, greatest(a.c, b.c) / least(a.c, b.c) >= 10 hub
  FROM ie JOIN n a ON a.project = ie.project AND a.node = s JOIN n b ON b.project = ie.project AND b.node = t),
c AS (SELECT scope, s, t, 2 * CAST(dir AS INT) + 2 * CAST(xs <> '' AND xt <> '' AND xs <> xt AS INT) + CAST(hub AS INT) AS score,
  concat_ws(' + ', CASE WHEN dir THEN 'cross-directory' END, CASE WHEN xs <> '' AND xt <> '' AND xs <> xt THEN 'cross-language' END, CASE WHEN hub THEN 'peripheral→hub' END) AS reason FROM j),
p AS (SELECT * FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY scope, least(s, t), greatest(s, t) ORDER BY score DESC, s, t) = 1)
SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, s, t) AS rank FROM p QUALIFY rank <= 5""")(lambda s, d: g.surprising(_file_edges(s, d)))


query("g_edge_weights", _W + " SELECT scope, s, t, kind, count(*) times FROM e WHERE s <> t GROUP BY 1, 2, 3, 4")(_edges(flows.edge_weights))
query("g_folder_flows", _F + f""", {_RESOLVED}, p AS (SELECT project, split_part(min(path), '/', 1) prefix FROM f WHERE contains(path, '/') GROUP BY 1), w AS (SELECT ie.project, s, t, prefix FROM ie JOIN p USING (project) WHERE starts_with(s, prefix || '/') OR starts_with(t, prefix || '/')),
x AS (SELECT project, CASE WHEN starts_with(s, prefix || '/') THEN split_part(substr(s, length(prefix) + 2), '/', 1) ELSE '[' || split_part(s, '/', 1) || ']' END s, CASE WHEN starts_with(t, prefix || '/') THEN split_part(substr(t, length(prefix) + 2), '/', 1) ELSE '[' || split_part(t, '/', 1) || ']' END t FROM w),
fl AS (SELECT project, s, t, count(*) edges FROM x WHERE s <> t GROUP BY 1, 2, 3), k1 AS (SELECT project, s FROM fl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY sum(edges) DESC, s) <= 24), k2 AS (SELECT project, t FROM fl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY sum(edges) DESC, t) <= 24)
SELECT fl.project, coalesce(k1.s, 'others') s, coalesce(k2.t, 'others') t, CAST(sum(edges) AS BIGINT) edges FROM fl LEFT JOIN k1 ON k1.project = fl.project AND k1.s = fl.s LEFT JOIN k2 ON k2.project = fl.project AND k2.t = fl.t GROUP BY 1, 2, 3""")(
    lambda s, d: flows.fold_sides(flows.folder_flows(_file_edges(s, d).withColumnRenamed("scope", "project"), read(s, d, "files").where("contains(path, '/')").groupBy("project").agg(F.substring_index(F.min("path"), "/", 1).alias("prefix")))))
query("g_cycle_examples")(_edges(lambda e: g.cycle_examples(e, g.strong_components(e))))
query("g_explain", _W + """, n AS (SELECT DISTINCT project AS scope, id node FROM modules WHERE project IS NOT NULL AND contains(lower(id), 'a')), u AS (SELECT DISTINCT scope, s, t FROM e WHERE s <> t),
a AS (SELECT scope, s node, t other, row_number() OVER (PARTITION BY scope, s ORDER BY t) k FROM u), b AS (SELECT scope, t node, s other, row_number() OVER (PARTITION BY scope, t ORDER BY s) k FROM u),
x AS (SELECT scope, node, count(*) c, string_agg(other, ', ' ORDER BY k) FILTER (k <= 10) l FROM a GROUP BY 1, 2), y2 AS (SELECT scope, node, count(*) c, string_agg(other, ', ' ORDER BY k) FILTER (k <= 10) l FROM b GROUP BY 1, 2)
SELECT n.scope, n.node, CASE WHEN coalesce(x.c, 0) = 0 AND coalesce(y2.c, 0) = 0 THEN 'isolated' WHEN coalesce(y2.c, 0) = 0 THEN 'entry' WHEN coalesce(x.c, 0) = 0 THEN 'leaf' WHEN y2.c >= 4 * x.c THEN 'hub' ELSE 'link' END AS role,
coalesce(x.c, 0) imports, coalesce(y2.c, 0) imported_by, coalesce(x.l, '') uses, coalesce(y2.l, '') used_by FROM n LEFT JOIN x ON x.scope = n.scope AND x.node = n.node LEFT JOIN y2 ON y2.scope = n.scope AND y2.node = n.node""")(
    lambda s, d: search.explain(g.module_edges(read(s, d, "module_edges")), read(s, d, "modules").select(F.col("project").alias("scope"), F.col("id").alias("node")).where("scope IS NOT NULL"), "a"))


def _by_letter(e):
    return g.modularity(e, e.select("scope", F.explode(F.array("s", "t")).alias("node")).distinct().withColumn("community", F.substring("node", 1, 1)))


def _dominant(s, d):
    """The community most files of a module are in, of the communities of files by imports."""
    e = _file_edges(s, d).withColumn("weight", F.lit(1).cast("long"))
    labels = g.large_communities(g.communities(e))
    return g.dominant_community(labels, labels.select("scope", "node", fl.module_of(F.col("node")).alias("file")))


def _starts(edges):
    """The most imported module of each project."""
    return g.top_targets(edges, 1).select("scope", F.col("node").alias("start"))


def _pairs(edges):
    return edges.groupBy("scope").agg(F.min(F.least("s", "t")).alias("a"), F.max(F.greatest("s", "t")).alias("b")).where("a <> b")


_START = ", st AS (SELECT scope, t AS start FROM y GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, t) = 1)"
query("g_impact", _R + _START + """, b(scope, start, node, hops) AS (SELECT scope, start, start, 0 FROM st UNION SELECT b.scope, start, y.s, hops + 1 FROM b JOIN y ON y.scope = b.scope AND y.t = b.node WHERE hops < 6)
SELECT scope, start, node, min(hops) hops FROM b GROUP BY 1, 2, 3""")(
    _edges(lambda e: g.distances(e.select("scope", F.col("t").alias("s"), F.col("s").alias("t")), _starts(e), 6)))
query("g_neighbourhood", _R + _START + """, u AS (SELECT scope, s, t FROM y UNION SELECT scope, t, s FROM y),
b(scope, start, node, hops) AS (SELECT scope, start, start, 0 FROM st UNION SELECT b.scope, start, u.t, hops + 1 FROM b JOIN u ON u.scope = b.scope AND u.s = b.node WHERE hops < 2)
SELECT scope, start, node, min(hops) hops FROM b GROUP BY 1, 2, 3""")(_edges(lambda e: g.distances(e, _starts(e), 2, directed=False)))
query("g_shortest_path")(_edges(lambda e: g.shortest_path(e, _pairs(e))))
query("g_path_lengths", _R + """, u AS (SELECT scope, s, t FROM y UNION SELECT scope, t, s FROM y), pr AS (SELECT scope, min(least(s, t)) a, max(greatest(s, t)) b FROM e GROUP BY 1 HAVING min(least(s, t)) <> max(greatest(s, t))),
b(scope, a, node, hops) AS (SELECT scope, a, a, 0 FROM pr UNION SELECT b.scope, b.a, u.t, hops + 1 FROM b JOIN u ON u.scope = b.scope AND u.s = b.node WHERE hops < 8)
SELECT pr.scope, pr.a, pr.b, min(hops) hops FROM pr JOIN b ON b.scope = pr.scope AND b.node = pr.b GROUP BY 1, 2, 3""")(_edges(lambda e: g.shortest_path(e, _pairs(e)).drop("path")))
query("g_components", _R + """, x AS (SELECT DISTINCT scope, s, t FROM y), r(scope, a, b) AS (SELECT scope, s, t FROM x UNION SELECT r.scope, a, t FROM r JOIN x ON x.scope = r.scope AND x.s = r.b),
m AS (SELECT p.scope, p.a node, greatest(p.a, max(p.b)) component FROM r p JOIN r q ON p.scope = q.scope AND p.a = q.b AND p.b = q.a GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY scope, component) AS size FROM m QUALIFY size > 1""")(_edges(g.strong_components))
query("g_cycle_report", _R + """, x AS (SELECT DISTINCT scope, s, t FROM y), r(scope, a, b) AS (SELECT scope, s, t FROM x UNION SELECT r.scope, a, t FROM r JOIN x ON x.scope = r.scope AND x.s = r.b),
m AS (SELECT p.scope, p.a node, greatest(p.a, max(p.b)) component FROM r p JOIN r q ON p.scope = q.scope AND p.a = q.b AND p.b = q.a GROUP BY 1, 2), n AS (SELECT scope, component, count(*) AS size FROM m GROUP BY 1, 2 HAVING count(*) > 1)
SELECT *, CASE WHEN size >= 10 THEN 'critical' WHEN size >= 5 THEN 'warn' ELSE 'info' END tier FROM n""")(_edges(lambda e: g.cycle_report(g.strong_components(e))))
query("g_communities")(_edges(g.communities))
query("g_communities_gain", _W + " SELECT DISTINCT scope, TRUE AS no_worse FROM e WHERE s <> t")(_edges(lambda e: g.modularity(e, g.communities(e)).join(_by_letter(e).select("scope", F.col("modularity").alias("other")), "scope").select("scope", (F.col("modularity") >= F.col("other")).alias("no_worse"))))
query("g_dominant_community")(lambda s, d: _dominant(s, d))
query("g_modularity")(_edges(lambda e: g.modularity(e, g.communities(e))))
query("g_modularity_by_letter", _W + """, u AS (SELECT scope, least(s, t) a, greatest(s, t) b, sum(weight) weight FROM e WHERE s <> t GROUP BY 1, 2, 3), k AS (SELECT scope, left(a, 1) ca, left(b, 1) cb, weight FROM u),
m AS (SELECT scope, sum(weight) m FROM k GROUP BY 1), i AS (SELECT scope, ca c, sum(weight) w FROM k WHERE ca = cb GROUP BY 1, 2), n AS (SELECT scope, c, sum(weight) w FROM (SELECT scope, ca c, weight FROM k UNION ALL SELECT scope, cb, weight FROM k) GROUP BY 1, 2)
SELECT n.scope, round(sum(coalesce(i.w, 0) / m - pow(n.w / (2 * m), 2)), 6) modularity, count(*) communities FROM n JOIN m ON m.scope = n.scope LEFT JOIN i ON i.scope = n.scope AND i.c = n.c GROUP BY 1""")(
    _edges(_by_letter))
