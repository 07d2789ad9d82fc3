"""Queries on text: search, scalar functions, security."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as t
from codestrata.operators import search, security, symbols
from codestrata.plans.registry import query
from codestrata.tables import read


@query("t_grep", """WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) line FROM source_texts WHERE regexp_matches(text, '(?i)rebuilds'))
SELECT file_id, line, substr(raw, greatest(instr(lower(raw), 'rebuilds') - 60, 1), 300) AS text FROM l WHERE regexp_matches(raw, '(?i)rebuilds')""")
def t_grep(s, d):
    return search.grep(read(s, d, "source_texts"), "file_id", "rebuilds")


@query("t_grep_groups", """WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) line FROM source_texts)
SELECT file_id, count(*) hits, min(line) first_line, least(count(*), 500) shown FROM l WHERE regexp_matches(raw, '\\breturn\\b') GROUP BY 1""")
def t_grep_groups(s, d):
    return search.grep_groups(search.grep(read(s, d, "source_texts"), "file_id", "return", case=True, word=True), "file_id")


@query("t_grep_page", """WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) raw FROM source_texts), g AS (SELECT file_id, count(*) hits FROM l WHERE regexp_matches(raw, '\\breturn\\b') GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY hits DESC, file_id) n, count(*) OVER () c FROM g) SELECT file_id, hits, CAST(n - 100 AS INT) place, c > 200 AS has_more FROM p WHERE n BETWEEN 101 AND 200""")
def t_grep_page(s, d):
    groups = search.grep_groups(search.grep(read(s, d, "source_texts"), "file_id", "return", case=True, word=True), "file_id").select("file_id", "hits")
    return search.page(groups, [F.desc("hits"), F.col("file_id")], offset=100)


@query("t_find_files", """WITH f AS (SELECT DISTINCT project, path, label FROM files), s AS (SELECT *, CASE WHEN lower(label) = 'graph' THEN 10000 WHEN starts_with(lower(label), 'graph') THEN 5000 + greatest(0, 100 - length(label))
WHEN contains(lower(label), 'graph') THEN 3000 + greatest(0, 100 - instr(lower(label), 'graph')) WHEN contains(lower(path), 'graph') THEN 1000 + greatest(0, 100 - instr(lower(path), 'graph'))
WHEN regexp_matches(lower(label), 'g.*r.*a.*p.*h') THEN 500 WHEN regexp_matches(lower(path), 'g.*r.*a.*p.*h') THEN 100 END score FROM f) SELECT * FROM s WHERE score IS NOT NULL""")
def t_find_files(s, d):
    return search.find_files(read(s, d, "files"), "graph")


@query("t_find_symbols", """WITH f AS (SELECT DISTINCT project, sid, name FROM symbols WHERE contains(lower(name), 'queue')), s AS (SELECT *, CASE WHEN lower(name) = 'queue' THEN 0 WHEN starts_with(lower(name), 'queue') THEN 1 ELSE 2 END tier FROM f) SELECT * FROM s""")
def t_find_symbols(s, d):
    return search.find_symbols(read(s, d, "symbols"), "queue")


@query("t_references", """WITH l AS (SELECT file_id, string_split(text, chr(10)) ls FROM source_texts WHERE regexp_matches(text, '\\bharbor\\b')), p AS (SELECT file_id, ls, unnest(ls) raw, generate_subscripts(ls, 1) line FROM l)
SELECT file_id, line, array_to_string(ls[greatest(line - 3, 1):line + 3], chr(10)) context FROM p WHERE regexp_matches(raw, '\\bharbor\\b')""")
def t_references(s, d):
    return search.references(read(s, d, "source_texts"), "file_id", "harbor")


@query("t_keyword_scores", """WITH m AS (SELECT project, id, max(coalesce(file_count, 0)) files FROM modules WHERE id IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, CAST(contains(lower(id), 'api') AS INT) + CAST(contains(lower(id), 'plat') AS INT) + CAST(contains(lower(id), 'config') AS INT) score FROM m)
SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, files DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 8""")
def t_keyword_scores(s, d):
    return search.keyword_scores(read(s, d, "modules"), ["api", "plat", "config", "to"])


@query("t_context")
def t_context(s, d):
    """The eval items taken as questions to every project."""
    sym = read(s, d, "symbols")
    projects = sym.where("project IS NOT NULL").select("project").distinct()
    questions = read(s, d, "eval_items").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).crossJoin(projects)
    return search.context(questions, sym, symbols.call_edges(sym, read(s, d, "source_texts")).select("src", "dst"))


@query("t_trim_history", """WITH m AS (SELECT source AS conversation, doc_id turn, text FROM documents WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER w nth, sum(coalesce(length(text), 0)) OVER (PARTITION BY conversation ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) upto
FROM m WINDOW w AS (PARTITION BY conversation ORDER BY turn DESC)) SELECT conversation, turn FROM r WHERE nth = 1 OR (nth <= 8 AND upto <= 12000)""")
def t_trim_history(s, d):
    m = read(s, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("conversation"), F.col("doc_id").alias("turn"), "text")
    return search.trim_history(m).select("conversation", "turn")


@query("t_path_functions", r"""SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) base, regexp_extract(path, '^(.*)/[^/]*$', 1) folder, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)) suffix,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') stem FROM files WHERE path IS NOT NULL""")
def t_path_functions(s, d):
    p = F.col("path")
    return read(s, d, "files").where("path IS NOT NULL").select("path", t.basename(p).alias("base"), t.parent(p).alias("folder"), t.suffix(p).alias("suffix"), t.stem(p).alias("stem")).distinct()


@query("t_name_functions", r"""SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')) snake, substr(md5(name), 1, 16) AS block_hash,
substr(sha256(trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_]', ' ', 'g'), '\s+', ' ', 'g'))), 1, 16) question_hash, CAST(length(name) // 3 AS BIGINT) tokens,
CASE WHEN length(name) <= 8 THEN repeat('*', length(name)) ELSE left(name, 4) || '…' || right(name, 4) END masked FROM symbols WHERE name IS NOT NULL""")
def t_name_functions(s, d):
    n = F.col("name")
    return read(s, d, "symbols").where("name IS NOT NULL").select("name", t.snake(n).alias("snake"), t.block_hash(n).alias("block_hash"), t.question_hash(n).alias("question_hash"), t.tokens_estimate(n).alias("tokens"), t.mask_secret(n).alias("masked")).distinct()


@query("t_entropy", """WITH n AS (SELECT DISTINCT name FROM symbols WHERE name <> ''), c AS (SELECT name, unnest(string_split(name, '')) ch FROM n), k AS (SELECT name, ch, count(*) c FROM c GROUP BY 1, 2)
SELECT name, round(-sum(c / length(name) * log2(c / length(name))), 6) entropy FROM k GROUP BY name""")
def t_entropy(s, d):
    return read(s, d, "symbols").where("name <> ''").select("name").distinct().select("name", F.round(t.entropy(F.col("name")), 6).alias("entropy"))


_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)


@query("t_query_tokens", f"""WITH r AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_./-]*')) raw, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_./-]*'), 1) i FROM eval_items),
p AS (SELECT item_id, i, lower(unnest(regexp_split_to_array(raw, '[./-]+'))) tok, generate_subscripts(regexp_split_to_array(raw, '[./-]+'), 1) j FROM r), k AS (SELECT item_id, tok, min((i, j)) pos FROM p WHERE length(tok) >= 3 AND tok NOT IN ({_STOP}) GROUP BY 1, 2),
a AS (SELECT item_id, string_agg(tok, ' ' ORDER BY pos) tokens FROM k GROUP BY 1) SELECT e.item_id, CASE WHEN e.text IS NOT NULL THEN coalesce(tokens, '') END tokens FROM eval_items e LEFT JOIN a USING (item_id)""")
def t_query_tokens(s, d):
    return read(s, d, "eval_items").select("item_id", F.array_join(t.query_tokens(F.col("text")), " ").alias("tokens"))


@query("t_security_issues")
def t_security_issues(s, d):
    return security.scan(read(s, d, "files"), read(s, d, "source_texts"))


@query("t_security_summary")
def t_security_summary(s, d):
    return security.summary(security.scan(read(s, d, "files"), read(s, d, "source_texts")))


@query("t_security_rules")
def t_security_rules(s, d):
    return security.by_rule(security.scan(read(s, d, "files"), read(s, d, "source_texts")))


@query("t_text_score", """SELECT DISTINCT project, path, CASE WHEN lower(path) = 'graph' THEN 1000 WHEN starts_with(lower(path), 'a') THEN 500 WHEN contains(lower(path), 'a') THEN 101 - instr(lower(path), 'a') ELSE -1 END AS score FROM files WHERE path IS NOT NULL""")
def t_text_score(s, d):
    return read(s, d, "files").where("path IS NOT NULL").select("project", "path").distinct().withColumn("score", search.text_score(F.col("path"), "a"))


@query("t_call_sites", r"""WITH s AS (SELECT DISTINCT sid, file_id, line "first", end_line FROM symbols WHERE sid IS NOT NULL AND lower(trim(coalesce(kind, ''))) IN ('function', 'method', 'constructor', 'func', 'def', 'fn') AND line > 0 AND end_line >= line),
l AS (SELECT file_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) raw, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) line FROM source_texts WHERE regexp_matches(text, '\breturn\b'))
SELECT sid, CAST(line AS INT) line, trim(raw, ' ') code FROM l JOIN s USING (file_id) WHERE regexp_matches(raw, '\breturn\b') AND line BETWEEN "first" AND end_line""")
def t_call_sites(s, d):
    return search.call_sites(read(s, d, "symbols"), read(s, d, "source_texts"), "return")


@query("t_related_files", r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\w.-]*\w')) word FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT DISTINCT project, path, lower(regexp_extract(path, '([^/]*)$', 1)) label FROM files WHERE project IS NOT NULL AND path IS NOT NULL), q AS (SELECT project, path, label, regexp_replace(label, '^(.+)\.[^.]*$', '\1') stem FROM p),
n AS (SELECT project, path, label word FROM q UNION SELECT project, path, stem FROM q WHERE length(stem) > 2) SELECT DISTINCT item_id, project, path FROM w JOIN n USING (word)""")
def t_related_files(s, d):
    return search.related_files(read(s, d, "eval_items"), read(s, d, "files"), "item_id")
