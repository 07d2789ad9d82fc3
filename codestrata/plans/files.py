"""Queries on files, modules and imports."""

from __future__ import annotations

from codestrata.operators import files as f
from codestrata.plans.registry import query
from codestrata.tables import read

_TYPE = "CASE WHEN {0} IN (" + ", ".join(f"'{x}'" for x in f.BINARY_EXT) + ") THEN 'binary' " + " ".join(
    f"WHEN {{0}} = '{ext}' THEN '{name}'" for ext, name in f.FILE_TYPES.items()) + " ELSE 'other' END"
_KIND = _TYPE.format("ext")
_FAMILY = "CASE " + " ".join(f"WHEN ext = '{ext}' THEN '{name}'" for ext, name in f.FAMILIES.items()) + " END"
_F = """WITH f AS (SELECT DISTINCT file_id, project, path, label, lower(ext) ext, coalesce(size, 0) size, coalesce(loc.code, 0) code, coalesce(loc.comment, 0) "comment", coalesce(loc.blank, 0) blank,
 coalesce(func_count, 0) func_count, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END module FROM files)"""
_TEST = "regexp_matches(lower(replace({0}, '\\', '/')), '" + f.TEST_PATH.replace("{", "{{") + "')"
_SKIP = "list_has_any(string_split(path, '/')[:-2], [" + ", ".join(f"'{x}'" for x in f.SKIP_DIRS) + "])"


def _files(fn):
    return lambda s, d: fn(read(s, d, "files"))


query("f_nodes", _F + f"""SELECT file_id, project, path, ext, size, code + "comment" + blank lines, module, {_KIND} kind, {_SKIP} skipped,
{_TEST.format('path')} test_dead,
regexp_matches(lower(replace(path, '\\', '/')), '(^|/)(?:test|tests|spec|specs|__tests__|fixtures|mocks)/|(?:test|[._]spec\\.)[^/]*$') test_security, {_KIND} NOT IN {f.NON_CODE} is_code FROM f""")(_files(f.file_nodes))
query("f_loc_totals", _F + """SELECT project, CAST(sum(code) AS BIGINT) code, CAST(sum("comment") AS BIGINT) "comment", CAST(sum(blank) AS BIGINT) blank, CAST(sum(code + "comment" + blank) AS BIGINT) total FROM f GROUP BY 1""")(_files(f.loc_totals))
query("f_type_counts", _F + f"SELECT project, {_KIND} kind, count(*) files FROM f GROUP BY 1, 2")(_files(f.type_counts))
query("f_top_languages", _F + """, n AS (SELECT project, coalesce(ext, '') ext, count(*) files FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, ext) nth FROM n)
SELECT project, CASE WHEN nth <= 4 THEN ext ELSE 'others' END AS name, CAST(sum(files) AS BIGINT) files FROM r GROUP BY 1, 2""")(_files(f.top_languages))
query("f_module_summary", _F + f""", m AS (SELECT project, module, count(*) FILTER ({_KIND} NOT IN ('binary', 'other')) file_count, CAST(coalesce(sum(func_count) FILTER ({_KIND} NOT IN ('binary', 'other')), 0) AS BIGINT) func_count,
count(*) FILTER ({_KIND} IN ('binary', 'other')) other_count FROM f GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY project ORDER BY module) - 1) % 15 colour FROM m""")(_files(f.module_summary))
query("f_project_types", _F + f""", w AS (SELECT project, count(*) FILTER (ext IN {f.FIRMWARE_EXT}) firmware, count(*) FILTER (ext IN {f.REACT_EXT}) react, count(*) FILTER (ext IN ('.ts', '.tsx')) typed FROM f GROUP BY 1),
n AS (SELECT project, {_FAMILY} family, count(*) files FROM f WHERE {_FAMILY} IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT project, 'react', react FROM w WHERE react > 0 AND react > typed * 0.5),
r AS (SELECT *, lead(files, 1, 0) OVER o "second" FROM n WINDOW o AS (PARTITION BY project ORDER BY files DESC, list_position({list(f.FAMILY_ORDER)}, family)) QUALIFY row_number() OVER o = 1)
SELECT w.project, CASE WHEN firmware > 0 THEN 'firmware' ELSE coalesce(family, 'c_cpp') END family, CASE WHEN firmware > 0 THEN firmware ELSE coalesce(files, 0) END files, coalesce("second", 0) "second",
CASE WHEN firmware > 0 THEN 'firmware' WHEN family IS NULL THEN 'c_cpp' WHEN "second" / files > 0.35 THEN 'mixed' ELSE family END project_type FROM w LEFT JOIN r USING (project)""")(_files(f.project_types))
query("f_treemap", _F + f"""SELECT file_id, project, round(CASE WHEN code + "comment" + blank > 0 THEN code + "comment" + blank ELSE log2(size + 1) * CASE WHEN ext IN {f.BINARY_EXT} THEN 2.2 ELSE 5.0 END END, 4) metric,
CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(string_split(path, '/')[1:2], '/') WHEN len(string_split(path, '/')) = 2 THEN split_part(path, '/', 1) ELSE coalesce(ext, '') END group_key FROM f""")(_files(f.treemap))
query("f_folder_rollup", _F + """, a AS (SELECT project, func_count, string_split(path, '/') p FROM f), b AS (SELECT project, func_count, p, unnest(range(0, len(p))) n FROM a)
SELECT project, CASE WHEN n = 0 THEN '' ELSE array_to_string(p[1:n], '/') END folder, count(*) files, CAST(sum(func_count) AS BIGINT) symbols, CAST(count(*) + sum(func_count) + ceil(count(*) * 0.25) AS BIGINT) nodes FROM b GROUP BY 1, 2""")(_files(f.folder_rollup))
query("f_fingerprint", _F + """SELECT f.project, count(*) || ':' || (SELECT count(DISTINCT sid) FROM symbols s WHERE s.project = f.project) || ':' || (SELECT count(DISTINCT edge_id) FROM module_edges e WHERE e.project = f.project)
 || ':' || count(DISTINCT module) fingerprint FROM f GROUP BY f.project""")(lambda s, d: f.fingerprint(read(s, d, "files"), read(s, d, "symbols"), read(s, d, "module_edges")))
_GROUPS = {ext: [ext, *(e for e, like in f.SAME_IMPORTS.items() if like == ext)] for ext in f.IMPORTS}
_IMPORTS = " UNION ALL ".join(f"SELECT project, path, list_concat(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1), regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 2)) refs FROM f JOIN source_texts USING (file_id) WHERE text IS NOT NULL AND ext IN ({', '.join(repr(e) for e in _GROUPS[ext])})"
                              for ext, p in f.IMPORTS.items())
_REFS = f"g AS ({_IMPORTS}), u AS (SELECT DISTINCT project, path, unnest(refs) AS ref FROM g), im AS (SELECT * FROM u WHERE ref <> '')"
_UP = r"regexp_replace({0}, '(^|/)[^/.][^/]*/\.\.(/|$)', '\1')"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace({0}, '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g'), '(/\.)?/?$', '')"
for _ in range(4):
    _NORMAL = _UP.format(_NORMAL)
_BARE = r"regexp_replace({0}, '([^/])\.[^./]*$', '\1')"
_LAST = "regexp_extract({0}, '([^/]*)$', 1)"
_SNAKE = r"lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'))"
_RESOLVED = _REFS + rf""", d0 AS (SELECT *, replace(ref, '\', '/') rs, regexp_extract(path, '^(.*/)?[^/]*$', 1) folder,
 CASE WHEN NOT contains(replace(ref, '\', '/'), '/') THEN lower(regexp_replace(regexp_replace(ref, '^(?:crate|self|super)::|^\.+', ''), '::|\.', '/', 'g')) END dotted FROM im),
d AS (SELECT *, CASE WHEN folder <> '' AND regexp_matches(rs, '[/.]') THEN {_NORMAL.format('(folder || rs)')} END seen, {_BARE.format(_LAST.format("replace(rs, '::', '/')"))} stem FROM d0),
ks AS (SELECT project, path, ref, 0 AS rule, seen AS key FROM d UNION ALL SELECT project, path, ref, 1, {_LAST.format('rs')} FROM d UNION ALL SELECT project, path, ref, 2, lower(stem) FROM d
 UNION ALL SELECT project, path, ref, 3, lower({_BARE.format(_LAST.format('seen'))}) FROM d UNION ALL SELECT project, path, ref, 4, {_SNAKE.format('stem')} FROM d WHERE NOT contains(stem, '_') AND stem <> lower(stem)
 UNION ALL SELECT project, path, ref, 5, dotted FROM d UNION ALL SELECT project, path, ref, 6, dotted FROM d),
ba AS (SELECT DISTINCT project, path, {_BARE.format('path')} bare FROM f), tl AS (SELECT project, path, string_split(lower(bare), '/') parts, unnest(range(2, len(string_split(bare, '/')) + 1)) i FROM ba),
ix AS (SELECT project, path target, 0 AS rule, path AS key FROM ba UNION ALL SELECT project, path, 1, {_LAST.format('path')} FROM ba UNION ALL SELECT project, path, unnest([2, 3, 4]), lower({_LAST.format('bare')}) FROM ba
 UNION ALL SELECT project, path, 5, lower(bare) FROM ba UNION ALL SELECT project, path, 6, array_to_string(parts[i:], '/') FROM tl),
hi AS (SELECT ks.project, path, ref, ks.rule, target FROM ks JOIN ix ON ix.project = ks.project AND ix.rule = ks.rule AND ix.key = ks.key WHERE ks.key <> ''),
ie AS (SELECT DISTINCT project, path s, target t FROM (SELECT *, min(rule) OVER (PARTITION BY project, path, ref) best FROM hi) WHERE rule = best AND path <> target)"""
query("f_imports", _F + f", {_REFS} SELECT * FROM im")(lambda s, d: f.imports(read(s, d, "files"), read(s, d, "source_texts")))
query("f_import_edges", _F + f", {_RESOLVED} SELECT * FROM ie")(lambda s, d: f.import_edges(read(s, d, "files"), read(s, d, "source_texts")))
query("f_entry_points", _F + f""", {_RESOLVED} SELECT DISTINCT project, path, CASE WHEN EXISTS (SELECT 1 FROM ie WHERE ie.project = f.project AND ie.s = f.path) THEN 'entry' ELSE 'isolated' END AS role FROM f
WHERE {_KIND} NOT IN {f.NON_CODE} AND NOT EXISTS (SELECT 1 FROM ie WHERE ie.project = f.project AND ie.t = f.path)""")(
    lambda s, d: f.entry_points(read(s, d, "files"), f.import_edges(read(s, d, "files"), read(s, d, "source_texts"))))
