"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from codestrata.llm import coupling, docpairs, encoding, handwritten, leakage, packing
from codestrata.tables import read

_PAIRS = r"""
WITH i AS (SELECT DISTINCT sha, regexp_replace(replace(path, '\', '/'), '^\./', '') path FROM commit_files),
o AS (SELECT DISTINCT sha, project FROM commits),
k AS (SELECT sha FROM i WHERE path <> '' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
r AS MATERIALIZED (SELECT o.project, i.sha, i.path FROM i JOIN k USING (sha) JOIN o USING (sha) WHERE path <> ''),
n AS (SELECT project, count(DISTINCT sha) n FROM r GROUP BY 1), c AS (SELECT project, path, count(*) c FROM r GROUP BY 1, 2),
p AS (SELECT a.project, a.path file_a, b.path file_b, count(*) c FROM r a JOIN r b ON a.sha = b.sha AND a.project = b.project AND a.path < b.path GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT {} FROM p JOIN n USING (project) JOIN c ca ON ca.project = p.project AND ca.path = file_a JOIN c cb ON cb.project = p.project AND cb.path = file_b
WHERE p.c * n.n >= 3 * ca.c * cb.c
"""


def _coupling(spark, d):
    return coupling.change_coupling(read(spark, d, "commit_files"), read(spark, d, "commits"))


def _pairs(spark, d, with_code=True):
    return docpairs.documented_pairs(read(spark, d, "symbols"), read(spark, d, "source_texts"), with_code)


def _windows(spark, d):
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "context_windows"))


QUERIES = {
    "p1_found": lambda s, d: _coupling(s, d).select("project", "file_a", "file_b"),
    "p1_coupling": _coupling,
    "p3_found": lambda s, d: handwritten.not_handwritten(read(s, d, "files"), read(s, d, "source_texts")).select("file_id"),
    "p4_found": lambda s, d: _pairs(s, d, with_code=False).select("sid"),
    "p4_pairs": lambda s, d: _pairs(s, d),
    "p4_functions": lambda s, d: docpairs.file_functions(read(s, d, "files"), read(s, d, "source_texts")),
    "p6_windows": _windows,
    "p6_invariants": lambda s, d: packing.check(_windows(s, d), read(s, d, "documents")),
    "p6_report": lambda s, d: packing.fill_report(_windows(s, d)),
    "p7_found": lambda s, d: leakage.leaks(read(s, d, "documents"), read(s, d, "eval_items")),
    "p8_found": lambda s, d: encoding.garbled(read(s, d, "documents")).select("doc_id").distinct(),
    "p8_repaired": lambda s, d: encoding.garbled(read(s, d, "documents")),
}

# Words as runs of letters and digits in lower case after canonical composition, which is what SQL has; where compatibility composition differs, the two may. Every run of 12 words is joined.
_LEAKED = r"""
WITH t AS (SELECT 'd' k, doc_id id, text FROM documents UNION ALL SELECT DISTINCT 'i', item_id, text FROM eval_items), u AS (SELECT k, id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\p{L}\p{N}]+') w FROM t WHERE text IS NOT NULL AND id IS NOT NULL),
g AS (SELECT k, id, array_to_string(w[i:i + 11], ' ') run FROM (SELECT *, unnest(range(1, len(w) - 10)) i FROM u WHERE len(w) >= 12))
SELECT DISTINCT d.id doc_id, i.id item_id FROM g d JOIN g i ON d.k = 'd' AND i.k = 'i' AND d.run = i.run
"""

# A case each of what makes a pair and what doesn't: (sid, file, name, kind, line, doc).
_SOURCES = {1: ("a.c", "int cut(int a) {\n  x();\n\nint whole(int b) {\n  return b;\n}\n"), 2: ("b.py", "class K:\n    def load(self, n):\n        \"\"\"d\"\"\"\n        return n\n\n    def drop(self):\n        pass\n"),
            3: ("c.rb", "module M\n  def go(a)\n    if a\n      a.each do |x|\n      end\n    end\n  end\nend\n"), 4: ("d.js", "}\nfunction run(a) {\n  return '}';\n}\n")}
_SYMBOLS = [
    ("torn", 1, "cut", "function", 1, "Drains what is queued."), ("whole", 1, "whole", " FUNC ", 4, "/** Counts the bytes left. */"), ("absent", 1, "gone", "function", 2, "Says something of its own."), ("elsewhere", 1, "whole", "function", 5, "Says something of its own."),
    ("member", 2, "load", "method", 2, "@return order after sorting by weight\n@param n n"), ("empty", 2, "drop", "def", 6, "TODO: write docs"), ("type", 2, "K", "class", 1, "Real words, but no callable."), ("nested", 3, "go", "fn", 2, "# Visits every member once."),
    ("pointer", 3, "go", "def", 2, "See above."), ("after", 4, "run", "function", 2, "Verwirft veraltete Zeilen und gibt die Anzahl zurück."), ("nowhere", 9, "run", "function", 2, "Says something of its own.")]
_CASES = [("torn", "int cut(int a) {\n  x();", "Drains what is queued.", False), ("whole", "int whole(int b) {\n  return b;\n}", "Counts the bytes left.", True), ("member", "    def load(self, n):\n        \"\"\"d\"\"\"\n        return n", "order after sorting by weight", True),
          ("nested", "  def go(a)\n    if a\n      a.each do |x|\n      end\n    end\n  end", "Visits every member once.", True), ("after", "function run(a) {\n  return '}';\n}", "Verwirft veraltete Zeilen und gibt die Anzahl zurück.", True)]


def _pair_cases(spark):
    s = spark.createDataFrame([(a, "p", b, _SOURCES.get(b, ("x.c",))[0], c, k, n, d) for a, b, c, k, n, d in _SYMBOLS], "sid string, project string, file_id long, file string, name string, kind string, line int, doc string")
    return docpairs.documented_pairs(s, spark.createDataFrame([(k, v[1]) for k, v in _SOURCES.items()], "file_id long, text string")).select("sid", "code", "description", "whole")


# Sentences of several languages, and how every tenth of them came to be garbled.
_SENTENCES = ["Für große Projekte dauert die Prüfung länger, während die Übersicht größtenteils überflüssig wäre.", "Voilà pourquoi la mémoire est saturée après la dernière révision du dépôt.", "Функция вызывается только из тестов, её можно удалить без последствий.",
              "La búsqueda tardó más de lo habitual según el análisis; ningún autor modificó el módulo.", "São necessárias três confirmações antes da remoção; a função não é chamada."]
_READ_AS = ["latin-1", "cp437", "mac_roman"]


def _garbled_texts():
    for i in range(400):
        text = " ".join(_SENTENCES[(i + k * (1 + i % 3)) % 5] for k in range(3))
        page = _READ_AS[i // 10 % 3] if i % 10 == 0 else None
        yield i, text.encode("utf-8").decode(page) if page else text, page and text


def _repair_cases(spark):
    return encoding.garbled(spark.createDataFrame([(i, t, f"s{i % 4}") for i, t, _ in _garbled_texts()], "doc_id long, text string, source string")).select("doc_id", "restored")


def _values(columns, rows):
    lit = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


QUERIES |= {"p4_cases": lambda s, d: _pair_cases(s), "p8_cases": lambda s, d: _repair_cases(s)}

SQL = {
    "p4_cases": _values("sid, code, description, whole", _CASES),
    "p8_cases": _values("doc_id, restored", [(i, t) for i, _, t in _garbled_texts() if t]),
    "p7_found": _LEAKED,
    # What must hold whatever the tokenizer: nothing lost, split without need, overlapping or too full, and few windows.
    "p6_invariants": "SELECT DISTINCT window_name, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) gaps, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) overfull, TRUE few_windows FROM context_windows WHERE window_name IS NOT NULL AND capacity > 0",
    "p1_found": _PAIRS.format("p.project, file_a, file_b"),
    "p1_coupling": _PAIRS.format(
        "p.project, file_a, file_b, p.c co_changes, ca.c changes_a, cb.c changes_b, n.n baskets, p.c * n.n / (ca.c * cb.c) lift"),
}
