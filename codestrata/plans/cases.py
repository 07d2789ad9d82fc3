"""Small stated cases of functions, parsers of formats, sources and caches, each with its rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as t
from codestrata.operators import files as fl, overview as o, parse, resolution as r, search
from codestrata.plans.fixture import _values
from codestrata.plans.registry import query
from codestrata.sources import git, reports


def _cases(name: str, schema: str, columns: str, rows: list[tuple], given: int, **exprs):
    """A query that applies column expressions, made when it runs, to the first ``given`` columns of the rows; the others are what must come out."""
    names = [c.split()[0] for c in schema.split(", ")]
    query(name, _values(columns, *rows))(lambda s, d: s.createDataFrame([x[:given] for x in rows], schema).select(*names, *(e().alias(n) for n, e in exprs.items())))


c = F.col
_cases("fx_week_start", "day string", "day, monday", [("2024-01-03", "2024-01-01"), ("2024-01-01", "2024-01-01"), ("2023-12-31", "2023-12-25"), ("soon", "soon")], 1, monday=lambda: t.week_start(c("day")))
_cases("fx_text_functions", "x string", "x, collapsed, snip, rounded", [("  a \t b\nc ", "a b c", "a b", 6), ("", "", "", 0), ("one", "one", "one", 3)], 1, collapsed=lambda: t.collapse(c("x")), snip=lambda: t.snippet(c("x")), rounded=lambda: t.clamp(F.length(F.trim("x")) - F.when(F.length("x") > 5, 1).otherwise(0), 0, 10).cast("int"))
_cases("fx_line_numbers", "x string, needle string", "x, needle, line", [("a\nb\nc", "c", 3), ("a", "a", 1), ("a", "z", None)], 2, line=lambda: t.line_number(c("x"), c("needle")))
_cases("fx_downgrade", "severity string", "severity, lower", [("high", "medium"), ("medium", "low"), ("low", "low")], 1, lower=lambda: t.downgrade(c("severity")))
_cases("fx_globs", "path string", "path, any_py, in_src, one_letter", [("src/a.py", True, True, True), ("a.pyc", False, False, False), ("src/bb.js", False, True, False)], 1, any_py=lambda: t.glob_match(c("path"), "*.py"), in_src=lambda: t.glob_match(c("path"), "src/*"), one_letter=lambda: t.glob_match(c("path"), "?.[jp]*y"))
_cases("fx_normal_paths", "path string", "path, normal", [("a/./b//../c.py", "a/c.py"), ("..\\x\\y", "../x/y"), ("a/../../b", "../b"), ("", "")], 1, normal=lambda: t.normal_path(c("path")))
_cases("fx_snake", "name string", "name, snake", [("UserController", "user_controller"), ("parseHTTPRequest", "parse_http_request"), ("plain", "plain"), ("a1B", "a1_b")], 1, snake=lambda: t.snake(c("name")))
_cases("fx_script_json", "x string", "x, held", [("</script>", '{"x":"\\u003c/script\\u003e"}'), ("a & b", '{"x":"a \\u0026 b"}')], 1, held=lambda: t.script_json(F.struct("x")))
_cases("fx_flow_questions", "question string, seeds int", "question, seeds, flows", [("How does a reach b?", 0, True), ("Where is a?", 1, False), ("Where is a?", 2, True), (None, None, False), ("the call chain of x", None, True)], 2, flows=lambda: o.flow_question(c("question"), c("seeds")))
_cases("fx_answer_clamp", "answer string, budget int", "answer, budget, shown", [("abcdef", 4, "abcd\n… 2 characters left out"), ("abc", 3, "abc")], 2, shown=lambda: o.clamp_answer(c("answer"), c("budget")))
_cases("fx_relations", "kind string", "kind, wanted", [("calls", False), ("import", True), ("Imports", True)], 1, wanted=lambda: search.related_kinds(c("kind"), ["imports"]))
_cases("fx_edge_kinds", "type string", "type, kind", [("guid_ref", "import"), ("call", "call"), ("inherit", "inherit"), ("inferred", "inferred"), ("unheard", "import"), (None, "import")], 1, kind=lambda: r.edge_kind(c("type")))
_cases("fx_trust_kinds", "origin string, type string", "origin, type, kind", [("parser", "call", "parser"), (None, "inferred", "inferred"), (None, "import", "import"), (None, None, "import")], 2, kind=lambda: r.trust_kind(c("origin"), c("type")))
_cases("fx_skipped_paths", "path string", "path, skipped, with_build, with_dist", [("a/build/x", True, False, True), ("dist/x", True, True, False), ("build", False, False, False), ("a/b.py", False, False, False), ("node_modules/x/y", True, True, True)], 1,
       skipped=lambda: fl.is_skipped(c("path")), with_build=lambda: fl.is_skipped(c("path"), include_build=True), with_dist=lambda: fl.is_skipped(c("path"), include=("dist",)))
_cases("fx_window_days", "asked int, configured int", "asked, configured, days", [(3, None, 7), (9000, 30, 3650), (None, 30, 30), (None, 3, 180), (None, None, 180), (90, 30, 90)], 2, days=lambda: reports.window_days(c("asked"), c("configured")))

_LOG = "COMMIT aa 2024-01-02 Ann B\n\n3\t1\tx.py\n-\t-\tlogo.png\nCOMMIT bb 2024-01-03 Cy\nnoise\nCOMMIT cc 2024-01-04 Di\n1\t0\ty\n"
query("fx_log", _values("project, sha, date, author, path, added, removed", ("p", "aa", "2024-01-02", "Ann B", "x.py", 3, 1), ("p", "aa", "2024-01-02", "Ann B", "logo.png", 0, 0), ("p", "bb", "2024-01-03", "Cy", None, 0, 0), ("p", "cc", "2024-01-04", "Di", "y", 1, 0)))(
    lambda s, d: git.log_rows(s.createDataFrame([("p", _LOG), ("q", None)], "project string, text string")).select("project", "sha", F.col("date").cast("string").alias("date"), "author", "path", F.col("add").alias("added"), F.col("del").alias("removed")))

_FORMATS = {
    "page.html": "<!-- <img src='no.png'> -->\n<a href='doc/x.html#top'>x</a><script src=\"a.js\"></script>\n<img srcset='i.png 1x, j.png 2x'><a href='https://x/y'>z</a>\n",
    "read.md": "# Title #\n[x](a/b.md) and ![i](pic.png)\n```\n[no](code.md)\n```\n[[Wiki Page]]\n[r]: ref.md\n",
    "conf.json": '{"main": "lib/a.js", "url": "https://x/y.js", "deep": [{"f": "b/c.yaml"}], "n": 1}',
    "q.sql": "-- from comment\ncreate view v as\nwith c as (select 1) select * from u join c on true;\ninsert into w values ('from x');\n",
    "x.toml": "[tool.x]\nname = \"conf/y.json\" # z.json\n",
    "d.inf": "[Sources]\n a.c # note\n[LibraryClasses]\n  L|pkg/l.inf\n[Depex]\n  gP\n",
    "m.asl": "Include (\"n.asl\")\nDevice (D) { }\n",
    "s.css": "@import \"base.css\";\n/* url(no.png) */ .a { background: url('bg.png') }\n",
}


def _formats(s):
    rows = [(n, p, "." + p.rsplit(".", 1)[-1], x) for n, (p, x) in enumerate(_FORMATS.items())]
    df = s.createDataFrame(rows, "file_id long, path string, ext string, text string")
    return parse.parse_files(df.drop("text"), df.select("file_id", "text"))


query("fx_format_hints", _values(
    "path, type, target, line", ("page.html", "resource_hint", "doc/x.html#top", 2), ("page.html", "import", "a.js", 2), ("page.html", "asset_ref", "i.png", 3), ("page.html", "asset_ref", "j.png", 3), ("read.md", "import", "a/b.md", 2), ("read.md", "asset_ref", "pic.png", 2),
    ("read.md", "import", "Wiki Page.md", 6), ("read.md", "import", "ref.md", 7), ("conf.json", "import", "lib/a.js", 0), ("conf.json", "config_ref", "b/c.yaml", 0), ("q.sql", "schema_ref", "u", 3), ("q.sql", "schema_ref", "w", 4), ("x.toml", "config_ref", "conf/y.json", 2),
    ("d.inf", "sources", "a.c", 2), ("d.inf", "library", "pkg/l.inf", 4), ("d.inf", "depex", "gP", 6), ("m.asl", "asl_include", "n.asl", 0), ("s.css", "import", "base.css", 0), ("s.css", "asset_ref", "bg.png", 2)))(
    lambda s, d: _formats(s).select("path", F.explode("hints").alias("h")).select("path", "h.type", "h.target", "h.line"))
query("fx_format_symbols", _values(
    "path, kind, name, line", ("read.md", "heading", "Title", 1), ("conf.json", "key", "main", 1), ("conf.json", "key", "url", 1), ("conf.json", "key", "deep", 1), ("conf.json", "key", "n", 1), ("q.sql", "view", "v", 2), ("x.toml", "section", "tool.x", 1), ("x.toml", "key", "name", 2), ("m.asl", "device", "D", 2)))(
    lambda s, d: _formats(s).select("path", F.explode("symbols").alias("y")).select("path", "y.kind", "y.name", "y.line"))
_COUNTED = [(".py", '"""doc\nmore"""\n# c\n\nx = 1  # y\n', 1, 3, 1), (".c", "/* a\n b */\nint x; // y\n// z\n", 1, 3, 0), (".sql", "-- a\nselect 1;\n\n", 1, 1, 1), (".rb", "# a\nx = 1\n", 1, 1, 0), (".js", "", 0, 0, 0)]
query("fx_line_counts", _values("ext, code, comments, blank", *((e, a, b, n) for e, _, a, b, n in _COUNTED)))(
    lambda s, d: parse.parse_files(*(lambda df: (df.drop("text"), df.select("file_id", "text")))(s.createDataFrame([(n, f"f{n}{x[0]}", x[0], x[1]) for n, x in enumerate(_COUNTED)], "file_id long, path string, ext string, text string")))
    .select(F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ext"), "code", F.col("comment").alias("comments"), "blank"))

_ANSWERS = "project string, question_hash string, answer string, saved_at long, file_hashes map<string,string>"


def _answers(s):
    asked = s.createDataFrame([(1, "p", "How does it WORK?"), (2, "p", "other"), (3, "q", "how does it work")], "question_id long, project string, question string")
    key = asked.where("question_id = 1").select(t.question_hash(F.col("question")).alias("h"))
    saved = s.createDataFrame([("p", "old", 1, {"a": "1"}), ("p", "new", 2, {"a": "2"}), ("p", "newest", 3, {"gone": "1"})], "project string, answer string, saved_at long, file_hashes map<string,string>")
    cache = saved.crossJoin(key).select("project", F.col("h").alias("question_hash"), "answer", "saved_at", "file_hashes")  # one key
    return o.cached_answers(asked, cache, s.createDataFrame([("p", "a", "2")], "project string, path string, sha string"))


query("fx_cached_answers", _values("question_id, answer", (1, "new")))(lambda s, d: _answers(s))
query("fx_valid_edges", _values("target, stale", ("b", False), ("c", True), ("d", True)))(lambda s, d: reports.valid_edges(
    s.createDataFrame([("p", "a", "b", "1", "2"), ("p", "a", "c", "1", "9"), ("p", "a", "d", "1", "1")], "project string, source string, target string, source_sha string, target_sha string"),
    s.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project string, path string, sha string")).select("target", "stale"))
query("fx_file_seeds", _values("question_id, token, path", (1, "panel", "a/panel.py"), (1, "shell_tools", "web/shell_tools_v2.js")))(lambda s, d: search.file_seeds(
    s.createDataFrame([(1, "p", "How does panel reach the shell_tools?"), (2, "p", "what is up")], "question_id long, project string, question string"),
    s.createDataFrame([("p", "web/panel.js"), ("p", "web/shell_tools_v2.js"), ("p", "a/panel.py"), ("r", "panel.js")], "project string, path string")).drop("project"))
