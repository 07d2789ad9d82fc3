"""Queries on a small project that ships with the library, for rules that the warehouse's tables have no case of. Their SQL states the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.operators import calibration, files as fl, graph, history, parse, quality, resolution as r, symbols as y
from codestrata.plans.registry import query
from codestrata.tables import materialize

SOURCES = {
    "app/main.py": 'import os\nfrom app.store import Store\n\n\nclass Shop(Store):\n    """Sells things."""\n\n    def load(self, path: Shelf) -> Crate:\n        """Takes what is there."""\n        if path and self.ok:\n            return fetch(path)\n        return None\n\n    @staticmethod\n    def _run():\n        subprocess.run(["python", "job.py"])\n\n\ndef sell():\n    json.dump(rows, open("sales.json", "w"))\n    return fetch(1)\n',
    "app/store.py": 'class Store:\n    def load(self, path):\n        return path\n\n\ndef fetch(path):\n    return tidy(path)\n\n\ndef tidy(path):\n    return open("conf/site.toml")\n',
    "tools/job.py": 'from ..app import store\n\nrows = load("sales.json")\n',
    "conf/site.toml": "[app]\nname = \"x\"\n",
    "web/page.html": "<script src='panel.js'></script>\n<img src='img/logo.png'>\n",
    "web/panel.js": "function boot() {\n  Shell.open();\n}\n",
    "web/shell.js": "import { draw } from './lib/draw_tools';\nwindow.Shell = draw(1);\n",
    "web/lib/draw_tools.js": "// Draws it.\nexport function draw(n) {\n  return n ? 1 : 2;\n}\n",
    "src/Depot.java": "package src;\nimport src.base.Shelf;\n/** Holds things. */\npublic class Depot extends Shelf {\n  private Crate crate;\n  /**\n   * Adds one.\n   */\n  @Override\n  public static int stow(Crate c, int n) {\n    if (n > 0 && c != null) { push(c); }\n    return n;\n  }\n  private void drop() {\n    stow(crate, 1);\n  }\n}\n",
    "src/base/Shelf.java": "package src.base;\npublic class Shelf {\n  public void drop() {\n    free();\n  }\n}\n",
    "fw/Drv.inf": "[Sources]\n  form.vfr\n[Packages]\n  fw/Pkg.dec\n[Guids]\n  gTankGuid\n",
    "fw/Pkg.dec": "[Guids]\n  # Names the tank.\n  gTankGuid = { 1 }\n",
    "fw/form.vfr": "prompt = STRING_TOKEN(STR_TANK);\n",
    "fw/text.uni": "#string STR_TANK #language en \"Tank\"\n",
    "lib/tank.rb": "# What holds water.\nmodule Vessel\nend\n\nclass Tank\n  include Vessel\n  extend Shared::Locks\nend\n",
    "lib/locks.rb": "module Locks\nend\n",
    "tests/test_shop.py": "def test_sell():\n    assert sell()\n",
}


def files(spark: SparkSession) -> DataFrame:
    rows = [(n, "fx", p, p.rsplit("/", 1)[-1], "." + p.rsplit(".", 1)[-1], len(t), None, 0) for n, (p, t) in enumerate(SOURCES.items())]
    return spark.createDataFrame(rows, "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int")


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SOURCES.values())), "file_id long, text string")


def parsed(spark: SparkSession) -> DataFrame:
    return materialize(parse.parse_files(files(spark), texts(spark)), "fixture")


def symbols(spark: SparkSession) -> DataFrame:
    """The parsed symbols in the form of the warehouse's table."""
    return materialize(parse.symbol_rows(parse.parse_files(files(spark), texts(spark)), files(spark)).withColumnRenamed("sym_id", "sid").withColumnRenamed("path", "file"), "fixture-symbols")


def _values(columns: str, *rows: tuple) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, x)) + ')' for x in rows)}) v({columns})"


def _names(c: str):
    return F.array_join(c, " ").alias(c)


query("fx_symbols", _values(
    "path, kind, name, line, end_line, parent, is_public, is_static, complexity, doc, decorators, bases, type_refs",
    ("app/main.py", "class", "Shop", 5, 16, None, True, False, None, "Sells things.", "", "Store", "Store"), ("app/main.py", "method", "load", 8, 12, "Shop", True, False, 3, "Takes what is there.", "", "", "Shelf Crate"),
    ("app/main.py", "method", "_run", 15, 16, "Shop", False, True, 1, None, "staticmethod", "", ""), ("app/main.py", "function", "sell", 19, 21, None, True, False, 1, None, "", "", ""),
    ("app/store.py", "class", "Store", 1, 3, None, True, False, None, None, "", "", ""), ("app/store.py", "method", "load", 2, 3, "Store", True, False, 1, None, "", "", ""),
    ("app/store.py", "function", "fetch", 6, 7, None, True, False, 1, None, "", "", ""), ("app/store.py", "function", "tidy", 10, 11, None, True, False, 1, None, "", "", ""),
    ("conf/site.toml", "section", "app", 1, 1, None, True, False, None, None, "", "", ""), ("conf/site.toml", "key", "name", 2, 2, None, True, False, None, None, "", "", ""),
    ("web/panel.js", "function", "boot", 1, 3, None, True, False, 1, None, "", "", ""), ("web/lib/draw_tools.js", "function", "draw", 2, 4, None, True, False, 2, "Draws it.", "", "", ""),
    ("src/Depot.java", "class", "Depot", 4, 17, None, True, False, None, "Holds things.", "", "Shelf", "Shelf Crate"), ("src/Depot.java", "method", "stow", 10, 13, "Depot", True, True, 3, "Adds one.", "@Override", "", "Crate"),
    ("src/Depot.java", "method", "drop", 14, 16, "Depot", False, False, 1, None, "", "", ""), ("src/base/Shelf.java", "class", "Shelf", 2, 6, None, True, False, None, None, "", "", ""),
    ("src/base/Shelf.java", "method", "drop", 3, 5, "Shelf", True, False, 1, None, "", "", ""), ("fw/Pkg.dec", "guid", "gTankGuid", 3, 3, None, True, False, None, "Names the tank.", "", "", ""),
    ("fw/text.uni", "string", "STR_TANK", 1, 1, None, True, False, None, None, "", "", ""), ("tests/test_shop.py", "function", "test_sell", 1, 2, None, True, False, 1, None, "", "", ""),
    ("lib/tank.rb", "module", "Vessel", 2, 3, None, True, False, None, "What holds water.", "", "", ""), ("lib/tank.rb", "class", "Tank", 5, 8, None, True, False, None, None, "", "", "Vessel Locks"), ("lib/locks.rb", "module", "Locks", 1, 2, None, True, False, None, None, "", "", "")))(
    lambda s, d: symbols(s).select(F.col("file").alias("path"), "kind", "name", "line", "end_line", "parent", "is_public", "is_static", "complexity", "doc", _names("decorators"), _names("bases"), _names("type_refs")))
query("fx_calls_by_function", _values(
    "path, caller, line, callee", ("app/main.py", "load", 8, "fetch"), ("app/main.py", "_run", 15, "run"), ("app/main.py", "sell", 19, "dump"), ("app/main.py", "sell", 19, "open"), ("app/main.py", "sell", 19, "fetch"),
    ("app/store.py", "fetch", 6, "tidy"), ("app/store.py", "tidy", 10, "open"), ("web/panel.js", "boot", 1, "open"), ("src/Depot.java", "stow", 10, "push"), ("src/Depot.java", "drop", 14, "stow"),
    ("src/base/Shelf.java", "drop", 3, "free"), ("tests/test_shop.py", "test_sell", 1, "sell")))(
    lambda s, d: parsed(s).select("path", F.explode("calls_by_function").alias("c")).select("path", "c.caller", "c.line", F.explode("c.callees").alias("callee")))
query("fx_imports", _values(
    "path, ref, rule, target", ("app/main.py", "app.store", 5, "app/store.py"), ("web/shell.js", "./lib/draw_tools", 2, "web/lib/draw_tools.js"), ("src/Depot.java", "src.base.Shelf", 5, "src/base/Shelf.java")))(
    lambda s, d: fl.resolve(fl.imports(files(s), texts(s)), files(s)).drop("project"))
query("fx_hint_edges", _values(
    "s, t, type, kind, via, origin, confidence, line", ("app/store.py", "conf/site.toml", "config_ref", "import", "open", "literal", 0.8, 11), ("web/page.html", "web/panel.js", "import", "import", None, "parser", None, 1),
    ("fw/Drv.inf", "fw/form.vfr", "sources", "import", None, "parser", None, 2), ("fw/Drv.inf", "fw/Pkg.dec", "package", "import", None, "parser", None, 4)))(
    lambda s, d: r.hint_edges(parsed(s), files(s)).drop("project", "subtype"))
query("fx_declared_edges", _values("s, t, type, via", ("fw/Drv.inf", "fw/Pkg.dec", "guid_ref", "gTankGuid"), ("fw/form.vfr", "fw/text.uni", "str_ref", "STR_TANK")))(
    lambda s, d: r.declared_edges(parsed(s), files(s)).drop("project"))
query("fx_global_edges", _values("s, t, type, origin, via", ("web/panel.js", "web/shell.js", "import", "inferred", "Shell")))(lambda s, d: r.global_edges(parsed(s), files(s)).drop("project"))
query("fx_candidates", _values(
    "source, target, signal, confidence, evidence", ("app/main.py", "tools/job.py", "shared_file", 0.65, "writes/reads sales.json"), ("app/main.py", "tools/job.py", "subprocess", 0.8, 'subprocess.run(["python", "job.py"])')))(
    lambda s, d: r.candidates(files(s), texts(s), symbols(s), fl.import_edges(files(s), texts(s))).drop("project"))
query("fx_stated_links", _values("src, dst, type, line", ("Tank", "Vessel", "mixin_include", 6), ("Tank", "Locks", "mixin_extend", 7)))(lambda s, d: _named(s, r.stated_links(parsed(s), symbols(s))))
query("fx_inheritance", _values("src, dst, type", ("Shop", "Store", "inherit"), ("Depot", "Shelf", "inherit")))(lambda s, d: _named(s, y.inheritance(symbols(s))))
query("fx_overrides", _values("src, dst", ("Shop.load", "Store.load"), ("Depot.drop", "Shelf.drop")))(lambda s, d: _named(s, y.overrides(symbols(s))))
query("fx_call_edges", _values(
    "src, dst, scope", ("Shop.load", "fetch", "project"), ("sell", "fetch", "project"), ("fetch", "tidy", "file"), ("Depot.drop", "Depot.stow", "file"), ("test_sell", "sell", "project")))(
    lambda s, d: _named(s, y.call_edges(symbols(s), texts(s))))
query("fx_hotspots", _values("name, callers, rank", ("fetch", 2, 1)))(lambda s, d: y.symbol_hotspots(y.call_edges(symbols(s), texts(s)), symbols(s)).select("name", "callers", "rank"))
query("fx_dead_code", _values("file, name", ("app/main.py", "load"), ("app/main.py", "_run"), ("app/store.py", "load"), ("web/panel.js", "boot"), ("web/lib/draw_tools.js", "draw"), ("src/Depot.java", "drop"), ("src/base/Shelf.java", "drop")))(
    lambda s, d: y.dead_code(symbols(s), texts(s)).select("file", "name"))
query("fx_central_definitions", _values("callee, target", ("fetch", "app/store.py"), ("tidy", "app/store.py"), ("stow", "src/Depot.java"), ("sell", "app/main.py")))(
    lambda s, d: r.central_definitions(y.calls(symbols(s), texts(s)), symbols(s), fl.import_edges(files(s), texts(s))).select("callee", "target").distinct())
query("fx_link_symbols", _values("s, t, link", ("app/main.py", "app/store.py", "load -> fetch"), ("web/shell.js", "web/lib/draw_tools.js", "import edge"), ("src/Depot.java", "src/base/Shelf.java", "import edge")))(
    lambda s, d: r.link_symbols(fl.import_edges(files(s), texts(s)), y.call_edges(symbols(s), texts(s)), symbols(s)).drop("project"))


def _named(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Edges between symbols with names for ids, members behind their type."""
    name = symbols(spark).select("sid", F.concat_ws(".", "parent", "name").alias("name"))
    end = lambda c: name.select(F.col("sid").alias(c), F.col("name").alias(f"name_{c}"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").drop("src", "dst", "project").withColumnsRenamed({"name_src": "src", "name_dst": "dst"})


_TRUST = (("import", None, "EXTRACTED"), ("import", 1.0, "EXTRACTED"), ("call", 0.7, "INFERRED"), ("call", 0.5, "INFERRED"), ("call", 0.49, "AMBIGUOUS"), ("inferred", 0.5, "INFERRED"), ("inferred", None, "AMBIGUOUS"),
          ("semantic", 0.4, "AMBIGUOUS"), ("semantic", 0.6, "INFERRED"), ("derived", None, "DERIVED"), ("derived", 0.5, "DERIVED"), ("derived", 0.2, "AMBIGUOUS"))
query("fx_trust_labels", _values("kind, confidence, label", *_TRUST))(
    lambda s, d: s.createDataFrame([x[:2] for x in _TRUST], "kind string, confidence double").withColumn("label", graph.trust_label(F.col("kind"), F.col("confidence"))))
_PATHS = (("a/test/x.py", True), ("a/Tests/x.py", True), ("test.py", True), ("test-x.js", True), ("a/conftest.py", True), ("a/x.test.min.js", True), ("a/x_spec.rb", True), ("a/latest.py", False), ("tester/x.py", False), ("a/contest.py", False), ("specs/a.js", True))
query("fx_test_paths", _values("path, is_test", *_PATHS))(lambda s, d: s.createDataFrame([x[:1] for x in _PATHS], "path string").withColumn("is_test", fl.is_test_for_dead_code(F.col("path"))))
_HEALTH = "project string, mean_complexity double, cycles long, god long, files long, dead long, functions long, percent double, modularity double, complex long, blocks long"
query("fx_health_scores", _values(
    "project, complexity_score, coupling_score, dead_code_score, duplication_score, cohesion_score, score, band, debt_minutes, debt_hours",
    ("a", 8.8, 5.0, 7.5, 7.5, 4.0, 6.87, "amber", 645, 10.8), ("b", 10.0, 10.0, 10.0, 10.0, 0.0, 8.5, "green", 0, 0.0), ("c", 0.0, 0.0, 0.0, 0.0, 10.0, 1.5, "red", 2900, 48.3)))(
    lambda s, d: quality.health_scores(s.createDataFrame([("a", 12.0, 3, 4, 50, 5, 20, 0.25, 0.4, 2, 1), ("b", 0.0, 0, 0, 0, 0, 0, 0.0, -0.2, 0, 0), ("c", 120.0, 20, 10, 100, 40, 40, 1.5, 1.0, 20, 0)], _HEALTH)).select(
        "project", "complexity_score", "coupling_score", "dead_code_score", "duplication_score", "cohesion_score", "score", "band", "debt_minutes", "debt_hours"))
_HARNESS = [("rich", "CLAUDE.md", "Run pytest.\nNever touch prod; delegate to a subagent.\n" + "x\n" * 60), ("rich", "AGENTS.md", "See CLAUDE.md\n"), ("rich", ".claude/settings.json", '{"permissions": {}}'), ("rich", ".claude/agents/a.md", ""), ("rich", ".claude/agents/b.md", ""),
            ("rich", ".claude/agents/c.md", ""), ("rich", "tests/test_a.py", ""), ("rich", ".github/workflows/ci.yml", ""), ("rich", "LESSONS.md", "## cache-miss (2026-01-02)\n"), ("rich", "CHANGELOG.md", ""), ("rich", ".gitignore", "x\n.env\n"),
            ("thin", "CLAUDE.md", ""), ("thin", ".env", "A=1"), ("thin", "src/tests/test_a.py", ""), ("thin", ".claude/settings.json", "{}"), ("none", "a.py", "x")]
query("fx_maturity", _values(
    "project, instructions, harness_config, loop_engineering, memory_learning, delegation, safety_governance, score, level", ("rich", 10.0, 7.0, 10.0, 10.0, 6.5, 10.0, 9.0, "self_improving"), ("thin", 8.0, 4.0, 0.0, 0.0, 0.0, 1.0, 2.4, "basic"),
    ("none", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.2, "none_adhoc")))(lambda s, d: calibration.maturity(_tree(s, _HARNESS), s.createDataFrame([(n, x[2]) for n, x in enumerate(_HARNESS)], "file_id long, text string")))


def _tree(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(n, x[0], x[1], x[1].rsplit("/", 1)[-1], "", 0, None, 0) for n, x in enumerate(rows)], "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int")


query("fx_touched_complexity", _values("branch, files, mean_complexity, hot_files", ("x", 3, 4.5, 1), ("y", 1, None, 0)))(lambda s, d: history.touched_complexity(
    s.createDataFrame([("p", "x", "a"), ("p", "x", "b"), ("p", "x", "b"), ("p", "x", "c"), ("p", "y", "z")], "project string, branch string, path string"),
    s.createDataFrame([("p", "a", 3.0), ("p", "b", 6.0), ("q", "c", 9.0)], "project string, path string, mean double"), s.createDataFrame([("p", "b")], "project string, path string")).drop("project"))
_LOOP = [("p", a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x"))]
query("fx_cycle_examples", _values("component, hops, path", ("c", 2, "a > b > a"), ("z", 3, "x > y > z > x")))(
    lambda s, d: (lambda e: graph.cycle_examples(e, graph.strong_components(e)).drop("scope"))(s.createDataFrame(_LOOP, "scope string, s string, t string")))
query("fx_dominant_community", _values("file, community, nodes", ("f.py", "k", 2), ("g.py", "k", 1)))(lambda s, d: graph.dominant_community(
    s.createDataFrame([("p", "a", "k"), ("p", "b", "k"), ("p", "c", "m"), ("p", "d", "m"), ("p", "e", "k")], "scope string, node string, community string"),
    s.createDataFrame([("p", "a", "f.py"), ("p", "b", "f.py"), ("p", "c", "f.py"), ("p", "d", "g.py"), ("p", "e", "g.py")], "scope string, node string, file string")).drop("scope"))
