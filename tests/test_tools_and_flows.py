import json

import pytest

from codestrata import __main__ as cli, tables, tools
from codestrata.operators import files as fl, flows, graph as g, overview as o, parse, quality, resolution as r, search
from codestrata.plans import fixture
from conftest import DATA, rows

SF = f"{DATA}/sf0.001"


def test_tools(spark, capsys):
    assert set(tools.TOOLS["path_between"].schema["required"]) == {"project", "a", "b"} and tools.TOOLS["explain"].schema["properties"]["term"] == {"type": "string"}
    for name, given in (("find_files", {"term": "a"}), ("find_symbols", {"term": "e"}), ("search_text", {"term": "return", "word": True}), ("call_sites", {"name": "return"}), ("explain", {"term": "a"}), ("dead_code", {}), ("bus_factor", {}), ("project_types", {})):
        assert tools.call(spark, SF, name, **given).count() > 0, name
    for name, given in (("nothing", {}), ("explain", {}), ("explain", {"term": 1}), ("explain", {"term": "a", "more": 1})):
        with pytest.raises(ValueError):
            tools.call(spark, SF, name, **given)
    assert cli.main(["tools"]) == 0 and all(json.loads(x)["name"] in tools.TOOLS for x in capsys.readouterr().out.splitlines())
    assert cli.main(["explain"]) == 2


def test_folder_flows(spark):
    e = spark.createDataFrame([("p", "a/x/1.py", "a/y/2.py"), ("p", "a/x/3.py", "a/y/2.py"), ("p", "a/x/1.py", "b/z/9.py"), ("p", "a/x/1.py", "a/x/3.py"), ("p", None, "a/x/1.py"), ("q", "m.py", "n/o.py"), ("q", "r.py", "s.py")], "project string, s string, t string")
    pre = spark.createDataFrame([("p", "a"), ("q", "")], "project string, prefix string")
    got = flows.folder_flows(e, pre)
    assert rows(got) == [("p", "x", "[b]", 1), ("p", "x", "y", 2), ("q", "m.py", "n", 1), ("q", "r.py", "s.py", 1)]
    assert rows(flows.fold_sides(got, 1)) == [("p", "x", "others", 1), ("p", "x", "y", 2), ("q", "m.py", "n", 1), ("q", "others", "others", 1)]
    paths = spark.createDataFrame([("p", "a/b/c.py"), ("p", "a/b/d/e.py"), ("q", "x.py"), ("q", "y/z.py"), ("r", "k/l.py"), (None, "a/b")], "project string, path string")
    assert rows(flows.common_folder(paths)) == [("p", "a/b"), ("q", ""), ("r", "k")]
    assert flows.folder_flows(e.limit(0), pre).count() == 0 and flows.common_folder(paths.limit(0)).count() == 0


def test_cycle_examples(spark):
    e = spark.createDataFrame([("p", a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "a"), ("x", "y"), ("q", "q"))] + [("q", f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)], "scope string, s string, t string")
    got = g.cycle_examples(e, g.strong_components(e))
    assert [(x["hops"], x["path"]) for x in got.where("scope = 'p'").collect()] == [(2, "a > b > a")] and got.where("scope = 'q'").first()["hops"] == 30
    with pytest.raises(RuntimeError):
        g.cycle_examples(e, g.strong_components(e), most=5)
    assert g.cycle_examples(e.limit(0), g.strong_components(e.limit(0))).count() == 0
    with pytest.raises(RuntimeError):
        g.strong_components(e, most_rounds=0)
    labels = spark.createDataFrame([("p", "a", "k"), ("p", "b", "k"), ("p", "c", "k"), ("p", "d", "m")], "scope string, node string, community string")
    assert rows(g.large_communities(labels), "node", "size") == [("a", 3), ("b", 3), ("c", 3)]


def test_resolution_rules(spark):
    F = "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int"
    paths = ("a/b/c.js", "a/d.js", "a/user_controller.rb", "com/foo/Bar.java", "x/com/foo/Baz.java", "util/index.js", "lib/index.js")
    f = spark.createDataFrame([(n, "p", x, x.rsplit("/", 1)[-1], "." + x.rsplit(".", 1)[-1], 0, None, 0) for n, x in enumerate(paths)], F)
    refs = spark.createDataFrame([("p", "a/b/c.js", x) for x in ("../d.js", "d.js", "../D", "UserController", "com.foo.Bar", "com.foo.Baz", "./nothing", "c.js", "", "index")] + [("p", "a/d.js", "crate::com::foo::Bar")], "project string, path string, ref string")
    assert rows(fl.resolve(refs, f), "ref", "rule", "target") == sorted([
        ("../d.js", 0, "a/d.js"), ("d.js", 1, "a/d.js"), ("../D", 2, "a/d.js"), ("UserController", 4, "a/user_controller.rb"), ("com.foo.Bar", 5, "com/foo/Bar.java"), ("com.foo.Baz", 6, "x/com/foo/Baz.java"),
        ("index", 2, "util/index.js"), ("index", 2, "lib/index.js"), ("crate::com::foo::Bar", 2, "com/foo/Bar.java")], key=repr)
    assert fl.resolve(refs.limit(0), f).count() == 0


def test_seeds_and_answers(spark):
    q = spark.createDataFrame([(1, "p", "How does panel reach the shell_tools?"), (2, "p", "what is up"), (3, "p", None)], "question_id long, project string, question string")
    f = spark.createDataFrame([("p", "web/panel.js"), ("p", "web/shell_tools_v2.js"), ("p", "a/panel.py"), ("r", "panel.js")], "project string, path string")
    assert rows(search.file_seeds(q, f), "question_id", "token", "path") == [(1, "panel", "a/panel.py"), (1, "shell_tools", "web/shell_tools_v2.js")]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Where is x?", 2), ("trace a call", 0), ("Where is x?", 1), (None, None)], "q string, n int")
    assert [x[0] for x in df.select(o.flow_question(F.col("q"), F.col("n"))).collect()] == [True, True, False, False]
    assert spark.range(1).select(o.clamp_answer(F.lit("abcdef"), F.lit(4))).first()[0] == "abcd\n… 2 characters left out" and spark.range(1).select(o.clamp_answer(F.lit("abc"), F.lit(4))).first()[0] == "abc"
    assert [x[0] for x in spark.createDataFrame([("calls",), ("import",), ("Imports",)], "k string").select(search.related_kinds(F.col("k"), ["import"])).collect()] == [False, True, True]
    index = search.search_index(fixture.files(spark), fixture.texts(spark))
    assert [(x["path"], x["line"]) for x in search.search_stream(index, "draw", word=True)] == [("web/lib/draw_tools.js", 2), ("web/shell.js", 1), ("web/shell.js", 2)]


def test_cached_and_backfill(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for key in ({"head": "a", "days": 90}, {"days": 90, "head": "a"}, {"head": "b", "days": 90}):
        assert tables.cached(spark, f"file://{tmp_path}", key, build).count() == 3
    assert len(made) == 2
    commits = spark.createDataFrame([("s1", "p", "2024-01-01", "x", None), ("s2", "p", "2024-01-03", "x", None), ("s3", "p", "2024-01-09", "x", None)], "sha string, project string, date string, author string, loaded_at string").selectExpr("sha", "project", "cast(date as date) date", "author", "loaded_at")
    inputs = spark.createDataFrame([("p", s, 5.0, 0, 0, 10, 0, 5, 0.0, 0.5, 0, 0) for s in ("s1", "s2", "s3")], "project string, sha string, mean_complexity double, cycles long, god long, files long, dead long, functions long, percent double, modularity double, complex long, blocks long")
    got = quality.backfill(commits, inputs)
    assert rows(got, "sha", "score") == [("s2", 9.1), ("s3", 9.1)]
    assert rows(quality.backfill(commits, inputs, got.withColumn("score", got["score"] * 0)), "score") == [(0.0,), (0.0,)]


def test_trust_kind_and_projections(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("x", "import"), (None, "inferred"), (None, "call"), (None, None)], "o string, t string")
    assert [x[0] for x in df.select(r.trust_kind(F.col("o"), F.col("t"))).collect()] == ["x", "inferred", "import", "import"]
    p = fixture.parsed(spark)
    assert rows(parse.function_rows(p).where("path = 'app/store.py'"), "id", "label", "is_public") == [(0, "load", True), (1, "fetch", True), (2, "tidy", True)]
    ids = rows(parse.symbol_rows(p, fixture.files(spark)), "sym_id")
    assert len(ids) == len(set(ids)) == 23 and ("sym_0_0",) in ids


def test_queries_are_named_without_a_session():
    import subprocess
    import sys

    from conftest import REPO
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > len(e.oracle_sql()) > 100 and set(e.oracle_sql()) <= set(e.queries()))"], cwd=REPO, capture_output=True, text=True)
    assert got.stdout.strip() == "True", got.stderr[-500:]
