import io
import subprocess
import zipfile

import pytest

from codestrata.operators import parse
from codestrata.sources import git, reports, trees
from conftest import rows

SAMPLES = [
    (".py", "import os\nfrom .a import b\nclass K(Base):\n    def m(self):\n        if x and y:\n            open('c.json')\n", ["os", ".a"], {"K", "m"}),
    (".js", "import x from './x.js';\nclass A extends B { go() { return run(1); } }\nfunction f(a) { return a ? 1 : 2 }\n", ["./x.js"], {"A", "go", "f"}),
    (".c", "#include \"u.h\"\nstruct S { int a; };\nint add(int a, int b) {\n  return a + b;\n}\n", ["u.h"], {"S", "add"}),
    (".java", "import a.b.C;\npublic class D extends E {\n  public int go(int x) {\n    return x;\n  }\n}\n", ["a.b.C"], {"D", "go"}),
    (".go", "package m\nimport \"fmt\"\ntype T struct {\n}\nfunc (t T) Run(a int) int {\n return a\n}\n", ["fmt"], {"T", "Run"}),
    (".rs", "use a::b;\npub struct Q {}\npub fn go(x: i64) -> i64 { x }\n", ["a::b"], {"Q", "go"}),
    (".rb", "require 'set'\nclass R < S\n  def go\n  end\nend\n", ["set"], {"R", "go"}),
    (".sh", "source lib.sh\nrun() {\n  echo 1\n}\n", ["lib.sh"], {"run"}),
    (".sql", "create table t (a int);\nwith c as (select 1) select * from u join c;", [], {"t"}),
    (".proto", "import \"z.proto\";\nmessage M { }", ["z.proto"], {"M"}),
    (".md", "# Title\n[x](a/b.md) ```code```", [], {"Title"}),
    (".toml", "[tool]\nname = 'x'\n", [], {"tool", "name"}),
    (".json", '{"main": "lib/a.js"}', [], {"main"}),
    (".inf", "[Sources]\n a.c\n[Guids]\n gX\nBASE_NAME = Drv\n", [], set()),
]


@pytest.mark.parametrize("ext,text,imports,names", SAMPLES)
def test_scanners(ext, text, imports, names):
    p = parse.scan(text, ext)
    assert p.diag is None and p.imports == imports and names <= {s["name"] for s in p.symbols}


def test_scanner_edges():
    assert parse.scan("def broken(:\n  def ok(): pass", ".py").diag and parse.scan("def broken(:\ndef ok(): pass", ".py").functions
    assert parse.scan(None, ".py").imports == [] and parse.scan("", ".zz").diag is None and parse.scan("x", ".zz").diag == "no scanner" and parse.scan("{", ".json").diag
    assert [h["target"] for h in parse.scan("select * from u join c", ".sql").hints] == ["u", "c"]
    assert {h["type"] for h in parse.scan("[Sources]\n a.c\n[Guids]\n gX\n", ".inf").hints} == {"sources", "guid_ref"}
    assert [h["target"] for h in parse.scan("<script src='a.js'></script><img src=\"http://x/y.png\"><img src='b.png'>", ".html").hints] == ["a.js", "b.png"]
    parse.register(".zz", lambda text, ext: 1 / 0)
    assert parse.scan("x", ".zz").diag == "failed: ZeroDivisionError"
    del parse.SCANNERS[".zz"]


def test_lines_and_complexity():
    assert parse.count_lines('"""doc\nmore"""\n# c\n\nx = 1  # y\n', ".py") == (1, 3, 1)
    assert parse.count_lines("/* a\n b */\nint x; // y\n// z\n", ".c") == (1, 3, 0)
    import ast
    assert parse.python_complexity(ast.parse("def f(a):\n  for x in a:\n    if x and a or x: pass\n  return [y for y in a if y]").body[0]) == 6


def test_parse_files_and_cache(spark):
    f = spark.createDataFrame([(1, "a.py", ".PY"), (1, "a.py", ".PY"), (2, "b.md", ".md"), (3, None, None)], "file_id long, path string, ext string")
    x = spark.createDataFrame([(1, "def f(): pass"), (2, None), (3, "?")], "file_id long, text string")
    first = parse.parse_files(f, x)
    assert first.count() == 3
    changed = spark.createDataFrame([(1, "def g(): pass"), (2, None)], "file_id long, text string")
    again = parse.parse_files(f, changed, first.cache())
    assert {r["file_id"]: [f["label"] for f in r["functions"]] for r in again.collect()} == {1: ["g"], 2: []}
    assert parse.parse_files(f.limit(0), x).count() == 0


LOG = "COMMIT aa 2024-01-02 Ann B\n\n3\t1\tx.py\n-\t-\tlogo.png\nCOMMIT bb 2024-01-03 Cy\nnoise\nCOMMIT cc 2024-01-04 Di\n1\t0\ty\n"


def test_log(spark):
    assert git.parse_log(LOG) == [("aa", "2024-01-02", "Ann B", "x.py", 3, 1), ("aa", "2024-01-02", "Ann B", "logo.png", 0, 0), ("bb", "2024-01-03", "Cy", None, 0, 0), ("cc", "2024-01-04", "Di", "y", 1, 0)]
    assert git.log_rows(spark.createDataFrame([("p", LOG), ("q", None)], "project string, text string")).count() == 4
    assert git.base_branch(["x", "develop", "trunk"]) == "trunk" and git.base_branch([]) == "main"


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "dist").mkdir()
    for name in ("a.py", "b.log", "dist/c.js", ".gitignore"):
        (tmp_path / name).write_text("*.log\n" if name == ".gitignore" else "x\n")
    run("add", "a.py", ".gitignore")
    run("-c", "user.name=T", "-c", "user.email=t@example.com", "commit", "-qm", "one")
    for source in (git.GitFiles, git.GitLog):
        spark.dataSource.register(source)
    assert rows(spark.read.format("git_files").load(str(tmp_path))) == [(".gitignore",), ("a.py",)]
    lines = [r["line"] for r in spark.read.format("git_log").load(str(tmp_path)).orderBy("n").collect()]
    assert [r[3] for r in git.parse_log("\n".join(lines))] == [".gitignore", "a.py"]
    assert git.ignored(str(tmp_path), ["a.py", "b.log"]) == {"b.log"} and git.branches(str(tmp_path))[0]["name"] == "main"
    tree = trees.read_tree(spark, str(tmp_path))
    assert "dist/c.js" not in [r["path"] for r in tree.select("path").collect()] and "a.py" in [r["path"] for r in tree.select("path").collect()]


def test_unzip(tmp_path):
    def archive(*names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return b.getvalue()

    assert trees.unzip(archive("top/a.py", "top/b/c.py"), str(tmp_path / "one")).endswith("top")
    with pytest.raises(ValueError):
        trees.unzip(archive("../evil"), str(tmp_path / "two"))


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([(1, "p", "m/a.py", "a.py", ".py", 5, None, 1)], "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int")
    s = spark.createDataFrame([(1, "s1", "f", "function", 3)], "file_id long, sid string, name string, kind string, line int")
    pages = reports.file_pages(f, s)
    assert pages.first()["body"] == "# m/a.py\n\n- f (line 3)"
    reports.write_pages(pages, str(tmp_path / "out"))
    reports.save_tables({"pages": reports.module_pages(f)}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/pages.parquet")).count() == 1


def test_parser_output():
    p = parse.scan("/** Holds. */\n@Entity\npublic class D extends E implements F {\n  private G g;\n  // Adds.\n  @Override\n  public static int add(Crate c) throws Full {\n    if (c) { push(c); }\n    return 1;\n  }\n  private void drop() {\n    add(g);\n  }\n}\n", ".java")
    d, add, drop = p.symbols
    assert (d["doc"], d["decorators"], d["bases"], d["is_public"]) == ("Holds.", ["@Entity"], ["E", "F"], True)
    assert (add["doc"], add["decorators"], add["is_static"], add["complexity"], add["type_refs"], add["line"], add["end_line"], add["parent"]) == ("Adds.", ["@Override"], True, 2, ["Crate", "Full"], 7, 10, "D")
    assert not drop["is_public"] and [(c["caller"], c["callees"]) for c in p.calls_by_function] == [("add", ["push"]), ("drop", ["add"])]
    c = parse.scan("EFI_STATUS EFIAPI Start(VOID) {\n  return go();\n}\nstatic int hide(int a)\n{\n  return 1;\n}\n", ".c")
    assert [(f["label"], f["is_efiapi"], f["is_static"]) for f in c.functions] == [("Start", True, False), ("hide", False, True)]
    for ext, text, want in [(".go", "// Runs.\nfunc Run(a Arg) Out {\n}\nfunc hide() {\n}\n", [("Run", True, "Runs."), ("hide", False, None)]), (".rs", "/// Fills.\npub fn fill() {}\nfn hide() {}\n", [("fill", True, "Fills."), ("hide", False, None)]),
                            (".ex", "defmodule T do\n  # Fills.\n  def fill(x) do\n    if x do\n      1\n    end\n  end\n  defp hide(x), do: x\nend\n", [("T", True, None), ("fill", True, "Fills."), ("hide", False, None)]),
                            (".vb", "' A tank.\nClass Tank\n  Private Sub Fill()\n  End Sub\nEnd Class\n", [("Tank", True, "A tank."), ("Fill", False, None)]), (".hs", "-- | Fills.\nfill :: Level -> Tank\nfill x = pour x\n", [("fill", True, "Fills.")])]:
        assert [(s["name"], s["is_public"], s["doc"]) for s in parse.scan(text, ext).symbols] == want
    long = "fn go(\n" + "".join(f"    a{i}: Part{i},\n" for i in range(60)) + ") -> Out {\n    if a { b() }\n}\n"
    assert (s := parse.scan(long, ".rs").symbols[0])["complexity"] == 2 and s["end_line"] == 64 and "Part59" in s["type_refs"]
    assert parse.scan("function f() {\n", ".js").symbols[0]["end_line"] == 2 and parse.scan("x = (", ".js").symbols == []


def test_every_extension_has_a_scanner_that_survives_noise():
    import random
    rng = random.Random(3)
    noise = ["".join(rng.choice("abC_ {}()[];:=<>'\"#/*-\n\t.,@$") for _ in range(300)) for _ in range(6)]
    for ext, f in parse.SCANNERS.items():
        for text in [*noise, "", "{" * 200, "(" * 200, "\n" * 50]:
            p = f(text, ext)
            assert all(s["line"] >= 1 and s["end_line"] >= s["line"] for s in p.symbols), ext
    assert parse.fingerprint(parse.scan_sql) != parse.fingerprint(lambda text, ext: None)


def test_saved_results_and_packages(spark, tmp_path):
    import tarfile
    df = spark.createDataFrame([(1,)], "a int")
    folder = f"file://{tmp_path}/result"
    assert reports.load_result(spark, folder) is None and reports.stale(spark, folder, "1")
    reports.save_result({"x": df}, folder, "2024-01-02", head="abc")
    assert reports.load_result(spark, folder)["x"].count() == 1 and reports.load_meta(spark, folder)["head"] == "abc" and not reports.stale(spark, folder, "2024-01-02")
    assert [m["folder"] for m in reports.recent_results(spark, [folder, folder + "-none"])] == [folder]
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        info = tarfile.TarInfo("package/a.js")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    assert trees.untar(data.getvalue(), str(tmp_path / "pkg")).endswith("package")
    bad = io.BytesIO()
    with tarfile.open(fileobj=bad, mode="w") as t:
        t.addfile(tarfile.TarInfo("../up"))
    with pytest.raises(ValueError):
        trees.untar(bad.getvalue(), str(tmp_path / "bad"))
    q = spark.createDataFrame([("ask", "How?", "So.", 3)], "tool string, question string, answer string, ms long")
    reports.log_queries(q, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").first()["chars"] == 3
    (tmp_path / "edges.json").write_text('{"source": "a", "target": "b", "confidence": 0.5, "reason": "' + "x" * 200 + '"}\n{"source": "a", "target": "a"}\n')
    e = reports.inferred_edges(spark, f"file://{tmp_path}/edges.json").first()
    assert len(e["reason"]) == 160 and e["origin"] == "inferred"
    v = spark.createDataFrame([("p", "a", "b", "1", "2"), ("p", "a", "c", "1", "9")], "project string, source string, target string, source_sha string, target_sha string")
    now = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project string, path string, sha string")
    assert rows(reports.valid_edges(v, now), "target", "stale") == [("b", False), ("c", True)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from codestrata import tables

    class Conf(dict):
        get = dict.get

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError):
        tables.scratch_dir(Fake())
    Fake.sparkContext = type("C", (), {"master": "spark://x:7077", "getCheckpointDir": lambda self: "hdfs://n/c"})()
    assert tables.scratch_dir(Fake()) == "hdfs://n/c"
