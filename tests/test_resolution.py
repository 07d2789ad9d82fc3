from codestrata.operators import overview as o, parse, resolution as r, symbols as y
from conftest import rows

FILES = "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int"
SYMBOLS = "sid string, project string, file_id long, file string, name string, kind string, line int, end_line int, bases array<string>, parent string, is_public boolean, signature string, doc string, complexity int"


def files(spark, *paths):
    return spark.createDataFrame([(i, "p", p, p.rsplit("/", 1)[-1], "." + p.rsplit(".", 1)[-1], 1, None, 0) for i, p in enumerate(paths, 1)], FILES)


def test_hints_and_candidates(spark):
    f = files(spark, "web/a.html", "web/b.js", "run/go.py", "run/job.py")
    x = spark.createDataFrame([(1, "<script src='b.js'></script>"), (2, "x"), (3, "subprocess.run(['python', 'job.py'])\n" + "#" * 250 + "\nopen('out.csv', 'w')"), (4, "rows = load('data/out.csv')")], "file_id long, text string")
    assert rows(r.hint_edges(parse.parse_files(f, x), f), "s", "t", "kind") == [("web/a.html", "web/b.js", "import")]
    m = r.mentions(f, x)
    assert rows(r.process_candidates(m, f), "source", "target", "evidence") == [("run/go.py", "run/job.py", "subprocess.run(['python', 'job.py'])")]
    assert rows(r.shared_file_candidates(m), "source", "target", "confidence") == [("run/go.py", "run/job.py", 0.65)]
    stated = spark.createDataFrame([("p", "run/go.py", "run/job.py")], "project string, s string, t string")
    assert r.process_candidates(m, f, stated).count() == 0 and r.shared_file_candidates(m, stated).count() == 0
    assert r.mentions(f, x.limit(0)).count() == 0
    assert r.hint_edges(parse.parse_files(f.limit(0), x), f).count() == 0


def test_a_data_file_that_many_touch_keeps_its_pairs(spark):
    f = files(spark, *[f"w{i}.py" for i in range(15)], *[f"r{i}.py" for i in range(15)])
    x = spark.createDataFrame([(i, "json.dump(x, 'a/config.json')" if i <= 15 else "open('config.json')") for i in range(1, 31)], "file_id long, text string")
    want = {(f"w{i}.py", f"r{j}.py") for i in range(15) for j in range(15)}
    got = rows(r.shared_file_candidates(r.mentions(f, x)), "source", "target")
    assert len(got) == len(set(got)) and want <= set(got) and {s for s, _ in got} == {s for s, _ in want}


def test_a_base_defined_twice_gives_both_files(spark):
    s = spark.createDataFrame([(f"k{i}", "p", i, f, n, "class", 1, 2, b, None, True, None, None, None) for i, (f, n, b) in enumerate(
        [("a.py", "Base", None), ("b.py", "Base", None), ("c.py", "Kid", ["Base"]), ("d.py", "Base", None), ("d.py", "Own", ["Base"])])], SYMBOLS)
    edges = spark.createDataFrame([("p", "c.py", "b.py")], "project string, s string, t string")
    assert rows(r.interface_candidates(s, edges), "source", "target") == [("c.py", "a.py"), ("c.py", "d.py")]


def test_calls_over_several_lines_keep_all_scripts(spark):
    f = files(spark, "go.py", "a.py", "b.sh", "far.py")
    x = spark.createDataFrame([(1, "subprocess.run(\n  ['python',\n   'a.py', 'b.sh'])\n" + "#" * 200 + "'far.py'")], "file_id long, text string")
    assert rows(r.process_candidates(r.mentions(f, x), f), "target") == [("a.py",), ("b.sh",)]


def test_symbols_and_calls(spark):
    s = spark.createDataFrame([
        ("k1", "p", 1, "a.py", "Base", "class", 1, 2, None, None, True, None, "d", None), ("k2", "p", 2, "b.py", "Kid", "class", 1, 6, ["Base"], None, True, None, None, None),
        ("f1", "p", 2, "b.py", "go", "method", 2, 4, [], "Kid", True, "def go(x: Base)", "", 3), ("f2", "p", 1, "a.py", "go", "function", 3, 4, None, None, True, None, None, None), ("f3", "p", 2, "b.py", "unused", "def", 5, 6, None, "", True, None, "text", 20)], SYMBOLS)
    x = spark.createDataFrame([(1, "class Base:\n  pass\ndef go():\n  return 1"), (2, "class Kid:\n  def go(self):\n    helper(open(1))\n    missing()\n  def unused():\n    go()")], "file_id long, text string")
    calls = y.calls(s, x)
    assert rows(calls, "sid", "callee") == [("f1", "helper"), ("f1", "missing"), ("f3", "go")]
    assert rows(r.classify_calls(calls, s), "callee", "leads_to") == [("go", "internal"), ("helper", "unknown"), ("missing", "unknown")]
    assert rows(y.call_edges(s, x), "src", "dst", "scope") == [("f3", "f1", "file")]
    assert rows(y.dead_code(s, x), "sid") == [("f3",)]
    assert rows(r.type_usage(s), "src", "dst") == [("f1", "k1")]
    assert rows(y.inheritance(s), "src", "dst", "type") == [("k2", "k1", "inherit")]
    edges = spark.createDataFrame([], "project string, s string, t string")
    assert rows(r.interface_candidates(s, edges), "source", "target") == [("b.py", "a.py")]
    assert rows(o.symbol_overview(s), "file_id", "types", "members", "free", "documented") == [(1, 1, 0, 1, 1), (2, 1, 1, 1, 1)]
    assert rows(y.complexity_histogram(s).where("functions > 0"), "bucket", "functions", "high") == [("1-5", 1, 0)]
    assert y.calls(s.limit(0), x).count() == 0


def test_unreached_is_a_partition(spark):
    f = files(spark, "a/x.go", "a/y.go", "b/only.go", "c/i.c", "c/i.h", "d/main.py", "README.md")
    e = spark.createDataFrame([("p", "d/main.py", "c/i.h")], "project string, s string, t string")
    assert rows(r.unreached(f, e), "path", "role") == [("b/only.go", "isolated"), ("d/main.py", "entry")]


def test_answer_cache(spark):
    q = spark.createDataFrame([(1, "p", "How does it WORK?"), (2, "p", "other")], "question_id long, project string, question string")
    h = q.select("question_id", o.question_hash(q["question"]).alias("h")).collect()[0]["h"]
    schema = "project string, question_hash string, answer string, saved_at long, file_hashes map<string,string>"
    c = spark.createDataFrame([("p", h, "old", 1, {"a": "1"}), ("p", h, "new", 2, {"a": "2"}), ("p", h, "newest", 3, {"gone": "1"})], schema)
    assert o.cached_answers(q, c, spark.createDataFrame([("p", "a", "2")], "project string, path string, sha string")).first()["answer"] == "new"
    assert o.cached_answers(q, c, spark.createDataFrame([("p", "a", "3")], "project string, path string, sha string")).count() == 0
    assert rows(o.save_answers(c, spark.createDataFrame([("p", "z", "x", 9, None)], schema), keep=2), "answer") == [("newest",), ("x",)]


def test_context_asks_every_project(spark, tmp_path):
    from codestrata.plans.search import t_context

    s = [(f"{p}{i}", p, n, "a.py", "job_queue", "function", 1, 2, None, None, True, None, None, None) for n, p in enumerate("pqr", 1) for i in range(14)]
    spark.createDataFrame(s, SYMBOLS).write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame([(1, "Where is job_queue?"), (2, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(n, "x") for n in (1, 2, 3)], "file_id long, text string").write.parquet(f"{tmp_path}/source_texts.parquet")
    got = rows(t_context(spark, str(tmp_path)), "question_id", "project", "rank")
    assert sorted(got) == [(1, p, k) for p in "pqr" for k in range(1, 13)]
