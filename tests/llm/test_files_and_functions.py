import random

import pytest

from codestrata.llm import docpairs, gll, handwritten
from conftest import rows

CS = "int outer(int a) {\n  if (a) { run(a); }\n  return a;\n}\n"


@pytest.mark.parametrize("ext,text,want", [
    (".c", CS, [("outer", 1, 4, True)]), (".c", "/* d */\n" + CS + CS.replace("outer", "two"), [("outer", 2, 5, True), ("two", 6, 9, True)]),
    (".js", "class A {\n  go(x) {\n    for (;;) { }\n  }\n  // t\n  stop() { return '}'; }\n}\n", [("go", 2, 4, True), ("stop", 6, 6, True)]),
    (".py", "class A:\n    def f(self):\n        \"\"\"doc\nleft\"\"\"\n        return 1\n\n    def g(self):\n        def h():\n            pass\n        return h\nx = 1\n", [("f", 2, 5, True), ("g", 7, 10, True), ("h", 8, 9, True)]),
    (".rb", "module M\n  def go(a)\n    if a\n      a.each do |x|\n      end\n    end\n  end\nend\n", [("go", 2, 7, True)]),
    (".c", "int broken(int a) {\n  if (a) {\n  return 1;\n}\n\n" + CS, None), (".c", "}\n}\n" + CS, [("outer", 3, 6, True)]), (".c", "int cut(int a) {\n  x();\n", [("cut", 1, 2, False)]), (".c", "", []), (".py", "\n\n", [])])
def test_functions(ext, text, want):
    got = [(f.name, text.count("\n", 0, f.start) + 1, text.count("\n", 0, f.end) + 1, f.whole) for f in gll.functions(text, ext)]
    if want is None:  # a closer is missing: both functions are still found, the second whole
        assert [g[0] for g in got] == ["broken", "outer"] and got[1][1:] == (6, 9, True)
    else:
        assert got == want


def test_parser_survives_noise():
    rng = random.Random(1)
    for n in range(150):
        kinds = "".join(rng.choice("DHOC") for _ in range(rng.randrange(40))) + "$"
        indents = [rng.randrange(4) for _ in kinds[:-1]] + [-1]
        got = gll.recover(kinds, indents)
        assert {at for _, at in got} == {at for at, k in enumerate(kinds) if k == "H"}
        assert all(at < end < len(kinds) and kinds[end - 1] == "C" for (name, at), ends in got.items() if name == "Whole" for end in ends)
        gll.functions("".join(rng.choice(["int f(int a) {\n", "}\n", "{", " x;\n", "// c\n"]) for _ in range(30)), ".c")
    assert gll.functions("{" * 20_000, ".c") == [] and len(gll.functions("void f(int a) {\n" * 3000 + "void g(int a) { }\n", ".c")) >= 1
    deep = "void f(int a) {" + "{" * 3000 + "}" * 3000 + "}"
    assert [f.whole for f in gll.functions(deep, ".c")] == [True]


@pytest.mark.parametrize("doc,name", [
    (None, "f"), ("", "f"), ("TBD.", "f"), ("/**\n * n/a\n */", "f"), ("/// docstring goes here", "f"), ("-----", "f"), ("\u200b", "f"), ("&nbsp;", "f"), ("<summary></summary>", "f"), ("待补充", "f"), ("à documenter", "f"),
    ("описание будет позже", "f"), ("See above.", "f"), ("{@inheritDoc}", "f"), ("(non-Javadoc)", "f"), ("cf. interface", "f"), ("Overridden from parent.", "f"), ("Closes the anchor.", "closeAnchor"), ("ANCHOR CLOSE", "CloseAnchor"),
    ("close_anchor: close anchor", "close_anchor"), ("Method to close an anchor.", "closeAnchor"), ("This function closes the anchors.", "closeAnchor"), ("Close the Node2s.", "closeNode2"), ("@param x\n@return", "f"), (":type x: int\n:rtype: int", "f"),
    ("@param view - view\n@returns {*}", "f"), ("Args:\n    x: x", "f"), ("noqa: E501", "f"), ("eslint-disable-next-line no-shadow", "f"), ("clang-format off", "f"), ("SPDX-License-Identifier: MIT", "f"), ("(c) 2019 the contributors", "f"),
    ("Licensed under the terms found in LICENSE.txt", "f"), ("return x + 1;", "f"), ("if (x > 0) { return false; }", "f"), ("x = load(x)\nprint(x)", "f"), ("console.log('v', v);", "f"), ("TODO(team): explain what this does", "f"), ("@since 1.4\n@author kim", "f")])
def test_trivial(doc, name):
    assert docpairs.describe(doc, name) is None


@pytest.mark.parametrize("doc,want", [
    ("/**\n * Blocks until the queue has drained.\n */", "Blocks until the queue has drained."), ("@return order after sorting by weight, heaviest first", "order after sorting by weight, heaviest first"),
    ("<returns>Remaining capacity once slots are subtracted.</returns>", "Remaining capacity once slots are subtracted."), ("Idempotent; safe under restarts.\nTODO: drop this", "Idempotent; safe under restarts."),
    ("计算 每个 模块 的 平均 深度", "计算 每个 模块 的 平均 深度"), ("Verwirft veraltete Zeilen und gibt die Anzahl zurück.", "Verwirft veraltete Zeilen und gibt die Anzahl zurück."), ("@throws LookupError if the sensor vanished", "if the sensor vanished")])
def test_described(doc, want):
    assert docpairs.describe(doc, "f") == want


def test_a_missing_closer_costs_no_function_in_a_large_file():
    one = "void cut(int a) {\n  x();\n" + "".join(f"void f{i}(int a) {{\n  x();\n}}\n" for i in range(2000))
    got = gll.functions(one, ".c")
    assert [g.name for g in got] == ["cut", *(f"f{i}" for i in range(2000))] and all(g.whole for g in got[1:])
    assert all(one[g.start : g.end] == f"void {g.name}(int a) {{\n  x();\n}}" for g in got[1:])
    many = "".join(f"void f{i}(int a) {{\n  x();\n" for i in range(3000))
    assert [(g.name, g.whole) for g in gll.functions(many, ".c")] == [(f"f{i}", False) for i in range(3000)]
    stairs = "".join(" " * (n % 40) + f"void f{n}(int a) {{\n" + "x();\n}\n" * (n % 3) for n in range(4000))
    assert [g.name for g in gll.functions(stairs, ".c")] == [f"f{n}" for n in range(4000)]
    shut = "".join("  " * n + f"void f{n}(int a) {{\n" for n in range(800)) + "}\n" * 800
    assert len(gll.functions(shut + "}\n", ".c")) == 800


def test_the_parser_makes_the_pairs(spark, monkeypatch):
    torn = "int cut(int a) {\r  x();\r\rint whole(int b) {\r  return b;\r}\r"
    s = spark.createDataFrame([("a", 1, "cut", 1), ("b", 1, "whole", 4), ("c", 1, "whole", 5)], "sid string, file_id long, name string, line int").selectExpr(
        "*", "'p' project", "'fn' kind", "'Drains what is queued.' doc", "'x.C' file")
    x = spark.createDataFrame([(1, torn)], "file_id long, text string")
    assert rows(docpairs.documented_pairs(s, x), "sid", "whole", "code") == [("a", False, "int cut(int a) {\r  x();"), ("b", True, "int whole(int b) {\r  return b;\r}")]
    assert [f.name for f in gll.functions(torn.replace("\r", "\n"), ".c")] == ["cut", "whole"]
    lame = gll.Grammar({"Unit": [([gll.EOF], gll.EOF)]})
    monkeypatch.setattr(gll, "PLAIN", lame)
    monkeypatch.setattr(gll, "BROKEN", lame)
    assert gll.functions("int cut(int a) {\n  x();\n", ".c") == []


def test_templates_of_any_length(spark):
    long = "Wraps the {} call so that every caller goes through the same retry and logging policy of this layer"
    s = spark.createDataFrame([(f"t{n}", 1, f"load{chr(65 + n // 26)}{chr(97 + n % 26)}x", n + 1) for n in range(30)], "sid string, file_id long, name string, line int").selectExpr(
        "*", "'p' project", "'fn' kind", f"replace('{long}', '{{}}', name) doc", "'x.c' file")
    own = s.limit(3).selectExpr("'own' || sid sid", "file_id", "name", "line", "project", "kind", "'Counts ' || sid || ' bytes left over after trimming.' doc", "file")
    assert docpairs.described(s.unionByName(own)).count() == 3


def test_pairs(spark):
    text = "# h\ndef keep(a):\n    return a\n\ndef drop(a):\n    return a\n"
    s = [("s1", "p", 1, "keep", " Function", 2, 3, "Blocks until it drains.", "a.py"), ("s1", "p", 1, "keep", " Function", 2, 3, "Blocks until it drains.", "a.py"), ("s2", "p", 1, "drop", "def", 5, 6, "TODO", "a.py"), ("s3", "p", 1, "K", "class", 1, 1, "Real words stay out.", "a.py"),
         ("s4", "p", 2, "gone", "fn", None, None, "Counts the bytes left.", None), ("s5", None, None, None, "fn", 1, 2, "Counts the bytes left.", None), ("s6", "p", 3, "x", None, 1, 2, "Words.", "b.py"), ("s7", "p", 1, "other", "func", 1, 99, "Reads past the end.", "a.py")]
    df = spark.createDataFrame([(*x, 5, "t") for x in s], "sid string, project string, file_id long, name string, kind string, line int, end_line int, doc string, file string, template long, ext string")
    x = spark.createDataFrame([(1, text), (3, None), (None, text)], "file_id long, text string")
    got = {r["sid"]: r for r in docpairs.documented_pairs(df, x).collect()}
    assert set(got) == {"s1"}  # s4, s6 without a text or name, s5 without a file, s7 where no function of its name starts
    assert got["s1"]["code"] == "def keep(a):\n    return a" and got["s1"]["whole"] and got["s1"]["description"] == "Blocks until it drains."
    assert rows(docpairs.documented_pairs(df, x, with_code=False)) == [("s1", "p", 1, "keep", "Blocks until it drains.", True)]
    assert docpairs.documented_pairs(df.limit(0), x).count() == 0
    f = spark.createDataFrame([(1, ".py"), (1, ".py")], "file_id long, ext string")
    assert rows(docpairs.file_functions(f, x), "name", "line", "description") == [("drop", 5, None), ("keep", 2, None)]


def test_templates_are_dropped(spark):
    words = "alpha beta gamma delta omega kappa sigma lambda".split()
    docs = [(f"t{i}", f"name{i}", "Wurble the frobnicator.") for i in range(60)] + [(f"r{i}", f"fn{i}", f"Moves the {words[i % 8]} beside the {words[i // 8 % 8]} before {i} others arrive at once.") for i in range(60)]
    df = spark.createDataFrame([(a, "p", 1, b, "function", 1, 2, c, "a.py") for a, b, c in docs], "sid string, project string, file_id long, name string, kind string, line int, end_line int, doc string, file string")
    assert {r["sid"][0] for r in docpairs.described(df).collect()} == {"r"}


def body(rng, names):
    return "\n".join(f"def {rng.choice(names)}_{i}(value):\n    # explains step {i} of the plan\n    result = {rng.choice(names)}(value, {rng.randrange(90)})\n    return result\n" for i in range(rng.randrange(3, 9)))


def test_files(spark):
    rng = random.Random(3)
    names = "load store merge split rank seal route trim scan verify".split()
    files, texts, truth = [], [], set()

    def add(path, text, bad, project=None):
        k = len(files) + 1
        files.append((k, project or f"p{k % 7}", path, "." + path.rsplit(".", 1)[1], 1.0))
        texts.append((k, text, "clash"))
        if bad:
            truth.add(k)

    for i in range(120):
        add(f"src/m{i}.py", rng.choice(["# Copyright the project team, internal use.\n", "", "# maintained by hand\n"]) + body(rng, names), False)
    accessors = lambda: "\n".join(f"def get_{rng.choice(names)}_{i:03}(v):\n    return v[{i}]" for i in range(60))
    for i in range(40):
        add(f"gen/a{i}.py", "# Code generated by tool. DO NOT EDIT.\n" + accessors(), True)
        add(f"src/b{i}.py", accessors(), True)
    for i in range(20):
        add(f"s/c{i}.min.js", "!function(){" + ";".join(f"{rng.choice('abcd')}[{j}]=f({j})" for j in range(200)) + "}();" + rng.choice(["\n//# sourceMappingURL=a.map", ""]), True)
        add(f"s/d{i}.py", rng.choice(["# x samples\n", ""]) + "T = [\n" + ",\n".join(", ".join(str(rng.randrange(255)) for _ in range(16)) for _ in range(30)) + "]\n", True)
    copied = body(rng, names)
    for p in ("one", "two"):
        add("v/w.py", "# @license lib 1.2.3\n" + copied, True, p)
    add("src/generator.py", "# writes: \"Code generated by us. DO NOT EDIT.\"\n" + body(rng, names), False)
    add("README.md", "# title\n" + accessors(), False)
    add("empty.py", "", False)
    files += [files[0], (7001, None, None, None, None), (7002, "p1", "no_text.py", ".py", None), (None, "p1", "x.py", ".py", 1.0)]
    texts += [(7001, None, "clash"), (8001, "orphan text", "clash")]
    f = spark.createDataFrame(files, "file_id long, project string, path string, ext string, probability double")
    x = spark.createDataFrame(texts, "file_id long, text string, notice string")
    got = {r["file_id"] for r in handwritten.not_handwritten(f, x).collect()}
    assert got == truth
    assert handwritten.not_handwritten(f.limit(0), x).count() == 0 and handwritten.not_handwritten(f, x.limit(0)).count() == 0


def test_all_labels_train(spark):
    """Beyond 20,000 files with a notice, those late by hash are of a kind of their own; the same forest comes from any partitions."""
    f = handwritten.F
    late = f.expr("place > 20000")
    ids = spark.range(24_000).withColumn("place", f.expr("row_number() OVER (ORDER BY xxhash64(id))")).selectExpr("id file_id", "place")
    kinds = ids.select("file_id", f.when(late | f.expr("file_id % 2 = 0"), "generated").otherwise("own").alias("notice"), f.when(late, -5.0).otherwise(f.expr("5.0 * (1 - file_id % 2)")).alias("digits"))
    asked = spark.createDataFrame([(-1, None, -5.0), (-2, None, 0.0), (-3, None, 5.0)], "file_id long, notice string, digits double")
    rows_ = kinds.union(asked).select("file_id", "notice", f.lit(False).alias("empty"), *(c if c == "digits" else f.pmod(f.xxhash64("file_id", f.lit(c)), f.lit(100)).cast("double").alias(c) for c in handwritten.FEATURES))
    seen = []
    for parts in (2, 7):
        got, threshold = handwritten.classify(rows_.repartition(parts))
        seen.append((threshold, {r["file_id"]: r["probability"] for r in got.where("file_id < 0").collect()}))
    threshold, p = seen[0]
    assert p[-1] > threshold and p[-3] > threshold and p[-2] <= threshold
    assert seen[0] == seen[1]


@pytest.mark.parametrize("head,want", [
    ("// Code generated by x. DO NOT EDIT.\n", "generated"), ("# Output of `x --emit y`. Manual changes are lost on the next run.\n", "generated"), ("/*\n * machine-made from a.g4 (x)\n */\n", "generated"), ("// @license foo 1.2.0\n", "vendored"),
    ("// foo v1.2.0 | (c) foo contributors | MIT\n", "vendored"), ("// Copyright the project team, internal use.\n", "own"), ("// Not generated any more: please edit freely.\n", "own"), ("// writes: \"@generated by us\"\n", None), ("// 由 x 自动生成，请勿手动修改\n", "generated"), ("/* x bundle */\n", "minified"), ("# x payload\n", "data"), ("", None)])
def test_notices(head, want):
    text = head + "int f(int a) {\n}\n"
    assert handwritten.notice(handwritten.split_head(text)[0], text) == want
