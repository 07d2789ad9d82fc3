import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as t
from codestrata.operators.rules import LANGUAGES, RULES
from codestrata.plans.security_cases import CASES
from codestrata.operators import search, security


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("f,given,want", [
    (t.week_start, "2024-05-15", "2024-05-13"), (t.week_start, "soon", "soon"), (t.normal_path, "a\\./b/../c//d", "a/c/d"), (t.normal_path, "../x", "../x"), (t.snake, "HTTPServerName", "http_server_name"),
    (t.basename, "a/b.c", "b.c"), (t.parent, "a/b/c", "a/b"), (t.suffix, "a/B.PY", ".py"), (t.stem, "x/y.tar.gz", "y.tar"), (t.collapse, " a \n b ", "a b"), (t.snippet, "one\ntwo", "one"),
    (t.mask_secret, "abcdefghijkl", "abcd…ijkl"), (t.mask_secret, "abc", "***"), (t.tokens_estimate, "abcdefg", 2)])
def test_functions(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_entropy_and_tokens(spark):
    for s in ("aab", "xyz", "q"):
        assert one(spark, t.entropy(F.lit(s))) == pytest.approx(-sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()))
    assert one(spark, t.entropy(F.lit(""))) == 0
    assert one(spark, t.query_tokens(F.lit("Where is src/core.Loader used by load_rules?"))) == ["src", "core", "loader", "load_rules"]
    assert one(spark, t.line_number(F.lit("a\nb\nc"), F.lit("c"))) == 3
    assert one(spark, t.glob_match(F.lit("a/b/x.py"), "*.py")) and not one(spark, t.glob_match(F.lit("a/x.pyc"), "*.py"))
    assert "</script>" not in one(spark, t.script_json(F.struct(F.lit("</script>").alias("a"))))


READY = security.Ready(RULES)


def scanned(spark, *rows):
    df = spark.createDataFrame([(n, "p", *x) for n, x in enumerate(rows)], "file_id long, project string, path string, text string, rule_id string").withColumn("ext", t.suffix(F.col("path")))
    return [(r["path"], r["rule_id"], r["severity"], r["line"]) for r in security.scan(df.drop("text"), df.select("file_id", "text")).orderBy("path", "rule_id", "line").collect()]


@pytest.mark.parametrize("rule,name,bad,good", CASES)
def test_each_rule(rule, name, bad, good):
    language = LANGUAGES.get("." + name.rsplit(".", 1)[-1], "dockerfile" if name == "Dockerfile" else "text")
    hits = [h for h in security.scan_text(bad, language, False, READY) if h[0] == rule] if bad else []
    assert bool(hits) == (bad is not None) and all(h[2] in (None, bad.rstrip("\n").count("\n") + 1) for h in hits)
    assert rule not in [h[0] for h in security.scan_text(good, language, False, READY)]
    assert next(r for r in RULES if r["id"] == rule)


def test_rules_cover_all_cases_and_compile():
    assert len(READY.rules) == len(RULES) == 101 == len({r["id"] for r in RULES}) and {c[0] for c in CASES} == {r["id"] for r in RULES}
    assert security.Ready([{"id": "bad", "severity": "low", "pattern": "("}]).rules == []
    own = security.Ready([{"id": "x", "severity": "high", "applies_to": ["*"], "pattern": "k=(\\w+)", "entropy_capture_group": 1, "entropy_min": 1.5, "deny_substrings_in_line": ["skip"], "allowlist_substrings": ["ok"]}])
    assert [h[2] for h in security.scan_text("k=abcd\nk=aaaa\nk=abcok\nk=abcd skip", "text", False, own)] == [1]


def test_handlers():
    lines = lambda rule, text, language: [h[2] for h in security.scan_text(text, language, False, READY) if h[0] == rule]
    assert lines("S039", "requests.get(\n  f(g(h(1))),\n)\nrequests.post(u,\n timeout=3)\nrequests.put(u", "python") == [1, 6]
    assert lines("S110", "FROM a\nUSER root\nUSER app\n", "dockerfile") == [] and lines("S110", "FROM a\n# USER app\nUSER 0:0", "dockerfile") == [3] and lines("S110", "FROM a\n# USER app", "dockerfile") == [1]
    assert lines("S114", "RUN x \\\n && apt install y\nRUN apt-get install --no-install-recommends z", "dockerfile") == [1]
    assert lines("S117", "\"Action\": \"*\"\n\"Action\": [\"*\"]\n\"Resource\": \"*\"", "text") == [1, 2] and lines("S117", "rules:\n verbs: ['*']", "yaml") == [2]
    assert lines("S073", "import xml.etree\nx = ElementTree.parse(f)", "python") == [2]


def test_what_is_scanned(spark):
    bad = "eval(a)"
    got = scanned(spark, ("a.py", bad, "z"), ("tests/b.py", bad, None), ("x/vendor/c.py", bad, None), ("d.min.js", bad, None), ("e.py", bad + "\n" + "#" * 200_000, None), ("f.js", ("x" * 600 + "\n") * 6 + bad, None), ("g.py", None, None), ("h.py", "", None), (None, bad, None))
    assert got == [("a.py", "S030", "high", 1), ("tests/b.py", "S030", "medium", 1)]
    f = spark.createDataFrame([(1, "p", "a.py", ".py"), (1, "p", "a.py", ".py"), (2, "p", None, None)], "file_id long, project string, path string, ext string")
    x = spark.createDataFrame([(1, "eval(a)\nos.system(b)"), (2, None)], "file_id long, text string")
    issues = security.scan(f, x)
    assert security.summary(issues).first()["high"] == 2 and security.by_rule(issues).count() == 2 and security.top_issues(issues, 1).count() == 1
    assert security.scan(f.limit(0), x).count() == 0


def test_search(spark):
    x = spark.createDataFrame([(1, "one two\nTWO three\n\ntwofold"), (2, None), (3, "")], "file_id long, text string")
    assert [r["line"] for r in search.grep(x, "file_id", "two").orderBy("line").collect()] == [1, 2, 4]
    assert [r["line"] for r in search.grep(x, "file_id", "two", case=True, word=True).collect()] == [1]
    assert search.references(x, "file_id", "three", 1).first()["context"] == "one two\nTWO three\n"
