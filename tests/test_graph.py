import random

from codestrata.operators import graph as g
from conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame([(i, "p", a, b, 1, "uses") for i, (a, b) in enumerate(pairs)], "edge_id long, scope string, s string, t string, weight long, kind string")


def reach(pairs, a):
    seen, todo = {a: 0}, [a]
    for x in todo:
        for s, t in pairs:
            if s == x and t not in seen:
                seen[t] = seen[x] + 1
                todo.append(t)
    return seen


def test_components_and_distances(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(38)] + [("x", "x")]
    nodes = {n for p in pairs for n in p}
    r = {n: reach(pairs, n) for n in nodes}
    want = {}
    for n in nodes:
        group = {m for m in nodes if m in r[n] and n in r[m]}
        if len(group) > 1:
            want[n] = (max(group), len(group))
    got = g.strong_components(edges(spark, pairs))
    assert {x["node"]: (x["component"], x["size"]) for x in got.collect()} == want
    start = spark.createDataFrame([("p", "n1")], "scope string, start string")
    assert {x["node"]: x["hops"] for x in g.distances(edges(spark, pairs), start, 30).collect()} == r["n1"]
    assert g.strong_components(edges(spark, [("a", "b")])).count() == 0
    assert g.strong_components(edges(spark, pairs).limit(0)).count() == 0


def test_a_long_circle_is_one_component(spark, monkeypatch):
    names = [f"n{random.Random(i).randrange(10**9):09}" for i in range(64)]
    ring = [(names[i], names[(i + 1) % 64]) for i in range(64)]
    written = []
    plain = g.materialize
    monkeypatch.setattr(g, "materialize", lambda df, label="t": written.append(label) or plain(df, label))
    got = g.strong_components(edges(spark, ring)).collect()
    assert {x["component"] for x in got} == {max(names)} and {x["size"] for x in got} == {64}
    assert written.count("colour") <= 40  # 64 rounds if colours went one link a round


def test_paths_and_communities(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("z", "y")])
    pairs = spark.createDataFrame([("p", "d", "e"), ("p", "a", "z")], "scope string, a string, b string")
    assert rows(g.shortest_path(e, pairs), "a", "b", "hops", "path") == [("d", "e", 4, "d > c > b > a > e")]
    cliques = [(f"{k}{i}", f"{k}{j}") for k in "lr" for i in range(5) for j in range(i)] + [("l0", "r0")]
    c = edges(spark, cliques)
    labels = g.communities(c)
    found = {x["node"]: x["community"] for x in labels.collect()}
    assert len({found[f"l{i}"] for i in range(5)}) == 1 and len({found[f"r{i}"] for i in range(5)}) == 1 and found["l1"] != found["r1"]
    q = g.modularity(c, labels).first()
    assert q["communities"] == 2 and -0.5 <= q["modularity"] <= 1 and q["modularity"] > 0.4


def test_trust(spark):
    from pyspark.sql import functions as F
    cases = [("import", None, "EXTRACTED"), ("import", "1.0", "EXTRACTED"), ("call", "0.7", "INFERRED"), ("call", "0.5", "INFERRED"), ("call", "0.49", "AMBIGUOUS"), ("inferred", "0.5", "INFERRED"), ("inferred", None, "AMBIGUOUS"),
             ("INFERRED_x", "0.9", "INFERRED"), ("semantic", "0.4", "AMBIGUOUS"), ("derived", None, "DERIVED"), ("derived", "0.5", "DERIVED"), ("derived", "0.2", "AMBIGUOUS"), (None, None, "EXTRACTED"), ("inferred", "high", "AMBIGUOUS"), ("call", "x", "EXTRACTED")]
    df = spark.createDataFrame(cases, "kind string, c string, want string")
    assert df.where(g.trust_label(F.col("kind"), F.col("c")) != F.col("want")).collect() == []


def test_surprising(spark):
    e = spark.createDataFrame([("p", "a/x.py", "b/y.js", "inferred"), ("p", "b/y.js", "a/x.py", "import"), ("p", "a/x.py", "a/z.py", "import")] + [("p", f"a/n{i}.py", "a/z.py", "import") for i in range(12)], "scope string, s string, t string, kind string")
    got = rows(g.surprising(e), "s", "t", "score", "reason")
    assert ("a/x.py", "b/y.js", 5, "cross-directory + cross-language + inferred edge") in got and len(got) == 5
    assert ("a/n0.py", "a/z.py", 1, "peripheral→hub") in got and not any(x[0] == "a/x.py" and x[1] == "a/z.py" for x in got)
    assert g.surprising(e.limit(0)).count() == 0


def test_health_scores(spark):
    from codestrata.operators import quality
    df = spark.createDataFrame([("a", 12.0, 3, 4, 50, 5, 20, 0.25, 0.4, 2, 1), ("b", 0.0, 0, 0, 0, 0, 0, 0.0, -0.2, 0, 0)],
                               "project string, mean_complexity double, cycles long, god long, files long, dead long, functions long, percent double, modularity double, complex long, blocks long")
    assert rows(quality.health_scores(df), "complexity_score", "coupling_score", "dead_code_score", "duplication_score", "cohesion_score", "score", "band") == [(10.0, 10.0, 10.0, 10.0, 0.0, 8.5, "green"), (8.8, 5.0, 7.5, 7.5, 4.0, 6.87, "amber")]
