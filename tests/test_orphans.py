import random
from datetime import datetime, timedelta

from codestrata.operators import orphans as o
from conftest import rows


def test_runs_merge(spark):
    df = spark.createDataFrame([("p", "k", 1, 5), ("p", "k", 5, 8), ("p", "k", 2, 3), ("p", "k", 20, None), ("p", "k", 9, 9), (None, "k", 1, 2), ("p", None, 1, 2), ("p", "k", None, 4), ("p", "k", 1, 5)],
                               "scope string, key string, start long, end long")
    assert rows(o.runs(df), "start", "end") == sorted([(1, 8), (20, o.FOREVER)], key=repr)


def test_find_orphans_equals_brute_force(spark):
    rng = random.Random(3)
    life = [(rng.choice("pq"), rng.choice("abc"), a := rng.randrange(100), rng.choice([None, a + rng.randrange(30)])) for _ in range(40)]
    refs = [(i, rng.choice("pq"), rng.choice(["a", "b", "c", "d"]), rng.randrange(-5, 140)) for i in range(1500)] + [(9001, "p", "a", None), (9002, None, "a", 5), (9003, "p", "", 5), (9004, "p", None, 5)]
    life += [("p", "a", 10, 20)] * 3
    want = sorted(i for i, s, k, t in refs if k and not (t is not None and any(s == s2 and k == k2 and a <= t and (b is None or t < b) for s2, k2, a, b in life)))
    r = spark.createDataFrame(refs, "id long, scope string, key string, at long")
    lf = spark.createDataFrame(life, "scope string, key string, start long, end long")
    assert sorted(x["id"] for x in o.find_orphans(r, lf).collect()) == want
    assert sorted(x["id"] for x in o.find_orphans(r, lf, rows_per_group=50).collect()) == want  # salted
    assert o.find_orphans(r.limit(0), lf).count() == 0
    assert o.find_orphans(r, lf.limit(0)).count() == sum(1 for x in refs if x[2])


def test_edge_ends(spark):
    t = datetime(2024, 1, 31, 23)
    edges = spark.createDataFrame([(1, "p", "a", "zz", t, t, 0, "x"), (1, "p", "a", "zz", t, t + timedelta(days=9), 0, "x"), (2, "p", None, "", t, t, 0, "x"), (3, "p", "b", "a", None, t, 0, "x")],
                                  "edge_id long, project string, s string, t string, recorded_at timestamp, loaded_at timestamp, salt int, scope string")
    mods = spark.createDataFrame([("p", "a", t - timedelta(days=1), t, "y"), ("p", "a", t, None, "y")], "project string, id string, added_at timestamp, removed_at timestamp, scope string")
    assert rows(o.orphan_edge_ends(edges, mods), "edge_id", "side") == [(1, "t"), (3, "s"), (3, "t")]
    assert ("module_edges", "t", "2024-01", 1) in rows(o.orphan_report(edges, mods), "table_name", "side", "month", "orphans")
