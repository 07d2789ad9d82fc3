import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import hierarchy as h
from conftest import rows


def brute(up):
    out = []
    for node in up:
        seen, at, depth = {node}, up[node], 1
        while at in up and at not in seen:
            seen.add(at)
            at, depth = up[at], depth + 1
        out.append((node, "cycle", -1) if at in seen else (node, at, depth))
    return sorted(out, key=repr)


def test_contract_equals_walking_up(spark):
    rng = random.Random(1)
    up = {f"c{i}": f"c{i - 1}" for i in range(1, 60)}  # a long chain
    up |= {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 150)}  # a random tree
    up |= {f"h{i}": "hub" for i in range(60)} | {f"x{i}": f"x{(i + 1) % 7}" for i in range(7)} | {"self": "self", "t1": "x3", "t2": "t1", "u": "self"}
    got = h.contract(spark.createDataFrame(list(up.items()), "node string, upper string"), paths=True)
    assert rows(got, "node", "root", "depth") == brute(up)
    for r in got.collect():
        if r["depth"] == -1:
            assert r["path"] is None
        else:
            assert len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root"] and r["path"][-1] == r["node"]
            assert all(up[b] == a for a, b in zip(r["path"], r["path"][1:]))


def test_contract_edges(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), (None, "b"), ("z", None)], "node string, upper string")
    assert rows(h.contract(df), "node", "root", "depth") == [("a", "b", 1)]
    assert h.contract(df.limit(0)).count() == 0


@pytest.mark.parametrize("ref,name", [
    ("private Foo", "Foo"), ("virtual public Bar", "Bar"), ("a.b.Baz<T>", "Baz"), ("ns::Map<String, List<X>>", "Map"), ("*Ptr<T>", "Ptr"), (" Pad ", "Pad"), ("Gen[T]", "Gen"),
    ("", ""), ("  ", ""), ("Public", "Public"), ("a.b.C", "C"), ("Seq<a.b.C>", "Seq")])
def test_referenced_name(spark, ref, name):
    assert spark.range(1).select(h.referenced_name(F.lit(ref)).alias("n")).first()["n"] == name


SYMBOLS = "sid string, project string, file_id long, name string, kind string, bases array<string>, parent string, node string, upper string, depth int"


def test_symbol_hierarchy(spark):
    s = [("a", "p", 1, "A", "class", ["x.B"], None), ("b", "p", 2, "B", " CLASS", ["Missing", None, "C<T>"], ""), ("c", "p", 3, "C", "interface", None, "Gone"),
         ("m", "p", 1, "A", "method", [], "A"), ("m", "p", 1, "A", "method", [], "A"), ("o", "q", 9, "O", "struct", ["A"], None), ("r", "q", 9, "R", "mixin", ["S"], None), ("s", "q", 9, "S", "class", ["R"], "O"),
         ("k", None, None, None, None, None, None), (None, "p", 1, "A", "class", ["C"], None)]
    df = spark.createDataFrame([(*x, "clash", "clash", 7) for x in s], SYMBOLS)
    got = h.symbol_hierarchy(df)
    assert rows(got, "link", "sid", "root", "depth") == sorted([
        ("bases", "a", "c", 2), ("bases", "b", "c", 1), ("bases", "r", "cycle", -1), ("bases", "s", "cycle", -1), ("parent", "m", "a", 1), ("parent", "s", "o", 1)], key=repr)
    assert rows(h.descendants(got), "link", "sid", "descendant", "distance") == sorted([("bases", "c", "a", 2), ("bases", "c", "b", 1), ("bases", "b", "a", 1), ("parent", "a", "m", 1), ("parent", "o", "s", 1)], key=repr)
    assert h.symbol_hierarchy(df.limit(0)).count() == 0
