import random
from collections import Counter
from itertools import combinations

import pytest

from codestrata.llm import coupling, packing
from conftest import rows


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    commits, files = [], []
    for i in range(1200):
        p = rng.choice(["p", "p", "q"])
        commits.append((f"s{i}", p, "clash", 1))
        names = {f"f{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice([1, 2, 3, 5, 9, 25]))}
        names |= {"hot.md"} if rng.random() < 0.3 else set()
        names |= {"x", "y"} if rng.random() < 0.05 else set()
        files += [(f"s{i}", rng.choice(["", "./"]) + n, "clash") for n in names] + ([(f"s{i}", None, "clash"), (f"s{i}", "", "clash")] if i % 50 == 0 else [])
    files += files[:200] + [("unknown", "a", "z"), ("unknown", "b", "z"), ("s1", "d\\e", "z"), ("s1", "d/e", "z"), (None, "a", "z")]
    commits += commits[:50]
    owner, baskets = dict((s, p) for s, p, *_ in commits), {}
    for s, path, _ in files:
        path = (path or "").replace("\\", "/").removeprefix("./")
        if s in owner and path:
            baskets.setdefault(s, set()).add(path)
    n, one, two = Counter(), Counter(), Counter()
    for s, b in baskets.items():
        if 2 <= len(b) <= 20:
            n[owner[s]] += 1
            one.update((owner[s], x) for x in b)
            two.update((owner[s], x, y) for x, y in combinations(sorted(b), 2))
    for least, lift in ((5, 3), (2, 1)):
        want = sorted(((p, a, b, c, one[p, a], one[p, b], n[p]) for (p, a, b), c in two.items() if c >= least and c * n[p] >= lift * one[p, a] * one[p, b]), key=repr)
        f = spark.createDataFrame(files, "sha string, path string, item string")
        c = spark.createDataFrame(commits, "sha string, project string, basket string, heavy int")
        got = coupling.change_coupling(f, c, min_together=least, min_lift=lift)
        assert rows(got, "project", "file_a", "file_b", "co_changes", "changes_a", "changes_b", "baskets") == want and want
    assert coupling.change_coupling(f.limit(0), c).count() == 0 and coupling.change_coupling(f, c.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_histogram_packs_everything(capacity):
    rng = random.Random(capacity)
    for _ in range(20):
        h = {x: rng.randrange(1, 400) for x in {rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))}}
        for patterns in (packing.pack_histogram(h, capacity),):
            held = Counter()
            for count, pattern in patterns:
                assert count > 0 and sum(n * t for n, t in pattern) <= capacity
                for n, t in pattern:
                    held[n] += t * count
            assert held == h
    assert packing.pack_histogram({}, capacity) == []


@pytest.mark.parametrize("rank_rows", [500_000, 90])
def test_windows_hold_each_text_once(spark, rank_rows):
    rng = random.Random(2)
    lengths = [(i, rng.choice([0, 1, 3, 10, 10, 10, 64, 65, 200, rng.randrange(1, 64)])) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(lengths, "doc_id long, tokens long"), 64, rank_rows).collect()
    pieces, used = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        if r["length"]:
            spans = used.setdefault(r["window_id"], [])
            spans.append((r["position"], r["position"] + r["length"]))
        else:
            assert r["window_id"] is None and r["position"] is None
    for i, n in lengths:
        p = sorted(pieces[i])
        assert len(p) == max(1, -(-n // 64)) and sum(x[1] for x in p) == n and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:]))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 64 and spans[0][0] == 0 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    total = sum(n for _, n in lengths)
    assert sorted(used) == list(range(len(used))) and len(used) <= total / 64 * 1.02 + 1


def test_pack_documents(spark):
    d = spark.createDataFrame([(1, "some words here", 3), (2, None, 0), (3, "", 0), (4, "word " * 700, 1), (5, "some words here", 3), (None, "no key", 1)], "doc_id long, text string, length int")
    w = spark.createDataFrame([("s", 512), ("s", 512), (None, 4), ("z", 0)], "window_name string, capacity int")
    got = packing.pack_documents(d, w)
    assert {(r["doc_id"], r["piece"]) for r in got.collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (5, 0), (None, 0)}
    assert packing.fill_report(got).first()["windows"] == 2
    assert packing.pack_documents(d.limit(0), w).count() == 0 and packing.pack_documents(d, w.limit(0)).count() == 0
