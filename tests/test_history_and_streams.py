import os
from datetime import date, datetime, timedelta

import pytest

from codestrata.operators import calibration, files as fl, history as h, quality
from codestrata.streaming import activity
from conftest import DATA, rows

D = date(2024, 5, 15)


@pytest.fixture(scope="module")
def log(spark):
    c = spark.createDataFrame([("a", "p", D, "x"), ("a", "p", D, "x"), ("b", "p", D + timedelta(7), None), ("c", "p", D + timedelta(7), " ")], "sha string, project string, date date, author string")
    f = spark.createDataFrame([("a", "./m\\n.py", 1, 2), ("a", "m/n.py", 1, 2), ("a", "z", None, 1), ("b", "z", 4, 0), ("b", None, 1, 1), ("b", "", 1, 1), ("gone", "z", 9, 9)], "sha string, path string, add long, del long")
    return c, f


def test_history(spark, log):
    assert rows(h.author_activity(*log), "author", "commits", "add", "del", "share", "rank") == [("Unknown", 2, 4, 0, 0.667, 1), ("x", 1, 1, 3, 0.333, 2)]
    assert rows(h.file_churn(*log), "path", "changes", "add", "del") == [("m/n.py", 1, 1, 2), ("z", 2, 4, 1)]
    assert rows(h.timeline(*log), "week", "commits") == [(date(2024, 5, 13), 1), (date(2024, 5, 20), 2)]
    assert h.heatmap(*log).count() == 10 and h.commits_by_day(*log).count() == 3
    assert rows(h.window_fallback(log[0], "2025-06-01"), "days", "commits") == [(730, 3)]
    assert {r["grain"] for r in h.change_groups(*log).collect()} == {"author", "week", "day"}
    for f in (h.author_activity, h.timeline, h.daily, h.file_churn, h.bus_factor, h.top_coupling, h.heatmap, h.peak_week, h.commits_by_day):
        assert f(log[0].limit(0), log[1].limit(0)).count() == 0


def test_merge_history(spark):
    old = spark.createDataFrame([("p", 1, "old"), ("p", 2, "old")], "k string, day int, v string")
    new = spark.createDataFrame([("p", 2, "new"), ("p", 3, "new")], "k string, day int, v string")
    assert rows(h.merge_history(old, new, ["k", "day"], "day", keep=2), "day", "v") == [(2, "old"), (3, "new")]


FILES = "file_id long, project string, path string, label string, ext string, size long, loc struct<code:int,comment:int,blank:int>, func_count int"


def test_files(spark):
    f = spark.createDataFrame([(1, "p", "src/a.py", "a.py", ".PY", 5, (3, 1, 0), 2), (1, "p", "src/a.py", "a.py", ".PY", 5, (3, 1, 0), 2), (2, "p", "src/b.py", "b.py", ".py", None, None, None), (3, "p", "README.md", "README.md", ".md", 1, None, None)], FILES)
    x = spark.createDataFrame([(1, "import src.b\n"), (2, None)], "file_id long, text string")
    edges = fl.import_edges(f, x)
    assert rows(edges) == [("p", "src/a.py", "src/b.py")]
    assert rows(fl.entry_points(f, edges), "path", "role") == [("src/a.py", "entry")]
    assert rows(fl.loc_totals(f), "code", "total") == [(3, 4)]
    assert rows(fl.folder_rollup(f), "folder", "files") == [("", 3), ("src", 2)]
    assert rows(calibration.maturity(f, x), "safety_governance", "level") == [(1.0, "none_adhoc")] and calibration.maturity(f.limit(0), x).count() == 0
    assert fl.file_nodes(f.limit(0)).count() == 0


def test_duplication(spark):
    block = "\n".join(f"value_{i} = compute({i})" for i in range(6))
    x = spark.createDataFrame([(1, block), (2, "# other\n" + block), (3, "short"), (4, None)], "file_id long, text string")
    assert quality.duplicate_windows(x).count() == 2
    f = spark.createDataFrame([(i, "p", f"{i}.py", None, ".py", None, None, None) for i in (1, 2, 3)], FILES)
    assert rows(quality.duplication(x, f), "lines", "duplicated", "blocks", "percent") == [(12, 12, 1, 1.0)]


def test_streams_equal_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, t + timedelta(seconds=40 * i), i % 3, "view", 1.0, None) for i in range(200)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    got = activity.run_to_end(spark, events.schema, str(tmp_path / "events"), activity.windowed, "windows")
    assert rows(got) == rows(activity.windowed(events))
    live = activity.run_to_end(spark, events.schema, str(tmp_path / "events"), activity.live_viewers, "live", mode="update")
    assert live.where("NOT expired").groupBy("user_id").max("events").count() == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_equal_sql(spark):
    """Every query with SQL gives the same rows in DuckDB, on the smallest warehouse."""
    import glob

    import duckdb

    import __spark_entry__ as entry

    d = f"{DATA}/sf0.001"
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")

    def plain(v):
        import decimal
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else v

    sql, queries = entry.oracle_sql(), entry.queries()
    assert set(sql) <= set(queries)
    for name in sql:
        df = queries[name](spark, d)
        columns = sorted(df.columns)
        r = con.execute(sql[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == columns, name
        want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=repr) == want, name
    assert entry.entry(spark).count() >= 0
