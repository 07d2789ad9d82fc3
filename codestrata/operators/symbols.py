"""Symbols: names, inheritance, overrides, calls, dead code, complexity and documentation.

A symbol delivered twice counts once; kinds are compared in lower case without outer blanks; an unknown complexity is skipped, not zero.
Names resolve in the same file first, else in the project if unique there. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.operators.files import is_test_for_dead_code
from codestrata.operators.hierarchy import CALLABLE_KINDS, TYPE_KINDS, clean_kind, referenced_name

# Call names that belong to the languages' own types rather than to a project, and words before '(' that are no calls.
BUILTIN_CALLS = ("get set add append pop push map filter join split keys values items find index count sort sorted len print range str int list dict format replace strip open read write close "
                 "update remove insert extend forEach reduce slice concat includes test exec then catch log toString equals hashCode size isEmpty contains put min max sum abs round zip any all iter next super").split()
NOT_CALLS = "if for while switch return catch function def fn func elif else do sizeof typeof new throw assert and or not in is lambda with match when unless until require import".split()
ENTRY_NAMES = ("main", "Main", "wmain", "WinMain", "DllMain")
BUCKETS = (("1-5", 1, 5), ("6-10", 6, 10), ("11-15", 11, 15), ("16-20", 16, 20), ("21+", 21, 1 << 30))


def known_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where("sid IS NOT NULL").select("sid", "project", "file_id", "file", "name", clean_kind(F.col("kind")).alias("kind"), "line", "end_line", "bases", "parent",
                                                   "is_public", "complexity").distinct()


def _callable(c: str = "kind") -> Column:
    return F.col(c).isin(*CALLABLE_KINDS)


def name_index(symbols: DataFrame) -> DataFrame:
    """Each callable name of a project with the files that define it, their number and the first by path."""
    return (known_symbols(symbols).where(_callable() & F.col("name").isNotNull()).groupBy("project", "name")
            .agg(F.countDistinct("file").alias("files"), F.min("file").alias("first_file"), F.count("*").alias("definitions")).withColumn("ambiguous", F.col("files") > 1))


def complexity_histogram(symbols: DataFrame) -> DataFrame:
    """Functions and methods by complexity bucket, every bucket present, with the project's mean and number above 15."""
    rows = known_symbols(symbols).where(F.col("kind").isin("function", "method") & F.col("complexity").isNotNull()).select("sid", "project", "complexity").distinct()
    bucket = F.lit(None).cast("string")
    for name, lo, hi in BUCKETS:
        bucket = F.when(F.col("complexity").between(lo, hi), name).otherwise(bucket)
    n = rows.withColumn("bucket", bucket).groupBy("project", "bucket").agg(F.count("*").alias("functions"))
    totals = rows.groupBy("project").agg(F.round(F.avg("complexity"), 4).alias("mean"), F.count(F.when(F.col("complexity") > 15, 1)).alias("high"))
    full = totals.withColumn("bucket", F.explode(F.array(*(F.lit(b[0]) for b in BUCKETS))))
    return full.join(n, ["project", "bucket"], "left").na.fill(0, ["functions"])


def length_stats(symbols: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` longest callables of each project beside the mean length (a top-k report)."""
    rows = known_symbols(symbols).where(_callable() & (F.col("end_line") >= F.col("line"))).select("sid", "project", "name", (F.col("end_line") - F.col("line") + 1).alias("lines")).distinct()
    project = Window.partitionBy("project")
    mean = rows.groupBy("project").agg(F.round(F.avg("lines"), 4).alias("mean"))
    return rows.withColumn("rank", F.row_number().over(project.orderBy(F.desc("lines"), "sid"))).where(F.col("rank") <= top).join(mean, "project")


def inheritance(symbols: DataFrame) -> DataFrame:
    """(project, src, dst, type): a type and each base that a type of its file bears, else the only type of that name in the project; 'implements' for interfaces and mixins.

    Of several types of the name in the file the first by sid counts. A name that several types elsewhere bear links to none of them.
    """
    s = known_symbols(symbols)
    types = s.where(F.col("kind").isin(*TYPE_KINDS))
    refs = types.select("project", "file_id", F.col("sid").alias("src"), F.explode("bases").alias("ref")).select("project", "file_id", "src", referenced_name(F.col("ref")).alias("name")).where("name <> ''").distinct()
    target = types.select("project", F.col("file_id").alias("tf"), F.col("sid").alias("dst"), "name", F.col("kind").alias("dst_kind"))
    hits = refs.join(target, ["project", "name"]).where("src <> dst")
    here = F.when(F.col("file_id") == F.col("tf"), F.struct("dst", "dst_kind"))
    picked = hits.groupBy("project", "src", "name").agg(F.min(here).alias("here"), F.min(F.struct("dst", "dst_kind")).alias("any"), F.countDistinct("dst").alias("n"))
    return picked.where("here IS NOT NULL OR n = 1").select("project", "src", F.coalesce("here", "any").alias("to")).select("project", "src", "to.dst", "to.dst_kind").select("project", "src", "dst", F.when(F.col("dst_kind").isin("interface", "mixin", "trait", "protocol"), "implements").otherwise("inherit").alias("type")).distinct()


def overrides(symbols: DataFrame) -> DataFrame:
    """(project, src, dst): a method and the same-named method of a base of its class."""
    s = known_symbols(symbols)
    owner = s.where(~_callable()).select("file_id", F.col("name").alias("parent_name"), F.col("sid").alias("owner"))
    methods = (s.where(_callable() & (referenced_name(F.col("parent")) != "")).select("project", "file_id", "sid", "name", referenced_name(F.col("parent")).alias("parent_name"))
               .join(owner, ["file_id", "parent_name"]).select("project", "sid", "name", "owner").distinct())
    links = inheritance(symbols).select("project", F.col("src").alias("owner"), F.col("dst").alias("base"))
    above = methods.select("project", F.col("sid").alias("dst"), "name", F.col("owner").alias("base"))
    return methods.join(links, ["project", "owner"]).join(above, ["project", "base", "name"]).select("project", F.col("sid").alias("src"), "dst").distinct()


def calls(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, file_id, sid, callee): the distinct names called in the lines of each callable, minus built-in ones and itself, extracted in the JVM."""
    line_array = F.split("text", r"\r\n|\n|\r", -1)
    body = F.array_join(F.slice("lines", F.col("line") + 1, F.greatest(F.col("end_line") - F.col("line"), F.lit(0))), "\n")  # sliced as it is joined: only the callable's own lines go on
    names = F.array_distinct(F.regexp_extract_all(F.regexp_replace(body, r"\"[^\"\n]*\"|'[^'\n]*'|//[^\n]*|(?m)^\s*#[^\n]*", ""), F.lit(r"([A-Za-z_]\w+)\s*\("), F.lit(1)))
    skip = F.array(*map(F.lit, [*BUILTIN_CALLS, *NOT_CALLS]))
    rows = known_symbols(symbols).where(_callable() & (F.col("line") > 0) & (F.col("end_line") >= F.col("line"))).select("project", "file_id", "sid", "name", "line", "end_line").distinct()
    return (rows.join(texts.where("text IS NOT NULL").select("file_id", line_array.alias("lines")), "file_id").where(F.col("line") < F.size("lines"))
            .select("project", "file_id", "sid", "name", F.explode(F.array_except(names, skip)).alias("callee")).where("callee <> name").drop("name"))


def call_edges(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, src, dst, scope): calls resolved to a callable of the same file, else to the only one of that name in the project."""
    target = known_symbols(symbols).where(_callable() & F.col("name").isNotNull()).select("project", "file_id", "sid", F.col("name").alias("callee"))
    local = target.groupBy("file_id", "callee").agg(F.max("sid").alias("local"))
    unique = target.groupBy("project", "callee").agg(F.min("sid").alias("only"), F.countDistinct("sid").alias("n")).where("n = 1").drop("n")
    hit = calls(symbols, texts).join(local, ["file_id", "callee"], "left").join(unique, ["project", "callee"], "left").withColumn("dst", F.coalesce("local", "only"))
    return hit.where("dst IS NOT NULL AND dst <> sid").select("project", F.col("sid").alias("src"), "dst", F.when(F.col("local").isNotNull(), "file").otherwise("project").alias("scope")).distinct()


def dead_code(symbols: DataFrame, texts: DataFrame, calls_of: DataFrame | None = None) -> DataFrame:
    """Callables whose name is called nowhere in their project; tests, entry points and dunder names are left out.

    A call counts for every file that defines the name. ``calls_of`` are calls already extracted.
    """
    defined = known_symbols(symbols).where(_callable() & F.col("name").isNotNull() & F.col("file").isNotNull()).where(
        ~is_test_for_dead_code(F.col("file")) & ~F.col("name").rlike("^__.+__$") & ~F.col("name").isin(*ENTRY_NAMES)).select("project", "sid", "file", "name").distinct()
    called = (calls_of if calls_of is not None else calls(symbols, texts)).select("project", F.col("callee").alias("name")).distinct()
    return defined.join(called, ["project", "name"], "left_anti")


def symbol_hotspots(edges: DataFrame, symbols: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` symbols of each project that several others point at, without those named like their file (a top-k report)."""
    n = edges.groupBy("project", F.col("dst").alias("sid")).agg(F.countDistinct("src").alias("callers")).where("callers > 1")
    stem = F.regexp_extract("file", r"([^/.]+)(?:\.[^/]*)?$", 1)
    named = n.join(known_symbols(symbols).select("sid", "name", "file").distinct(), "sid").where(F.lower("name") != F.lower(stem))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("callers"), "sid"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("project", "sid", "name", "callers", "rank")


def top_callers(symbols: DataFrame, texts: DataFrame, top: int = 50, calls_of: DataFrame | None = None) -> DataFrame:
    """The ``top`` files of each project by distinct outgoing calls; a god file is among the first 5 % and makes 100 or more (a top-k report)."""
    n = (calls_of if calls_of is not None else calls(symbols, texts)).select("project", "file_id", "callee").distinct().groupBy("project", "file_id").agg(F.count("*").alias("calls"))
    project = Window.partitionBy("project")
    of = n.groupBy("project").agg(F.count("*").alias("of"))
    rows = n.withColumn("rank", F.row_number().over(project.orderBy(F.desc("calls"), "file_id"))).where(F.col("rank") <= top).join(of, "project")
    god = (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("of") * 0.05 + 0.5))) & (F.col("calls") >= 100)
    return rows.select("project", "file_id", "calls", "rank", god.alias("god_file"))


def members(symbols: DataFrame, shown: int = 20) -> DataFrame:
    """Types of each file with the number of members and the first ``shown`` by line, names joined (an overview)."""
    s = known_symbols(symbols)
    owner = s.where(~_callable()).select("project", "file_id", F.col("name").alias("owner"), F.col("sid").alias("owner_sid"))
    m = s.where(_callable()).select("file_id", referenced_name(F.col("parent")).alias("owner"), "sid", "name", "line").where("owner <> ''").distinct().join(owner, ["file_id", "owner"])
    nth = F.row_number().over(Window.partitionBy("owner_sid").orderBy("line", "sid"))
    rows = m.withColumn("nth", nth)
    return rows.groupBy("project", "owner_sid").agg(F.count("*").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "name")))), lambda x: x["name"]), ", ").alias("names"))
