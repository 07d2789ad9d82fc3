"""Overviews of a project at four depths, and a cache of answers that stays valid while its files do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions.text import question_hash
from codestrata.operators.files import entry_points, known_files, module_summary
from codestrata.operators.hierarchy import CALLABLE_KINDS
from codestrata.operators.symbols import known_symbols


def project_overview(files: DataFrame, edges: DataFrame, shown: int = 10) -> DataFrame:
    """Depth 0, one row a project: modules, files, edges between modules, and the first entry points by path (a bounded view). ``edges(project, s, t)`` link files."""
    m = module_summary(files).groupBy("project").agg(F.count("*").alias("modules"), F.sum(F.col("file_count") + F.col("other_count")).alias("files"))
    cross = edges.where(F.substring_index("s", "/", 1) != F.substring_index("t", "/", 1)).groupBy("project").agg(F.count("*").alias("cross_edges"))
    nth = F.row_number().over(Window.partitionBy("project").orderBy("path"))
    e = entry_points(files, edges).where("role = 'entry'")
    first = e.withColumn("nth", nth).where(F.col("nth") <= shown).groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("entries"))
    n = e.groupBy("project").agg(F.count("*").alias("n_entries"))
    return m.join(cross, "project", "left").join(n, "project", "left").join(first, "project", "left").na.fill(0, ["cross_edges", "n_entries"]).na.fill("", ["entries"])


def module_overview(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth 1, one row a module: edges within, out of and into it."""
    top = lambda c: F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise("_root")
    e = edges.select("project", top("s").alias("a"), top("t").alias("b"))
    ends = F.explode(F.array_distinct(F.array("a", "b"))).alias("module")
    counts = e.select("project", "a", "b", ends).groupBy("project", "module").agg(
        F.count(F.when(F.col("a") == F.col("b"), 1)).alias("within"), F.count(F.when((F.col("a") == F.col("module")) & (F.col("a") != F.col("b")), 1)).alias("out"), F.count(F.when((F.col("b") == F.col("module")) & (F.col("a") != F.col("b")), 1)).alias("into"))
    return module_summary(files).join(counts, ["project", "module"], "left").na.fill(0, ["within", "out", "into"])


def file_overview(calls: DataFrame, shown: int = 10) -> DataFrame:
    """Depth 2, one row a caller: the number of names it calls and the first by name (a bounded view)."""
    nth = F.row_number().over(Window.partitionBy("sid").orderBy("callee"))
    return (calls.select("project", "file_id", "sid", "callee").distinct().withColumn("nth", nth).groupBy("project", "file_id", "sid")
            .agg(F.count("*").alias("callees"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("callee")))), ", ").alias("names")))


def symbol_overview(symbols: DataFrame) -> DataFrame:
    """Depth 3, one row a file: its types, members, free callables, and how many symbols have documentation."""
    docs = symbols.where("sid IS NOT NULL").groupBy("sid").agg(F.max(F.coalesce(F.length("doc") > 0, F.lit(False))).alias("documented"))
    s = known_symbols(symbols).select("sid", "project", "file_id", "kind", "parent").distinct().join(docs, "sid")
    call, member = F.col("kind").isin(*CALLABLE_KINDS), F.coalesce(F.length("parent") > 0, F.lit(False))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return s.groupBy("project", "file_id").agg(n(~call, "types"), n(call & member, "members"), n(call & ~member, "free"), n(F.col("documented"), "documented"), F.count("*").alias("symbols"))


def answer_budget(files: DataFrame) -> DataFrame:
    """How much larger an answer may be for a project of its size: once, one and a half times or twice."""
    n = known_files(files).groupBy("project").agg(F.countDistinct("file_id").alias("files"))
    return n.withColumn("factor", F.when(F.col("files") < 1500, 1.0).when(F.col("files") < 6000, 1.5).otherwise(2.0))


def cached_answers(questions: DataFrame, cache: DataFrame, current: DataFrame) -> DataFrame:
    """(question_id, answer) for questions(question_id, project, question) whose cached answer still holds.

    ``cache(project, question_hash, answer, saved_at, file_hashes map)`` holds answers with the hashes of the files they rest on; all of these must be as in
    ``current(project, path, sha)``. The latest valid answer counts.
    """
    wanted = questions.select("question_id", "project", question_hash(F.col("question")).alias("question_hash"))
    hit = wanted.join(cache, ["project", "question_hash"])
    used = hit.select("question_id", "saved_at", "project", F.explode_outer("file_hashes").alias("path", "sha"))
    stale = (used.where("path IS NOT NULL").join(current.select("project", "path", F.col("sha").alias("now")), ["project", "path"], "left")
             .where("now IS NULL OR now <> sha").select("question_id", "saved_at").distinct())
    valid = hit.join(stale, ["question_id", "saved_at"], "left_anti")
    return valid.groupBy("question_id").agg(F.max_by("answer", "saved_at").alias("answer"))


def save_answers(cache: DataFrame, new: DataFrame, keep: int = 200) -> DataFrame:
    """The cache with new answers in place of old ones to the same question, the ``keep`` latest of each project (a bounded cache)."""
    both = cache.unionByName(new)
    latest = F.row_number().over(Window.partitionBy("project", "question_hash").orderBy(F.desc("saved_at")))
    newest = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("saved_at"), "question_hash"))
    return both.withColumn("n", latest).where("n = 1").withColumn("n", newest).where(F.col("n") <= keep).drop("n")


def flow_question(question: Column, seed_files: Column | None = None) -> Column:
    """Whether a question asks how one thing leads to another: by its words, or because it names two files or more."""
    told = F.coalesce(F.lower(question).rlike(r"\b(flow|path|trace|from .+ to |between|reach(es)?|lead(s)? to|call chain|depend(s)? on)\b"), F.lit(False))
    return told if seed_files is None else told | (F.coalesce(seed_files, F.lit(0)) >= 2)


def clamp_answer(text: Column, budget: Column) -> Column:
    """An answer of at most ``budget`` characters; where it is cut, a notice says how many are left out."""
    cut = F.concat(F.substring(text, F.lit(1), budget), F.lit("\n… "), (F.length(text) - budget).cast("string"), F.lit(" characters left out"))
    return F.when(F.length(text) > budget, cut).otherwise(text)


def render_context(context: DataFrame, symbols: DataFrame, budget: int = 6000) -> DataFrame:
    """(question_id, project, body): the symbols of :func:`codestrata.operators.search.context` as text, one a line by rank, within the budget."""
    named = known_symbols(symbols).groupBy("sid").agg(F.min(F.struct("name", "kind", "file", "line")).alias("n"))
    line = F.concat(F.lit("- "), F.coalesce("n.name", F.lit("?")), F.lit(" ("), "n.kind", F.lit(") "), F.coalesce("n.file", F.lit("?")), F.lit(":"), F.coalesce(F.col("n.line").cast("string"), F.lit("?")))
    rows = context.join(named, "sid").withColumn("text", line).groupBy("question_id", "project").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all"))  # a context is bounded
    return rows.select("question_id", "project", clamp_answer(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), F.lit(budget)).alias("body"))
