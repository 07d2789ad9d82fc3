"""Sinks: tables for later runs, and a tree of markdown reports written in parallel."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codestrata.functions.text import question_hash, tokens_estimate
from codestrata.operators.files import known_files, module_of
from codestrata.operators.hierarchy import CALLABLE_KINDS, clean_kind

FUNCTIONS_SHOWN, FILES_SPLIT = 60, 50


SCHEMA_REVISION = 1
DAYS = (7, 3650)  # bounds of a history window


def save_result(tables: dict[str, DataFrame], folder: str, built_at: str, **meta: str) -> None:
    """A scan's tables, and last a row of metadata that makes them valid: revision of the layout, time, names, and what else is given."""
    spark = next(iter(tables.values())).sparkSession
    save_tables(tables, folder)
    row = {"revision": SCHEMA_REVISION, "built_at": built_at, "tables": ",".join(sorted(tables)), **meta}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")


def load_meta(spark: SparkSession, folder: str) -> dict | None:
    """A saved result's metadata; None where there is none or its layout is of another revision."""
    try:
        rows = spark.read.text(f"{folder}/_meta").collect()  # one line
        meta = json.loads(rows[0]["value"]) if rows else None
    except (AnalysisException, ValueError):
        return None
    return meta if meta and meta.get("revision") == SCHEMA_REVISION else None


def load_result(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    meta = load_meta(spark, folder)
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in meta["tables"].split(",")} if meta else None


def stale(spark: SparkSession, folder: str, built_at: str) -> bool:
    """Whether a result loaded when it was ``built_at`` has been replaced or removed since."""
    meta = load_meta(spark, folder)
    return meta is None or meta["built_at"] != built_at


def recent_results(spark: SparkSession, folders: list[str], newest: int = 10) -> list[dict]:
    """The metadata of the ``newest`` valid results, latest first."""
    found = [{**m, "folder": f} for f in folders if (m := load_meta(spark, f))]
    return sorted(found, key=lambda m: (m["built_at"], m["folder"]), reverse=True)[:newest]


def inferred_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, confidence, reason, origin) of a file of inferred edges, one JSON object a line: ends must be known, a reason has 160 characters at most."""
    rows = spark.read.schema("source string, target string, confidence double, reason string, origin string").json(path)
    return rows.where("source <> '' AND target <> '' AND source <> target").withColumns({"reason": F.substring("reason", 1, 160), "origin": F.coalesce("origin", F.lit("inferred"))})


def valid_edges(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Inferred edges(project, source, target, source_sha, target_sha, ...) whose two files are still as they were, by current(project, path, sha); with a column ``stale`` for the notice instead of dropping them here."""
    now = lambda c: current.select("project", F.col("path").alias(c), F.col("sha").alias(f"{c}_now"))
    rows = edges.join(now("source"), ["project", "source"], "left").join(now("target"), ["project", "target"], "left")
    same = lambda c: F.coalesce(F.col(f"{c}_now") == F.col(f"{c}_sha"), F.lit(False))
    return rows.withColumn("stale", ~(same("source") & same("target"))).drop("source_now", "target_now")


def log_queries(rows: DataFrame, folder: str) -> None:
    """Append rows(tool, question, answer, ms) to a log: hashes and sizes only, never the texts."""
    rows.select("tool", question_hash(F.col("question")).alias("question_hash"), F.length("answer").alias("chars"), tokens_estimate(F.col("answer")).alias("tokens"), "ms").write.mode("append").json(folder)


def read_page(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """The lines of a project's written pages."""
    return spark.read.text(folder).where(F.col("project") == project).select("value")


def clamp_days(days: Column) -> Column:
    return F.greatest(F.lit(DAYS[0]), F.least(F.lit(DAYS[1]), days))


def window_days(asked: Column, configured: Column, otherwise: int = 180) -> Column:
    """How many days a history covers: what is asked for, within bounds; else what the project sets, if that is within bounds; else ``otherwise``."""
    return F.coalesce(F.when(asked.isNotNull(), clamp_days(asked)), F.when(configured.between(*DAYS), configured), F.lit(otherwise))


def symbol_pages(files: DataFrame, symbols: DataFrame, shown: int = 120) -> DataFrame:
    """(project, page, symbols, body): one page a file with its first ``shown`` symbols by line; the others are counted."""
    s = symbols.where("sid IS NOT NULL").select("file_id", "sid", "name", clean_kind(F.col("kind")).alias("kind"), "line").distinct()
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "sid"))
    lists = s.withColumn("nth", nth).groupBy("file_id").agg(F.count("*").alias("symbols"), F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "kind", "name", "line")))).alias("top"))
    text = F.array_join(F.transform("top", lambda x: F.concat(F.lit("- "), x["kind"], F.lit(" "), F.coalesce(x["name"], F.lit("?")), F.lit(" "), F.coalesce(x["line"].cast("string"), F.lit("?")))), "\n")
    return known_files(files).select("file_id", "project", "path").distinct().join(lists, "file_id").select("project", F.col("path").alias("page"), "symbols", F.concat(F.lit("# "), "path", F.lit("\n\n"), text).alias("body"))


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below ``folder``, replacing what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def module_pages(files: DataFrame) -> DataFrame:
    """(project, page, body): one markdown page a module, or a page a sub-folder where a module has more than 50 files."""
    rows = known_files(files).select("project", "path", module_of(F.col("path")).alias("module"), (F.col("code") + F.col("comment") + F.col("blank")).alias("lines"))
    many = F.count("*").over(Window.partitionBy("project", "module")) > FILES_SPLIT
    sub = F.regexp_extract("path", r"^[^/]+/([^/]+)/", 1)
    rows = rows.withColumn("page", F.when(many & (sub != ""), F.concat_ws("/", "module", sub)).otherwise(F.col("module")))
    line = F.format_string("- `%s` %d lines", "path", "lines")
    return rows.groupBy("project", "page").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("list")).select(
        "project", "page", "files", "lines", F.concat(F.lit("# "), "page", F.lit("\n\n"), "list").alias("body"))


def file_pages(files: DataFrame, symbols: DataFrame, shown: int = FUNCTIONS_SHOWN) -> DataFrame:
    """(project, page, functions, body): one page a file with its first ``shown`` callables by line; the others are counted."""
    s = symbols.where(clean_kind(F.col("kind")).isin(*CALLABLE_KINDS)).select("file_id", "sid", "name", "line").distinct()
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "sid"))
    lists = s.withColumn("nth", nth).groupBy("file_id").agg(
        F.count("*").alias("functions"), F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "name", "line")))).alias("top"))
    text = F.array_join(F.transform("top", lambda x: F.format_string("- %s (line %d)", x["name"], x["line"])), "\n")
    return known_files(files).select("file_id", "project", "path").distinct().join(lists, "file_id", "left").select(
        "project", F.col("path").alias("page"), F.coalesce("functions", F.lit(0)).alias("functions"), F.concat(F.lit("# "), "path", F.lit("\n\n"), F.coalesce(text, F.lit("no functions"))).alias("body"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as text, one folder a project, written by the executors."""
    pages.select("project", "body").write.mode("overwrite").partitionBy("project").text(folder)
