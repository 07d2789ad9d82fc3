"""References to records that do not exist at the time of the reference.

The times at which a key exists are sorted integers (microseconds); they are compressed into contiguous runs. A
reference is matched as-of to the run that starts last before it and is an orphan if there is none or it
lies beyond the run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FOREVER = (1 << 63) - 1


def runs(lifetimes: DataFrame) -> DataFrame:
    """Merge (scope, key, start, end) into disjoint runs; touching or overlapping lifetimes become one.

    Null scope, key or start, and lifetimes of no length, exist never. A null end means still there.
    """
    live = (
        lifetimes.select("scope", "key", "start", F.coalesce("end", F.lit(FOREVER)).alias("end"))
        .where(F.col("scope").isNotNull() & F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("start") < F.col("end")))
        .groupBy("scope", "key", "start").agg(F.max("end").alias("end")))
    order = Window.partitionBy("scope", "key").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        live.withColumn("fresh", fresh).withColumn("island", island)
        .groupBy("scope", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island"))


def find_orphans(references: DataFrame, lifetimes: DataFrame, rows_per_group: int = 500_000) -> DataFrame:
    """The rows of ``references(scope, key, at, ...)`` whose key does not exist at ``at``; columns are kept.

    Null and empty keys refer to nothing and are no orphans. A null scope or time matches no run, so
    such a reference is one, and takes no part in the match. A key with more than ``rows_per_group`` references is salted: its references are dealt
    into groups of about that size and its runs repeated for each, so no task gets an unbounded group.
    """
    given = references.where(F.col("key").isNotNull() & (F.col("key") != ""))
    nowhere = F.col("scope").isNull() | F.col("at").isNull()
    refs = given.where(~nowhere)
    hot = (refs.groupBy("scope", "key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_group)
           .select("scope", "key", F.ceil(F.col("n") / rows_per_group).cast("int").alias("salts")))
    names = references.columns
    ref_rows = (
        refs.join(hot, ["scope", "key"], "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*names), F.col("salts")).cast("int")))
        .select("scope", "key", "salt", F.col("at").alias("t"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("run_end"),
                F.struct(*names).alias("row")))
    run_rows = (
        runs(lifetimes).join(hot, ["scope", "key"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .select("scope", "key", "salt", F.col("start").alias("t"), F.lit(0).alias("is_ref"), F.col("end").alias("run_end"),
                F.lit(None).cast(ref_rows.schema["row"].dataType).alias("row")))
    asof = Window.partitionBy("scope", "key", "salt").orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ref_rows.unionByName(run_rows)
        .withColumn("until", F.last("run_end", ignorenulls=True).over(asof))
        .where((F.col("is_ref") == 1) & (F.col("until").isNull() | (F.col("t") >= F.col("until"))))
        .select("row.*").unionByName(given.where(nowhere)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """(edge_id, side, scope, key, at, recorded_at) of both ends of each edge; repeated rows count once."""
    ends = F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col("s").alias("key")), F.struct(F.lit("t").alias("side"), F.col("t").alias("key"))))
    return (
        edges.select("edge_id", F.col("project").alias("scope"), "s", "t", "recorded_at").distinct()
        .select("edge_id", "scope", "recorded_at", ends.alias("e"))
        .select("edge_id", "e.side", "scope", "e.key", _micros(F.col("recorded_at")).alias("at"), "recorded_at"))


def module_lifetimes(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("project").alias("scope"), F.col("id").alias("key"), _micros(F.col("added_at")).alias("start"),
                          _micros(F.col("removed_at")).alias("end"))


def orphan_edge_ends(edges: DataFrame, modules: DataFrame, **options) -> DataFrame:
    return find_orphans(edge_ends(edges), module_lifetimes(modules), **options)


def orphan_report(edges: DataFrame, modules: DataFrame, table: str = "module_edges") -> DataFrame:
    """Orphans per table, side and month of ``recorded_at``."""
    return (
        orphan_edge_ends(edges, modules)
        .groupBy(F.lit(table).alias("table_name"), "side", F.date_format("recorded_at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("orphans"), F.countDistinct("scope", "key").alias("missing_keys")))
