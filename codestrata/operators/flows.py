"""Flows between parts of a tree: folders, groups and kinds of edges, for views that show one level at a time.

Edges are (project, s, t) between paths. Null ends are passed over; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def common_folder(paths: DataFrame) -> DataFrame:
    """(project, prefix): the deepest folder that holds all paths of a project, '' if none does. Partial results are combined, so no group is gathered.

    The least and the greatest path by segments share exactly the segments that all share.
    """
    folders = F.transform(F.split("path", "/"), lambda x: x)
    held = paths.where("project IS NOT NULL AND path IS NOT NULL").select("project", F.slice(folders, 1, F.size(folders) - 1).alias("folders"))
    ends = held.groupBy("project").agg(F.min("folders").alias("a"), F.max("folders").alias("b"))
    both = F.filter(F.sequence(F.lit(1), F.greatest(F.size("a"), F.lit(1))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    depth = F.when(F.size("a") == 0, 0).otherwise(F.coalesce(F.array_max(F.filter(both, lambda i: (i <= F.size("a")) & (i <= F.size("b")))), F.lit(0)))
    return ends.select("project", F.when(depth > 0, F.array_join(F.slice("a", 1, F.greatest(depth, F.lit(1))), "/")).otherwise("").alias("prefix"))


def group_below(path: Column, prefix: Column) -> Column:
    """The group of a path in a view of the folder ``prefix``: the folder or file one level below it; for a path outside, one level past what it shares with the prefix, in brackets."""
    below = F.when(prefix == "", path).when(F.startswith(path, F.concat(prefix, F.lit("/"))), F.substring(path, F.length(prefix) + 2, F.length(path)))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(F.split(prefix, "/"))), lambda i: F.slice(F.split(path, "/"), 1, i) == F.slice(F.split(prefix, "/"), 1, i)))
    outside = F.concat(F.lit("["), F.array_join(F.slice(F.split(path, "/"), 1, shared + 1), "/"), F.lit("]"))
    return F.coalesce(F.substring_index(below, "/", 1), outside)


def folder_flows(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(project, s, t, edges): edges between the groups one level below each project's prefix(project, prefix), of edges with an end below it; those within a group don't flow."""
    rows = edges.where("s IS NOT NULL AND t IS NOT NULL").join(prefixes, "project")
    inside = lambda c: (F.col("prefix") == "") | F.startswith(F.col(c), F.concat("prefix", F.lit("/")))
    rows = rows.where(inside("s") | inside("t")).select("project", group_below(F.col("s"), F.col("prefix")).alias("s"), group_below(F.col("t"), F.col("prefix")).alias("t"))
    return rows.where("s <> t").groupBy("project", "s", "t").agg(F.count("*").alias("edges"))


def fold_sides(flows: DataFrame, kept: int = 24) -> DataFrame:
    """Flows(project, s, t, edges) where on each side all but the ``kept`` ends with most edges are 'others' (a bounded view)."""
    out = flows
    for side in ("s", "t"):
        n = flows.groupBy("project", side).agg(F.sum("edges").alias("n"))
        place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), side))
        top = n.withColumn("place", place).where(F.col("place") <= kept).select("project", side, F.lit(True).alias(f"keep_{side}"))
        out = out.join(top, ["project", side], "left")
    name = lambda c: F.when(F.col(f"keep_{c}"), F.col(c)).otherwise("others").alias(c)
    return out.select("project", name("s"), name("t"), "edges").groupBy("project", "s", "t").agg(F.sum("edges").alias("edges"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """(scope, s, t, kind, times): how often each kind of edge links two different nodes."""
    return edges.where("s <> t").groupBy("scope", "s", "t", "kind").agg(F.count("*").alias("times"))
