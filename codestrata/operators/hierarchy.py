"""Parent-child links to full hierarchies by tree contraction.

Every node has at most one upper node. The links are contracted in rounds: leaves are raked off,
and an independent set of nodes with a single child is spliced out of its chain, so even a path of
n nodes takes O(log n) rounds. What was removed is recorded; afterwards the rounds are replayed in
reverse and give each node its root, depth and path. Links that never become leaves are
circles: the core that remains when a round finds no leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.tables import materialize

CALLABLE_KINDS = ("function", "method", "constructor", "func", "def", "fn")
TYPE_KINDS = ("class", "struct", "interface", "mixin")
CYCLE = "cycle"


def clean_kind(kind: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(kind, F.lit("")), r"^\s+|\s+$", ""))


def _outside(text: Column) -> Column:
    """What stands outside all angle and square brackets, however deep they nest; nothing after one that never closes."""
    def step(acc: Column, c: Column) -> Column:
        opens, closes = c.isin("<", "["), c.isin(">", "]") & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((acc["depth"] > 0) | opens, acc["kept"]).otherwise(F.concat(acc["kept"], c)).alias("kept"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept")), step, lambda acc: acc["kept"])


def referenced_name(ref: Column) -> Column:
    """The bare name a reference holds.

    Type arguments in angle or square brackets go first (innermost outward, so nested ones vanish),
    then pointer marks, access words, qualifiers before ``.`` ``::`` ``\\`` ``/`` or ``#``, and outer blanks.
    Null stays null and a reference without a name becomes the empty string.
    """
    out = ref
    for _ in range(2):
        out = F.regexp_replace(out, r"<[^<>]*>|\[[^\[\]]*\]", "")
    out = F.when(out.rlike(r"[<\[]"), _outside(out)).otherwise(out)
    out = F.regexp_replace(out, r"[*&^]", " ")
    out = F.regexp_replace(out, r"(?i)(^|\s)(?:(?:public|private|protected|virtual)\b\s*)+(?=\S)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^.*(?:::|->|[.\\/#])\s*", ""))


def contract(links: DataFrame, paths: bool = False, max_rounds: int = 200) -> DataFrame:
    """Resolve ``links(node, upper)``, one row a node, into (node, root, depth[, path]).

    A node whose way up runs into a circle gets root 'cycle', depth -1 and a null path. ``path`` holds the nodes
    from the root down to the node itself. Only nodes that have an upper node come out. Rows with a null
    end are ignored; of several uppers for a node the smallest counts. An empty input gives an empty result.
    """
    seg = F.array("node") if paths else F.lit(1)
    joined = F.concat("over_seg", "seg") if paths else F.col("over_seg") + F.col("seg")
    state = materialize(
        links.where(F.col("node").isNotNull() & F.col("upper").isNotNull())
        .groupBy("node").agg(F.min("upper").alias("upper"))
        .select("node", "upper", seg.alias("seg")), "links")
    records: list[DataFrame] = []
    core = state.limit(0)
    for rnd in range(max_rounds):
        kids = state.groupBy(F.col("upper").alias("node")).agg(F.count("*").alias("kids"))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(rnd)), F.lit(2))  # noqa: E731, B023
        marked = state.join(kids, "node", "left").withColumn(
            "mark",
            F.when(F.col("kids").isNull(), F.lit("rake"))
            .when((F.col("kids") == 1) & (coin(F.col("node")) == 1) & (coin(F.col("upper")) == 0), F.lit("splice"))
            .otherwise(F.lit("keep"))).drop("kids")
        spliced = marked.where(F.col("mark") == "splice").select(
            F.col("node").alias("upper"), F.col("upper").alias("over"), F.col("seg").alias("over_seg"))
        moved = marked.join(spliced, "upper", "left").select(
            "node", F.coalesce("over", "upper").alias("upper"), "mark", F.when(F.col("over").isNull(), F.col("seg")).otherwise(joined).alias("seg"))
        moved = materialize(moved, "contracted")  # the one table a round; what it holds is asked of its column of marks, which takes no shuffle of rows
        any_of = lambda mark: F.coalesce(F.bool_or(F.col("mark") == mark), F.lit(False)).alias(mark)
        seen = moved.agg(any_of("rake"), any_of("keep")).first()
        if not seen["rake"]:  # what is left, spliced nodes included, leads into circles only
            core = state
            break
        records.append(moved.where(F.col("mark") != "keep").drop("mark"))
        state = moved.where(F.col("mark") == "keep").drop("mark")
        if not seen["keep"]:
            break
    else:
        raise RuntimeError(f"contraction did not end within {max_rounds} rounds")

    path_type = "array<string>" if paths else "int"
    nodes = core.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast(path_type).alias("path"))
    length = F.size("seg") if paths else F.col("seg")
    on_cycle = F.col("depth") == -1
    full = (F.when(on_cycle, F.lit(None)).otherwise(F.concat(F.coalesce("path", F.array("upper")), F.col("seg")))
            if paths else F.lit(None).cast("int"))

    def replay(record: DataFrame, parts: list[DataFrame]) -> DataFrame:
        known = reduce(DataFrame.unionByName, parts).select(F.col("node").alias("upper"), "root", "depth", "path")
        return record.join(known, "upper", "left").select(
            "node", F.coalesce("root", "upper").alias("root"),
            F.when(on_cycle, F.lit(-1)).otherwise(F.coalesce("depth", F.lit(0)) + length).cast("int").alias("depth"), full.alias("path"))

    # Rounds shrink in proportion, so reading all later ones again is no more work than the first. Two are replayed in one job.
    done = [nodes]
    for at in range(len(records), 0, -2):
        later = replay(records[at - 1], done)
        both = [later, replay(records[at - 2], [*done, later])] if at > 1 else [later]
        done.append(materialize(reduce(DataFrame.unionByName, both), "resolved"))
    out = reduce(DataFrame.unionByName, done)
    return out if paths else out.drop("path")


def symbol_links(symbols: DataFrame) -> DataFrame:
    """(link, sid, upper) for the two hierarchies of a symbol table.

    ``parent`` links lead to the non-callable symbol of the same file that the column names, ``bases`` links from a type
    to the type of the same project that the first resolvable entry names. Repeated rows count once. A null or empty
    reference, a null file or project, and a name nobody bears give no link. Of several symbols that
    share a name in the same scope the smallest sid is taken.
    """
    rows = symbols.select("sid", "project", "file_id", "name", clean_kind(F.col("kind")).alias("kind"), "bases", "parent").where(
        F.col("sid").isNotNull())
    upper = lambda scope, keep: rows.where(keep).groupBy(scope, "name").agg(F.min("sid").alias("upper"))
    parents = (
        rows.select("sid", "file_id", referenced_name(F.col("parent")).alias("name")).where(F.col("name") != "").distinct()
        .join(upper("file_id", ~F.col("kind").isin(*CALLABLE_KINDS)), ["file_id", "name"])
        .select(F.lit("parent").alias("link"), "sid", "upper"))
    is_type = F.col("kind").isin(*TYPE_KINDS)
    bases = (
        rows.where(is_type).select("sid", "project", F.posexplode("bases").alias("pos", "ref"))
        .select("sid", "project", "pos", referenced_name(F.col("ref")).alias("name")).where(F.col("name") != "").distinct()
        .join(upper("project", is_type), ["project", "name"])
        .groupBy("sid").agg(F.min_by("upper", F.struct("pos", "upper")).alias("upper"))
        .select(F.lit("bases").alias("link"), "sid", "upper"))
    return parents.unionByName(bases)


def symbol_hierarchy(symbols: DataFrame, paths: bool = True) -> DataFrame:
    """(link, sid, root, depth[, path]) of every symbol with an upper symbol, by :func:`contract`."""
    tagged = symbol_links(symbols)
    key = lambda c: F.concat(F.substring("link", 1, 1), F.lit(":"), F.col(c))
    bare = lambda c: F.substring(c, 3, 1 << 30)
    got = contract(tagged.select(key("sid").alias("node"), key("upper").alias("upper")), paths)
    out = got.select(
        F.when(F.col("node").startswith("p:"), "parent").otherwise("bases").alias("link"), bare("node").alias("sid"),
        F.when(F.col("depth") == -1, F.lit(CYCLE)).otherwise(bare("root")).alias("root"), "depth",
        *([F.transform("path", lambda x: F.substring(x, 3, 1 << 30)).alias("path")] if paths else []))
    return out


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(link, sid, descendant, distance): every pair of a symbol and one below it, from the paths.

    Symbols whose way up runs into a circle have no path and give no pairs; they are reported with root 'cycle'.
    """
    return (
        hierarchy.where(F.col("path").isNotNull())
        .select("link", F.col("sid").alias("descendant"), "depth", F.posexplode("path").alias("at", "above"))
        .where(F.col("at") < F.col("depth"))
        .select("link", F.col("above").alias("sid"), "descendant", (F.col("depth") - F.col("at")).alias("distance")))
