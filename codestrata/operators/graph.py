"""Graphs as edge tables: degrees, flows, components, cycles, distances, communities.

Edges are (scope, s, t[, weight]); nothing links different scopes, so one run serves every project at once. Iterative operators write each round to the
shared folder and stop when nothing changes; node and edge sets are never gathered. Null and empty ends are no nodes, self
links and repeated edges count once or not at all as stated. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.tables import materialize


def module_edges(edges: DataFrame) -> DataFrame:
    """(scope, s, t, weight, kind, edge_id) of distinct edges with both ends; a null weight is 1."""
    return (edges.where("project IS NOT NULL AND s <> '' AND t <> ''")
            .select("edge_id", F.col("project").alias("scope"), "s", "t", F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("kind", F.lit("")).alias("kind")).distinct())


def undirected_weights(edges: DataFrame) -> DataFrame:
    """Weight and number of the edges between each two different nodes, whatever their direction."""
    return (edges.where("s <> t").groupBy("scope", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
            .agg(F.sum("weight").alias("weight"), F.count("*").alias("edges")))


def typed_edges(edges: DataFrame) -> DataFrame:
    """The first edge, by id, of each (s, t, kind), without self links."""
    nth = F.row_number().over(Window.partitionBy("scope", "s", "t", "kind").orderBy("edge_id"))
    return edges.where("s <> t").withColumn("nth", nth).where("nth = 1").drop("nth")


def degrees(edges: DataFrame) -> DataFrame:
    """Incoming, outgoing and all edges of each node, and the incoming share of the scope's most linked node."""
    ends = F.explode(F.array(F.struct(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    rows = typed_edges(edges).select("scope", ends.alias("e")).groupBy("scope", "e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))
    most = rows.groupBy("scope").agg(F.max("in_degree").alias("most"))
    return rows.join(most, "scope").withColumn("centrality", F.when(F.col("most") > 0, F.round(F.col("in_degree") / F.col("most"), 4)).otherwise(0.0)).drop("most")


def top_targets(edges: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` nodes of each scope by incoming edges, with a severity by rank (a top-k report)."""
    n = typed_edges(edges).groupBy("scope", F.col("t").alias("node")).agg(F.count("*").alias("edges"))
    scope = Window.partitionBy("scope")
    place = F.row_number().over(scope.orderBy(F.desc("edges"), "node"))
    share = F.col("rank") / F.col("all")
    return (n.withColumn("rank", place).where(F.col("rank") <= top).join(n.groupBy("scope").agg(F.count("*").alias("all")), "scope")
            .withColumn("tier", F.when(share <= 0.1, "critical").when(share <= 0.25, "warn").otherwise("info")).drop("all"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that point at each other."""
    e = edges.select("scope", "s", "t").distinct()
    return e.where("s < t").join(e.select("scope", F.col("s").alias("t"), F.col("t").alias("s")), ["scope", "s", "t"]).select("scope", F.col("s").alias("a"), F.col("t").alias("b"))


def flows(edges: DataFrame, top: int = 15) -> DataFrame:
    """Weight from module to module where all but each scope's ``top`` modules by weight are folded into 'others'."""
    e = edges.where("s <> t").groupBy("scope", "s", "t").agg(F.sum("weight").alias("weight"))
    ends = F.explode(F.array(F.col("s"), F.col("t"))).alias("node")
    total = e.select("scope", ends, "weight").groupBy("scope", "node").agg(F.sum("weight").alias("total"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("total"), "node"))
    kept = total.withColumn("rank", rank).where(F.col("rank") <= top)
    side = lambda c: kept.select("scope", F.col("node").alias(c), F.col("node").alias(f"{c}_name"))
    named = e.join(side("s"), ["scope", "s"], "left").join(side("t"), ["scope", "t"], "left")
    name = lambda c: F.coalesce(f"{c}_name", F.lit("others")).alias(c)
    return named.select("scope", name("s"), name("t"), "weight").groupBy("scope", "s", "t").agg(F.sum("weight").alias("weight"))


def concentration(edges: DataFrame, top: int = 3) -> DataFrame:
    """The share of the ``top`` targets in all incoming edges of a scope, in whole percent."""
    n = typed_edges(edges).groupBy("scope", F.col("t").alias("node")).agg(F.count("*").alias("edges"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("edges"), "node"))
    first = n.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("scope").agg(F.sum("edges").alias("top_edges"))
    return first.join(n.groupBy("scope").agg(F.sum("edges").alias("edges")), "scope").withColumn("percent", F.floor(100 * F.col("top_edges") / F.col("edges") + 0.5))


def trust_label(kind: Column, confidence: Column) -> Column:
    """EXTRACTED, DERIVED, INFERRED or AMBIGUOUS, by the kind of an edge and how sure it is.

    Derived edges (kind holds 'deriv') count as such unless their confidence is below one half; inferred and semantic ones need a known confidence of at least one half. Any other
    edge was read from the source if its confidence is unknown or 1, and counts as inferred down to one half. Everything else is ambiguous.
    """
    low, sure = F.lower(F.coalesce(kind, F.lit(""))), confidence.try_cast("double")
    half = F.coalesce(sure >= 0.5, F.lit(False))
    return (F.when(low.contains("deriv"), F.when(sure.isNull() | half, "DERIVED").otherwise("AMBIGUOUS"))
            .when(low.contains("infer") | (low == "semantic"), F.when(half, "INFERRED").otherwise("AMBIGUOUS"))
            .when(sure.isNull() | (sure >= 1.0), "EXTRACTED").when(half, "INFERRED").otherwise("AMBIGUOUS"))


def trust_summary(edges: DataFrame) -> DataFrame:
    """Edges by trust label for each scope, every label present. Edges without a column ``confidence`` have none."""
    confidence = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("double")
    n = edges.withColumn("label", trust_label(F.col("kind"), confidence)).groupBy("scope", "label").agg(F.count("*").alias("edges"))
    labels = F.explode(F.array(*map(F.lit, ("EXTRACTED", "DERIVED", "INFERRED", "AMBIGUOUS")))).alias("label")
    return edges.select("scope").distinct().select("scope", labels).join(n, ["scope", "label"], "left").na.fill(0, ["edges"])


def surprising(edges: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` edges(scope, s, t, kind) between files of each scope that cross most boundaries (a top-k report).

    2 points for ends in different top folders, 2 for different extensions, 1 for an inferred edge, 1 where one end has ten times the links of the other. Of the edges between two files the best counts,
    whatever its direction; ties go by name.
    """
    ends = F.explode(F.array("s", "t")).alias("node")
    degree = edges.where("s <> t").select("scope", ends).groupBy("scope", "node").agg(F.count("*").alias("degree"))
    of = lambda c: degree.select("scope", F.col("node").alias(c), F.col("degree").alias(f"d{c}"))
    rows = edges.where("s <> t").join(of("s"), ["scope", "s"]).join(of("t"), ["scope", "t"])
    top_folder = lambda c: F.substring_index(c, "/", 1)
    ext = lambda c: F.regexp_extract(c, r"[^/](\.[^./]*)$", 1)
    parts = [
        (F.when(top_folder("s") != top_folder("t"), "cross-directory"), 2), (F.when((ext("s") != "") & (ext("t") != "") & (ext("s") != ext("t")), "cross-language"), 2),
        (F.when(F.coalesce("kind", F.lit("")).contains("inferred"), "inferred edge"), 1), (F.when(F.greatest("ds", "dt") / F.least("ds", "dt") >= 10, "peripheral→hub"), 1)]
    score = sum((F.when(p.isNotNull(), n).otherwise(0) for p, n in parts), F.lit(0))
    rows = rows.withColumns({"score": score, "reason": F.concat_ws(" + ", *(p for p, _ in parts))}).where("score > 0")
    pair = rows.groupBy("scope", F.least("s", "t"), F.greatest("s", "t")).agg(F.min(F.struct((-F.col("score")).alias("order"), "s", "t", "reason", "score")).alias("e")).select("scope", "e.s", "e.t", "e.score", "e.reason")
    return pair.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "s", "t"))).where(F.col("rank") <= top)


# --- iterative operators ----------------------------------------------------------------------------------------------------------


def distances(edges: DataFrame, starts: DataFrame, most: int = 8, directed: bool = True) -> DataFrame:
    """(scope, start, node, hops) of every node within ``most`` steps of ``starts(scope, start)``, by frontier expansion."""
    e = edges.where("s <> t").select("scope", "s", "t").distinct()
    if not directed:
        e = e.unionByName(e.select("scope", F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    e = materialize(e, "adjacent")
    seen = materialize(starts.select("scope", "start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct(), "seen")
    parts, frontier = [seen], seen
    for hop in range(1, most + 1):
        known = _union(parts).select("scope", "start", "node")
        frontier = materialize(
            frontier.join(e, (frontier["scope"] == e["scope"]) & (frontier["node"] == e["s"])).select(frontier["scope"], "start", F.col("t").alias("node")).distinct()
            .join(known, ["scope", "start", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """(scope, a, b, hops, path) for ``pairs(scope, a, b)`` that are linked, ignoring direction; the least path by name on ties."""
    both = edges.where("s <> t").select("scope", "s", "t").distinct()
    both = materialize(both.unionByName(both.select("scope", F.col("t").alias("s"), F.col("s").alias("t"))).distinct(), "both-ways")
    reach = pairs.select("scope", F.col("a").alias("start")).distinct().select("scope", "start", F.col("start").alias("node"), F.array("start").alias("path"))
    parts = [materialize(reach, "paths")]
    frontier = parts[0]
    for _ in range(most):
        known = _union(parts).select("scope", "start", "node")
        frontier = materialize(
            frontier.join(both, (frontier["scope"] == both["scope"]) & (frontier["node"] == both["s"]))
            .groupBy(frontier["scope"], "start", F.col("t").alias("node")).agg(F.min(F.concat("path", F.array("t"))).alias("path"))
            .join(known, ["scope", "start", "node"], "left_anti"), "paths")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    found = _union(parts)
    return pairs.join(found.select("scope", F.col("start").alias("a"), F.col("node").alias("b"), "path"), ["scope", "a", "b"]).select(
        "scope", "a", "b", (F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"))


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(scope, node, component, size) of the nodes on circles, by trimming and forward-backward colouring.

    Nodes without incoming or outgoing edges cannot be on a circle and are trimmed. Of the rest, the largest name is spread along the edges until it settles; the
    nodes that reach their own colour's node backwards form that node's component. Found components are removed and the rest goes
    round again. The component is named by its largest node.
    """
    live = materialize(edges.where("s <> t").select("scope", "s", "t").distinct(), "live")
    found: list[DataFrame] = []
    for rnd in range(most_rounds + 1):
        if rnd == most_rounds:
            raise RuntimeError(f"components remain after {most_rounds} rounds")
        while True:
            size = live.count()
            sources, targets = live.select("scope", F.col("s").alias("n")).distinct(), live.select("scope", F.col("t").alias("n")).distinct()
            both = sources.intersect(targets)
            kept = materialize(live.join(both.withColumnRenamed("n", "s"), ["scope", "s"], "left_semi").join(both.withColumnRenamed("n", "t"), ["scope", "t"], "left_semi").select("scope", "s", "t"), "live")
            live = kept
            if live.count() == size:
                break
        if not size:
            break
        colour = materialize(live.select("scope", F.col("s").alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            pushed = live.join(colour.select("scope", F.col("node").alias("s"), "colour"), ["scope", "s"]).select("scope", F.col("t").alias("node"), "colour")
            # What reaches a colour's node reaches all of that colour: jumping to its colour spreads along a chain in a number of rounds that grows with its logarithm where names are mixed.
            beyond = colour.select("scope", F.col("node").alias("old"), F.col("colour").alias("jump"))
            new = materialize(colour.withColumnRenamed("colour", "old").join(pushed.groupBy("scope", "node").agg(F.max("colour").alias("top")), ["scope", "node"], "left").join(beyond, ["scope", "old"], "left")
                              .select("scope", "node", F.greatest("old", F.coalesce("top", "old"), F.coalesce("jump", "old")).alias("colour"), "old"), "colour")
            moved = not new.where("colour <> old").isEmpty()
            colour = new.drop("old")
            if not moved:
                break
        same = materialize(
            live.join(colour.select("scope", F.col("node").alias("s"), F.col("colour").alias("cs")), ["scope", "s"]).join(
                colour.select("scope", F.col("node").alias("t"), F.col("colour").alias("ct")), ["scope", "t"]).where("cs = ct").select("scope", "s", "t", F.col("cs").alias("colour")), "same")
        back = materialize(colour.where("node = colour"), "back")
        parts, frontier = [back], back
        while not frontier.isEmpty():
            known = _union(parts).select("scope", "node")
            frontier = materialize(
                same.join(frontier.select("scope", F.col("node").alias("t"), "colour"), ["scope", "t", "colour"]).select("scope", F.col("s").alias("node"), "colour").distinct()
                .join(known, ["scope", "node"], "left_anti"), "back")
            parts.append(frontier)
        done = materialize(_union(parts), "component")
        found.append(done)
        live = materialize(live.join(done.select("scope", F.col("node").alias("s")), ["scope", "s"], "left_anti").join(done.select("scope", F.col("node").alias("t")), ["scope", "t"], "left_anti"), "live")
    if not found:
        return edges.select("scope", F.col("s").alias("node"), F.col("s").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    members = _union(found)
    sizes = members.groupBy("scope", "colour").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, ["scope", "colour"]).select("scope", "node", F.col("colour").alias("component"), "size")


def cycle_report(components: DataFrame) -> DataFrame:
    """One row a component, with a severity by size."""
    tier = F.when(F.col("size") >= 10, "critical").when(F.col("size") >= 5, "warn").otherwise("info")
    return components.groupBy("scope", "component").agg(F.count("*").alias("size")).withColumn("tier", tier)


def cycle_examples(edges: DataFrame, components: DataFrame, most: int = 64) -> DataFrame:
    """(scope, component, hops, path): one simple circle of each strong component, the shortest through its least node and of these the least by name.

    Found by expanding paths from that node within the component, one join a step; each node keeps its first and least path only. A circle of more than ``most`` links is an error.
    """
    name = lambda c: components.select("scope", F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    inside = materialize(edges.where("s <> t").select("scope", "s", "t").distinct().join(name("s"), ["scope", "s"]).join(name("t"), ["scope", "t"]).where("of_s = of_t").select("scope", F.col("of_s").alias("component"), "s", "t"), "inside")
    start = components.groupBy("scope", "component").agg(F.min("node").alias("start"))
    frontier = materialize(start.select("scope", "component", "start", F.col("start").alias("node"), F.array("start").alias("path")), "circles")
    seen, done = [frontier], []
    for _ in range(most):
        step = (frontier.join(inside.withColumnRenamed("s", "node"), ["scope", "component", "node"]).groupBy("scope", "component", "start", F.col("t").alias("node"))
                .agg(F.min(F.concat("path", F.array("t"))).alias("path")))
        step = materialize(step, "circles")
        closed = step.where("node = start")
        done.append(closed)
        known = _union([x.select("scope", "component", "node") for x in seen])
        frontier = materialize(step.join(known, ["scope", "component", "node"], "left_anti").join(_union(done).select("scope", "component"), ["scope", "component"], "left_anti"), "circles")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    else:
        raise RuntimeError(f"a circle has more than {most} links")
    return _union(done).select("scope", "component", (F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"))


def large_communities(labels: DataFrame, least: int = 3) -> DataFrame:
    """(scope, node, community, size) without communities of fewer than ``least`` nodes."""
    n = labels.groupBy("scope", "community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(n, ["scope", "community"]).select("scope", "node", "community", "size")


def dominant_community(labels: DataFrame, owners: DataFrame) -> DataFrame:
    """(scope, file, community, nodes): the community most nodes of each owners(scope, node, file) are in; the least by name on ties."""
    n = labels.join(owners.select("scope", "node", "file").distinct(), ["scope", "node"]).groupBy("scope", "file", "community").agg(F.count("*").alias("nodes"))
    return n.groupBy("scope", "file").agg(F.min(F.struct((-F.col("nodes")).alias("order"), "community", "nodes")).alias("m")).select("scope", "file", "m.community", "m.nodes")


def communities(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(scope, node, community) by local moving: a node joins the neighbouring community that adds most to modularity, the smallest name on ties.

    All nodes start alone. In each round half of the nodes, by hash, may move, which keeps two nodes from swapping for ever; it ends
    when neither half moves.
    """
    pairs = undirected_weights(edges)
    both = materialize(pairs.select("scope", F.col("a").alias("s"), F.col("b").alias("t"), "weight").unionByName(pairs.select("scope", F.col("b").alias("s"), F.col("a").alias("t"), "weight")), "weights")
    own = materialize(both.groupBy("scope", F.col("s").alias("node")).agg(F.sum("weight").alias("k")), "node-weight")
    mass = own.groupBy("scope").agg(F.sum("k").alias("mm"))  # twice the weight of all edges
    label = own.select("scope", "node", F.col("node").alias("community"))
    still = 0
    for n in range(rounds):
        totals = label.join(own, ["scope", "node"]).groupBy("scope", "community").agg(F.sum("k").alias("total"))
        around = both.join(label.select("scope", F.col("node").alias("t"), "community"), ["scope", "t"]).groupBy("scope", F.col("s").alias("node"), "community").agg(F.sum("weight").alias("w"))
        choices = (around.unionByName(label.select("scope", "node", "community", F.lit(0).cast("long").alias("w"))).groupBy("scope", "node", "community").agg(F.sum("w").alias("w"))
                   .join(label.select("scope", "node", F.col("community").alias("old")), ["scope", "node"]).join(own, ["scope", "node"]).join(totals, ["scope", "community"]).join(mass, "scope"))
        rest = F.col("total") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0)
        gain = F.round(F.col("w") - F.col("k") * rest / F.col("mm"), 9)
        best = choices.withColumn("gain", gain).groupBy("scope", "node").agg(F.min_by("community", F.struct((-F.col("gain")).alias("g"), (F.col("community") != F.col("old")).alias("moves"), "community")).alias("new"))
        turn = F.pmod(F.xxhash64("node", F.lit(n // 2)), F.lit(2)) == n % 2
        nxt = materialize(label.join(best, ["scope", "node"]).select("scope", "node", F.when(turn, F.col("new")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "label")
        label = nxt.drop("old")
        still = still + 1 if nxt.where("community <> old").isEmpty() else 0
        if still == 2:
            return label
    raise RuntimeError(f"communities did not settle within {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The modularity of a partition of each scope's undirected weighted graph, between -0.5 and 1."""
    pairs = undirected_weights(edges)
    end = lambda c: labels.select("scope", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    known = pairs.join(end("a"), ["scope", "a"]).join(end("b"), ["scope", "b"])
    total = known.groupBy("scope").agg(F.sum("weight").alias("m"))
    inside = known.where("ca = cb").groupBy("scope", F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    ends = known.select("scope", F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("scope", "community").agg(F.sum("weight").alias("ends"))
    return (ends.join(inside, ["scope", "community"], "left").na.fill(0, ["inside"]).join(total, "scope")
            .groupBy("scope").agg(F.round(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), F.lit(2))), 6).alias("modularity"), F.count("*").alias("communities")))
