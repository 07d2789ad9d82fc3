"""Items that appear together: pair counts and lift by heavy-light decomposition.

Within a scope (a project) items are split by how many baskets hold them. Pairs of heavy items are counted
by population counts over a dense bit matrix (items x baskets), one matrix for each block of baskets. Pairs
of light items are listed from each basket, which a size bound keeps short, and hash-counted. Mixed pairs come from
probing the heavy matrix at the positions of a light item's basket list. The three partial counts are
summed and scored.

Scopes, baskets and items are numbered by hash in the first scan, and only numbers are shuffled; the names come back for the pairs in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.tables import materialize

BLOCK = 8192  # baskets in a bit matrix
HEAVY_SHARE = 64  # heavy: in at least 1/64 of the scope's baskets, so a scope has at most 64 x max_size heavy items
HEAVY_LEAST = 16


def clean_path(path: Column) -> Column:
    """Forward slashes, without one leading './'."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def commit_baskets(commit_files: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(basket, item) and (basket, scope) rows: commit and cleaned path, commit and project; null and empty values don't count."""
    items = commit_files.select(F.col("sha").alias("basket"), clean_path(F.col("path")).alias("item")).where(F.col("basket").isNotNull() & (F.col("item") != ""))
    owners = commits.where(F.col("sha").isNotNull() & F.col("project").isNotNull()).select(F.col("sha").alias("basket"), F.col("project").alias("scope"))
    return items, owners


def _bit_counts(basket: np.ndarray, ids: np.ndarray, heavy: np.ndarray) -> list[np.ndarray]:
    """[low, high, count] of pairs within one block of baskets: heavy ones by popcount, mixed ones by list probing."""
    baskets, at = np.unique(basket, return_inverse=True)
    h_ids, h_at = np.unique(ids[heavy], return_inverse=True)
    bits = np.zeros((len(h_ids), len(baskets)), dtype=bool)
    bits[h_at, at[heavy]] = True
    words = np.packbits(np.pad(bits, ((0, 0), (0, -len(baskets) % 64))), axis=1).view(np.uint64)
    lo, hi, n = [], [], []
    for i in range(len(h_ids) - 1):
        both = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1)
        hit = np.flatnonzero(both)
        lo.append(np.full(len(hit), h_ids[i]))
        hi.append(h_ids[i + 1 + hit])
        n.append(both[hit])
    l_at = np.flatnonzero(~heavy)
    if len(l_at) and len(h_ids):
        l_at = l_at[np.argsort(ids[l_at], kind="stable")]
        l_ids, starts = np.unique(ids[l_at], return_index=True)
        ends = np.append(starts[1:], len(l_at))
        by_basket = np.ascontiguousarray(bits.T)
        step = max(1, (1 << 22) // len(h_ids))  # probes at a time, for bounded memory
        first = 0
        while first < len(l_ids):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, "right")))
            rows = l_at[starts[first] : ends[last - 1]]
            both = np.add.reduceat(by_basket[at[rows]].astype(np.int32), starts[first:last] - starts[first], axis=0)
            r, c = np.nonzero(both)
            lo.append(np.minimum(l_ids[first + r], h_ids[c]))
            hi.append(np.maximum(l_ids[first + r], h_ids[c]))
            n.append(both[r, c])
            first = last
    return [np.concatenate(x).astype("int64") if x else np.empty(0, "int64") for x in (lo, hi, n)]


def _list_counts(basket: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """[low, high, count] of pairs of light items, listed from each basket: rows of a basket stand together, and each row meets those 1, 2, ... places on."""
    order = np.lexsort((ids, basket))
    basket, ids = basket[order], ids[order]
    lo, hi = [], []
    for k in range(1, len(ids)):
        same = np.flatnonzero(basket[k:] == basket[:-k])
        if not len(same):
            break
        lo.append(ids[same])
        hi.append(ids[same + k])
    if not lo:
        return [np.empty(0, "int64")] * 3
    pairs, n = np.unique(np.stack([np.concatenate(lo), np.concatenate(hi)]), axis=1, return_counts=True)
    return [pairs[0], pairs[1], n.astype("int64")]


def _block_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """The pair counts of one block of baskets. Light pairs come from light items only, the others have a heavy one: no pair is counted twice."""
    basket, ids, heavy = (rows[c].to_numpy() for c in ("basket", "item", "heavy"))
    by_list = _list_counts(basket[~heavy], ids[~heavy])
    if heavy.any():
        near = np.isin(basket, basket[heavy])
        by_bits = _bit_counts(basket[near], ids[near], heavy[near])
    else:
        by_bits = [np.empty(0, "int64")] * 3
    lo, hi, n = (np.concatenate([a, b]) for a, b in zip(by_list, by_bits))
    return pd.DataFrame({"scope": np.full(len(lo), rows["scope"].iloc[0]), "lo": lo, "hi": hi, "n": n})


def pair_counts(items: DataFrame, owners: DataFrame, min_together: int = 5, min_lift: int = 3, max_size: int = 20) -> DataFrame:
    """(scope, item_a, item_b, together, n_a, n_b, baskets, lift) of each pair with at least ``min_together`` common baskets
    and a lift, together * baskets / (n_a * n_b), of at least ``min_lift``.

    ``items(basket, item)`` may repeat; ``owners(basket, scope)`` names the baskets that exist. Baskets of 2 to ``max_size`` different
    items count. item_a < item_b in byte order. The bounds only prune items that cannot be
    part of a result, since together <= min(n_a, n_b) means n_a, n_b >= min_together and
    baskets >= min_lift * max(n_a, n_b). Baskets meet their owners by 96 bits of hash, items and baskets of one scope are told apart by 64. An empty input gives an empty result.
    """
    basket = [F.xxhash64("basket").alias("b"), F.hash("basket").alias("c")]
    # Everything up to the owners is done in one partitioning by basket.
    of_basket = Window.partitionBy("b", "c")
    sized = (items.select(*basket, F.xxhash64("item").alias("item")).repartition("b", "c").distinct()
             .withColumns({"size": F.count("*").over(of_basket), "first": F.min("item").over(of_basket)}).where(F.col("size").between(2, max_size)))
    owned = owners.select(*basket, F.xxhash64("scope").alias("scope")).repartition("b", "c").distinct()
    rows = materialize(sized.join(owned, ["b", "c"]).select("scope", F.col("b").alias("basket"), "item", (F.col("item") == F.col("first")).alias("head")), "basket-items")
    scopes = rows.where("head").groupBy("scope").agg(F.count("*").alias("baskets"))
    known = materialize(
        rows.groupBy("scope", "item").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)
        .join(scopes, "scope").where(F.col("baskets") >= F.col("n") * min_lift)
        .withColumn("heavy", F.col("n") >= F.greatest(F.lit(HEAVY_LEAST), F.ceil(F.col("baskets") / HEAVY_SHARE))), "items")
    block = F.pmod(F.xxhash64("basket", F.lit(1)), F.ceil(F.col("baskets") / BLOCK))
    counted = (
        rows.join(known.select("scope", "item", "heavy", "baskets"), ["scope", "item"]).select("scope", block.alias("block"), "basket", "item", "heavy")
        .groupBy("scope", "block").applyInPandas(_block_counts, "scope long, lo long, hi long, n long")
        .groupBy("scope", "lo", "hi").agg(F.sum("n").alias("together")).where(F.col("together") >= min_together))
    end = lambda x, *more: known.select("scope", F.col("item").alias(x), F.col("n").alias(f"n_{x}"), *more)
    pairs = materialize(
        counted.join(end("lo", "baskets"), ["scope", "lo"]).join(end("hi"), ["scope", "hi"])
        .where(F.col("together") * F.col("baskets") >= F.col("n_lo") * F.col("n_hi") * min_lift), "pairs")
    wanted = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    names = materialize(items.select(F.xxhash64("item").alias("id"), "item").join(wanted, "id", "left_semi").distinct(), "names")
    of_scope = owners.select(F.xxhash64("scope").alias("scope"), F.col("scope").alias("name")).distinct()
    name = lambda x: names.select(F.col("id").alias(x), F.col("item").alias(f"item_{x}"))
    named = pairs.join(name("lo"), "lo").join(name("hi"), "hi").join(of_scope, "scope")
    flip = F.col("item_lo") > F.col("item_hi")
    two = lambda x, a, b: F.when(flip, F.col(f"{x}_{b}")).otherwise(F.col(f"{x}_{a}"))
    return named.select(
        F.col("name").alias("scope"), two("item", "lo", "hi").alias("item_a"), two("item", "hi", "lo").alias("item_b"), "together",
        two("n", "lo", "hi").alias("n_a"), two("n", "hi", "lo").alias("n_b"), "baskets",
        (F.col("together") * F.col("baskets") / (F.col("n_lo") * F.col("n_hi"))).alias("lift"))


def change_coupling(commit_files: DataFrame, commits: DataFrame, **options) -> DataFrame:
    """Files of a project that change together: (project, file_a, file_b, co_changes, changes_a, changes_b, baskets, lift)."""
    items, owners = commit_baskets(commit_files, commits)
    return pair_counts(items, owners, **options).select(
        F.col("scope").alias("project"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("together").alias("co_changes"),
        F.col("n_a").alias("changes_a"), F.col("n_b").alias("changes_b"), "baskets", "lift")
