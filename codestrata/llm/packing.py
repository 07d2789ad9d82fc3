"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Only the histogram of lengths, at most ``capacity`` numbers however many texts there are, decides how containers are
filled. Lengths are placed longest first; each goes into the open pattern with the least room that still takes
it, the counts of equal patterns being updated together, so no document is looked at. The patterns are
then joined back: the k-th text of a length takes the k-th slot of that length.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codestrata.tables import materialize, spread

TOKENIZER = "byte_bpe_50k.tiktoken"
RANK_ROWS = 500_000  # pieces of one length that are ranked together


def tokenizer_file(name: str = TOKENIZER) -> str:
    """The path of a public vocabulary file that is installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern by which that vocabulary's text is split before its pairs are merged."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, tokens): the number of tokens of the whole text; 0 for a null or empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(count, "doc_id long, tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of containers, [(length, times), ...]), longest length first, by shortest-pack-first.

    A length goes into the pattern with the most room left, and into new containers if that is too little. All containers of a pattern are filled
    at once; a pattern is split only where fewer texts remain, so patterns number about as many as lengths.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    heads: list[int] = []  # the rooms in use, in order

    def put(left: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(heads, left)
        room[left].append((count, pattern))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rest = histogram[length]
        while rest:
            if not heads or heads[-1] < length:
                put(capacity, rest if 2 * length > capacity else -(-rest // (capacity // length)), [])
                continue
            left = heads[-1]
            count, pattern = room[left].pop()
            if not room[left]:
                del room[left]
                heads.pop()
            times = min(left // length, -(-rest // count))
            if heads and heads[-1] >= length:  # only as long as this one stays the shortest pack
                times = min(times, max(1, (left - heads[-1]) // length))
            used = min(count, rest // times)
            if used < count:
                put(left, count - used, pattern)
            put(left - times * length, used, [*pattern, (length, times)])
            rest -= used * times
    return [(count, pattern) for left in heads for count, pattern in room[left] if pattern]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, times, first container, offset): rank r of it stands in container
    first + (r - first rank) // times at offset + (r - first rank) % times * length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = seen.get(length, 0)
            out.setdefault(length, []).append((first, times, base, offset))
            seen[length] = first + times * count
            offset += length * times
        base += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(lengths: DataFrame, capacity: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, window_id, position): where each piece of each text stands.

    ``lengths(doc_id, tokens)`` has one row a text. A text longer than ``capacity`` is cut into full windows and a
    rest; any other text stays whole. ``start`` is the piece's first token within the text, ``position`` its first
    token within the window. A text without tokens takes no room: its window and position are null. Ties between texts of one
    length are broken by hash and id, which changes no window's content in tokens.
    """
    cut = F.when(F.col("tokens") <= capacity, F.lit(1)).otherwise(F.ceil(F.col("tokens") / capacity)).cast("int")
    pieces = (
        lengths.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), cut - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
                F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity).alias("length")))
    histogram = {r["length"]: r["n"] for r in pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # A length with many pieces is ranked in parts by hash; a part's first rank is the number of pieces in the parts before it.
    many = {n: -(-k // rank_rows) for n, k in histogram.items() if k > rank_rows}
    if many:
        hot = F.broadcast(lengths.sparkSession.createDataFrame(list(many.items()), "length long, parts long"))  # at most one row for each rank_rows pieces
        pieces = pieces.join(hot, "length", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        pieces = pieces.withColumn("part", F.lit(0))
    offsets = {n: np.zeros(1, np.int64) for n in histogram}
    if many:
        for r in pieces.where(F.col("length").isin(*many)).groupBy("length", "part").agg(F.count("*").alias("n")).collect():
            offsets[r["length"]] = offsets[r["length"]] if len(offsets[r["length"]]) > 1 else np.zeros(many[r["length"]] + 1, np.int64)
            offsets[r["length"]][r["part"] + 1] = r["n"]
        offsets = {n: np.cumsum(v) for n, v in offsets.items()}
    slots = _slots(pack_histogram(histogram, capacity))
    sent = lengths.sparkSession.sparkContext.broadcast((slots, offsets))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, offsets = sent.value
        for b in batches:
            length, part, nth = (b[c].to_numpy() for c in ("length", "part", "nth"))
            window, position = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(length, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(length[order]) != 0)) if len(b) else []
            for at, end in zip(starts, np.append(starts[1:], len(b))):
                rows = order[at:end]
                n = int(length[rows[0]])
                if n == 0:
                    continue
                rank = offsets[n][part[rows]] + nth[rows] - 1
                table = slots[n]
                k = np.searchsorted(table[:, 0], rank, side="right") - 1
                past = rank - table[k, 0]
                window[rows] = table[k, 2] + past // table[k, 1]
                position[rows] = table[k, 3] + past % table[k, 1] * n
            out = b[["doc_id", "piece", "start", "length"]].copy()
            out["window_id"] = pd.Series(window, index=b.index, dtype="Int64").where(b["length"] > 0)
            out["position"] = pd.Series(position, index=b.index, dtype="Int64").where(b["length"] > 0)
            yield out

    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")).cast("long")
    ranked = pieces.where("length > 0").withColumn("nth", nth).unionByName(pieces.where("length = 0").withColumn("nth", F.lit(0).cast("long")))
    # As text, since one null key would make pandas hold all keys of its batch as fractions.
    return ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, "doc_id string, piece int, start long, length long, window_id long, position long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(documents: DataFrame, windows: DataFrame, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """The packing of all texts for each window size: (window_name, capacity) and the columns of :func:`pack`.

    ``tokenizer`` is the path of a tiktoken vocabulary, on every machine, and ``pattern`` what it splits by; without them the public ones beside Python
    are taken. Window rows with a null name or a capacity below 1 are passed over; a repeated one counts once.
    """
    lengths = materialize(token_lengths(documents, tokenizer or tokenizer_file(), pattern or split_pattern()), "lengths")
    out = None
    for w in windows.where("window_name IS NOT NULL AND capacity > 0").distinct().orderBy("window_name").collect():
        one = pack(lengths, w["capacity"]).select(F.lit(w["window_name"]).alias("window_name"), F.lit(w["capacity"]).alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "window_name string, capacity int, doc_id long, piece int, start long, length long, window_id long, position long")
    return out


def check(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """(window_name, lost, gaps, split, overlaps, overfull, few_windows): what must hold of a packing, per window size.

    ``lost`` is the number of texts that stand nowhere, ``gaps`` counts the texts whose pieces don't follow one another or don't add up, ``overlaps`` the windows whose pieces don't stand end to end from 0, ``overfull`` those that hold more
    than their capacity, ``split`` the pieced texts that a window would have held. ``few_windows`` tells that there are at most 1 % more windows than tokens need.
    """
    by = ["window_name", "capacity"]
    held = packed.where("window_id IS NOT NULL")
    texts = packed.groupBy(*by, "doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("start").alias("first"), F.count("*").alias("pieces"), F.countDistinct("start").alias("starts"))
    text = texts.groupBy(*by).agg(F.count("*").alias("texts"), F.count(F.when((F.col("n") != F.col("end")) | (F.col("first") != 0) | (F.col("pieces") != F.col("starts")), 1)).alias("gaps"),
                                  F.count(F.when((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity")), 1)).alias("split"))
    rooms = held.groupBy(*by, "window_id").agg(F.sum("length").alias("n"), F.max(F.col("position") + F.col("length")).alias("end"), F.min("position").alias("first"), F.count("*").alias("pieces"), F.countDistinct("position").alias("starts"))
    room = rooms.groupBy(*by).agg(F.count(F.when((F.col("n") != F.col("end")) | (F.col("first") != 0) | (F.col("pieces") != F.col("starts")), 1)).alias("overlaps"), F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("overfull"),
                                  (F.count("*") <= F.ceil(F.sum("n") / F.first("capacity")) * 1.01 + 1).alias("few_windows"))
    known = documents.select("doc_id").distinct().count()
    return text.join(room, by, "left").select("window_name", (F.lit(known) - F.col("texts")).alias("lost"), "gaps", "split", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("overfull", F.lit(0)).alias("overfull"), F.coalesce("few_windows", F.lit(True)).alias("few_windows"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per window size: containers used, tokens held and the share of unused room."""
    return (
        packed.where("window_id IS NOT NULL").groupBy("window_name", "capacity")
        .agg((F.max("window_id") + 1).alias("windows"), F.sum("length").alias("tokens"))
        .withColumn("unused_share", 1 - F.col("tokens") / (F.col("windows") * F.col("capacity"))))
