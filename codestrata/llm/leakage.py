"""Evaluation texts leaking into training text: a prefix-filtered set join over word shingles.

A document holds a passage of an item if both share ``run`` consecutive words. Every such window of an item consists
of ``run - width + 1`` shingles of ``width`` words, and a document with the window has them all. So it is enough to
look for one of them: the rarest in the corpus, the window's prefix in the global order by rarity. Documents are
joined on these prefix shingles; a hit fixes where the item would have to lie in the document, the positions bound how
far the match can reach, and the words themselves are then compared, over windows no longer than the item.

Only hits of item shingles leave the corpus, and only texts with a prefix hit are looked at again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from codestrata.tables import materialize, spread

INDEX_SHINGLES = 500_000  # shingles of items, counted, up to which the items are sent to the executors: some 50 MB there
FILTER_BITS = 1 << 28  # of the filter that stands for larger item sets, 32 MB whatever their number
FILTER_PARTS = 512
HOT_HITS = 100_000  # hits of one prefix shingle that are joined together
PLACES = 200  # places of items that are checked at once in one text

_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, after NFKC, in lower case, without format characters. Null gives none."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = _FORMAT.sub("", unicodedata.normalize("NFKC", _FORMAT.sub("", text))).lower()
    return _WORD.findall(unicodedata.normalize("NFKC", text))


class _Codes(dict):
    """A 64-bit number for each word, kept for the next time; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each ``width`` consecutive words; hits are verified on the words."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out.view(np.int64)


def _shingles(rows: Iterator[pd.DataFrame], key: str, width: int, least: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pd.DataFrame]:
    """(key, pos, shingle) of texts with at least ``least`` words; with ``known`` only of the shingles it says may be known."""
    for batch in rows:
        keys, pos, out = [], [], []
        for k, text in zip(batch[key], batch["text"]):
            found = words(text)
            if len(found) < least:
                continue
            h = shingle_hashes(word_hashes(found), width)
            at = np.arange(len(h), dtype=np.int32) if known is None else np.flatnonzero(known(h)).astype(np.int32)
            if len(at):
                keys.append(np.full(len(at), k))
                pos.append(at)
                out.append(h[at])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        yield pd.DataFrame({key: cat(keys, np.int64), "pos": cat(pos, np.int32), "shingle": cat(out, np.int64)})


def _among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


def _bits(h: np.ndarray) -> list[np.ndarray]:
    """Three places in the filter for each shingle."""
    u = h.view(np.uint64)
    with np.errstate(over="ignore"):
        return [((u * np.uint64(m)) >> np.uint64(20)) % np.uint64(FILTER_BITS) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _in_filter(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(held[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 for b in _bits(h)]).astype(bool)


def _filter(item_shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of all item shingles, of fixed size: partitions set their bits, parts of it are joined by OR."""
    size = FILTER_BITS // 8 // FILTER_PARTS

    def fill(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in rows:
            for at in _bits(b["shingle"].to_numpy()):
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        parts = held.reshape(FILTER_PARTS, size)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"part": some, "bits": [parts[n].tobytes() for n in some]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        for b in rows["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [out.tobytes()]})

    held = np.zeros((FILTER_PARTS, size), np.uint8)
    got = item_shingles.select("shingle").mapInPandas(fill, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary")
    for r in got.toLocalIterator():  # FILTER_PARTS rows at most
        held[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return held.reshape(-1)


class _Index:
    """The items' words, and for each prefix shingle the places (item, position) where it stands."""

    def __init__(self, items: pd.DataFrame, places: pd.DataFrame):
        self.texts, self.ids = [words(t) for t in items["text"]], items["item_id"].to_numpy()
        nth = pd.Series(np.arange(len(items)), index=items["item_id"])
        places = places.sort_values("shingle", kind="stable")
        self.keys, self.starts = np.unique(places["shingle"].to_numpy(), return_index=True)
        self.ends = np.append(self.starts[1:], len(places))
        self.item, self.pos = nth.loc[places["item_id"]].to_numpy(), places["pos"].to_numpy()


def _verify(doc: list[str], item: list[str], at: int, pos: int, width: int, run: int) -> bool:
    """Whether the run of equal words around doc[at:] and item[pos:] is at least ``run`` long."""
    back = 0
    while back < min(at, pos) and doc[at - back - 1] == item[pos - back - 1]:
        back += 1
    n, most = 0, min(len(doc) - at, len(item) - pos)
    if back + most < run:  # positional bound
        return False
    while n < most and doc[at + n] == item[pos + n]:
        n += 1
        if back + n >= run:
            return n >= width
    return False


def _match(rows: Iterator[pd.DataFrame], index: _Index, key: str, width: int, run: int) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out_doc, out_item = [], []
        for k, text in zip(batch[key], batch["text"]):
            found = words(text)
            if len(found) < run:
                continue
            h = shingle_hashes(word_hashes(found), width)
            slot = np.searchsorted(index.keys, h)
            slot[slot == len(index.keys)] = 0
            sure: set[int] = set()
            for at in np.flatnonzero(index.keys[slot] == h):
                for place in range(index.starts[slot[at]], index.ends[slot[at]]):
                    i = int(index.item[place])
                    if i not in sure and _verify(found, index.texts[i], int(at), int(index.pos[place]), width, run):
                        sure.add(i)
            for i in sure:
                out_doc.append(k)
                out_item.append(index.ids[i])
        yield pd.DataFrame({key: np.array(out_doc, np.int64), "item_id": np.array(out_item, np.int64)})


def _prefix_places(item_shingles: DataFrame, counts: DataFrame, width: int, run: int) -> DataFrame:
    """(item_id, pos, shingle): of each window of ``run`` words the shingle that is rarest in the corpus, at every place it has in the items."""
    of_item = Window.partitionBy("item_id")
    ranked = item_shingles.join(counts, "shingle", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)), "shingle"))
    prefix = (ranked.withColumn("least", F.min("rank").over(of_item.orderBy("pos").rowsBetween(0, run - width))).withColumn("end", F.max("pos").over(of_item))
              .where(F.col("pos") + (run - width) <= F.col("end")).select(F.col("least.shingle").alias("shingle")).distinct())
    return item_shingles.join(prefix, "shingle", "left_semi")


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, width: int = 5, index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """(doc_id, item_id) of each document and item with at least ``run`` consecutive words in common.

    Null, empty and shorter texts share nothing. Rows with equal texts each get their matches; a repeated row
    counts once, and so does an id with several texts, whose words don't run on from one to the next. Items of up to ``index_shingles`` shingles, counted first, are indexed and
    sent to the executors. Of a larger set, say of a whole benchmark collection, a filter of fixed size is sent, and hits are joined by a shuffle. Both ways give the same rows.
    """
    spark = documents.sparkSession
    numbered = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    items = materialize(numbered.withColumn("of", F.col("item_id")).withColumn("item_id", F.xxhash64("of", "text")), "items")
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    shingles = lambda df, key, known=None: df.mapInPandas(lambda rows: _shingles(rows, key, width, run, known), f"{key} long, pos int, shingle long")
    item_shingles = materialize(shingles(items.select("item_id", "text"), "item_id"), "item-shingles")
    size = item_shingles.count()
    if not size:
        return spark.createDataFrame([], "doc_id long, item_id long")
    small = size <= index_shingles
    known = np.unique(item_shingles.select("shingle").toPandas()["shingle"].to_numpy()) if small else _filter(item_shingles)  # its size was counted, or is fixed
    test = _among if small else _in_filter
    sent = spark.sparkContext.broadcast(known)
    hits = shingles(spread(docs), "doc_id", lambda h: test(sent.value, h))
    hits = materialize(hits if small else hits.join(item_shingles.select("shingle").distinct(), "shingle", "left_semi"), "hits")
    places = _prefix_places(item_shingles, hits.groupBy("shingle").agg(F.count("*").alias("n")), width, run)
    if not small:
        found = _match_by_shuffle(docs, items, hits, materialize(places, "places"), width, run)
    else:
        held = places.toPandas()
        index = spark.sparkContext.broadcast(_Index(items.select("item_id", "text").toPandas(), held))
        prefixes = F.broadcast(spark.createDataFrame(pd.DataFrame({"shingle": np.unique(held["shingle"])})))  # index_shingles rows at most
        at = materialize(hits.join(prefixes, "shingle", "left_semi").select("doc_id").distinct(), "candidates")  # of known size, so that few of them move no text
        found = docs.join(at, "doc_id", "left_semi").mapInPandas(lambda rows: _match(rows, index.value, "doc_id", width, run), "doc_id long, item_id long")
    return found.distinct().join(items.select("item_id", "of").distinct(), "item_id").select("doc_id", F.col("of").alias("item_id")).distinct()


def _holds(doc: list[str], item: list[str], shift: int, run: int) -> bool:
    """Whether ``run`` consecutive words are equal where the item's first word would stand at ``shift`` in the document."""
    n = 0
    for at in range(max(0, shift), min(len(doc), shift + len(item))):
        n = n + 1 if doc[at] == item[at - shift] else 0
        if n >= run:
            return True
    return False


def _check(rows: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    for b in rows:
        out = []
        for k, text, placed in zip(b["doc_id"], b["text"], b["placed"]):
            doc, split = words(text), {}
            for p in placed:
                item = split.setdefault(p["item_id"], words(p["item_text"]) if p["item_id"] not in split else None)
                if _holds(doc, item, p["shift"], run):
                    out.append((k, p["item_id"]))
        yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")


def _match_by_shuffle(docs: DataFrame, items: DataFrame, hits: DataFrame, places: DataFrame, width: int, run: int) -> DataFrame:
    """Hits and places joined on the shingle, a hot one in parts; each (document, item, shift) is then checked once, some ``PLACES`` of them with a text."""
    hits = hits.join(places.select("shingle").distinct(), "shingle", "left_semi")
    hot = hits.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > HOT_HITS).select("shingle", F.ceil(F.col("n") / HOT_HITS).cast("int").alias("parts"))
    left = hits.join(hot, "shingle", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("parts", F.lit(1))).cast("int")).select("shingle", "part", "doc_id", F.col("pos").alias("at"))
    right = places.join(hot, "shingle", "left").select("shingle", "item_id", "pos", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    shifts = materialize(left.join(right, ["shingle", "part"]).select("doc_id", "item_id", (F.col("at") - F.col("pos")).alias("shift")).distinct(), "shifts")
    groups = shifts.groupBy("doc_id").agg(F.ceil(F.count("*") / PLACES).alias("groups"))
    placed = (shifts.join(groups, "doc_id").withColumn("nth", F.pmod(F.xxhash64("item_id", "shift"), F.col("groups")))
              .join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
              .groupBy("doc_id", "nth").agg(F.collect_list(F.struct("item_id", "shift", "item_text")).alias("placed")))
    return placed.join(docs, "doc_id").select("doc_id", "text", "placed").mapInPandas(lambda rows: _check(rows, run), "doc_id long, item_id long")
