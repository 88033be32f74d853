"""Benchmark decontamination by size-partitioned MinHash containment.

Items are tiny beside documents, so their Jaccard similarity says nothing; what
counts is *containment*, the part of an item's five-word shingles that a document
holds. Items are partitioned by size: partition p has those of more than 2^(p-1) and up to 2^p
distinct shingles. From each item a bottom-k MinHash sketch is kept, its k that of the partition
(``sketch_size``). An item of n shingles that a document holds to at least t lacks at most
(1 - t) n of them there, so floor((1 - t) 2^p) + 1 of its hashes can't all be missing: up to partition 6,
at 0.8, a sketch finds its item for certain. Larger partitions keep the ``SKETCH`` smallest hashes; all of those are
missing with a chance of (1 - t)^k, 7e-12 at 0.8.

*Candidates.* A table of bits over the sketch hashes, of at most 2^``MOST_BITS`` bits whatever the benchmark,
is sent to the workers. The shingle hashes of each document that pass it are joined with the sketches: a match makes
document and item a candidate pair. *Check.* The texts of candidate documents, once for each distinct text,
meet the items that may be in them, and containment is counted on the shingles themselves, as strings.

There is one path for every size. A side of a join is broadcast while its counted rows are at most
``BROADCAST_ROWS``; beyond that it is shuffled, and adaptive execution splits keys that many documents share.

An item with fewer than five words has one shingle, all its words; it is contained
where they occur in a row. Words: see ``bytewords`` (case and punctuation do not
count). Defined cases: a null text is empty; items without words are never found;
an item that repeats a shingle counts it once; rows that repeat a doc_id or an
item_id are each compared; ties do not arise, for every item at or above the
threshold is reported; further columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bytewords import shingle_hashes, text_words, words
from quarrystone.llm.common import checkpointed, ship, text_or_empty

ship(__name__)

SHINGLE, THRESHOLD, SKETCH = 5, 0.8, 16
#: rows of a side that is broadcast: hashes, keys of texts
BROADCAST_ROWS = 1 << 20
#: characters of all items together, for broadcasting them
BROADCAST_CHARS = 16 << 20
#: the table of bits: at least, and at most
LEAST_BITS, MOST_BITS = 20, 27
#: items that one copy of a text is checked against
LIST = 64


def sketch_size(p: int, threshold: float) -> int:
    """Hashes kept of an item in partition p."""
    return min(SKETCH, 2**p - math.ceil(threshold * 2**p - 1e-9) + 1)


def _sketches(threshold: float):
    """Batches of (item, text) to (item, k, part, hash): the sketch of each item with words; k is its shingles' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            hashes: list[np.ndarray] = []
            at = 0
            for _, last, bounds, (h,) in words(batch.column(1)):
                for i in range(len(bounds) - 1):
                    own = h[bounds[i] : bounds[i + 1]]
                    k = min(SHINGLE, len(own))
                    if k:
                        mine = np.unique(shingle_hashes(own, np.array([0, len(own)]), k)[0])
                        p = int(len(mine) - 1).bit_length()
                        mine = mine[: sketch_size(p, threshold)]
                        rows += [(at + i, k, p)] * len(mine)
                        hashes.append(mine)
                at = last
            at_, k_, p_ = (np.array([r[j] for r in rows], np.int64) for j in range(3))
            values = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_)), pa.array(k_), pa.array(p_), pa.array(values)], names=["item", "k", "part", "hash"])

    return run


def _bit_table(hashes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, table): the top ``bits`` bits of each hash are the place of a set bit; at most 2^(MOST_BITS - 6) longs come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 6))
    place = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
    found = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits, table.view(np.uint64)


def _probe(lengths: list[int], bits: int, shared):
    """Batches of (key, text) to (key, hash): the shingle hashes that pass the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low, six = shared.value, np.uint64(63), np.uint64(6)
        for batch in batches:
            owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, _, bounds, (h,) in words(batch.column(1)):
                for k in lengths:
                    hashes, owner = shingle_hashes(h, bounds, k)
                    place = hashes >> np.uint64(64 - bits)
                    hit = np.flatnonzero((table[(place >> six).astype(np.int64)] >> (place & low)) & np.uint64(1))
                    owners.append(owner[hit] + first)
                    found.append(hashes[hit])
            pairs = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(found)]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["key", "hash"])

    return run


def shingles_of(text: str | None, k: int | None = None) -> set[tuple[str, ...]]:
    """The distinct shingles of k words; without k those of an item: five words, or all of fewer."""
    w = text_words(text or "")
    k = min(SHINGLE, len(w)) if k is None else k
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def _check(threshold: float):
    """Batches of (key, text, items) to (key, item, item_id, containment, shingles) of the items that the text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, items in zip(*(batch.column(i) for i in range(3)), strict=True):
                held: dict[int, set] = {}
                for x in items.as_py():
                    own = shingles_of(x["text"])
                    k = len(next(iter(own)))
                    if k not in held:
                        held[k] = shingles_of(text.as_py(), k)
                    n = len(own & held[k])
                    if n >= threshold * len(own) - 1e-9:
                        out.append((key.as_py(), x["item"], x["item_id"], n / len(own), len(own)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["key", "item", "item_id", "containment", "shingles"])

    return run


def text_key(text: Column) -> Column:
    """What tells texts apart; equal texts hold the same items and are checked once."""
    return F.md5(text_or_empty(text))


def held_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """key (``text_key``), item, item_id, containment, shingles for each distinct text that holds an item; ``item`` tells rows of the benchmark apart."""
    spark = docs.sparkSession
    few = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text_or_empty(F.col("text")).alias("text"))
    items = checkpointed(numbered)
    sketches = checkpointed(items.select("item", "text").mapInArrow(_sketches(threshold), "item long, k long, part long, hash long"))
    size = sketches.agg(F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("k")).first()
    bits, table = _bit_table(sketches, size["n"])
    texts = docs.select(text_key(F.col("text")).alias("key"), text_or_empty(F.col("text")).alias("text"))
    hits = texts.mapInArrow(_probe(sorted(size["k"]), bits, spark.sparkContext.broadcast(table)), "key string, hash long")
    pairs = checkpointed(hits.join(few(sketches.select("hash", "item"), size["n"]), "hash").select("key", "item").distinct())
    counts = pairs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("lists"))
    n = counts.count()
    chars = items.agg(F.coalesce(F.sum(F.char_length("text") + 64), F.lit(0)).alias("c")).first()["c"]
    wanted = pairs.join(few(counts, n), "key").join(F.broadcast(items) if chars <= broadcast_chars else items, "item")
    lists = wanted.groupBy("key", F.pmod(F.xxhash64("item"), "lists").alias("list")).agg(F.collect_list(F.struct("item", "item_id", "text")).alias("items"))
    once = texts.join(few(counts.select("key"), n), "key", "left_semi").dropDuplicates(["key"])
    return once.join(lists, "key").select("key", "text", "items").mapInArrow(_check(threshold), "key string, item long, item_id long, containment double, shingles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """doc_id, item_id, containment, shingles of the item: a row for every item that a document holds."""
    held = checkpointed(held_items(docs, benchmark, threshold, broadcast_rows, broadcast_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    side = F.broadcast(held) if held.count() <= broadcast_rows else held
    return rows.join(side, "key").select("doc_id", "item_id", "containment", "shingles")


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = checkpointed(held_items(docs, benchmark, threshold, broadcast_rows, broadcast_chars).select(F.col("key").alias("__bad")).distinct())
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(side, text_key(docs["text"]) == side["__bad"], "left_anti")
