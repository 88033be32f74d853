"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components.

*Fingerprint.* A-Z are lower-cased, words are runs of anything but ASCII white
space, shingles are three words joined by a space (repeats included; with fewer
words the whole sequence, with none nothing). Each is hashed with XXH64, seed 42;
a bit of the fingerprint is 1 if it is 1 in over half the hashes. A text without
words has fingerprint zero.

*Candidates.* Only distinct fingerprints are compared. They are cut into five
blocks; two that differ in at most three bits agree on at least two blocks, so each
is dealt to the ten pairs of blocks. A pair of blocks with more than ``CROWD``
fingerprints is cut again: its other 38 or 39 bits into six blocks, of which two
close fingerprints share at least three. What then shares a key has at most 20 free
bits, so no group is larger than 2^20 however large the input.

*Check.* Small groups report all their links, larger ones a spanning forest of
them, found by searching outwards from each fingerprint (or, in the largest, by
looking up all changes of up to three free bits). So links grow with the
fingerprints, not with their pairs, and none between components is lost.

*Components.* Links between fingerprints are joined up by ``components``; a
component's id is the smallest doc_id in it.

Defined cases: a null text is the empty text; null ids never are the smallest,
and a component of null ids only has a null id; repeated rows keep a row each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import checkpointed, ship, text_or_empty
from quarrystone.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE, DISTANCE = 3, 3
#: (first bit, bits) of the five blocks
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
CROWD = 2048
#: groups up to this size report all links
FEW = 16
HEAVY = 1000
PAIR = 0x0000000100000001

ship(__name__)


def shingles(text: Column) -> Column:
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), "[ \t\n\u000b\f\r]+"), lambda w: w != "")
    one = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)]))
    # the words are bound once: a lambda over them would split the text again for every shingle
    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), one))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (the fingerprint as a long), a row for each row of ``docs``."""
    hashes = F.transform(shingles(text_or_empty(F.col(text))), lambda s: F.xxhash64(s))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keys, hashes.alias("hs"))
    rows = rows.select("row", *keys, F.explode_outer("hs").alias("h"))
    sums = rows.groupBy("row", *keys).agg(F.count("h").alias("n"), *[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(PAIR))).alias(f"s{k}") for k in range(32)])
    fp = F.lit(0).cast("long")
    for k in range(64):
        ones = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(f"s{k - 32}", 32)
        bit = (1 << k) - (1 << 64 if k == 63 else 0)
        fp = fp.bitwiseOR(F.when(2 * ones > F.col("n"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, fp.alias("fp"))


def _bits(value: Column, first: int, count: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << count) - 1))


def _free_blocks(pair: tuple[int, int]) -> list[tuple[int, int]]:
    """The six small blocks of the bits outside the two."""
    out = []
    for i, (first, count) in enumerate(BLOCKS):
        if i not in pair:
            out += [(first, count // 2), (first + count // 2, count - count // 2)]
    return out


PAIRS = list(combinations(range(len(BLOCKS)), 2))
TRIPLES = list(combinations(range(6), 3))


def _keys(fp: Column) -> Column:
    return F.array(*[_bits(fp, *BLOCKS[i]) + _bits(fp, *BLOCKS[j]) * (1 << 13) + (k << 26) for k, (i, j) in enumerate(PAIRS)])


def _sub_keys(key: Column, fp: Column) -> Column:
    """For each pair of blocks, the 20 keys of three small blocks each (at most 21 bits)."""
    out = None
    for k, pair in enumerate(PAIRS):
        free = _free_blocks(pair)
        subs = F.array(*[_bits(fp, *free[a]) + _bits(fp, *free[b]) * (1 << 7) + _bits(fp, *free[c]) * (1 << 14) + ((t + 1) << 21) for t, (a, b, c) in enumerate(TRIPLES)])
        here = F.shiftright(key, 26) == k
        out = F.when(here, subs) if out is None else out.when(here, subs)
    return out


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, by search outwards."""
    left, us, vs = np.arange(1, len(fps)), [], []
    todo = [0]
    while True:
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= DISTANCE
            if near.any():
                found = left[near]
                us += [at] * len(found)
                vs += found.tolist()
                todo += found.tolist()
                left = left[~near]
        if not len(left):
            return us, vs
        todo, left = [int(left[0])], left[1:]


def _lookups(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a large group: every fingerprint's smallest neighbour by each change of up to three free bits, as links."""
    fps = np.sort(fps)
    free = [b for b in range(64) if ((np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps)) >> np.uint64(b)) & np.uint64(1)]
    root = np.arange(len(fps))

    def find(a: np.ndarray) -> np.ndarray:
        while True:
            b = root[a]
            if (b == a).all():
                return a
            root[a] = root[b]
            a = root[a]

    us, vs = [], []
    for k in range(1, DISTANCE + 1):
        for bits in combinations(free, k):
            mask = np.uint64(sum(1 << b for b in bits))
            to = fps ^ mask
            at = np.searchsorted(fps, to)
            ok = (at < len(fps)) & (to > fps)
            i = np.flatnonzero(ok)
            i = i[fps[at[i]] == to[i]]
            j = at[i]
            while len(i):  # join what this change links and is not yet joined
                a, b = find(i), find(j)
                new = a != b
                i, j, a, b = i[new], j[new], a[new], b[new]
                if not len(i):
                    break
                hi, lo = np.maximum(a, b), np.minimum(a, b)
                _, first = np.unique(hi, return_index=True)
                root[hi[first]] = lo[first]
                us.append(fps[i[first]])
                vs.append(fps[j[first]])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _links_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, sub, fp), sorted, to links (u, v); a group may go over several batches."""

    def links(key: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        size = np.diff(np.r_[start, len(fp)])
        us, vs = [], []
        group = np.repeat(np.arange(len(start)), size)
        small = size <= FEW
        active = np.flatnonzero(small[group])
        for d in range(1, FEW):  # each with its d-th successor in the group
            active = active[active + d < len(fp)]
            active = active[group[active + d] == group[active]]
            if not len(active):
                break
            near = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= DISTANCE]
            us.append(fp[near])
            vs.append(fp[near + d])
        for g in np.flatnonzero(~small):
            own = fp[start[g] : start[g] + size[g]]
            if size[g] <= CROWD:
                a, b = _forest(own)
                us.append(own[a])
                vs.append(own[b])
            else:
                a, b = _lookups(own)
                us.append(a)
                vs.append(b)
        u = np.concatenate(us) if us else np.zeros(0, np.uint64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now[2] = now[2].astype(np.int64).view(np.uint64)
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield links(*[x[:cut] for x in now])
    if held and len(held[0]):
        yield links(*held)


def links(distinct: DataFrame, fp: str = "fp", crowd: int = CROWD) -> DataFrame:
    """Links u, v that connect whatever distinct fingerprints are within three bits of each other."""
    keyed = distinct.select(F.col(fp).alias("fp")).withColumn("key", F.explode(_keys(F.col("fp"))))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    counted = keyed.join(counts, "key")
    subs = F.when(F.col("n") <= crowd, F.array(F.lit(0).cast("long"))).otherwise(_sub_keys(F.col("key"), F.col("fp")))
    dealt = counted.select("key", "fp", F.explode(subs).alias("sub")).select("key", "sub", "fp")
    spread = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return spread.mapInArrow(_links_of_groups, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    Fingerprints that more than one in ``HEAVY`` rows have are fewer than ``HEAVY``: they are joined back by a broadcast, all others by a shuffle.
    """
    prints = checkpointed(fingerprints(docs, ["doc_id"], text))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(groups))
    linked = roots.join(groups, roots["node"] == groups["fp"]).select("node", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select("node", "component_id")
    of = checkpointed(groups.join(named, groups["fp"] == named["node"], "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    heavy = F.col("n") * HEAVY > prints.count()
    known = prints.join(F.broadcast(of.where(heavy).select(F.col("fp").alias("h"), F.col("component_id").alias("c"))), F.col("fp") == F.col("h"), "left")
    rest = known.where(F.col("h").isNull()).select("doc_id", "fp").join(of.where(~heavy), "fp").select("doc_id", "fp", "component_id")
    every = known.where(F.col("h").isNotNull()).select("doc_id", "fp", F.col("c").alias("component_id")).unionByName(rest)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
