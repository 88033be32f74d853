"""Near-duplicates by SimHash: shingles of five words, Jaccard at least 0.8.

*Sets.* Words are those of ``bytewords``; a text's set holds the hashes of its runs
of five words (with fewer words, of the whole sequence). Texts of one set are one
node, so exact copies never meet each other. A text without words is like its
exact copies only, and a set of under four hashes like itself only.

*Fingerprint.* A bit is 1 if it is 1 in over half of the set's hashes, each of them mixed anew
for every word of 64 bits. Two sets at 0.8 differ in about 0.151 of the bits or fewer (small sets in up
to 0.156, four hashes within five in 0.188), so 64 bits cut into blocks that some such pair
is sure to share would not tell texts apart: the fingerprint has 960 bits for blocks and 256 for a first check.

*Candidates.* The 960 bits are cut into 80 blocks of twelve; each block and its place are a key. A pair at 0.8
shares none with a chance of about 6 in 10^6, at 0.85 of 4 in 10^8; that is what can be missed. Sets of up to
``SMALL`` hashes have twice the blocks. Comparing the sets of a key takes time that grows with the square of the sets: of n sets
a pair meets by chance in one of 4,096 times, for each block.

*Hamming check.* Sets that share a key and differ in at most ``DISTANCE`` of the other 256 bits, then in at most
``WHOLE`` of all 1,216, are candidates (``LOOSE`` and ``WHOLE_LOOSE`` between small sets, which have 2,176 bits). The limits lie
five standard deviations above what sets at 0.8 differ in (4.7 at 0.156): each fails under 3 in 10^6 of them.

*Exact check.* On the sets. One with at most 2 ``few`` candidates, in all its keys together, makes a pair with each, so
pairs grow with the sets and not with the square of a group. Between two sets that have more there are no pairs: such sets that
candidates connect are a cluster, and a spanning forest of its links is found by searching outwards from each set, candidates or not. More than
``crowd`` of them are dealt to all pairs of their blocks: nothing is dropped, but that work grows with the square of the blocks.

*Components.* Links are joined up by ``components``; a group keeps its least row, by
id (rows without one last), then by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import bytewords
from quarrystone.llm.common import checkpointed, ship, text_or_empty
from quarrystone.llm.components import components

WORDS = 5
#: sets of fewer hashes have no like but themselves; sets of up to SMALL hashes have further blocks
LEAST, SMALL = 4, 7
#: words of 64 bits: for the Hamming check, and for the blocks
CHECK, WIDTH = 4, 15
BITS = 12
BLOCKS = 64 * WIDTH // BITS
DISTANCE, LOOSE = 67, 80
WHOLE, WHOLE_LOOSE = 250, 500
FEW, CROWD = 8, 2048
#: groups up to this size are compared together; of larger ones so many pairs at a time
NARROW, ROUND = 256, 1 << 17
_ODD = bytewords.mix(np.arange(1, CHECK + 2 * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: columns of the words of the first Hamming check
CHECKED = [f"w{i}" for i in range(CHECK)]
_ONES = np.uint64(0x0101010101010101)

ship(__name__)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, hashes, bounds): the distinct hashes of text first + i, sorted, lie from bounds[i] to bounds[i + 1]."""
    for first, last, bounds, (words,) in bytewords.words(texts):
        hashes, owner = bytewords.shingle_hashes(words, bounds, WORDS)
        sizes = np.diff(bounds)
        for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
            h, _ = bytewords.shingle_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, sizes[i]]), int(sizes[i]))
            hashes, owner = np.r_[hashes, h], np.r_[owner, [i]]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
            hashes, owner = hashes[new], owner[new]
        yield first, hashes, np.searchsorted(owner, np.arange(last - first + 1))


def _set_keys(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return bytewords.mix(np.add.reduceat(bytewords.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + sizes.astype(np.uint64))


def _prints(hashes: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """SimHash fingerprints, a word of 64 bits for each of ``odd``, of sets that lie in ``hashes`` one behind the other."""
    # bits are counted in bytes, so by 255 hashes at most
    parts = -(-sizes // 255)
    first = np.r_[0, np.cumsum(parts)[:-1]]
    starts = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]] - 255 * first, parts) + 255 * np.arange(parts.sum())
    out = np.empty((len(sizes), len(odd)), dtype=np.uint64)
    counts = np.empty((len(starts), 8), dtype=np.uint64)
    for w, o in enumerate(odd):
        h = bytewords.mix(hashes * o)
        for k in range(8):
            counts[:, k] = np.add.reduceat((h >> np.uint64(k)) & _ONES, starts)
        ones = counts.view(np.uint8).reshape(-1, 8, 8)  # byte j of count k is of bit k + 8 j
        if len(starts) > len(sizes):
            ones = np.add.reduceat(ones.astype(np.int32), first, axis=0)
        most = ones > (sizes // 2)[:, None, None]
        out[:, w] = np.packbits(most.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 8).view(np.uint64)[:, 0]
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text) to (id, th, s, print); the fingerprint of a set that can have no like is empty."""
    for batch in batches:
        s = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
        lengths, flat = np.zeros(len(s), dtype=np.int64), []
        for first, hashes, bounds in _sets(batch.column(2)):
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            at, sizes = first + full, np.diff(bounds)[full]
            s[at] = _set_keys(hashes, bounds[full], sizes)
            prints = np.zeros((len(full), len(_ODD)), dtype=np.uint64)
            wide = np.where(sizes < LEAST, 0, np.where(sizes <= SMALL, len(_ODD), CHECK + WIDTH))
            for mask, words in ((wide > 0, slice(0, CHECK + WIDTH)), (wide == len(_ODD), slice(CHECK + WIDTH, None))):
                if mask.any():
                    prints[mask, words] = _prints(hashes[np.repeat(mask, sizes)], sizes[mask], _ODD[words])
            lengths[at] = wide
            flat.append(prints[np.arange(len(_ODD)) < wide[:, None]])
        values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.view(np.int64)), lists], names=["id", "th", "s", "print"])


def _keys_of(words: np.ndarray) -> np.ndarray:
    """The keys of the blocks of ``WIDTH`` words of each of several fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    halves = (bits.reshape(len(words), BLOCKS, 2, BITS // 2) @ (1 << np.arange(BITS // 2)).astype(np.uint8)).astype(np.int32)
    return halves[:, :, 0] | halves[:, :, 1] << BITS // 2 | np.arange(BLOCKS, dtype=np.int32) << BITS


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, print) to (s, the words of the first Hamming check, keys)."""
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            prints = values[starts[own][:, None] + np.arange(length)]
            keys = [_keys_of(prints[:, i : i + WIDTH]) + (n * BLOCKS << BITS) for n, i in enumerate(range(CHECK, length, WIDTH))]
            keys = np.concatenate(keys, axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            check = [pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(CHECK)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *check, lists], names=["s", *CHECKED, "keys"])


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that it reaches over the links u-v."""
    label = np.arange(n)
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, np.r_[label[u], label[v]], np.r_[low, low])
        while (label[label] != label).any():
            label = label[label]
    return label


def _candidates(few: int):
    """A function of batches of (key, s, the words of the first Hamming check), sorted by key, to (key, u, v, n, m): pairs that pass it.

    Where a key has more than ``few`` times as many pairs as sets, it gives the sets u instead, with no v, their number n
    and in m the least set that pairs of the key connect with u.
    """

    def found(key: np.ndarray, s: np.ndarray, *signed: np.ndarray) -> pa.RecordBatch:
        words = [w.view(np.uint64) for w in signed]  # of signed numbers the bits of the magnitude would be counted

        def close(i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
            return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.uint16) for w in words) <= most

        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        group = np.repeat(np.arange(len(start)), size)
        most = np.where(key < BLOCKS << BITS, DISTANCE, LOOSE)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        active = np.flatnonzero((size <= NARROW)[group])
        for d in range(1, NARROW):  # each with its d-th successor in the group
            active = active[active + d < len(key)]
            active = active[group[active + d] == group[active]]
            if not len(active):
                break
            near = active[close(active, active + d, most[active])]
            us.append(near)
            vs.append(near + d)
        u, v = np.concatenate(us), np.concatenate(vs)
        crowded = (np.bincount(group[u], minlength=len(size)) > few * size)[group[u]]
        us, vs, ends = [u[~crowded]], [v[~crowded]], [np.unique(np.r_[u[crowded], v[crowded]])]
        label = _labels(len(key), u[crowded], v[crowded])
        for g in np.flatnonzero(size > NARROW):
            own, i, few_pairs, n = np.arange(start[g], start[g] + size[g]), 0, few * size[g], 0
            step, pairs = max(1, ROUND // int(size[g])), []
            while i < len(own) and n <= few_pairs:
                x, y = own[i : i + step, None], own[None, i:]
                x, y = np.nonzero(close(x, y, most[own[i]]) & (x < y))
                pairs.append((own[i + x], own[i + y]))
                n += len(x)
                i += step
            first, second = (np.concatenate(z) for z in zip(*pairs, strict=True))
            if n <= few_pairs:
                us.append(first)
                vs.append(second)
                continue
            # pairs are too many: only what they connect
            left = own
            while len(left):
                root, todo, left = left[0], [left[0]], left[1:]
                while todo and len(left):
                    at = todo.pop()
                    near = close(at, left, most[at])
                    label[left[near]] = root
                    todo += left[near].tolist()
                    left = left[~near]
            ends.append(own[(np.bincount(label[own] - start[g]) > 1)[label[own] - start[g]]])
        u, v, ends = np.concatenate(us), np.concatenate(vs), np.concatenate(ends)
        number = np.bincount(group[ends], minlength=len(size))[group[ends]]
        least = s.copy()
        np.minimum.at(least, label[ends], s[ends])
        none = pa.nulls(len(ends), pa.int64())
        columns = [
            pa.array(np.r_[key[u], key[ends]], pa.int32()), pa.array(np.r_[s[u], s[ends]], pa.int64()),
            pa.concat_arrays([pa.array(s[v], pa.int64()), none]), pa.array(np.r_[np.full(len(u), 2), number], pa.int32()),
            pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(least[label[ends]], pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "u", "v", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero(now[0] != now[0][-1]) if len(now[0]) else ()
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield found(*[x[:cut] for x in now])
        if held and len(held[0]):
            yield found(*held)

    return run


def _listed(few: int):
    """A function as ``_candidates``, to (s, m, vs): for each key and set its candidates, none listed if over 2 ``few`` or not known as pairs, and the least set that they connect with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _candidates(few)(batches):
            paired = found.filter(found.column("v").is_valid())
            crowded = found.filter(found.column("v").is_null())
            key, u, v = (paired.column(c).to_numpy(zero_copy_only=False) for c in ("key", "u", "v"))
            order = np.lexsort((np.r_[u, v], np.r_[key, key]))
            key, s, other = np.r_[key, key][order], np.r_[u, v][order], np.r_[v, u][order]
            new = np.r_[True, (key[1:] != key[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, dtype=bool)
            # each pair is there from either end, so its ends' numbers lie in the places order takes them from
            node = np.empty(len(s), dtype=np.int64)
            node[order] = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            degree = np.diff(np.r_[start, len(s)])
            label = _labels(len(start), node[: len(u)], node[len(u) :])
            short = degree <= 2 * few
            bounds = np.r_[0, np.cumsum(np.where(short, degree, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds, mask=np.r_[~short, False]), pa.array(other[np.repeat(short, degree)]))
            lists = pa.concat_arrays([lists, pa.nulls(len(crowded), lists.type)])
            names = pa.array(np.r_[s[start], crowded.column("u").to_numpy()])
            reps = pa.array(np.r_[s[start][label], crowded.column("m").to_numpy(zero_copy_only=False).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([names, reps, lists], names=["s", "m", "vs"])

    return run


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (s, hs), for texts with words."""
    for batch in batches:
        for _, hashes, bounds in _sets(batch.column(0)):
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                starts, sizes = bounds[full], np.diff(bounds)[full]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(hashes)].astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_keys(hashes, starts, sizes).view(np.int64)), lists], names=["s", "hs"])


def _forest(table: pa.Table) -> pa.Table:
    """A spanning forest of the links among the sets (cluster, sub, s, hs) of one cluster, or of two of its blocks."""
    table = table.combine_chunks()
    s, lists = table.column("s").to_numpy(), table.column("hs").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    us, vs, left, todo = [], [], np.arange(1, len(s)), [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        own = np.zeros(len(values), dtype=np.int64)
        own[ids[starts[at] : starts[at] + sizes[at]]] = 1
        both = np.add.reduceat(own[ids], starts)[left]
        near = 9 * both >= 4 * (sizes[left] + sizes[at])
        found = left[near]
        us += [s[at]] * len(found)
        vs += s[found].tolist()
        todo += found.tolist()
        left = left[~near]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def least_rows(rows: DataFrame, few: int = FEW, crowd: int = CROWD) -> DataFrame:
    """``id`` and ``th`` of the least row of each group of near-duplicates, of rows (id, th, text); th is a hash of the text."""
    rows = rows.select("id", "th", text_or_empty(F.col("text")).alias("text"))
    sketches = rows.mapInArrow(_sketches, "id long, th long, s long, print array<long>")
    sets = checkpointed(sketches.groupBy("s").agg(F.min(F.struct("id", "th")).alias("least"), F.first("print").alias("print")))
    keyed = sets.where(F.size("print") > 0).select("s", "print").mapInArrow(_keyed, f"s long, {', '.join(f'{c} long' for c in CHECKED)}, keys array<int>")
    spread = keyed.select(F.explode("keys").alias("key"), "s", *CHECKED).repartition("key").sortWithinPartitions("key")
    found = spread.mapInArrow(_listed(few), "s long, m long, vs array<long>").groupBy("s").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"), F.max(F.col("vs").isNull()).alias("unlisted"), F.collect_set("m").alias("ms"))
    found = checkpointed(found.select("s", "vs", "ms", (F.col("unlisted") | (F.size("vs") > 2 * few)).alias("many")))
    pairs = found.where(~F.col("many")).select("s", F.explode("vs").alias("v")).select(F.least("s", "v").alias("u"), F.greatest("s", "v").alias("v")).distinct()
    printed = pairs.join(sets.select(F.col("s").alias("u"), F.col("print").alias("a")), "u").join(sets.select(F.col("s").alias("v"), F.col("print").alias("b")), "v")
    words = F.least(F.size("a"), F.size("b"))
    bits = F.aggregate(F.zip_with(F.slice("a", 1, words), F.slice("b", 1, words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = checkpointed(printed.where(bits <= F.when(words > CHECK + WIDTH, WHOLE_LOOSE).otherwise(WHOLE)).select("u", "v"))
    dense = found.where("many")
    # a set's links all go to the least one, so that those between the m are few, whatever the number of sets
    clusters = components(dense.select(F.explode(F.array_union("ms", F.array("s"))).alias("u"), F.array_min("ms").alias("v")))
    dense = checkpointed(dense.join(clusters, dense["s"] == clusters["node"], "left").select("s", F.coalesce("root", "s").alias("cluster")))
    members = pairs.select(F.explode(F.array("u", "v")).alias("s")).unionAll(dense.select("s")).distinct()
    named = sets.join(members, "s", "left_semi").select(F.col("least.th").alias("th"))
    texts = rows.select("th", "text").join(named, "th", "left_semi").dropDuplicates(["th"])
    held = checkpointed(texts.select("text").mapInArrow(_text_sets, "s long, hs array<long>"))
    both = pairs.join(held.select(F.col("s").alias("u"), F.col("hs").alias("a")), "u").join(held.select(F.col("s").alias("v"), F.col("hs").alias("b")), "v")
    near = both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")
    dense = dense.join(dense.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
    blocks = F.ceil(F.col("n") / crowd)
    own = F.pmod(F.xxhash64("s"), blocks)
    sub = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    dealt = dense.select("cluster", "s", F.explode(sub).alias("sub"))
    forest = dealt.join(held, "s").groupBy("cluster", "sub").applyInArrow(_forest, "u long, v long")
    roots = components(near.unionAll(forest))
    named = sets.join(roots, sets["s"] == roots["node"], "left").select(F.coalesce("root", "s").alias("component"), "least")
    return named.groupBy("component").agg(F.min("least").alias("least")).select("least.*")
