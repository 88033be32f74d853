"""Homomorphic multiset hash of documents (native).

A document is the multiset of its paragraphs (lines). Every paragraph is hashed
to a wide vector and the vectors are summed lane by lane modulo 2^32:

* 8 *identity* lanes are the eight words of the paragraph's SHA-256. Their sums are
  equal for equal multisets of paragraphs, and for others with a chance of about 2^-256,
  texts made to collide aside.
* 64 *likeness* lanes hold, for every three-word shingle of the paragraph, one
  bit each of the shingle's 64-bit hash. With the number of shingles they give
  a signed projection whose cosine estimates how many shingles two documents
  share.

Both parts are sums, so the order of paragraphs does not matter and a paragraph
is inserted or deleted by adding or subtracting its vector (``combine``). ``edit_likeness``
makes use of that: the paragraphs that an edit leaves alone are hashed once and count for both texts.

Defined cases: a null text is the empty text; the empty text has one empty
paragraph (split keeps it), hence a fingerprint of its own; a paragraph of
fewer than three words has one shingle, the whole sequence, and one without
words has none; equal texts have equal fingerprints whatever row they are in; rows with a null id,
and rows that repeat an id, are spread over buckets by the hash of their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import hex32, text_or_empty

IDENTITY_LANES = 8
LIKENESS_LANES = 64
#: hashes whose bits are counted in bytes: one more bit of the top byte would be the sign
CHUNK = 127
MASK = 0xFFFFFFFF
#: hex digits of the identity part, of the shingle count and of one lane
IDENTITY_HEX, LANE_HEX = 8 * IDENTITY_LANES, 8


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def digests(text: Column) -> Column:
    """SHA-256 of every paragraph, as hex digits."""
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def identity_words(hashes: Column) -> list[Column]:
    """Sums modulo 2^32 of the eight words of each digest, two to a long."""

    def lane(j: int) -> Column:
        word = lambda h: F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("long")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + word(h)).bitwiseAND(F.lit(MASK))

    return [F.shiftleft(lane(j), 32).bitwiseOR(lane(j + 1)) for j in range(0, IDENTITY_LANES, 2)]


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the three-word shingles of every paragraph, in order."""
    words = F.transform(paragraphs(text), lambda p: F.array_remove(F.split(p, "[ \t\r\f\u000b]+"), ""))
    return F.flatten(
        F.transform(
            F.filter(words, lambda w: F.size(w) > 0),
            lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        )
    )


def _packed_sums(h: Column) -> list[Column]:
    """8 sums of eight counters each, of 8 bits: byte j of sum k counts bit k + 8 j. Good for ``CHUNK`` hashes."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0101010101010101))).alias(f"p{k}") for k in range(8)]


def _summed(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``LANES``: rows whose sums by ``keys`` are the lanes of the text, one row for each ``CHUNK`` shingles."""
    # selects of their own: beside explode, digests and lanes would be evaluated again for every shingle
    own = rows.select(*keys, digests(F.col(text)).alias("__d"), shingle_hashes(F.col(text)).alias("__hs"))
    ids = [f"__i{j}" for j in range(IDENTITY_LANES // 2)]
    own = own.select(*keys, *[c.alias(n) for n, c in zip(ids, identity_words(F.col("__d")), strict=True)], "__hs").select(*keys, *ids, F.posexplode_outer("__hs").alias("__at", "__h"))
    chunk = F.coalesce(F.floor(F.col("__at") / CHUNK).cast("int"), F.lit(0))
    sums = own.groupBy(*keys, *ids, chunk.alias("__chunk")).agg(F.count("__h").alias("n"), *_packed_sums(F.col("__h"))).na.fill(0, [f"p{k}" for k in range(8)])
    # the identity belongs to the text, not to each of its chunks
    once = lambda c: F.when(F.col("__chunk") == 0, c).otherwise(F.lit(0))
    lanes = [once(x).alias(f"i{2 * j + half}") for j, i in enumerate(ids) for half, x in enumerate((F.shiftrightunsigned(i, 32), F.col(i).bitwiseAND(F.lit(MASK))))]
    two = [F.shiftrightunsigned(f"p{k % 8}", 8 * (k // 8)).bitwiseAND(F.lit(0x000000FF000000FF)).alias(f"s{k}") for k in range(32)]
    return sums.select(*keys, *lanes, "n", *two)


#: sums of a text: identity lanes, number of shingles, and likeness lanes, two to a long (bit k in the low half, bit k + 32 in the high half)
LANES = [*[f"i{j}" for j in range(IDENTITY_LANES)], "n", *[f"s{k}" for k in range(32)]]


def _prints(sums: DataFrame, keys: list[str], out: str, lanes: str) -> DataFrame:
    """``keys``, the fingerprint string and its signed lanes, of rows of ``_summed``; identity lanes modulo 2^32."""
    total = lambda c: F.sum(c).bitwiseAND(F.lit(MASK)) if c[0] == "i" else F.sum(c)
    sums = sums.groupBy(*keys).agg(*[total(c).alias(c) for c in LANES])
    packed = [F.col(f"s{k}") for k in range(32)]
    counts = F.array(*[s.bitwiseAND(F.lit(MASK)) for s in packed], *[F.shiftrightunsigned(s, 32) for s in packed])
    sums = sums.select(*keys, F.array(*[f"i{j}" for j in range(IDENTITY_LANES)], "n").alias("__own"), counts.alias("__counts"))
    fp = F.array_join(F.transform(F.concat("__own", "__counts"), hex32), "")
    return sums.select(*keys, fp.alias(out), F.transform("__counts", lambda c: (2 * c - F.get("__own", IDENTITY_LANES)).cast("double")).alias(lanes))


def fingerprints(df: DataFrame, text: str, keys: list[str], out: str = "fingerprint", lanes: str = "lanes") -> DataFrame:
    """One row per row of ``df`` with ``keys``, the fingerprint string and its signed lanes.

    ``keys`` must tell the rows apart. If ``df`` is already partitioned by some
    of the keys, no shuffle is added. The fingerprint is 64 hex digits of the
    identity lanes, 8 of the number of shingles and 8 for each likeness lane.
    A signed lane is the shingles with the lane's bit set minus those without.
    """
    return _prints(_summed(df.select(*keys, text_or_empty(F.col(text)).alias("__t")), keys, "__t"), keys, out, lanes)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union (sign 1) or difference (sign -1) of two multisets of paragraphs."""
    n = F.length(a) / LANE_HEX
    lane = lambda fp, i: F.conv(F.substring(fp, i * LANE_HEX + 1, F.lit(LANE_HEX)), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: hex32(lane(a, i) + sign * lane(b, i))), "")


def likeness(a: Column, b: Column, fp_a: Column, fp_b: Column) -> Column:
    """Cosine of two signed lane vectors, clipped to 0..1; 1 for equal fingerprints.

    ``a`` and ``b`` are the signed lanes of ``fp_a`` and ``fp_b``. 0 where either has no shingle.
    """
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when(fp_a == fp_b, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size))).otherwise(F.lit(0.0))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Columns bucket, place, doc_id, text, next_text, own: each document with the next one's text.

    The order is descending doc_id (null ids last), then text hash, then text;
    after the last document comes the first. Documents are dealt to ``buckets`` buckets by ranges of
    (doc_id, text hash), so that only neighbours meet, however many rows share an id or have none. The first
    document of each bucket is also given to the bucket before it (``own`` is
    false there), which needs it as its last document's neighbour. The bucket
    limits and these first documents number at most ``buckets``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).withColumn("hash", F.xxhash64("text"))
    limits = _limits(base, buckets)
    first = F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("order"), "hash")
    bucket = _bucket_of(limits, first)
    own = base.select(bucket.alias("bucket"), first.alias("first"), "doc_id", "text", F.lit(True).alias("own"))
    heads = {r["bucket"]: r["first"] for r in own.groupBy("bucket").agg(F.min("first").alias("first")).collect()}
    have = sorted(heads)
    if not have:
        return own.select("bucket", F.lit(0).alias("place"), "doc_id", "text", F.lit("").alias("next_text"), "own")
    before = {b: have[i - 1] for i, b in enumerate(have)}
    lent = spark.createDataFrame([(b, int(heads[b]["order"]), int(heads[b]["hash"]), before[b]) for b in have], "bucket int, o long, h long, to int")
    lent = own.join(F.broadcast(lent), "bucket").where((F.col("first.order") == F.col("o")) & (F.col("first.hash") == F.col("h")))
    # rows that repeat a head exactly would be lent more than once: one is enough
    lent = lent.dropDuplicates(["bucket", "to", "doc_id", "text"]).select(F.col("to").alias("bucket"), "first", "doc_id", "text", F.lit(False).alias("own"))
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), "first", "text")
    return own.unionByName(lent).select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"), "own")


def _limits(base: DataFrame, buckets: int) -> list[tuple]:
    """Where buckets begin, in the order of ``with_next``: (id, None), or (id, hash) inside an id (or None) that holds more rows than a bucket should.

    Ids come from approximate quantiles; an id that more than one of them names is cut by equal ranges of its text hashes.
    """
    if buckets <= 1:
        return []
    named = base.where(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    times: dict = {}
    for x in map(int, named):
        times[x] = times.get(x, 0) + 1
    ends = base.agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    if ends["nulls"]:
        times[None] = math.ceil(buckets * ends["nulls"] / ends["n"])
    out: list[tuple] = []
    for x in sorted(times, key=lambda x: (x is None, -(x or 0))):
        out.append((x, None))
        step = 2**64 // times[x]
        out += [(x, -(2**63) + j * step) for j in range(1, times[x])]
    return out


def _bucket_of(limits: list[tuple], first: Column) -> Column:
    """The number of limits at or before ``first`` (order, hash), by halving.

    The limits stand in two constant arrays: an expression that grew with them would be planned and compiled for each of them.
    """
    if not limits:
        return F.lit(0)
    longs = lambda values: F.split(F.lit(",".join(str(max(-(2**63), min(2**63 - 1, x))) for x in values)), ",").cast("array<long>")
    orders = longs(2**63 - 1 if i is None else -i for i, _ in limits)
    hashes = longs(-(2**63) if h is None else h for _, h in limits)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(limits).bit_length()))])
    limit = lambda i: F.struct(F.get(orders, i), F.get(hashes, i))
    reached = lambda i: (i < len(limits)) & (limit(i) <= first)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step - 1), at + step).otherwise(at))


def edit_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text replaces the last third (floor) by as many first characters
    of the next document. Whole paragraphs before the cut are in both texts: they are hashed once, apart from the
    rest of the text and the rest of the edited text, and the sums are added. Texts are shuffled once, by bucket; everything after
    keeps that partitioning.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, n)
    chars = F.char_length("text")
    third = F.floor(chars / 3).cast("int")
    both = rows.select("bucket", "place", "own", "doc_id", chars.cast("long").alias("n_chars"), "text", F.left(F.col("text"), chars - third).alias("head"), F.left(F.col("next_text"), third).alias("tail"))
    both = both.withColumn("edited_sha256", F.sha2(F.concat("head", "tail"), 256))
    # the kept paragraphs end with the last line end before the cut; without one there are none
    cut = F.char_length("head") - F.char_length(F.substring_index("head", "\n", -1))
    both = both.withColumn("cut", F.when(F.col("own"), cut).otherwise(F.lit(0)))
    since = lambda t: F.substring(t, F.col("cut") + 1, F.char_length(t))
    piece = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("t"))
    pieces = F.array(piece(0, since(F.col("text"))), piece(1, F.when(F.col("own"), since(F.concat("head", "tail")))), piece(2, F.when(F.col("cut") > 0, F.left(F.col("head"), F.col("cut") - 1))))
    keys = ["bucket", "place", "own", "doc_id", "n_chars", "edited_sha256"]
    each = both.select(*keys, F.explode(F.filter(pieces, lambda x: x["t"].isNotNull())).alias("x")).select(*keys, F.col("x.kind").alias("kind"), F.col("x.t").alias("t"))
    sums = _summed(each, [*keys, "kind"], "t")
    # the kept paragraphs count for both texts
    sums = sums.withColumn("kind", F.explode(F.when(F.col("kind") < 2, F.array("kind")).otherwise(F.array(F.lit(0), F.lit(1))))).where(F.col("own") | (F.col("kind") == 0))
    prints = _prints(sums, [*keys, "kind"], "fingerprint", "lanes")
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("fingerprint", "lanes")))
    one = prints.groupBy(*keys).agg(pick(0).alias("mine"), pick(1).alias("edited"))
    order = Window.partitionBy("bucket").orderBy("place")
    one = one.withColumn("next", F.lead("mine").over(order)).where("own")
    near = lambda other: likeness(F.col("mine.lanes"), F.col(f"{other}.lanes"), F.col("mine.fingerprint"), F.col(f"{other}.fingerprint"))
    return one.select("doc_id", "n_chars", "edited_sha256", F.col("mine.fingerprint").alias("fingerprint"), F.col("edited.fingerprint").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"))
