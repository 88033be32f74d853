"""WARC records and a Merkle audit of their fixity.

``records`` writes pages as WARC/1.0 resource records: per archive file in order
of page_id, each with its offset and length. ``tree`` hashes them: a leaf is the
SHA-256 of a record with its place in the order, a node that of its up to ``FANOUT`` children in
order, each with the range of offsets that it covers, counted from the node's own start; the top node of an archive
is its root. ``audit`` compares two replicas: roots first, then only the
children of nodes that differ, down to records.

An archive holds the page_ids of one range of ``ARCHIVE`` numbers, and a record's
place in the tree is its page_id's place in that range. So every group is bounded (an
archive has ``ARCHIVE`` places, a node ``FANOUT`` children), no archive depends on the
amount of data, and a missing record changes one path of the tree, not all that follow.
Nodes cover the same numbers in both replicas. Ranges start at their node, so a record that is lost
shifts its siblings' ranges, which stand in nodes that differ anyway, and no others; offsets in the file are reported.
Where page_ids lie far apart, an archive holds few records and the descent saves little.

A record has the mandatory headers: its date is a parameter, for pages have none, and its id is made of
page_id, url and content, so rows that repeat all three are copies of one record. Of records that share a place, the place is told to differ, not which one.

Defined cases: null urls and contents are empty; rows that repeat a page_id share
a place, in order of their hashes, and each counts (a replica with one copy less is
reported as ``changed``); rows with a null page_id are put into archives below 0 and placed by their hash; a
record that one replica lacks is ``missing`` or ``extra``; identical replicas, and
empty ones, give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import checkpointed, text_or_empty

FANOUT, LEVELS = 16, 3
#: places of an archive
ARCHIVE = FANOUT**LEVELS
DATE = "1970-01-01T00:00:00Z"


def record(url: Column, content: Column, page_id: Column | None = None, date: str = DATE) -> Column:
    """The record as a string: header lines, an empty line, the content and the two line ends after it."""
    url, content = text_or_empty(url), text_or_empty(content)
    own = F.sha2(F.concat_ws("\n", F.coalesce((F.lit(None) if page_id is None else page_id).cast("string"), F.lit("")), url, content), 256)
    uuid = F.concat_ws("-", *[F.substring(own, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, content: str = "html") -> DataFrame:
    """page_id, archive, place, length, digest; contents are hashed where they are read and not kept."""
    r = record(F.col("url"), F.col(content), F.col("page_id").cast("long"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(r).cast("long").alias("length"), F.sha2(r, 256).alias("digest"))
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE).cast("long"), -1 - F.conv(F.substring("digest", 4, 6), 16, 10).cast("long"))
    place = F.coalesce(F.pmod("page_id", F.lit(ARCHIVE)), F.conv(F.substring("digest", 1, 3), 16, 10).cast("long") % ARCHIVE)
    return rows.withColumn("archive", archive).withColumn("place", place)


def records(pages: DataFrame, content: str = "html") -> DataFrame:
    """The records with archive, offset and length, ready to be written one archive after the other."""
    order = Window.partitionBy("archive").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return leaves(pages, content).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def _node(children: Column) -> Column:
    """SHA-256 over children (structs place, hash, length) in order, each with its range of offsets in the node."""

    def step(a: Column, c: Column) -> Column:
        end = a["at"] + c["length"]
        return F.struct(end.alias("at"), F.concat(a["said"], F.concat_ws(":", c["place"].cast("string"), c["hash"], a["at"].cast("string"), end.cast("string")), F.lit(",")).alias("said"))

    return F.sha2(F.aggregate(F.array_sort(children), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("said")), step)["said"], 256)


def places(leaf: DataFrame) -> DataFrame:
    """Level 0: archive, place, hash, length, n (records). Copies of a record are counted before they meet."""
    copies = leaf.groupBy("archive", "place", "digest", "length").agg(F.count(F.lit(1)).alias("n"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("digest", "length", "n"))), lambda c: F.concat_ws(":", c["digest"], c["length"].cast("string"), c["n"].cast("string")))
    return copies.groupBy("archive", "place").agg(F.sha2(F.array_join(own, ","), 256).alias("hash"), F.sum(F.col("length") * F.col("n")).alias("length"), F.sum("n").alias("n"))


def tree(level: DataFrame) -> list[DataFrame]:
    """Levels from the places up to the roots, each with archive, place, hash, length, n."""
    levels = [level]
    for _ in range(LEVELS):
        up = level.select("archive", F.floor(F.col("place") / FANOUT).alias("up"), F.struct("place", "hash", "length").alias("child"), "length", "n")
        level = up.groupBy("archive", F.col("up").alias("place")).agg(_node(F.collect_list("child")).alias("hash"), F.sum("length").alias("length"), F.sum("n").alias("n"))
        levels.append(level)
    return levels


def audit(replica_a: DataFrame, replica_b: DataFrame, content: str = "html") -> DataFrame:
    """archive, page_id, offset and length in replica A, status: a row for each place whose records differ.

    The leaves are reduced to places once and checkpointed: from then on only hashes are
    handled. Trees are grown over them, and from the roots down the children of differing
    nodes only are joined and compared.
    """
    sides = [checkpointed(places(leaves(r, content))) for r in (replica_a, replica_b)]
    a, b = tree(sides[0]), tree(sides[1])
    found: DataFrame | None = None
    for level in range(LEVELS, -1, -1):
        x, y = (t[level].select("archive", "place", F.col("hash").alias(h)) for t, h in ((a, "hash_a"), (b, "hash_b")))
        if found is not None:
            keep = found.select("archive", F.col("place").alias("parent"))
            x, y = (s.withColumn("parent", F.floor(F.col("place") / FANOUT)).join(keep, ["archive", "parent"], "left_semi").drop("parent") for s in (x, y))
        found = checkpointed(x.join(y, ["archive", "place"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    found = found.select("archive", "place", status.alias("status"))
    # offsets of the differing places, from the archives that hold them only
    order = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = sides[0].join(found.select("archive").distinct(), "archive", "left_semi").select("archive", "place", "length", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    page = F.when(F.col("archive") >= 0, F.col("archive") * ARCHIVE + F.col("place"))
    return found.join(at, ["archive", "place"], "left").select("archive", page.alias("page_id"), "offset", "length", "status")
