"""Relevance search (BM25) over chunks of text with boosted terms.

A *chunk* has text, headings and boost terms (titles, aliases, tags). Its term counts are
those of text and headings plus ``boost_weight`` for each boosted token.

One query needs no index: one pass over the chunks stores their lengths and the counts of the
query's terms only; from these come the number of chunks, their mean length and how many hold each term
(one row, whatever the corpus), and then every score. No text is shuffled. Many queries go the same way: a chunk's counts of the
queries' terms are stored, and each partition scores its own chunks against all queries and passes on what may be among the k best. Where a corpus is
asked again and again, ``write_index`` keeps its postings by term and ``search_index`` reads those of a query's terms.
Terms are counted where their row is (``_tally``), so counting shuffles nothing.

Filters are applied to the chunks before either, so statistics are those of what is searched.
Scores that differ in the tenth decimal at most count as equal, and go by the id columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.text import query_tokens, tokens
from quarrystone.session import checkpointed, ship, stored

# Fixed values of the ranking.
K1, B = 1.5, 0.75
TOP = 8
ALIAS_BOOST = 2.5
#: terms of all queries (each query's distinct ones) that every worker may hold
BROADCAST_TERMS = 200_000
#: cells of a worker's table of counts, terms by chunks
CELLS = 2_000_000
#: rows that a worker counts at once
SLICE = 1000
#: folders of a written index, and files in each
BUCKETS, PARTS = 256, 8

ship(__name__)


def boost_weight(boost: float) -> int:
    """The whole number nearest, the even one of two; 1 at least."""
    return max(1, round(boost))


def prefiltered(chunks: DataFrame, path: list[str] | None = None, tag: list[str] | None = None, path_column: str = "path", tags_column: str = "tags") -> DataFrame:
    """Chunks whose path holds one of the texts and which have one of the tags, in any case."""
    if path:
        hit = F.lit(False)
        for p in path:
            hit = hit | F.contains(F.lower(path_column), F.lit(p.lower()))
        chunks = chunks.where(hit)
    if tag:
        chunks = chunks.where(F.arrays_overlap(F.transform(F.coalesce(tags_column, F.array().cast("array<string>")), lambda t: F.lower(t)), F.array(*[F.lit(t.lower()) for t in tag])))
    return chunks


def chunk_tokens(text: str = "text", headings: str | None = None) -> Column:
    return tokens(F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), *([F.coalesce(F.col(headings), F.lit(""))] if headings else [])))


def boost_tokens(boost: str) -> Column:
    return tokens(F.array_join(F.coalesce(F.col(boost), F.array().cast("array<string>")), " "))


def _counts(chunks: DataFrame, text: str, headings: str | None, boost: str | None, weight: int) -> DataFrame:
    """Adds __body, __boost (token arrays) and __dl (length)."""
    rows = chunks.withColumn("__body", chunk_tokens(text, headings)).withColumn("__boost", boost_tokens(boost) if boost else F.array().cast("array<string>"))
    return rows.withColumn("__dl", F.size("__body") + weight * F.size("__boost"))


def term_weight(tf: Column, idf: float | Column, dl: Column, avgdl: float | Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(
    chunks: DataFrame, query: str, ids: list[str], k: int = TOP, text: str = "text", headings: str | None = None, boost: str | None = None, alias_boost: float = ALIAS_BOOST, keep: list[str] | None = None
) -> DataFrame:
    """The best ``k`` chunks with a positive score: rank, score (4 decimals), ``ids`` and ``keep`` columns.

    A query term counts as often as it is repeated; terms that no chunk has are dropped.
    """
    w = boost_weight(alias_boost)
    asked = query_tokens(query)
    terms = sorted(set(asked))
    rows = _counts(chunks, text, headings, boost, w)
    # of each chunk only the tokens that are asked for are kept: one pass over them, however many terms
    only = lambda c: F.filter(c, lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")
    rows = rows.withColumns({"__body": only("__body"), "__boost": only("__boost")})
    tf = lambda t: F.size(F.filter("__body", lambda x: x == t)) + w * F.size(F.filter("__boost", lambda x: x == t))
    more = [c for c in keep or [] if c not in ids]
    hit = (F.size("__body") > 0) | (F.size("__boost") > 0)
    rows = stored(rows.select(*ids, "__dl", F.array(*[tf(t) for t in terms]).cast("array<int>").alias("__tf"), *[F.when(hit, F.col(c)).alias(c) for c in more]))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__dl"), F.lit(0)).alias("total"), *[F.count_if(F.get("__tf", i) > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n = stats["n"]
    avgdl = stats["total"] / n if n else 0.0
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df = stats[f"df{i}"]
        if df:
            score = score + asked.count(t) * term_weight(F.get("__tf", i).cast("double"), math.log(1 + (n - df + 0.5) / (df + 0.5)), F.col("__dl"), avgdl)
    scored = rows.withColumn("__score", F.when(F.col("__dl") > 0, score).otherwise(0.0) if avgdl else F.lit(0.0))
    best = scored.where(F.col("__score") > 0).select(F.round("__score", 9).alias("__score"), *ids, *more).orderBy(F.desc("__score"), *ids).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("__score"), *ids))
    return best.select(rank.alias("rank"), F.round("__score", 4).alias("score"), *ids, *more)


def _postings(chunks: DataFrame, ids: list[str], text: str, headings: str | None, boost: str | None, alias_boost: float) -> DataFrame:
    """chunk (a number given to the row), ``ids``, dl, term, tf."""
    w = boost_weight(alias_boost)
    rows = _counts(chunks, text, headings, boost, w).select(F.monotonically_increasing_id().alias("chunk"), *ids, F.col("__dl").alias("dl"), "__body", "__boost")
    kept = ["chunk", *ids, "dl"]
    out = T.StructType([*[rows.schema[c] for c in kept], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(_tally(kept, w), out)


def _word_rows(b, w: int) -> Iterator[tuple]:
    """Of body and boost: their tokens in one array, the row of each, its weight."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for name, weight in (("__body", 1), ("__boost", w)):
        lists = b.column(name)
        yield lists.flatten().cast(pa.string()), np.repeat(np.arange(b.num_rows, dtype="int64"), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)), weight


def _summed(keys: list, weights: list) -> tuple:
    """The distinct keys, sorted, and the sum of each one's weights."""
    import numpy as np

    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate([np.full(len(k), w) for k, w in zip(keys, weights, strict=True)]), minlength=len(key))


def _tally(kept: list[str], w: int):
    """A row for each term of a row's tokens: the ``kept`` columns, term, tf. Terms are counted where the row is."""

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                words, rows, weights = zip(*_word_rows(b, w), strict=True)
                coded = pa.concat_arrays(words).dictionary_encode()
                codes, size = coded.indices.to_numpy(zero_copy_only=False), max(len(coded.dictionary), 1)
                cut = len(words[0])
                key, tf = _summed([rows[0] * size + codes[:cut], rows[1] * size + codes[cut:]], weights)
                of = pa.array(key // size)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in kept], coded.dictionary.take(pa.array(key % size)), pa.array(tf.astype("int64"))], names=[*kept, "term", "tf"])

    return tally


def postings(chunks: DataFrame, ids: list[str], text: str = "text", headings: str | None = None, boost: str | None = None, alias_boost: float = ALIAS_BOOST) -> DataFrame:
    """``ids``, dl, term, tf: the inverted index in long form; a chunk's tokens are counted where they are, nothing is shuffled."""
    return _postings(chunks, ids, text, headings, boost, alias_boost).drop("chunk")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(
    chunks: DataFrame, folder: str, ids: list[str], text: str = "text", headings: str | None = None, boost: str | None = None, alias_boost: float = ALIAS_BOOST, buckets: int = BUCKETS
) -> None:
    """Writes the postings below ``folder`` for ``search_index``: texts are tokenised once, whatever is asked later.

    Postings lie in folders by a hash of their term. A bucket is cut into ``PARTS`` files by chunk,
    so that a very frequent term is no single task. ``ids`` must not be named chunk, dl, term, tf or bucket.
    """
    if clash := {"chunk", "dl", "term", "tf", "bucket"} & {c.lower() for c in ids}:
        raise ValueError(f"columns of the index: {', '.join(sorted(clash))}")
    spread = _postings(chunks, ids, text, headings, boost, alias_boost).withColumn("bucket", _bucket(F.col("term"), buckets))
    spread = spread.repartition("bucket", F.pmod(F.xxhash64("chunk"), F.lit(PARTS)))
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    # a chunk's length is the sum of its counts: the texts are not read again for it
    totals = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(chunks.sparkSession.read.schema(spread.schema).parquet(f"{folder}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total"))))
    totals.withColumns({"buckets": F.lit(buckets), "schema": F.lit(spread.schema.json())}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def search_index(spark: SparkSession, folder: str, query: str, ids: list[str], k: int = TOP) -> DataFrame:
    """What ``search`` gives for the chunks that ``write_index`` saw, without their texts: only the buckets of the query's terms are read."""
    asked = query_tokens(query)
    terms = sorted(set(asked))
    whole = spark.read.parquet(f"{folder}/totals").first()
    n, avgdl = whole["n"], (whole["total"] / whole["n"] if whole["n"] else 0.0)
    schema = T.StructType.fromJson(json.loads(whole["schema"]))
    rows = spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("bucket").isin([_bucket(F.lit(t), whole["buckets"]) for t in terms]) & F.col("term").isin(terms))
    df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weight = F.lit(0.0)
    for t, d in df.items():
        weight = F.when(F.col("term") == t, asked.count(t) * term_weight(F.col("tf").cast("double"), math.log(1 + (n - d + 0.5) / (d + 0.5)), F.col("dl"), avgdl)).otherwise(weight)
    scored = rows.groupBy("chunk", *ids).agg(F.round(F.sum(weight), 9).alias("__score"))
    best = scored.where(F.col("__score") > 0).orderBy(F.desc("__score"), *ids).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("__score"), *ids)).alias("rank"), F.round("__score", 4).alias("score"), *ids)


def search_many(chunks: DataFrame, queries: DataFrame, ids: list[str], query_id: str, query_text: str = "text", k: int = TOP, text: str = "text", headings: str | None = None, boost: str | None = None, alias_boost: float = ALIAS_BOOST) -> DataFrame:
    """query_id, rank, score, ``ids``: the best ``k`` chunks of every query.

    The chunks are tokenised once; what is stored of them are their counts of terms that a query has. While the queries' terms
    are few, each partition scores its own chunks against all queries and passes on those that may be among the k best (ties at the
    end all). Beyond that terms and postings meet by a shuffle, and scores are summed per (query, chunk).
    """
    w = boost_weight(alias_boost)
    asked = checkpointed(queries.select(query_id, F.explode(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("times")))
    few = asked.count() <= BROADCAST_TERMS
    rows = _counts(chunks, text, headings, boost, w)
    if few:
        return _search_few(rows, asked, ids, query_id, k, w)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__dl"), F.lit(0)).alias("total")).first()
    n, avgdl = stats["n"], (stats["total"] / stats["n"] if stats["n"] else 0.0)
    tf = stored(_postings(chunks, ids, text, headings, boost, alias_boost).join(asked.select("term").distinct(), "term", "left_semi"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "idf")
    scored = tf.join(asked.join(idf, "term"), "term").groupBy(query_id, "chunk", *ids).agg(F.sum(F.col("times") * term_weight(F.col("tf").cast("double"), F.col("idf"), F.col("dl"), F.lit(avgdl or 1.0))).alias("__score"))
    return _best_of_each(scored, query_id, ids, k)


def _best_of_each(scored: DataFrame, query_id: str, ids: list[str], k: int) -> DataFrame:
    best = scored.withColumn("__score", F.round("__score", 9)).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("__score"), *ids))).where(F.col("rank") <= k)
    return best.select(query_id, "rank", F.round("__score", 4).alias("score"), *ids)


def _search_few(rows: DataFrame, asked: DataFrame, ids: list[str], query_id: str, k: int, w: int) -> DataFrame:
    """``search_many`` for queries that every worker may hold: ``rows`` are those of ``_counts``."""
    import numpy as np

    spark = rows.sparkSession
    # a query goes by its place in the list: ids of any type stay where they are
    queries = asked.select(query_id).distinct().collect()
    place = {r[0]: i for i, r in enumerate(queries)}
    wanted = asked.collect()
    terms = sorted({r["term"] for r in wanted})
    number = {t: i for i, t in enumerate(terms)}
    kinds = {f.name: f for f in rows.schema.fields}
    fields = [kinds[c] for c in ids]
    counts = T.StructType([*fields, T.StructField("__dl", T.IntegerType()), T.StructField("__terms", T.ArrayType(T.IntegerType())), T.StructField("__tfs", T.ArrayType(T.IntegerType()))])
    only = rows.select(*ids, "__dl", "__body", "__boost").mapInArrow(_counter(spark.sparkContext.broadcast(terms), ids, w), counts)
    only = stored(only)
    stats = only.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__dl"), F.lit(0)).alias("total")).first()
    n, avgdl = stats["n"], (stats["total"] / stats["n"] if stats["n"] else 0.0) or 1.0
    df = {r["t"]: r["df"] for r in only.select(F.explode("__terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    lists: list[tuple[list, list]] = [([], []) for _ in queries]
    for r in wanted:
        t = number[r["term"]]
        if t in df:
            of = lists[place[r[query_id]]]
            of[0].append(t)
            of[1].append(r["times"] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
    held = spark.sparkContext.broadcast([(np.array(a, dtype="int64"), np.array(b, dtype="float64")) for a, b in lists])
    found = only.where(F.size("__terms") > 0).mapInArrow(_scorer(held, len(terms), ids, avgdl, k), T.StructType([T.StructField("__query", T.IntegerType()), T.StructField("__score", T.DoubleType()), *fields]))
    best = _best_of_each(found, "__query", ids, k)
    named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(queries)], T.StructType([T.StructField("__query", T.IntegerType()), asked.schema[query_id]]))
    return best.join(F.broadcast(named), "__query").select(query_id, "rank", "score", *ids)


def _counter(terms, ids: list[str], w: int):
    """Counts of the terms in each row's tokens, as numbers of terms and how often they are there; nothing of other tokens is kept."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(terms.value, pa.string())
        size = max(len(known), 1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                keys, weights = [], []
                for words, rows, weight in _word_rows(b, w):
                    found = pc.index_in(words, value_set=known)
                    hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                    keys.append(rows[hit] * size + found.take(pa.array(hit)).to_numpy(zero_copy_only=False))
                    weights.append(weight)
                key, tf = _summed(keys, weights)
                ends = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1, dtype="int64") * size).astype("int32"))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype("int32"))) for x in (key % size, tf)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], b.column("__dl"), *lists], names=[*ids, "__dl", "__terms", "__tfs"])

    return count


def _scorer(queries, size: int, ids: list[str], avgdl: float, k: int):
    """Query, score and ids of the rows that may be among the k best of a query: what scores less than k rows seen before is left out."""

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best = np.full((len(queries.value), k), -1.0)
        step = max(1, CELLS // max(size, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                terms, tfs = b.column("__terms"), b.column("__tfs")
                row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
                tf = tfs.flatten().to_numpy().astype("float64")
                dl = b.column("__dl").to_numpy().astype("float64")[row]
                weight = np.zeros((size, b.num_rows))
                weight[terms.flatten().to_numpy(), row] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                which, rows, scores = [], [], []
                for q, (of, idf) in enumerate(queries.value):
                    s = idf @ weight[of] if len(of) else np.zeros(b.num_rows)
                    # a score is rounded to nine places later: what is less by more than that can't tie
                    near = np.flatnonzero((s > 0) & (s >= best[q, 0] - 1e-8))
                    if not len(near):
                        continue
                    top = np.sort(np.concatenate([best[q], s[near]]))[-k:]
                    best[q] = top
                    near = near[s[near] >= top[0] - 1e-8]
                    which.append(np.full(len(near), q, dtype="int32"))
                    rows.append(near)
                    scores.append(s[near])
                if rows:
                    at_rows = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), pa.array(np.concatenate(scores)), *[b.column(c).take(at_rows) for c in ids]], names=["__query", "__score", *ids])

    return score


def term_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df, cf over all chunks."""
    each = _postings(chunks, [], text, None, None, 1.0).select("term", "tf")
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
