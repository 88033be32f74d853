"""Toxicity by maximum-scoring segments of token log-odds.

*Log-odds.* From labelled training documents, the toxic part of a word's
occurrences is estimated with Dirichlet priors that back off by prefix: the word's
prior mean is that of its first six characters, whose prior mean is that of its
first four, whose prior mean is the overall part. A token's score is the log-odds
of its estimate against the overall part, less ``DRIFT``, so that ordinary text
has a falling sum. Words are counted in ``2^BITS`` buckets of a hash: that bounds
the table that comes to the driver and goes to the workers, whatever the corpus.

*Segments.* One linear scan per text finds all maximal scoring segments (every
token run whose sum no shorter or longer run beats).

*Calibration.* Segment scores of clean calibration documents, which the counts have not
seen, have an exponential tail above their 90 % quantile u: its rate is lambda, and K
follows from how many exceed u per token. A segment of score S in a text of n tokens is
expected K n exp(-lambda S) times by chance; it is significant below ``EVALUE``. A
document's evidence is the best sum statistic of its r highest segments (Karlin and Altschul,
1993), so that many middling passages count as one strong one does. A logistic curve fitted
to the calibration documents turns evidence into a score between 0 and 1.

*Folds.* By crc32 of the id as text modulo 5: remainder 0 is held out and never
read, 1 to 3 give the counts, 4 the calibration. Labels are a sample of at most
about ``MAX_LABELS`` documents (all, while there are no more), so that they may be broadcast.

Defined cases: null or empty texts have no token and the least evidence; if the
labels that are counted, or those of the calibration fold, hold one class only or none, every score is the part of toxic labels;
conflicting labels of one id count as toxic; null labels are ignored; a null id is hashed as
an empty text; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bytewords import words
from quarrystone.llm.common import checkpointed, ship

ship(__name__)

BITS = 20
PREFIXES = (4, 6)
#: weight of the prior, in occurrences
ALPHA = 10.0
#: chosen on the calibration fold of the sf0.1 tables (errors of 804: 14 at 0.5, 8 at 0.8, 14 at 1.1)
DRIFT = 0.8
EVALUE = 0.01
MAX_LABELS = 1 << 19
#: evidence of a text without any segment is minus this
FLOOR = 20.0
BIN = 0.05


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class Counts:
    """Occurrences in toxic and clean documents by bucket, and the overall toxic part."""

    toxic: np.ndarray
    clean: np.ndarray
    part: float


@dataclass
class Model:
    counts: Counts
    lam: float
    ln_k: float
    slope: float
    shift: float


def _plain(model: Model) -> tuple:
    """The model as arrays and numbers: what is broadcast needs no class of this package on the workers."""
    c = model.counts
    return (c.toxic, c.clean, c.part), model.lam, model.ln_k, model.slope, model.shift


def _model(plain: tuple) -> Model:
    return Model(Counts(*plain[0]), *plain[1:])


def _buckets(hashes: list[np.ndarray]) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, toxic) to one row per bucket seen in the partition."""
    totals = [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)]
    tokens = [0, 0]
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, bounds, hashes in words(batch.column(0), PREFIXES):
            toxic = np.repeat(label[first:last] == 1, np.diff(bounds))
            for k, kind in enumerate((toxic, ~toxic)):
                tokens[k] += int(kind.sum())
                for b in _buckets(hashes):
                    totals[k] += np.bincount(b[kind], minlength=1 << BITS)
    at = np.flatnonzero(totals[0] + totals[1])
    rows = [np.r_[at, -1], np.r_[totals[0][at], tokens[0]], np.r_[totals[1][at], tokens[1]]]
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["bucket", "toxic", "clean"])


def token_scores(counts: Counts, hashes: list[np.ndarray]) -> np.ndarray:
    """Score of each token: log-odds of the word's toxic part against the overall part, less the drift."""
    whole, *prefixes = _buckets(hashes)
    p: np.ndarray | float = counts.part
    q: np.ndarray | float = 1 - counts.part
    for b in [*prefixes, whole]:
        # both parts are kept: 1 - p would round to nothing for words seen in toxic documents only
        t, c = counts.toxic[b] + ALPHA * p, counts.clean[b] + ALPHA * q
        p, q = t / (t + c), c / (t + c)
    return np.log(p / q) - (math.log(counts.part / (1 - counts.part)) + DRIFT)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last + 1, score), in order; linear in the positive scores."""
    cum = np.cumsum(scores)
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    before: list[int] = []  # the nearest earlier candidate that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(cum[i])
        left, start = right - float(scores[i]), i
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = before[j]
            if j < 0 or rights[j] >= right:
                lefts.append(left)
                rights.append(right)
                spans.append((start, i + 1))
                before.append(j)
                break
            left, start = lefts[j], spans[j][0]
            del lefts[j:], rights[j:], spans[j:], before[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(spans, lefts, rights, strict=True)]


def _segments_of(counts: Counts, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Place, tokens and segments of each text of a batch."""
    for first, last, bounds, hashes in words(texts, PREFIXES):
        scores = token_scores(counts, hashes)
        for i in range(last - first):
            own = scores[bounds[i] : bounds[i + 1]]
            yield first + i, len(own), maximal_segments(own)


def evidence(segments: list[float], n: int, lam: float, ln_k: float) -> float:
    """Evidence against chance of a text with these segment scores, on a compressed scale.

    The sum statistic of the r best segments, T = sum(lam S) - r ln(K n), has the
    tail exp(-T) T^(r-1) / (r! (r-1)!); the best -ln of it over r counts. -FLOOR for a text without segments.
    """
    if not n or not segments:
        return math.asinh(-FLOOR)
    limit = ln_k + math.log(n)
    total, best = 0.0, -FLOOR
    for r, s in enumerate(sorted(segments, reverse=True), 1):
        x = lam * s - limit
        total += x
        if r == 1:
            best = max(best, total)
        elif total <= r or total < best and x < 0:  # the tail formula holds for large T; from here on sums only fall
            break
        else:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return math.asinh(best)


def _labels(labels: DataFrame, max_labels: int) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    return known


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (evidence, toxic, clean), lightly held back."""
    x, t, c = (np.array(v, dtype=float) for v in zip(*rows, strict=True))
    w, hold = np.array([1.0, 0.0]), np.array([1e-3, 1e-3])

    def loss(w: np.ndarray) -> float:
        z = w[0] * x + w[1]
        return float(t @ np.logaddexp(0, -z) + c @ np.logaddexp(0, z) + 0.5 * (hold * w) @ w)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -40, 40)))
        g = np.array([((t + c) * p - t) @ x, ((t + c) * p - t).sum()]) + hold * w
        v = (t + c) * p * (1 - p)
        h = np.array([[(v * x) @ x, v @ x], [v @ x, v.sum()]]) + np.diag(hold)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model | float:
    """The model, or a constant score where the labels cannot tell the classes apart."""
    spark = docs.sparkSession
    known = F.broadcast(_labels(labels, max_labels))
    id_ = F.col("doc_id").cast("long")
    labelled = docs.select(id_.alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(id_.isNotNull() & (fold(F.col("doc_id")) != 0)).join(known, "label_id")
    learn = labelled.where(fold(F.col("label_id")) != 4).select("text", "toxic")
    table = learn.mapInArrow(_count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    bucket, toxic, clean = (table.column(i).to_numpy() for i in range(3))
    total = bucket < 0
    t, c = int(toxic[total].sum()), int(clean[total].sum())
    if not t or not c:
        n = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
        return n["t"] / n["n"] if n["n"] else 0.0
    counts = Counts(np.zeros(1 << BITS), np.zeros(1 << BITS), t / (t + c))
    counts.toxic[bucket[~total]] = toxic[~total]
    counts.clean[bucket[~total]] = clean[~total]
    shared = spark.sparkContext.broadcast((counts.toxic, counts.clean, counts.part))

    def segment_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counts(*shared.value)
        for batch in batches:
            rows = [(n, [s for _, _, s in found]) for _, n, found in _segments_of(own, batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["toxic", "n", "segments"])

    seen = checkpointed(labelled.where(fold(F.col("label_id")) == 4).select("text", "toxic").mapInArrow(segment_scores, "toxic int, n long, segments array<double>"))
    chance = seen.where("toxic = 0").select(F.explode("segments").alias("s"))
    u = chance.agg(F.percentile_approx("s", 0.9, 10000).alias("u")).first()["u"]
    tokens = seen.where("toxic = 0").agg(F.sum("n").alias("n")).first()["n"] or 1
    if u is None:  # clean text has no segment at all: log-odds have rate 1 by their nature, and one chance segment is granted
        lam, ln_k = 1.0, -math.log(tokens)
    else:
        over = chance.where(F.col("s") > u).agg(F.count(F.lit(1)).alias("k"), F.avg(F.col("s") - u).alias("mean")).first()
        lam = 1 / max(over["mean"] or 1.0, 1e-3)
        ln_k = lam * u + math.log(max(over["k"], 1) / tokens)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [evidence(found, n, lam, ln_k) for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([math.floor(x / BIN) for x in at], pa.int32())], names=["toxic", "bin"])

    bins = seen.mapInArrow(evidences, "toxic int, bin int").groupBy("bin").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    if not any(r["t"] for r in bins) or all(r["t"] == r["n"] for r in bins):
        return t / (t + c)
    slope, shift = _logistic([((r["bin"] + 0.5) * BIN, r["t"], r["n"] - r["t"]) for r in bins])
    return Model(counts, lam, ln_k, slope, shift)


def _probability(model: Model, segments: list[float], n: int) -> float:
    x = model.slope * evidence(segments, n, model.lam, model.ln_k) + model.shift
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant ones)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"), F.lit(0).alias("n_passages"))
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for batch in batches:
            p, k = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i, n, found in _segments_of(m.counts, batch.column(2)):
                p[i] = _probability(m, [s for _, _, s in found], n)
                k[i] = sum(_significant(m, s, n) for _, _, s in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(k)], names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int")


def _significant(model: Model, s: float, n: int) -> bool:
    return model.lam * s > model.ln_k + math.log(n) - math.log(EVALUE)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (code points), score, evalue, passage: a row for each significant passage."""
    import re

    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    word = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for batch in batches:
            out = []
            for i, n, found in _segments_of(m.counts, batch.column(1)):
                found = [x for x in found if _significant(m, x[2], n)]
                if found:
                    text = batch.column(1)[i].as_py()
                    at = [x.span() for x in word.finditer(text)]
                    out += [(batch.column(0)[i].as_py(), at[a][0], at[b - 1][1], s, math.exp(m.ln_k + math.log(n) - m.lam * s), text[at[a][0] : at[b - 1][1]]) for a, b, s in found]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "start", "end", "score", "evalue", "passage"])

    return rows.mapInArrow(run, "doc_id long, start long, end long, score double, evalue double, passage string")


def keep_clean(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    if isinstance(model, float):
        return docs if model < 0.5 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, n, found in _segments_of(m.counts, batch.column(at).cast(pa.string())):
                keep[i] = _probability(m, [s for _, _, s in found], n) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
