"""Mixing sources to target weights by Poisson replication (native).

Each document of source s is repeated k times, where k is drawn from the Poisson
distribution with mean rate(s), by inverting it at uniform numbers hashed from the seed and
the document. rate(s) = size * share(s) / documents of s, so the expected number of copies
from s is ``size * share(s)``. The copies are then ordered by a hash over the
whole output: a global shuffle that any later run repeats.

A rate above ``PART`` is cut into equal parts of at most that: k is the sum of one draw for each
part, each at a hash of its own, which has the same distribution. So the plan holds a short table of quantiles
for each named source, however rare the source is, and a document costs a draw for every ``PART`` copies that it gets.

The sources named in ``shares`` have a share of their own; all others together
have what is left, in proportion to their documents. So at most
``len(shares) + 1`` rates come to the driver, whatever the number of sources.

Defined cases: a null source counts among the others; a null text is kept; a
null doc_id is replaced in the hash by the text's hash; rows that repeat the
same doc_id get the same number of copies each; a named source without
documents leaves its share unused; an empty table gives an empty result;
further columns are carried along, but for ``copy`` and ``order_key``, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import free_name

#: bits of the uniform number; exact in a double
BITS = 52
#: the largest rate that one draw stands for
PART = 32.0


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, BITS // 4), 16, 10).cast("double") / float(2**BITS)


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where 1 is reached in doubles; for rates of at most ``PART``."""
    out, total, k = [], 0.0, 0
    limit = rate + 12 * math.sqrt(rate) + 60
    while k <= limit:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        if k > rate and out and total <= out[-1]:
            break
        out.append(total)
        k += 1
    return out


def parts_of(rate: float) -> int:
    """The number of draws for a rate."""
    return max(1, math.ceil(rate / PART))


def rates(docs: DataFrame, shares: dict[str, float], size: float | None = None) -> dict[str | None, float]:
    """Mean copies per document of each named source and, under None, of all others."""
    label = F.when(F.col("source").isin(list(shares)), F.col("source"))
    n = {r["label"]: r["n"] for r in docs.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = float(sum(n.values())) if size is None else float(size)
    left = max(0.0, 1.0 - math.fsum(shares[s] for s in sorted(shares)))
    return {s: size * (left if s is None else shares[s]) / k for s, k in n.items()}


def copies(seed: str, key: Column, rate_of: dict[str | None, float]) -> Column:
    """The Poisson number of the document ``key`` under the rate of the row's source."""

    def drawn(rate: float) -> Column:
        parts = parts_of(rate)
        table = poisson_cdf(rate / parts)
        at = lambda u: F.size(F.filter(F.array(*[F.lit(x) for x in table]), lambda c: c <= u))
        first = at(uniform(seed, key))
        if parts == 1:
            return first
        more = lambda n, j: n + at(uniform(seed, F.concat(key, F.lit("#"), j.cast("string"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(parts - 1)), first, more)

    out = drawn(rate_of.get(None, 0.0))
    for s, rate in rate_of.items():
        if s is not None:
            out = F.when(F.col("source") == s, drawn(rate)).otherwise(out)
    return out


def mix(docs: DataFrame, shares: dict[str, float], size: float | None = None, seed: str = "mix") -> DataFrame:
    """The columns of ``docs`` with ``copy`` (1, 2, ...) and ``order_key``, globally sorted by the latter."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rate_of = rates(docs, shares, size)
    number = free_name(docs.columns, "__number")
    counted = docs.withColumn(number, copies(seed, key, rate_of)).where(F.col(number) > 0)
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(number)))).drop(number)
    keyed = copied.withColumn("order_key", F.md5(F.concat(F.lit(seed + ":order:"), key, F.lit(":"), F.col("copy").cast("string"))))
    return keyed.orderBy("order_key")
