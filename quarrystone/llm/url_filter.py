"""URL filter by the ratio of two character language models (native).

Rules (host suffix, path prefix) accept or reject some URLs outright. All URLs
that a rule fits also train two variable-order Markov models, one of accepted
and one of rejected URLs; any other URL gets the verdict of the difference of
its log-likelihoods, divided by its length, against a threshold.

Every symbol stays apart (A-Z are lower-cased), with contexts of up to ``ORDER`` of them. Counts grow with the URLs: they stay in a table
of distinct grams, and only the histogram below comes to the driver.

*Smoothing.* Witten-Bell: the probability after a context of length k is
(count + t * P_{k-1}) / (total + t), t the distinct symbols seen after it; below
the empty context stands the uniform distribution over all code points.

*Calibration.* Models are fitted on four fifths of the rule-labelled URLs (by
hash). On the other fifth the threshold with the best balanced accuracy is taken
from a histogram of the scores (its bins are fixed); if that fifth lacks one
class, the threshold is 0. A score above the threshold accepts.

Defined cases: a null URL or one without ``://`` has an empty host and path and
the score of the empty text; ties at the threshold block; with no labelled URL
of one class all scores are 0; repeated rows are judged alike; of fitting rules
the longest wins, host and path taken together, then that of the longer host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import checkpointed, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: symbols of context before the one that is judged
ORDER = 5
#: the uniform distribution below the empty context is over all code points
UNIFORM = 1 / 0x110000
#: bins of the calibration histogram, over scores of -SPAN to SPAN
BINS, SPAN = 2000, 5.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = [
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = text_or_empty(url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, allow) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<name:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def best_threshold(bins: list[tuple[int, bool, int]]) -> float:
    """The bin edge with the best balanced accuracy when scores above it are accepted."""
    good, bad = sum(n for _, a, n in bins if a), sum(n for _, a, n in bins if not a)
    if not good or not bad:
        return 0.0
    at: dict[int, list[int]] = {}
    for b, a, n in bins:
        at.setdefault(b, [0, 0])[int(a)] += n
    best, above_good, above_bad = (-1.0, 0.0, 0.0), good, bad
    for b in range(BINS):
        below = at.get(b, [0, 0])
        above_good, above_bad = above_good - below[1], above_bad - below[0]
        edge = -SPAN + (b + 1) * 2 * SPAN / BINS
        best = max(best, (above_good / good + 1 - above_bad / bad, -abs(edge), edge))
    return best[2]


def grams(host: Column, path: Column) -> Column:
    """Per symbol, the ORDER symbols before it (NUL before the start) and itself; A-Z are lower-cased, all else stays apart."""
    text = F.translate(F.concat(host, path), UPPER, LOWER)
    padded = F.concat(F.lit("\0" * ORDER), text)
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def log_ratios(counted: DataFrame) -> DataFrame:
    """``gram`` and the log ratio ``r`` of its last symbol, of distinct grams with their counts among accepted (a) and rejected (b) URLs."""
    below = None
    for k in range(ORDER + 1):
        level = counted.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("c", F.expr(f"left(g, {k})"))
        after = level.groupBy("c").agg(*[f(x).alias(f"{n}{x}") for x in "ab" for n, f in (("n", F.sum), ("t", lambda x: F.count(F.when(F.col(x) > 0, 1))))])
        rows = level.join(after, "c")
        if below is None:
            rows = rows.withColumns({"pa": F.lit(UNIFORM), "pb": F.lit(UNIFORM), "both": (F.col("na") > 0) & (F.col("nb") > 0)})
        else:
            rows = rows.withColumn("s", F.expr(f"right(g, {k})")).join(below, "s")
        mixed = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}"))
        below = rows.select(F.col("g").alias("s"), mixed("a").alias("pa"), mixed("b").alias("pb"), "both")
    return below.select(F.col("s").alias("gram"), F.when(F.col("both"), F.log("pa") - F.log("pb")).otherwise(F.lit(0.0)).alias("r"))


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (length-normalised log ratio), threshold.

    The table of grams is smoothed level by level by joins on the context and on the shorter gram. Equal URLs are counted once with their number.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    urls = checkpointed(urls.withColumn("held", held))
    seen = lambda allow: F.when((F.col("rule.allow") == allow) & ~F.col("held"), F.col("n")).otherwise(F.lit(0))
    each = urls.select("host", "path", seen(True).alias("a"), seen(False).alias("b"), F.explode(grams(F.col("host"), F.col("path"))).alias("gram"))
    ratios = checkpointed(log_ratios(checkpointed(each.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))))
    means = each.select("host", "path", "gram").join(ratios, "gram").groupBy("host", "path").agg(F.round(F.avg("r"), 9).alias("score"))
    scored = checkpointed(urls.join(means, ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS)))
    bins = scored.where(F.col("held") & F.col("rule").isNotNull()).select(F.col("rule.allow").alias("allow"), place.cast("int").alias("bin"), "n").groupBy("bin", "allow").agg(F.sum("n").alias("n")).collect()
    threshold = best_threshold([(r["bin"], r["allow"], r["n"]) for r in bins])
    accepted = F.coalesce(F.col("rule.allow"), F.col("score") > threshold)
    out = rows.join(scored, ["host", "path"])
    return out.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.when(accepted, "allow").otherwise("block").alias("verdict"), "score", F.lit(threshold).alias("threshold"))
