"""Milestone gaps across versions of a schedule.

Versions (exports or milestone sheets, oldest first) become one long table:
version, group, key, date. Gaps are differences along two directions of it: *stagger*
(the same milestone in the previous group) and *step* (the previous milestone that
the group has). Orders of groups and keys are dimensions of the
number of distinct groups and keys, never of the activities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.values import loose_date, tenths
from quarrystone.operators import calendar as cal
from quarrystone.operators.schedule import ScheduleError, Schedules, wbs_paths

# The default patterns for groups (in a name, a WBS element, a code) and keys.
GROUP_IN_NAME = r"^\s*([A-Za-z][A-Za-z .&/-]*?\s*\d+[A-Za-z]?)\s*[:\-–]\s"
KEY_IN_NAME = r"\(([A-Za-z][A-Za-z0-9&/]{1,9})\)"
GROUP_IN_WBS = r"^\s*([A-Za-z][A-Za-z .&/-]{0,20}?[\s_-]*\d+[A-Za-z]?)\s*$"
GROUP_IN_CODE = r"((?:ROMP|PHASE|PH|AREA|BLDG|ZONE|SECTOR|DH|POD)[-_ ]?\d+[A-Za-z]?)(?![0-9])"
SHEET_COLUMNS = ["group", "milestone", "date"]
FOUND = ["version", "grp", "key", "date", "code", "name"]


def _capture(c: Column, pattern: str) -> Column:
    """The first group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def normal_group(c: Column) -> Column:
    """'ROMP 01', 'ROMP-1' and 'romp1' are 'ROMP 1'."""
    s, p = F.trim(c), r"(?s)^(.*?)[\s_-]*0*(\d+)([A-Za-z]?)$"
    part = lambda i: F.upper(F.trim(F.regexp_extract(s, p, i)))
    return F.when(s.rlike(p), F.concat(part(1), F.lit(" "), F.regexp_extract(s, p, 2), part(3))).otherwise(s)


def natural_key(c: Column) -> Column:
    """Sorts digits as numbers and letters without case; texts and numbers take turns, a text first."""
    texts = F.transform(F.split(F.lower(c), r"\d+"), lambda x: x)
    numbers = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.transform(F.arrays_zip(texts.alias("t"), numbers.alias("n")), lambda x: F.struct(x["t"].alias("t"), F.coalesce(x["n"].try_cast("decimal(38,0)"), F.lit(-1)).alias("n")))


def milestones_of(s: Schedules, version: str, group: str | None = None, key: str | None = None, search: str | None = None, all_types: bool = False) -> DataFrame:
    """version, grp, key, date, code, name and n (1 for the match that counts, by code; others are reported by ``doubles``)."""
    key_pattern = key or KEY_IN_NAME
    rows = s.mine if all_types else s.mine.where("milestone")
    if search:
        rows = rows.where(F.contains(F.lower("name"), F.lit(search.lower())))
    keys = F.regexp_extract_all("name", F.lit(key_pattern), F.lit(1))
    rows = rows.where(F.col("name").rlike(key_pattern)).withColumn("key", F.element_at(keys, -1 if key_pattern == KEY_IN_NAME else 1))
    rows = rows.join(wbs_paths(s.wbs).select("file", "wbs_id", "name_list"), ["file", "wbs_id"], "left")
    in_wbs = F.get(F.filter(F.transform(F.reverse("name_list"), lambda n: _capture(n, group or GROUP_IN_WBS)), lambda g: g.isNotNull()), 0)
    found = F.coalesce(_capture(F.col("name"), group or GROUP_IN_NAME), in_wbs, _capture(F.col("code"), "(?i)" + (group or GROUP_IN_CODE)))
    date = F.when(F.col("type") == "TT_Mile", F.col("start")).otherwise(F.col("finish")).cast("date")
    rows = rows.select(F.lit(version).alias("version"), normal_group(found).alias("grp"), "key", date.alias("date"), "code", "name", "line_no").where(F.col("grp").isNotNull() & F.col("date").isNotNull())
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("version", "grp", "key").orderBy("code", "line_no"))).drop("line_no")


def sheet(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The same from a CSV with Group, Milestone and Date (in any case); of repeated milestones the last row counts."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    if any(c not in names for c in SHEET_COLUMNS):
        raise ScheduleError(f"{path}: columns Group, Milestone, Date are needed")
    g, m, d = (F.coalesce(F.col(f"`{names[c]}`"), F.lit("")) for c in SHEET_COLUMNS)
    rows = raw.select(normal_group(g).alias("grp"), F.trim(m).alias("key"), loose_date(d).alias("date"), F.monotonically_increasing_id().alias("at")).where(F.col("date").isNotNull())
    last = rows.groupBy("grp", "key").agg(F.max_by("date", "at").alias("date"))
    return last.select(F.lit(version).alias("version"), "grp", "key", "date", F.lit("").alias("code"), F.lit("manual").alias("name"), F.lit(1).alias("n"))


def doubles(found: DataFrame) -> DataFrame:
    """version, grp, key, kept, dropped: activities that matched a milestone which another had already."""
    kept = F.first("code").over(Window.partitionBy("version", "grp", "key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("kept", kept).where("n > 1").select("version", "grp", "key", "kept", F.col("code").alias("dropped"))


def groups_in_order(dates: DataFrame) -> DataFrame:
    """grp, g (1, 2, ... in natural order)."""
    return dates.select("grp").distinct().withColumn("g", F.row_number().over(Window.orderBy(natural_key(F.col("grp")), "grp")))


def majority_order(dates: DataFrame) -> DataFrame:
    """key, score, k (1, 2, ...): a key scores for each other key that it precedes more often than it follows.

    The pairs of keys of one version and group are counted before they are compared; ties go by name.
    """
    x = dates.select("version", "grp", F.col("key").alias("a"), F.col("date").alias("da"))
    y = dates.select("version", "grp", F.col("key").alias("b"), F.col("date").alias("db"))
    votes = x.join(y, ["version", "grp"]).where((F.col("a") != F.col("b")) & (F.col("da") != F.col("db")))
    sides = votes.groupBy("a", "b").agg(F.sum(F.when(F.col("da") < F.col("db"), 1).otherwise(-1)).alias("lead"))
    score = sides.groupBy(F.col("a").alias("key")).agg(F.count_if(F.col("lead") > 0).alias("score"))
    rows = dates.select("key").distinct().join(score, "key", "left").na.fill(0, ["score"])
    return rows.withColumn("k", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))


def named_order(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(key.strip(), 0, i + 1) for i, key in enumerate(keys)], "key string, score long, k int")


def gap_definitions(dates: DataFrame, groups: DataFrame, keys: DataFrame) -> DataFrame:
    """kind (stagger, step), grp, key, from_grp, from_key, label, cadence (the label without its group).

    A step starts at the previous key, in their order, that the group has in any version; a stagger at the previous group.
    """
    have = dates.select("grp", "key").distinct().join(groups, "grp").join(keys.select("key", "k"), "key")
    step = have.withColumn("from_key", F.lag("key").over(Window.partitionBy("grp").orderBy("k"))).where(F.col("from_key").isNotNull())
    steps = step.select(F.lit("step").alias("kind"), "grp", "g", "key", "k", F.col("grp").alias("from_grp"), "from_key", F.concat("from_key", F.lit(" to "), "key").alias("label"), F.concat("from_key", F.lit(" to "), "key").alias("cadence"))
    before = groups.select(F.col("grp").alias("from_grp"), (F.col("g") + 1).alias("g"))
    stagger = have.join(before, "g")
    staggers = stagger.select(F.lit("stagger").alias("kind"), "grp", "g", "key", "k", "from_grp", F.col("key").alias("from_key"), F.concat("key", F.lit(" stagger (vs "), "from_grp", F.lit(")")).alias("label"), F.concat("key", F.lit(" stagger")).alias("cadence"))
    return staggers.unionByName(steps)


def gap_values(dates: DataFrame, definitions: DataFrame, schedule: Schedules | None = None) -> DataFrame:
    """The definitions with version and gap, where both ends have a date: calendar days, or working days (tenths) of the schedule's project calendar."""
    to = dates.select("version", "grp", "key", F.col("date").alias("to_date"))
    since = dates.select("version", F.col("grp").alias("from_grp"), F.col("key").alias("from_key"), F.col("date").alias("from_date"))
    rows = definitions.join(to, ["grp", "key"]).join(since, ["version", "from_grp", "from_key"])
    return with_span(rows, "from_date", "to_date", "gap", schedule).drop("from_date", "to_date")


def with_span(rows: DataFrame, a: str, b: str, out: str, schedule: Schedules | None = None) -> DataFrame:
    if schedule is None:
        return rows.withColumn(out, F.datediff(b, a).cast("double"))
    p = schedule.projects.first()
    rows = rows.withColumn("file", F.lit(p["file"])).withColumn("__pair_cal", F.lit(p["cal_id"])).withColumn("__a", F.col(a).cast("timestamp_ntz")).withColumn("__b", F.col(b).cast("timestamp_ntz"))
    low, high = rows.agg(F.min(F.least(a, b)), F.max(F.greatest(a, b))).first()
    if low is None:
        return rows.withColumn(out, F.lit(None).cast("double")).drop("file", "__pair_cal", "__a", "__b")
    days = cal.calendar_days(schedule.calendars, str(low), str(high))
    return cal.with_hours_between(rows, days, "__pair_cal", "__a", "__b", "__h").withColumn(out, tenths(F.col("__h") / F.lit(p["project_day_hr"]))).drop("file", "__pair_cal", "__a", "__b", "__h")


def compare(values: DataFrame, reference: str, focus: str, min_gap: float | None = None, shrink: float | None = None, unit: str = "cd") -> DataFrame:
    """One row per gap: ref, focus, change (tenths), change_pct, squeezed, why (null unless the gap is flagged)."""
    at = lambda v: F.max(F.when(F.col("version") == v, F.col("gap")))
    rows = values.groupBy("kind", "grp", "g", "key", "k", "from_grp", "from_key", "label", "cadence").agg(at(reference).alias("ref"), at(focus).alias("focus"))
    change = tenths(F.col("focus") - F.col("ref"))
    rows = rows.withColumn("change", change).withColumn("change_pct", F.when(F.col("ref") != 0, F.bround(100.0 * F.col("change") / F.abs("ref"), 0)))
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    already = F.when(F.col("ref") <= 0, F.lit(f" (already so in {reference})")).otherwise(F.lit(" (new)"))
    why = [F.when(F.col("focus") < 0, F.concat(F.lit("out of sequence"), already)).when(F.col("focus") == 0, F.concat(F.lit("no gap"), already))]
    if min_gap is not None:
        why.append(F.when((F.col("focus") > 0) & (F.col("focus") < min_gap), F.lit(f"under {min_gap:g} {unit}")))
    if shrink is not None:
        why.append(F.when(-F.col("change") >= shrink, F.concat(F.lit("squeezed "), number(-F.col("change")), F.lit(f" {unit}"))))
    text = F.concat_ws("; ", *why)
    return rows.withColumn("squeezed", F.coalesce(F.col("change") < 0, F.lit(False))).withColumn("why", F.when(text != "", text))


def cadence(values: DataFrame) -> DataFrame:
    """version, kind, cadence, least, mean, most over the groups."""
    return values.groupBy("version", "kind", "cadence").agg(F.min("gap").alias("least"), F.avg("gap").alias("mean"), F.max("gap").alias("most"), F.count(F.lit(1)).alias("n"))


def missing(dates: DataFrame) -> DataFrame:
    """version, grp, key that another version has: all versions times all milestones, less those found.

    The versions are few and named by the caller, so they are spread as an array.
    """
    versions = [r["version"] for r in dates.select("version").distinct().orderBy("version").collect()]
    anywhere = dates.select("grp", "key").distinct().withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])) if versions else F.lit(None).cast("string"))
    return anywhere.join(dates.select("version", "grp", "key").distinct(), ["version", "grp", "key"], "left_anti")


def matrix(dates: DataFrame, groups: DataFrame, keys: DataFrame, versions: list[str], values: DataFrame, reference: str, focus: str, schedule: Schedules | None = None) -> DataFrame:
    """One row per milestone: its date in each version (v0, v1, ...), code, delta from reference to focus, stagger and step of the focus."""
    at = lambda v: F.max(F.when(F.col("version") == v, F.col("date")))
    rank = F.when(F.col("version") == focus, -2).when(F.col("version") == reference, -1)
    for i, v in enumerate(versions):
        rank = rank.when(F.col("version") == v, i)
    rows = dates.groupBy("grp", "key").agg(*[at(v).alias(f"v{i}") for i, v in enumerate(versions)], F.min_by("code", F.when(F.col("code") != "", rank)).alias("code"))
    rows = rows.join(groups, "grp").join(keys.select("key", "k"), "key")
    rows = with_span(rows, f"v{versions.index(reference)}", f"v{versions.index(focus)}", "delta", schedule)
    own = values.where(F.col("version") == focus).groupBy("grp", "key").agg(F.max(F.when(F.col("kind") == "stagger", F.col("gap"))).alias("stagger"), F.max(F.when(F.col("kind") == "step", F.col("gap"))).alias("step"))
    return rows.join(own, ["grp", "key"], "left").na.fill("", ["code"])
