"""Listings and roll-ups of schedules: projects, summary, activities, WBS, relationships, calendars, resources, assignments.

Every function takes a ``Schedules`` and returns a DataFrame keyed by file; orders are
given as columns or by the caller's ``orderBy``. Limits are those that the listing
itself has, and each comes with the total before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.values import labelled, tenths
from quarrystone.operators import calendar as cal
from quarrystone.operators import path
from quarrystone.session import stored
from quarrystone.operators.schedule import MILESTONES, RELATION, STATUS, TASK_TYPE, ScheduleError, Schedules, wbs_paths

STATUS_GROUPS = {"not_started": ["TK_NotStart"], "active": ["TK_Active"], "complete": ["TK_Complete"], "incomplete": ["TK_NotStart", "TK_Active"]}
TYPE_GROUPS = {"task": ["TT_Task", "TT_Rsrc"], "milestone": MILESTONES, "loe": ["TT_LOE"], "wbs": ["TT_WBS"]}
#: what a listing shows of an activity
ACTIVITY = ["file", "code", "name", "status_label", "start", "finish", "float_d"]


def with_labels(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status_label", labelled(F.col("status"), STATUS)).withColumn("type_label", labelled(F.col("type"), TASK_TYPE))


def projects(s: Schedules) -> DataFrame:
    """All projects of the files, with their number of activities."""
    n = s.tasks.groupBy("file", "proj_id").agg(F.count(F.lit(1)).alias("n_activities"))
    return s.all_projects.join(n, ["file", "proj_id"], "left").select("file", "line_no", "proj_id", "short_name", "recalc", "scd_end", F.coalesce("n_activities", F.lit(0)).alias("n_activities"), "export_flag")


def finish_dates(s: Schedules) -> DataFrame:
    """file, finish: the latest finish of the project's own activities, else its scheduled end."""
    last = s.mine.where(~F.col("summary")).groupBy("file").agg(F.max("finish").alias("__last"))
    return s.projects.join(last, "file", "left").select("file", F.coalesce("__last", "scd_end").alias("finish"))


def summary(s: Schedules) -> DataFrame:
    """One row per file: project facts and counts."""
    kind = lambda *t: F.count_if(F.col("type").isin(*t))
    status = lambda x: F.count_if(F.col("status") == x)
    counts = s.mine.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_activities"), status("TK_NotStart").alias("n_not_started"), status("TK_Active").alias("n_active"), status("TK_Complete").alias("n_complete"),
        kind("TT_Task", "TT_Rsrc").alias("n_tasks"), kind(*MILESTONES).alias("n_milestones"), kind("TT_LOE").alias("n_loe"), kind("TT_WBS").alias("n_wbs_summary"),
        F.count_if(~F.col("complete") & (F.coalesce("float_d", F.lit(0.0)) < 0)).alias("n_negative_float"),
    )
    own = s.projects.select("file", "proj_id")
    n = lambda df, name: df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    assigned = s.assigned.join(s.mine.select("file", "task_id"), ["file", "task_id"], "left_semi")
    parts = [
        counts, n(s.rels.join(own.withColumnRenamed("proj_id", "succ_proj"), ["file", "succ_proj"], "left_semi"), "n_relationships"), n(s.wbs.join(own, ["file", "proj_id"], "left_semi"), "n_wbs"),
        n(s.calendars.where(F.col("clndr_id") != cal.ALWAYS), "n_calendars"), n(s.rsrc, "n_resources"), n(assigned, "n_assignments"), n(path.path_nodes(s), "n_longest_path"),
    ]
    out = s.projects.join(finish_dates(s).withColumnRenamed("finish", "forecast_finish"), "file")
    for p in parts:
        out = out.join(p, "file", "left")
    out = out.na.fill(0, [c for c in out.columns if c.startswith("n_")])
    out = cal.with_hours_between(out, s.days, "cal_id", "data_date", "forecast_finish", "__h")
    critical = F.when(F.col("critical_type") == "CT_TotFloat", F.concat(F.lit("total float <= "), "critical_h", F.lit(" h"))).when(F.col("critical_type") == "CT_DrivPath", "longest path").otherwise(F.col("critical_type"))
    progress = F.when(F.col("retained") == "Y", "retained logic").when(F.col("override") == "Y", "progress override").otherwise("actual dates")
    return out.withColumn("remaining_d", F.col("__h") / F.col("project_day_hr")).withColumn("critical_as", critical).withColumn("out_of_sequence", progress).drop("__h")


def upcoming_milestones(s: Schedules) -> DataFrame:
    """Incomplete milestones with n (place by finish, nulls last)."""
    rows = with_labels(s.mine.where(F.col("milestone") & ~F.col("complete")))
    return rows.select(*ACTIVITY, F.row_number().over(Window.partitionBy("file").orderBy(F.col("finish").asc_nulls_last(), "line_no")).alias("n"))


def activities(
    s: Schedules, status: str | None = None, type: str | None = None, wbs: str | None = None, search: str | None = None, float_lt: float | None = None, on_longest_path: bool = False
) -> DataFrame:
    """Activities that fit all conditions, with durations in days, labels and WBS; order by start (nulls last), code."""
    rows = with_labels(s.mine)
    if status:
        rows = rows.where(F.col("status").isin(STATUS_GROUPS[status]))
    if type:
        rows = rows.where(F.col("type").isin(TYPE_GROUPS[type]))
    if search:
        rows = rows.where(F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("code"), F.lit(search.lower())))
    if float_lt is not None:
        rows = rows.where(F.col("float_d") < float_lt)
    if on_longest_path:
        rows = rows.join(path.path_nodes(s).withColumnRenamed("node", "task_id"), ["file", "task_id"], "left_semi")
    rows = rows.join(wbs_paths(s.wbs).select("file", "wbs_id", "codes", "names"), ["file", "wbs_id"], "left").na.fill("", ["codes", "names"])
    if wbs:
        rows = rows.where(F.contains(F.lower("codes"), F.lit(wbs.lower())) | F.contains(F.lower("names"), F.lit(wbs.lower())))
    return rows.select(*ACTIVITY, (F.col("target_h") / F.col("day_hr")).alias("target_d"), (F.col("remain_h") / F.col("day_hr")).alias("remain_d"), "type_label", F.col("codes").alias("wbs"), "task_id")


def find_activity(s: Schedules, code: str) -> DataFrame:
    """The activity with the code, else the only one whose code or name holds it; else an error with up to 15 candidates."""
    exact = s.mine.where(F.col("code") == code)
    exact = exact.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy(F.col("line_no").desc()))).where("__n = 1").drop("__n")
    if not exact.isEmpty():
        return exact
    part = F.lit(code.lower())
    hits = s.mine.where(F.contains(F.lower("code"), part) | F.contains(F.lower("name"), part))
    some = hits.orderBy("line_no").select("code").limit(16).collect()
    if len(some) != 1:
        raise ScheduleError(f"activity {code!r} not found" + (f"; candidates: {', '.join(r['code'] for r in some[:15])}" if some else ""))
    return hits


def relations_of(s: Schedules, activity: DataFrame, gap: DataFrame) -> DataFrame:
    """Predecessors and successors of the given activities: side, the other end's columns, lag_d, gap_d, state."""
    at = activity.select("file", "task_id")
    # the gap is in days of the successor's calendar, the lag in days of the other end's
    state = F.when(F.col("driving"), "DRIVING").when(F.col("violated"), "violated").otherwise("")

    def side(name: str, mine: str, other: str) -> DataFrame:
        rows = gap.join(at.withColumnRenamed("task_id", mine), ["file", mine], "left_semi")
        o = lambda c: F.col(f"{other}_{c}")
        return rows.select(
            "file", F.lit(name).alias("side"), F.col(mine).alias("task_id"), o("code").alias("code"), o("name").alias("name"), labelled(F.col("rel_type"), RELATION).alias("rel"), (F.col("lag_h") / o("day_hr")).alias("lag_d"),
            labelled(o("status"), STATUS).alias("status_label"), o("start").alias("start"), o("finish").alias("finish"), (F.col("gap_h") / F.col("s_day_hr")).alias("gap_d"), state.alias("state"), "line_no",
        )

    return side("pred", "succ_id", "p").unionByName(side("succ", "pred_id", "s"))


def wbs_rollup(s: Schedules, depth: int | None = None) -> DataFrame:
    """One row per WBS element: what its subtree holds. Order by file, sort_key.

    Activities meet their ancestors through the path of their own element: a row per
    level, which are summed before they are shuffled.
    """
    paths = wbs_paths(s.wbs)
    own = s.wbs.join(s.projects.select("file", "proj_id"), ["file", "proj_id"], "left_semi")
    leaf = s.mine.select("file", "wbs_id", "complete", "start", "finish", "float_d").join(paths.select("file", "wbs_id", "ancestors"), ["file", "wbs_id"])
    up = leaf.select("file", F.explode("ancestors").alias("wbs_id"), "complete", "start", "finish", "float_d")
    sums = up.groupBy("file", "wbs_id").agg(
        F.count(F.lit(1)).alias("n_activities"), F.count_if("complete").alias("n_complete"), F.min("start").alias("start"), F.max("finish").alias("finish"), F.min(F.when(~F.col("complete"), F.col("float_d"))).alias("min_float_d")
    )
    # siblings are ordered by sequence number, then short name
    keys = own.select("file", F.col("wbs_id").alias("id"), F.struct("seq", "short_name", "line_no").alias("key"))
    steps = paths.select("file", "wbs_id", F.posexplode("ancestors").alias("at", "id")).join(keys, ["file", "id"])
    order = steps.groupBy("file", "wbs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("sort_key"))
    rows = own.select("file", "wbs_id", "short_name", "name").join(paths.select("file", "wbs_id", "codes", "depth"), ["file", "wbs_id"]).join(order, ["file", "wbs_id"]).join(sums, ["file", "wbs_id"], "left")
    rows = rows.na.fill(0, ["n_activities", "n_complete"])
    return rows.where(F.col("depth") <= depth) if depth is not None else rows


def relationships(s: Schedules, code: str | None = None, gap: DataFrame | None = None) -> DataFrame:
    """Relationships that touch the project (or an activity of it), with lag_d and gap_d in days."""
    g = s.gaps if gap is None else gap
    rows = g.join(s.per_file.select("file", F.col("proj_id").alias("__proj")), "file").where((F.col("succ_proj") == F.col("__proj")) | (F.col("pred_proj") == F.col("__proj")))
    if code:
        at = path.named_ends(s, code).select("file", F.col("node").alias("__node"))
        rows = rows.join(at, "file").where((F.col("succ_id") == F.col("__node")) | (F.col("pred_id") == F.col("__node")))
    return rows.select(
        "file", "line_no", F.col("p_code").alias("pred_code"), F.col("p_name").alias("pred_name"), labelled(F.col("rel_type"), RELATION).alias("rel"), F.col("s_code").alias("succ_code"), F.col("s_name").alias("succ_name"),
        (F.col("lag_h") / F.col("p_day_hr")).alias("lag_d"), (F.col("gap_h") / F.col("s_day_hr")).alias("gap_d"), "driving", "lag_h",
    )


def relationship_mix(rows: DataFrame) -> DataFrame:
    """file, rel, n, pct over the rows of ``relationships``."""
    n = rows.groupBy("file", "rel").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("file")))


def lag_signs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count_if(F.col("lag_h") < 0).alias("n_leads"), F.count_if(F.col("lag_h") > 0).alias("n_lags"), F.count(F.lit(1)).alias("n_relationships"))


def calendar_list(s: Schedules) -> DataFrame:
    """Calendars with their working week, number of exceptions and of activities (by the id they name)."""
    named = s.mine.groupBy("file", "clndr_id").agg(F.count(F.lit(1)).alias("n_activities"))
    rows = s.calendars.where(F.col("clndr_id") != cal.ALWAYS).join(named, ["file", "clndr_id"], "left")
    return rows.select("file", "clndr_id", "name", F.regexp_replace("type", "CA_", "").alias("type"), "day_hr", "week_hr", cal.week_text(F.col("week")).alias("work_week"), F.size("exceptions").alias("n_exceptions"), F.coalesce("n_activities", F.lit(0)).alias("n_activities"), "parsed", "line_no")


def holidays(s: Schedules, year: int) -> DataFrame:
    """Exceptions of a year in calendars that activities use."""
    used = s.mine.select("file", "clndr_id").distinct()
    rows = s.calendars.join(used, ["file", "clndr_id"], "left_semi").select("file", "clndr_id", "name", F.explode("exceptions").alias("day", "periods")).where(F.year("day") == year)
    hours = F.aggregate("periods", F.lit(0).cast("long"), lambda a, p: a + (p["e"] - p["s"])) / F.lit(3600.0)
    return rows.select("file", "name", "day", F.date_format("day", "EEE").alias("weekday"), F.size("periods").alias("n_periods"), hours.alias("hours"))


def rate_limits(s: Schedules) -> DataFrame:
    """file, rsrc_id, limit: the latest positive units per hour; of equal dates the last row."""
    dated = s.rates.where(F.col("limit") > 0).withColumn("at", F.struct(F.coalesce("start", F.lit("0001-01-01").cast("timestamp_ntz")).alias("start"), "line_no"))
    return dated.groupBy("file", "rsrc_id").agg(F.max_by("limit", "at").alias("limit"))


def _of_mine(s: Schedules) -> DataFrame:
    own = s.mine.select("file", "task_id", "code", F.col("name").alias("task_name"), "complete", "cal_id", F.col("start").alias("task_start"), "early_start", "early_end", F.col("restart").alias("task_restart"), F.col("reend").alias("task_reend"), F.col("line_no").alias("task_line"))
    return s.assigned.join(own, ["file", "task_id"])


def daily_load(s: Schedules) -> DataFrame:
    """file, rsrc_id, day, qty: remaining quantity spread over the remaining working time of each assignment.

    An assignment is not multiplied by its days. Its first and last day are worked out from their
    periods; for the days between it adds its rate to a running sum of its resource and calendar where they begin, and takes it
    off where they end. What is summed up are days, at most as many as the schedules span, for each resource and calendar.
    """
    rows = _of_mine(s).where(~F.col("complete") & (F.col("remain_qty") > 0))
    rows = rows.join(s.rsrc.select("file", "rsrc_id", F.col("type").alias("rsrc_type")), ["file", "rsrc_id"], "left").where(~F.coalesce(F.col("rsrc_type") == "RT_Mat", F.lit(False)))
    rows = rows.withColumn("s", F.coalesce("restart", "early_start", "task_restart")).withColumn("f", F.coalesce("reend", "early_end", "task_reend")).where(F.col("f") > F.col("s"))
    rows = cal.with_hours_between(rows.select("file", "rsrc_id", "cal_id", "remain_qty", "s", "f"), s.days, "cal_id", "s", "f", "total").where(F.col("total") > 0)
    rows = stored(rows.select("file", "rsrc_id", "cal_id", "s", "f", F.col("s").cast("date").alias("s_day"), F.col("f").cast("date").alias("f_day"), (F.col("remain_qty") / F.col("total")).alias("rate")))
    d = s.days.where("day_sec > 0").select("file", F.col("clndr_id").alias("cal_id"), "day", "periods", "day_sec")
    ends = rows.withColumn("day", F.explode(F.array_distinct(F.array("s_day", "f_day")))).join(d, ["file", "cal_id", "day"])
    lo, hi = (F.timestamp_diff("SECOND", F.col("day").cast("timestamp_ntz"), F.col(c)).cast("double") for c in ("s", "f"))
    part = F.aggregate("periods", F.lit(0.0), lambda a, p: a + F.greatest(F.lit(0.0), F.least(p["e"].cast("double"), hi) - F.greatest(p["s"].cast("double"), lo)))
    ends = ends.select("file", "rsrc_id", "day", (F.col("rate") * part / 3600.0).alias("qty")).where(F.col("qty") > 0)
    step = lambda day, sign: F.struct(day.alias("day"), (sign * F.col("rate")).alias("rate"), F.lit(sign).alias("n"))
    between = rows.where(F.datediff("f_day", "s_day") > 1).select("file", "rsrc_id", "cal_id", F.explode(F.array(step(F.date_add("s_day", 1), 1), step(F.col("f_day"), -1))).alias("x")).select("file", "rsrc_id", "cal_id", "x.*")
    steps = between.groupBy("file", "rsrc_id", "cal_id", "day").agg(F.sum("rate").alias("rate"), F.sum("n").alias("n"))
    order = Window.partitionBy("file", "rsrc_id", "cal_id").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steady = steps.select("file", "rsrc_id", "cal_id", "day", F.lead("day").over(order).alias("until"), F.sum("rate").over(so_far).alias("rate"), F.sum("n").over(so_far).alias("n")).where("n > 0 and until is not null")
    inner = steady.withColumn("day", F.explode(F.sequence("day", F.date_sub("until", 1)))).join(d, ["file", "cal_id", "day"])
    inner = inner.select("file", "rsrc_id", "day", (F.col("rate") * F.col("day_sec") / 3600.0).alias("qty"))
    return ends.unionByName(inner).groupBy("file", "rsrc_id", "day").agg(F.sum("qty").alias("qty"))


def overallocation(s: Schedules) -> DataFrame:
    """file, rsrc_id, limit, peak (share of capacity), days_over, first_over, for resources with a limit and a load."""
    r = s.rsrc.select("file", "rsrc_id", "clndr_id").join(s.calendars.select("file", "clndr_id", F.col("clndr_id").alias("own_cal")), ["file", "clndr_id"], "left")
    r = r.join(s.projects.select("file", F.col("cal_id").alias("proj_cal")), "file").select("file", "rsrc_id", F.coalesce("own_cal", "proj_cal").alias("clndr_id"))
    hours = s.calendars.select("file", "clndr_id", "day_hr", "week", "exceptions")
    limits = rate_limits(s).join(s.projects.select("file", F.col("cal_id").alias("proj_cal")), "file").join(r, ["file", "rsrc_id"], "left").withColumn("clndr_id", F.coalesce("clndr_id", "proj_cal")).join(hours, ["file", "clndr_id"])
    rows = daily_load(s).join(limits, ["file", "rsrc_id"])
    day_h = cal.day_hours(F.col("day"), F.col("week"), F.col("exceptions"))
    # a day without working time counts as a whole one
    rows = rows.withColumn("cap", F.col("limit") * F.when(day_h > 0, day_h).otherwise(F.col("day_hr")))
    over = F.col("qty") > F.col("cap") + 1e-6
    return rows.groupBy("file", "rsrc_id", "limit").agg(F.max(F.col("qty") / F.col("cap")).alias("peak"), F.count_if(over).alias("days_over"), F.min(F.when(over, F.col("day"))).alias("first_over"))


def resources(s: Schedules) -> DataFrame:
    """Sums of each resource's assignments, its limit and its overallocation; order by target_qty descending."""
    actual = lambda k: F.sum(F.col(f"reg_{k}") + F.col(f"ot_{k}"))
    sums = _of_mine(s).groupBy("file", "rsrc_id").agg(
        F.count(F.lit(1)).alias("n_assignments"), F.sum("target_qty").alias("target_qty"), actual("qty").alias("actual_qty"), F.sum("remain_qty").alias("remain_qty"),
        F.sum("target_cost").alias("target_cost"), actual("cost").alias("actual_cost"), F.sum("remain_cost").alias("remain_cost"),
    )
    r = s.rsrc.select("file", "rsrc_id", F.col("short_name").alias("resource"), F.col("name").alias("name"), F.regexp_replace("type", "RT_", "").alias("type"))
    out = sums.join(r, ["file", "rsrc_id"], "left").withColumn("resource", F.coalesce("resource", "rsrc_id")).na.fill("", ["name", "type"])
    out = out.join(rate_limits(s), ["file", "rsrc_id"], "left")
    return out.join(overallocation(s).drop("limit"), ["file", "rsrc_id"], "left")


def assignments(s: Schedules, resource: str | None = None) -> DataFrame:
    """Assignments of the project's activities; order by start (nulls last), then as in the file."""
    r = s.rsrc.select("file", "rsrc_id", F.col("short_name").alias("rsrc_short"), F.col("name").alias("rsrc_name"), F.col("type").alias("rsrc_type"))
    rows = _of_mine(s).join(r, ["file", "rsrc_id"], "left")
    if resource:
        rows = rows.where(F.contains(F.lower(F.concat(F.coalesce("rsrc_name", F.lit("")), F.coalesce("rsrc_short", F.lit("")))), F.lit(resource.lower())))
    return rows.select(
        "file", "task_id", "code", "task_name", F.coalesce("rsrc_short", "rsrc_id").alias("resource"), F.coalesce("rsrc_name", "rsrc_id").alias("rsrc_name"), F.coalesce("rsrc_type", F.lit("")).alias("rsrc_type"), "target_qty", (F.col("reg_qty") + F.col("ot_qty")).alias("actual_qty"), "remain_qty",
        "target_cost", (F.col("reg_cost") + F.col("ot_cost")).alias("actual_cost"), "remain_cost", "task_start", "task_line", "line_no",
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns rounded to tenths as reports show them."""
    for c in columns:
        df = df.withColumn(c, tenths(F.col(c)))
    return df


