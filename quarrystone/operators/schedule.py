"""The schedule model: typed tables of activities, relationships, WBS, calendars and resources.

A ``Schedules`` holds any number of schedules, one per ``file``; every operator keys
by file, so comparing updates is a join of one table with itself. Of each file one
project is chosen (``mine`` marks its activities); relationships may lead to others.

Tables come from exports (``from_exports``) or from any DataFrames of the typed
form below (``Schedules.of``).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.values import moment, number
from quarrystone.operators import calendar as cal
from quarrystone.session import checkpointed, stored
from quarrystone.sources.xer import ScheduleError, newest, read_lines, require_schedules, rows_of, table_of

# Codes of the export format and their labels.
STATUS = {"TK_NotStart": "Not Started", "TK_Active": "In Progress", "TK_Complete": "Complete"}
TASK_TYPE = {
    "TT_Task": "Task", "TT_Rsrc": "Resource Dependent", "TT_Mile": "Start Milestone",
    "TT_FinMile": "Finish Milestone", "TT_LOE": "Level of Effort", "TT_WBS": "WBS Summary",
}
RELATION = {"PR_FS": "FS", "PR_SS": "SS", "PR_FF": "FF", "PR_SF": "SF"}
CONSTRAINT = {
    "CS_MSO": "Start On", "CS_MSOA": "Start On or After", "CS_MSOB": "Start On or Before",
    "CS_MEO": "Finish On", "CS_MEOA": "Finish On or After", "CS_MEOB": "Finish On or Before",
    "CS_ALAP": "As Late As Possible", "CS_MANDSTART": "Mandatory Start", "CS_MANDFIN": "Mandatory Finish",
}
#: rows of the day dimension that every worker may hold
BROADCAST_DAYS = 200_000
#: files, and calendars of all files, that every worker may hold
BROADCAST_FILES = 50_000
HARD = ["CS_MSO", "CS_MEO", "CS_MSOB", "CS_MEOB", "CS_MANDSTART", "CS_MANDFIN"]
MILESTONES = ["TT_Mile", "TT_FinMile"]
SUMMARIES = ["TT_LOE", "TT_WBS"]

#: field of the export -> (column, how it is read)
PROJECT_FIELDS = {
    "proj_id": ("proj_id", "text"), "proj_short_name": ("short_name", "text"), "export_flag": ("export_flag", "text"), "clndr_id": ("clndr_id", "text"),
    "last_recalc_date": ("recalc", "moment"), "next_data_date": ("next_date", "moment"), "plan_start_date": ("plan_start", "text"), "plan_end_date": ("plan_end", "text"),
    "scd_end_date": ("scd_end", "moment"), "critical_path_type": ("critical_type", "text"), "critical_drtn_hr_cnt": ("critical_h", "text"),
}
OPTION_FIELDS = {
    "proj_id": ("proj_id", "text"), "sched_calendar_on_relationship_lag": ("lag_calendar", "text"), "sched_retained_logic": ("retained", "text"), "sched_progress_override": ("override", "text"),
    "sched_lag_early_start_flag": ("lag_early_start", "text"), "key_activity_for_multiple_longest_paths": ("key_activity", "text"), "use_total_float_multiple_longest_paths": ("use_total_float", "text"),
}
CALENDAR_FIELDS = ["clndr_id", "clndr_name", "clndr_type", "default_flag", "day_hr_cnt", "week_hr_cnt", "clndr_data"]
WBS_FIELDS = {
    "wbs_id": ("wbs_id", "text"), "proj_id": ("proj_id", "text"), "parent_wbs_id": ("parent", "text"), "wbs_short_name": ("short_name", "text"), "wbs_name": ("name", "text"),
    "proj_node_flag": ("project_node", "text"), "seq_num": ("seq", "number"),
}
TASK_FIELDS = {
    "task_id": ("task_id", "text"), "proj_id": ("proj_id", "text"), "wbs_id": ("wbs_id", "text"), "clndr_id": ("clndr_id", "text"), "task_code": ("code", "text"), "task_name": ("name", "text"),
    "task_type": ("type", "text"), "status_code": ("status", "text"), "complete_pct_type": ("pct_type", "text"), "phys_complete_pct": ("phys_pct", "number"),
    "target_drtn_hr_cnt": ("target_h", "number"), "remain_drtn_hr_cnt": ("remain_h", "number"), "total_float_hr_cnt": ("float_h", "optional"), "free_float_hr_cnt": ("free_h", "number"),
    "cstr_type": ("cstr1", "text"), "cstr_type2": ("cstr2", "text"), "cstr_date": ("cstr_date1", "moment"), "cstr_date2": ("cstr_date2", "moment"),
    "driving_path_flag": ("driving_flag", "text"), "float_path": ("float_path", "text"), "float_path_order": ("float_order", "number"),
    "act_start_date": ("act_start", "moment"), "act_end_date": ("act_end", "moment"), "early_start_date": ("early_start", "moment"), "early_end_date": ("early_end", "moment"),
    "late_start_date": ("late_start", "moment"), "late_end_date": ("late_end", "moment"), "target_start_date": ("target_start", "moment"), "target_end_date": ("target_end", "moment"),
    "restart_date": ("restart", "moment"), "reend_date": ("reend", "moment"),
}
REL_FIELDS = {
    "task_pred_id": ("rel_id", "text"), "task_id": ("succ_id", "text"), "pred_task_id": ("pred_id", "text"), "proj_id": ("succ_proj", "text"), "pred_proj_id": ("pred_proj", "text"),
    "pred_type": ("type", "text"), "lag_hr_cnt": ("lag_h", "number"),
}
RSRC_FIELDS = {"rsrc_id": ("rsrc_id", "text"), "rsrc_short_name": ("short_name", "text"), "rsrc_name": ("name", "text"), "rsrc_type": ("type", "text"), "clndr_id": ("clndr_id", "text")}
RATE_FIELDS = {"rsrc_id": ("rsrc_id", "text"), "start_date": ("start", "moment"), "max_qty_per_hr": ("limit", "number")}
ASSIGN_FIELDS = {
    "task_id": ("task_id", "text"), "rsrc_id": ("rsrc_id", "text"), "target_qty": ("target_qty", "number"), "act_reg_qty": ("reg_qty", "number"), "act_ot_qty": ("ot_qty", "number"),
    "remain_qty": ("remain_qty", "number"), "target_cost": ("target_cost", "number"), "act_reg_cost": ("reg_cost", "number"), "act_ot_cost": ("ot_cost", "number"), "remain_cost": ("remain_cost", "number"),
    "restart_date": ("restart", "moment"), "reend_date": ("reend", "moment"),
}


def _read(c: Column, how: str) -> Column:
    if how == "moment":
        return moment(c)
    if how == "number":
        return number(c)
    if how == "optional":
        return F.when(c != "", number(c))
    return c


def typed(rows: DataFrame, table: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    own = table_of(rows, table, list(fields))
    return own.select("file", "line_no", *[_read(F.col(f), how).alias(name) for f, (name, how) in fields.items()])


@dataclass
class Schedules:
    """See the module. All frames have ``file``; ``projects`` has one row per file."""

    projects: DataFrame
    tasks: DataFrame
    rels: DataFrame
    wbs: DataFrame
    calendars: DataFrame
    rsrc: DataFrame
    rates: DataFrame
    assigned: DataFrame
    all_projects: DataFrame
    headers: DataFrame | None = None
    _days: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def of(projects, options, calendars, wbs, tasks, rels, rsrc, rates, assigned, project: str | None = None, headers=None) -> Schedules:
        """From typed tables; ``calendars`` as ``calendar.calendars`` gives them."""
        # the model is read many times by each operator: it is made once, and lost executors cost nothing before it
        calendars = checkpointed(calendars.unionByName(cal.always(projects)))
        tasks = _once(stored(tasks), "file", "task_id")
        wbs = newest(wbs, "file", "wbs_id")
        rsrc = newest(rsrc, "file", "rsrc_id")
        chosen = checkpointed(_with_calendar(_with_options(choose_projects(projects, tasks, project), options), calendars))
        # a row per file or calendar: joined by a shuffle, all activities of a file would meet in one task
        few = chosen.count() <= BROADCAST_FILES and calendars.count() <= BROADCAST_FILES
        model = stored(_model_tasks(tasks, F.broadcast(chosen), F.broadcast(calendars)) if few else _model_tasks(tasks, chosen, calendars))
        # a relationship with an end that is in no table does not exist
        ids = model.select("file", "task_id")
        known = rels.join(ids.select("file", F.col("task_id").alias("succ_id")), ["file", "succ_id"], "left_semi").join(ids.select("file", F.col("task_id").alias("pred_id")), ["file", "pred_id"], "left_semi")
        return Schedules(chosen, model, stored(known), wbs, calendars, rsrc, rates, assigned, projects, headers)

    @functools.cached_property
    def per_file(self) -> DataFrame:
        """``projects``, for joins on the file alone: held by every worker while they are few."""
        return _small(self.projects)

    @property
    def mine(self) -> DataFrame:
        return self.tasks.where("mine")

    @functools.cached_property
    def span(self) -> tuple[str, str]:
        """First and last day that any date or lag of these schedules can reach."""
        dates = ["act_start", "act_end", "early_start", "early_end", "target_start", "target_end", "restart", "reend", "cstr_date1", "cstr_date2"]
        ends = lambda df, cols: df.agg(F.min(F.least(*cols)).alias("a"), F.max(F.greatest(*cols)).alias("b")).first()
        found = [ends(self.tasks, [F.col(c) for c in dates]), ends(self.assigned, [F.col("restart"), F.col("reend")]), ends(self.projects, [F.col("data_date"), F.col("scd_end")])]
        lows, highs = [r["a"] for r in found if r["a"]], [r["b"] for r in found if r["b"]]
        if not lows:
            return "2000-01-01", "2000-01-02"
        lag = self.rels.agg(F.max(F.abs("lag_h")).alias("m")).first()["m"] or 0.0
        import datetime as dt

        more = dt.timedelta(days=cal.reach(self.calendars, lag))
        low, high = min(lows).date(), max(highs).date()
        return str(max(low - more, dt.date(1, 1, 1))), str(min(high + more, dt.date(9999, 12, 31)))

    @functools.cached_property
    def gaps(self) -> DataFrame:
        """``path.gaps`` of these schedules, made once."""
        from quarrystone.operators.path import gaps

        return stored(gaps(self))

    @property
    def days(self) -> DataFrame:
        """The day dimension of all calendars over ``span``."""
        if self._days is None:
            days = checkpointed(cal.calendar_days(self.calendars, *self.span))
            # a day is some 150 bytes; with more calendars than that the joins shuffle both sides
            self._days = F.broadcast(days) if days.count() <= BROADCAST_DAYS else days
        return self._days


def _once(rows: DataFrame, *keys: str) -> DataFrame:
    """``newest`` of stored rows. Whether any keys repeat is asked of the keys alone: whole rows are shuffled only if some do."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if twice.isEmpty() else stored(newest(rows, *keys))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_FILES else df


def choose_projects(projects: DataFrame, tasks: DataFrame, wanted: str | None) -> DataFrame:
    """One project per file: the one named, by id or short name, else part of its name; else the export-flagged one with most activities."""
    counts = tasks.groupBy("file", "proj_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    rows = projects.join(counts, ["file", "proj_id"], "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)))
    if wanted:
        exact = (F.col("proj_id") == wanted) | (F.col("short_name") == wanted)
        rows = rows.withColumn("__rank", F.when(exact, 0).when(F.contains(F.lower("short_name"), F.lit(wanted.lower())), 1))
        order = [F.col("__rank").asc_nulls_last(), F.col("line_no")]
    else:
        rows = rows.withColumn("__rank", F.when(F.col("export_flag") == "Y", 0).otherwise(1))
        order = [F.col("__rank"), F.col("n_tasks").desc(), F.col("line_no")]
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where("__n = 1")
    if wanted:
        bad = first.where(F.col("__rank").isNull()).select("file").limit(1).collect()
        if bad:
            names = [r["short_name"] for r in projects.where(F.col("file") == bad[0]["file"]).orderBy("line_no").limit(100).collect()]
            raise ScheduleError(f"project {wanted!r} not in {bad[0]['file']}; projects: {', '.join(names)}")
    return first.withColumn("data_date", F.coalesce("recalc", "next_date")).drop("__rank", "__n", "line_no", "n_tasks")


def _with_options(chosen: DataFrame, options: DataFrame) -> DataFrame:
    """The options of the project, else the file's first."""
    o = options.select(F.col("file").alias("__f"), F.col("proj_id").alias("__p"), "line_no", "lag_calendar", "retained", "override", "lag_early_start", "key_activity", "use_total_float")
    joined = chosen.join(o, F.col("file") == F.col("__f"), "left")
    order = Window.partitionBy("file").orderBy((F.col("__p") == F.col("proj_id")).desc_nulls_last(), "line_no")
    return joined.withColumn("__n", F.row_number().over(order)).where("__n = 1").withColumn("has_options", F.col("__f").isNotNull()).drop("__n", "__f", "__p", "line_no")


def _with_calendar(chosen: DataFrame, calendars: DataFrame) -> DataFrame:
    """cal_id and day_hr of the project: its own calendar, else the default, else the first, else round the clock."""
    c = calendars.select(F.col("file").alias("__f"), F.col("clndr_id").alias("cal_id"), F.col("name").alias("cal_name"), F.col("day_hr").alias("project_day_hr"), "default_flag", F.col("line_no").alias("__l"))
    joined = chosen.join(c, F.col("file") == F.col("__f"), "left")
    rank = F.when(F.col("cal_id") == F.col("clndr_id"), 0).when(F.col("default_flag") == "Y", 1).when(F.col("cal_id") != cal.ALWAYS, 2).otherwise(3)
    order = Window.partitionBy("file").orderBy(rank, "__l")
    return joined.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__f", "__l", "default_flag", "clndr_id")


def _model_tasks(tasks: DataFrame, chosen: DataFrame, calendars: DataFrame) -> DataFrame:
    """Tasks with mine, data_date, cal_id, day_hr, cal_name, start, finish, complete, summary, milestone, float_d."""
    p = chosen.select("file", F.col("proj_id").alias("my_proj"), "data_date", F.col("cal_id").alias("proj_cal"), F.col("project_day_hr"), F.col("cal_name").alias("proj_cal_name"))
    c = calendars.select("file", "clndr_id", F.col("day_hr").alias("__hr"), F.col("name").alias("__name"))
    rows = tasks.join(p, "file").join(c, ["file", "clndr_id"], "left")
    own = F.col("__hr").isNotNull()
    rows = rows.withColumn("cal_id", F.when(own, F.col("clndr_id")).otherwise(F.col("proj_cal"))).withColumn("day_hr", F.when(own, F.col("__hr")).otherwise(F.col("project_day_hr"))).withColumn("cal_name", F.when(own, F.col("__name")).otherwise(F.col("proj_cal_name")))
    return rows.select(
        *tasks.columns, "my_proj", "data_date", "proj_cal", "project_day_hr", "cal_id", "cal_name", "day_hr",
        F.col("proj_id").eqNullSafe(F.col("my_proj")).alias("mine"),
        F.coalesce("act_start", "early_start", "restart").alias("start"), F.coalesce("act_end", "early_end", "reend").alias("finish"),
        F.col("status").eqNullSafe("TK_Complete").alias("complete"), F.coalesce(F.col("type").isin(SUMMARIES), F.lit(False)).alias("summary"), F.coalesce(F.col("type").isin(MILESTONES), F.lit(False)).alias("milestone"),
        (F.col("float_h") / F.col("day_hr")).alias("float_d"),
    )


def from_exports(spark: SparkSession, paths: str | list[str], project: str | None = None) -> Schedules:
    """The schedules of the export files at ``paths``."""
    from quarrystone.sources.xer import headers

    lines = read_lines(spark, paths)
    require_schedules(lines)
    rows = rows_of(lines)
    raw_calendars = newest(table_of(rows, "CALENDAR", CALENDAR_FIELDS), "file", "clndr_id")
    return Schedules.of(
        typed(rows, "PROJECT", PROJECT_FIELDS), typed(rows, "SCHEDOPTIONS", OPTION_FIELDS), cal.calendars(raw_calendars), typed(rows, "PROJWBS", WBS_FIELDS), typed(rows, "TASK", TASK_FIELDS),
        typed(rows, "TASKPRED", REL_FIELDS), typed(rows, "RSRC", RSRC_FIELDS), typed(rows, "RSRCRATE", RATE_FIELDS), typed(rows, "TASKRSRC", ASSIGN_FIELDS), project, headers(lines),
    )


def wbs_paths(wbs: DataFrame) -> DataFrame:
    """file, wbs_id, codes, names, path, depth: from below the project node down, by pointer doubling.

    Each round joins every node's known piece of path with the piece of the node it ends at, so a
    tree of depth d takes log2(d) rounds. A node that its own ancestors lead back to keeps the pieces up to there.
    ``ancestors`` lists the ids on the path, the node itself last.
    """
    # a piece is the nodes from `top` (exclusive) down to the node
    real = wbs.where(~F.coalesce(F.col("project_node") == "Y", F.lit(False))).select("file", "wbs_id", "parent", "short_name", "name")
    now = real.select("file", "wbs_id", F.array(F.struct("wbs_id", "short_name", "name")).alias("piece"), F.col("parent").alias("top"))
    for _ in range(24):  # 2^24 levels
        up = now.select(F.col("file").alias("__f"), F.col("wbs_id").alias("__w"), F.col("piece").alias("__piece"), F.col("top").alias("__top"))
        joined = now.join(up, (F.col("file") == F.col("__f")) & (F.col("top") == F.col("__w")), "left")
        # of a loop the piece already holds some of the ids above: stop before the first repeat
        ids = F.transform("piece", lambda x: x["wbs_id"])
        fresh = ~F.arrays_overlap(ids, F.transform("__piece", lambda x: x["wbs_id"]))
        grow = F.col("__w").isNotNull() & fresh
        step = joined.select("file", "wbs_id", F.when(grow, F.concat("__piece", "piece")).otherwise(F.col("piece")).alias("piece"), F.when(grow, F.col("__top")).alias("top"), grow.alias("grew"))
        step = checkpointed(step)
        grew = not step.where("grew").isEmpty()
        now = step.drop("grew")
        if not grew:
            break
    part = lambda f: F.transform("piece", lambda x: x[f])
    return now.select("file", "wbs_id", F.array_join(part("short_name"), ".").alias("codes"), F.array_join(part("name"), " > ").alias("names"), part("wbs_id").alias("ancestors"), part("short_name").alias("code_list"), part("name").alias("name_list"), F.size("piece").alias("depth"))
