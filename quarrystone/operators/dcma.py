"""The 14-point schedule-quality assessment.

``assess`` gives 14 rows per file; ``offenders`` lists what fails a check. All counts come
from a few aggregates over flagged activities and relationships, so the cost is that of the
scans and of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.values import labelled, tenths
from quarrystone.operators import calendar as cal
from quarrystone.operators import path
from quarrystone.operators.schedule import HARD, RELATION, Schedules
from quarrystone.session import stored

# Number, name, threshold of each check.
CHECKS = {
    1: ("Logic (missing predecessor or successor)", "<= 5%"),
    2: ("Leads (negative lag)", "0%"),
    3: ("Lags (positive lag)", "<= 5%"),
    4: ("Relationship types (FS share)", ">= 90% FS"),
    5: ("Hard constraints", "<= 5%"),
    6: ("High float (> 44 wd)", "<= 5%"),
    7: ("Negative float", "0%"),
    8: ("High duration (original > 44 wd)", "<= 5%"),
    9: ("Invalid dates (actuals after / forecasts before data date)", "0%"),
    10: ("Resources (tasks with duration but no assignment)", "0%"),
    11: ("Missed tasks (finished late or not at all vs baseline)", "<= 5%"),
    12: ("Critical path test (driving chain reaches data date)", "pass/fail"),
    13: ("CPLI (critical path length index)", ">= 0.95"),
    14: ("BEI (baseline execution index)", ">= 0.95"),
}
LONG = 44.0
#: beginnings of the reasons with which a driving chain may rightly start
SOUND = ["data date", "in progress", "level of effort", "As Late"]
TASK_CHECKS = [1, 5, 6, 7, 8, 9, 10, 11]
REL_CHECKS = [2, 3, 4]


def baseline_of(s: Schedules, baseline: Schedules | None) -> DataFrame:
    """code, bl_start, bl_finish, bl_cost, bl_qty from the baseline's one schedule; else, with file, from each schedule's own planned dates.

    Of activities that share a code the last counts.
    """
    src = baseline or s
    sums = src.assigned.groupBy("file", "task_id").agg(F.sum("target_cost").alias("c"), F.sum("target_qty").alias("q"))
    start, finish = ("start", "finish") if baseline else ("target_start", "target_end")
    rows = src.mine.join(sums, ["file", "task_id"], "left").select("file", "code", "line_no", F.struct(F.col(start).alias("bl_start"), F.col(finish).alias("bl_finish"), F.coalesce("c", F.lit(0.0)).alias("bl_cost"), F.coalesce("q", F.lit(0.0)).alias("bl_qty")).alias("v"))
    last = rows.groupBy("file", "code").agg(F.max_by("v", "line_no").alias("v")).select("file", "code", "v.*")
    return last.drop("file") if baseline else last


def baseline_keys(baseline: Schedules | None) -> list[str]:
    """What activities and baseline are joined on: one baseline serves every file."""
    return ["code"] if baseline else ["file", "code"]


def flagged_tasks(s: Schedules, baseline: Schedules | None = None) -> DataFrame:
    """The project's activities with a boolean c1, c5, ... for each check on activities, and what the counts need."""
    inc = ~F.col("complete") & ~F.col("summary")
    work = inc & ~F.col("milestone")
    mark = lambda df, key, name: df.select("file", F.col(key).alias("task_id")).distinct().withColumn(name, F.lit(True))
    t = s.mine.join(mark(s.rels, "succ_id", "__p"), ["file", "task_id"], "left").join(mark(s.rels, "pred_id", "__s"), ["file", "task_id"], "left").join(mark(s.assigned, "task_id", "__a"), ["file", "task_id"], "left")
    t = t.join(path.default_ends(s).select("file", F.col("node").alias("task_id"), F.lit(True).alias("__end")), ["file", "task_id"], "left")
    far = F.coalesce("start", F.lit("9999-12-31").cast("timestamp_ntz"))
    first = s.mine.where(inc).groupBy("file").agg(F.min(far).alias("__first"))
    t = t.join(first, "file", "left").join(baseline_of(s, baseline), baseline_keys(baseline), "left").withColumn("__bl", F.col("bl_cost").isNotNull())
    no_p = inc & F.col("__p").isNull() & (far != F.col("__first"))
    no_s = inc & F.col("__s").isNull() & F.col("__end").isNull()
    dd = F.col("data_date")
    yes = lambda c: F.coalesce(c, F.lit(False))
    wrong = yes(F.col("act_start") > dd) | yes(F.col("act_end") > dd) | yes((F.col("status") == "TK_NotStart") & (F.col("early_start") < dd)) | yes((F.col("status") == "TK_Active") & (F.col("early_end") < dd))
    due = ~F.col("summary") & yes(F.col("bl_finish") <= dd)
    float_d = F.coalesce("float_d", F.lit(0.0))
    flags = {
        "inc": inc, "work": work, "no_p": no_p, "no_s": no_s, "c1": no_p | no_s, "c5": inc & (yes(F.col("cstr1").isin(HARD)) | yes(F.col("cstr2").isin(HARD))),
        "c6": inc & (float_d > LONG), "c7": inc & (float_d < 0), "c8": work & (F.col("target_h") / F.col("day_hr") > LONG), "c9": wrong, "c10": work & (F.col("target_h") > 0) & F.col("__a").isNull(),
        "due": due, "c11": due & (F.col("act_end").isNull() | (F.col("act_end").cast("date") > F.col("bl_finish").cast("date"))),
        "done": ~F.col("summary") & yes(F.col("act_end") <= dd) & F.col("__bl"), "loaded": F.col("__a").isNotNull(),
    }
    return t.withColumns(flags)


def flagged_rels(s: Schedules, tasks: DataFrame) -> DataFrame:
    """Relationships with an incomplete activity at either end, with c2, c3, c4."""
    inc = tasks.where("inc").select("file", "task_id", F.lit(True).alias("__i"))
    r = s.rels.join(inc.select("file", F.col("task_id").alias("succ_id"), F.col("__i").alias("__x")), ["file", "succ_id"], "left").join(inc.select("file", F.col("task_id").alias("pred_id"), F.col("__i").alias("__y")), ["file", "pred_id"], "left")
    return r.where(F.col("__x").isNotNull() | F.col("__y").isNotNull()).withColumns({"c2": F.col("lag_h") < 0, "c3": F.col("lag_h") > 0, "c4": F.col("type") != "PR_FS"}).drop("__x", "__y")


def _days_text(x: Column) -> Column:
    return F.format_string("%.1f", tenths(x))


def assess(s: Schedules, baseline: Schedules | None = None) -> DataFrame:
    """file, check, name, count, denominator (null for the last two indices), value (of the indices), threshold, passed, note."""
    t = stored(flagged_tasks(s, baseline))
    n = lambda c: F.count_if(F.col(c)).alias(c)
    a = t.groupBy("file").agg(*[n(c) for c in ("inc", "work", "no_p", "no_s", "c1", "c5", "c6", "c7", "c8", "c9", "c10", "due", "c11", "done", "loaded")], F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("c7"), F.col("float_d"))).alias("worst"), F.count_if(F.col("due") & F.col("act_end").isNotNull()).alias("due_done"))
    r = flagged_rels(s, t).groupBy("file").agg(F.count(F.lit(1)).alias("rels"), n("c2"), n("c3"), n("c4"))
    on = stored(path.longest_path(s))
    sound = F.coalesce(F.col("reason").rlike("^(" + "|".join(SOUND) + ")"), F.lit(True))
    starts = on.groupBy("file").agg(F.count_distinct(F.when(~sound, F.col("reason"))).alias("c12"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("starts"))
    # of activities that tie at the end the first in the file is measured
    end = on.where("is_end").groupBy("file").agg(F.min_by(F.struct("finish", "float_d"), "line_no").alias("e"))
    p = s.projects.select("file", "data_date", "cal_id", "project_day_hr").join(end, "file", "left").withColumn("__f", F.col("e.finish"))
    p = cal.with_hours_between(p, s.days, "cal_id", "data_date", "__f", "__h").withColumn("cpl", F.col("__h") / F.col("project_day_hr"))
    p = p.withColumn("cpli", F.when(F.col("cpl") > 0, (F.col("cpl") + F.coalesce(F.col("e.float_d"), F.lit(0.0))) / F.col("cpl")))
    p = p.select("file", "cpl", "cpli", F.col("e").isNotNull().alias("has_end"), F.col("e.float_d").alias("end_float"))
    x = s.projects.select("file").join(a, "file", "left").join(r, "file", "left").join(starts, "file", "left").join(p, "file", "left")
    x = x.na.fill(0, [c for c, k in x.dtypes if k == "bigint"])
    col = F.col
    pct = lambda c, d: F.when(col(d) > 0, 100.0 * col(c) / col(d)).otherwise(0.0)
    bei = F.when(col("due") > 0, col("done") / col("due"))
    few = lambda c, d: pct(c, d) <= 5
    text = F.lit
    rows = [
        (1, col("c1"), col("inc"), few("c1", "inc"), F.format_string("%d without predecessor, %d without successor (project start/finish excused)", "no_p", "no_s")),
        (2, col("c2"), col("rels"), col("c2") == 0, text("")),
        (3, col("c3"), col("rels"), few("c3", "rels"), text("")),
        (4, col("rels") - col("c4"), col("rels"), F.when(col("rels") > 0, 100.0 * (col("rels") - col("c4")) / col("rels")).otherwise(0.0) >= 90, F.format_string("%d non-FS relationships", "c4")),
        (5, col("c5"), col("inc"), few("c5", "inc"), text("Start/Finish On, On or Before, Mandatory")),
        (6, col("c6"), col("inc"), few("c6", "inc"), text("")),
        (7, col("c7"), col("inc"), col("c7") == 0, F.when(col("c7") > 0, F.concat(text("worst "), _days_text(col("worst")), text(" wd"))).otherwise("")),
        (8, col("c8"), col("work"), few("c8", "work"), text("")),
        (9, col("c9"), col("n"), col("c9") == 0, text("")),
        (10, col("c10"), col("work"), col("c10") == 0, F.when(col("loaded") > 0, "").otherwise("schedule is not resource-loaded at all")),
        (11, col("c11"), col("due"), few("c11", "due"), text("")),
        (12, col("c12"), F.lit(1).cast("long"), col("c12") == 0, F.when(F.coalesce(col("starts"), text("")) != "", F.concat(text("path starts at: "), "starts")).otherwise("no incomplete path")),
        (13, None, None, F.coalesce(col("cpli") >= 0.95, F.lit(False)), F.when(col("has_end"), F.concat(text("CPL "), F.coalesce(_days_text(col("cpl")), text("")), text(" wd, finish TF "), F.coalesce(_days_text(col("end_float")), text("")), text(" wd"))).otherwise("")),
        (14, None, None, F.coalesce(bei >= 0.95, F.lit(False)), F.format_string("%d completed / %d due by data date (%d of the due ones finished)", "done", "due", "due_done")),
    ]
    none = F.lit(None).cast("long")
    value = {13: col("cpli"), 14: bei}
    parts = F.array(*[
        F.struct(F.lit(i).alias("check"), F.lit(CHECKS[i][0]).alias("name"), (none if c is None else c.cast("long")).alias("count"), (none if d is None else d.cast("long")).alias("denominator"), value.get(i, F.lit(None).cast("double")).alias("value"), F.lit(CHECKS[i][1]).alias("threshold"), ok.alias("passed"), note.alias("note"))
        for i, c, d, ok, note in rows
    ])
    return x.select("file", F.explode(parts).alias("r")).select("file", "r.*")


def offenders(s: Schedules, check: int, baseline: Schedules | None = None) -> DataFrame:
    """The activities (or relationships, for checks 2 to 4) that count against a check; empty for 12 to 14."""
    t = flagged_tasks(s, baseline)
    if check in REL_CHECKS:
        code = s.tasks.select("file", "task_id", "code", "day_hr")
        r = flagged_rels(s, t).where(F.col(f"c{check}"))
        r = r.join(code.select("file", F.col("task_id").alias("pred_id"), F.col("code").alias("pred_code"), "day_hr"), ["file", "pred_id"]).join(code.select("file", F.col("task_id").alias("succ_id"), F.col("code").alias("succ_code")), ["file", "succ_id"])
        return r.select("file", "line_no", "pred_code", labelled(F.col("type"), RELATION).alias("rel"), "succ_code", (F.col("lag_h") / F.col("day_hr")).alias("lag_d"))
    if check in TASK_CHECKS:
        return t.where(F.col(f"c{check}"))
    return t.limit(0)
