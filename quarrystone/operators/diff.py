"""Comparison of two updates of a schedule.

Both updates' activities meet once, in a full outer join on the activity code
(``compare``); every section is a filter and a projection of it. Relationships meet in a
second full outer join on (predecessor, successor).

Of activities that share a code the last in the file counts. Working-day shifts are on
the new update's project calendar, durations and floats in days of each side's own calendars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.values import elapsed_days, instant, labelled, tenths
from quarrystone.operators import calendar as cal
from quarrystone.operators import path
from quarrystone.operators.rollups import finish_dates
from quarrystone.operators.schedule import CONSTRAINT, RELATION, STATUS, TASK_TYPE, Schedules

COLUMNS = [
    "name", "type", "status", "complete", "summary", "milestone", "start", "finish", "act_start", "act_end", "float_d", "target_h", "day_hr", "cal_name", "cstr1", "cstr2", "cstr_date1", "cstr_date2",
]

def _shift(df: DataFrame, new: Schedules, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: working days from a to b on the new update's project calendar, in tenths."""
    p = new.projects.first()
    rows = cal.with_hours_between(df.withColumn("file", F.lit(p["file"])).withColumn("__pair_cal", F.lit(p["cal_id"])), new.days, "__pair_cal", a, b, "__h")
    return rows.withColumn(out, tenths(F.col("__h") / F.lit(p["project_day_hr"]))).drop("__h", "__pair_cal", "file")


def compare(old: Schedules, new: Schedules) -> DataFrame:
    """code, a_... (old) and b_... (new) columns, in_old, in_new, shift_d (finish, working days in tenths)."""

    def side(s: Schedules, name: str) -> DataFrame:
        one = s.mine.groupBy("code").agg(F.max_by(F.struct(*COLUMNS), "line_no").alias("v"))
        return one.select(F.col("code").alias("code"), *[F.col(f"v.{c}").alias(f"{name}_{c}") for c in COLUMNS], F.lit(True).alias(f"in_{name}"))

    both = side(old, "a").join(side(new, "b"), "code", "full_outer").na.fill(False, ["in_a", "in_b"])
    return _shift(both, new, "a_finish", "b_finish", "shift_d").withColumnsRenamed({"in_a": "in_old", "in_b": "in_new"})


def headline(old: Schedules, new: Schedules, both: DataFrame) -> DataFrame:
    """One row: data dates, forecast finishes and their shift, numbers of activities."""
    n = both.agg(F.count_if("in_old").alias("n_old"), F.count_if("in_new").alias("n_new"), F.count_if(~F.col("in_old")).alias("n_added"), F.count_if(~F.col("in_new")).alias("n_deleted"))
    one = n
    for name, x in (("old", old), ("new", new)):
        p = x.projects.join(finish_dates(x), "file").select("data_date", "finish").first()
        one = one.withColumn(f"{name}_data_date", instant(p["data_date"])).withColumn(f"{name}_finish", instant(p["finish"]))
    one = _shift(one, new, "old_finish", "new_finish", "shift_wd")
    days = lambda x, y: tenths(elapsed_days(F.col(x), F.col(y)))
    return one.withColumn("shift_cd", days("old_finish", "new_finish")).withColumn("data_date_cd", days("old_data_date", "new_data_date"))


def _common(both: DataFrame) -> DataFrame:
    return both.where("in_old and in_new")


def milestone_movement(both: DataFrame) -> DataFrame:
    """Milestones (of either update) that moved; order by size of the shift, then code."""
    return _common(both).where((F.col("a_milestone") | F.col("b_milestone")) & (F.col("shift_d") != 0)).select("code", F.col("b_name").alias("name"), F.col("a_finish").alias("old_finish"), F.col("b_finish").alias("new_finish"), "shift_d", F.col("a_float_d").alias("old_float_d"), F.col("b_float_d").alias("new_float_d"))


def path_changes(old: Schedules, new: Schedules, both: DataFrame, to: str | None = None) -> DataFrame:
    """code, name, change (joined or left), floats: what only one update has on its longest path; joined come first, then by code."""

    def on(s: Schedules, name: str) -> DataFrame:
        codes = s.tasks.join(path.path_nodes(s, to).withColumnRenamed("node", "task_id"), ["file", "task_id"], "left_semi")
        return codes.select("code").distinct().withColumn(name, F.lit(True))

    only = on(old, "__a").join(on(new, "__b"), "code", "full_outer").where(F.col("__a").isNull() | F.col("__b").isNull())
    rows = only.join(both, "code", "left")
    return rows.select("code", F.coalesce("b_name", "a_name").alias("name"), F.when(F.col("__b").isNotNull(), "joined").otherwise("left").alias("change"), F.col("a_float_d").alias("old_float_d"), F.col("b_float_d").alias("new_float_d"))


def _dates(old: Schedules, new: Schedules) -> tuple:
    return old.projects.first()["data_date"], new.projects.first()["data_date"]


def planned(old: Schedules, new: Schedules, both: DataFrame) -> DataFrame:
    """What the old update forecast to finish by the new data date, with achieved; nothing unless both have a data date."""
    a, b = _dates(old, new)
    rows = _common(both)
    if not (a and b):
        return rows.limit(0).withColumn("achieved", F.lit(False))
    return rows.where(~F.col("a_complete") & (F.col("a_finish") <= instant(b)) & ~F.col("a_summary")).withColumn("achieved", F.col("b_complete"))


def progress(old: Schedules, new: Schedules, both: DataFrame) -> DataFrame:
    """One row: n_planned, n_achieved, n_started, n_finished."""
    n = planned(old, new, both).agg(F.count(F.lit(1)).alias("n"), F.count_if("achieved").alias("done")).first()
    started = lambda c: F.col(c).isin("TK_Active", "TK_Complete")
    q = _common(both).agg(F.count_if(~started("a_status") & started("b_status")).alias("n_started"), F.count_if(~F.col("a_complete") & F.col("b_complete")).alias("n_finished"))
    return q.select(F.lit(n["n"]).alias("n_planned"), F.lit(n["done"]).alias("n_achieved"), "n_started", "n_finished")


def missed(old: Schedules, new: Schedules, both: DataFrame) -> DataFrame:
    return planned(old, new, both).where(~F.col("achieved")).select("code", F.col("b_name").alias("name"), F.col("a_finish").alias("old_finish"), F.col("b_finish").alias("new_finish"), labelled(F.col("b_status"), STATUS).alias("status_label"))


def rewritten_actuals(both: DataFrame) -> DataFrame:
    """code, name, field, old, new: actual dates that the new update has otherwise or no longer, and completions taken back."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")

    def date(field: str, c: str) -> Column:
        changed = F.col(f"a_{c}").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        return F.when(changed, F.struct(F.lit(field).alias("field"), when(f"a_{c}").alias("old"), F.coalesce(when(f"b_{c}"), F.lit("(removed)")).alias("new")))

    undone = F.when(F.col("a_complete") & ~F.col("b_complete"), F.struct(F.lit("status").alias("field"), F.lit("Complete").alias("old"), labelled(F.col("b_status"), STATUS).alias("new")))
    found = F.array_compact(F.array(date("actual start", "act_start"), date("actual finish", "act_end"), undone))
    return _common(both).select("code", F.col("b_name").alias("name"), F.explode(found).alias("x")).select("code", "name", "x.*")


def slips(both: DataFrame, least: float = 0.5) -> DataFrame:
    """Activities still open that moved by at least ``least`` working days; order by shift, largest first."""
    rows = _common(both).where(~F.col("b_complete") & ~F.col("b_summary") & (F.abs("shift_d") >= least) & (F.col("shift_d") != 0))
    change = F.coalesce("b_float_d", F.lit(0.0)) - F.coalesce("a_float_d", F.lit(0.0))
    return rows.select("code", F.col("b_name").alias("name"), F.col("a_finish").alias("old_finish"), F.col("b_finish").alias("new_finish"), "shift_d", F.col("a_float_d").alias("old_float_d"), F.col("b_float_d").alias("new_float_d"), change.alias("float_change_d"))


def duration_changes(both: DataFrame) -> DataFrame:
    a, b = F.col("a_target_h") / F.col("a_day_hr"), F.col("b_target_h") / F.col("b_day_hr")
    rows = _common(both).where(F.abs(a - b) >= 0.05)
    return rows.select("code", F.col("b_name").alias("name"), a.alias("old_d"), b.alias("new_d"), (b - a).alias("change_d"), labelled(F.col("b_status"), STATUS).alias("status_label"))


def _constraints(side: str) -> Column:
    day = lambda i: F.coalesce(F.date_format(f"{side}_cstr_date{i}", "yyyy-MM-dd"), F.lit(""))
    one = lambda i: F.when(F.col(f"{side}_cstr{i}") != "", F.concat(labelled(F.col(f"{side}_cstr{i}"), CONSTRAINT), F.lit(" "), day(i)))
    text = F.concat_ws("; ", one(1), one(2))
    return F.when(text == "", "none").otherwise(text)


def constraint_changes(both: DataFrame) -> DataFrame:
    parts = lambda s: [F.coalesce(F.col(f"{s}_cstr1"), F.lit("")), F.coalesce(F.col(f"{s}_cstr2"), F.lit("")), F.col(f"{s}_cstr_date1").cast("date"), F.col(f"{s}_cstr_date2").cast("date")]
    same = F.lit(True)
    for x, y in zip(parts("a"), parts("b"), strict=True):
        same = same & x.eqNullSafe(y)
    return _common(both).where(~same).select("code", F.col("b_name").alias("name"), _constraints("a").alias("old"), _constraints("b").alias("new"))


def calendar_changes(both: DataFrame) -> DataFrame:
    return _common(both).where(~F.col("a_cal_name").eqNullSafe(F.col("b_cal_name"))).select("code", F.col("b_name").alias("name"), F.col("a_cal_name").alias("old"), F.col("b_cal_name").alias("new"))


def type_changes(both: DataFrame) -> DataFrame:
    return _common(both).where(~F.col("a_type").eqNullSafe(F.col("b_type"))).select("code", F.col("b_name").alias("name"), labelled(F.col("a_type"), TASK_TYPE).alias("old"), labelled(F.col("b_type"), TASK_TYPE).alias("new"))


def renamed(both: DataFrame) -> DataFrame:
    return _common(both).where(~F.col("a_name").eqNullSafe(F.col("b_name"))).select("code", F.col("a_name").alias("old"), F.col("b_name").alias("new"))


def logic_changes(old: Schedules, new: Schedules) -> DataFrame:
    """pred, succ, change (added, deleted, changed), old, new: the relationships (type and lag in days) of each pair of activities.

    Of relationships of the same pair and type the last in the file counts.
    """

    def side(s: Schedules, name: str) -> DataFrame:
        r = path.ends_of(s).where(F.col("p_mine") | F.col("s_mine"))
        one = r.groupBy(F.col("p_code").alias("pred"), F.col("s_code").alias("succ"), F.col("rel_type").alias("type")).agg(F.max_by(tenths(F.col("lag_h") / F.col("p_day_hr")), "line_no").alias("lag"))
        return one.groupBy("pred", "succ").agg(F.array_sort(F.collect_list(F.struct("type", "lag"))).alias(name))

    def text(c: str) -> Column:
        signed = lambda x: F.concat(F.when(x > 0, "+").otherwise(""), F.regexp_replace(x.cast("string"), r"\.0$", ""))
        one = lambda x: F.concat(labelled(x["type"], RELATION), F.when(x["lag"] != 0, F.concat(F.lit(" "), signed(x["lag"]))).otherwise(""))
        return F.coalesce(F.array_join(F.transform(c, one), ", "), F.lit("-"))

    both = side(old, "a").join(side(new, "b"), ["pred", "succ"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed")
    return both.select("pred", "succ", change.alias("change"), text("a").alias("old"), text("b").alias("new"))


def added(both: DataFrame) -> DataFrame:
    return both.where("not in_old").select("code", F.col("b_name").alias("name"), F.col("b_start").alias("start"), F.col("b_finish").alias("finish"), (F.col("b_target_h") / F.col("b_day_hr")).alias("target_d"))


def deleted(both: DataFrame) -> DataFrame:
    return both.where("not in_new").select("code", F.col("a_name").alias("name"), labelled(F.col("a_status"), STATUS).alias("status_label"), F.col("a_finish").alias("old_finish"))
