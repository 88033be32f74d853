"""Earned value by project and by top-level WBS element.

Per activity: the budget (BAC), its planned (PV), earned (EV) and actual (AC) part
and the cost to complete (ETC), for cost and for quantity; then one aggregation with
grouping sets. The planned part grows linearly in working time from the baseline's start to
its finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators import calendar as cal
from quarrystone.operators.dcma import baseline_keys, baseline_of
from quarrystone.operators.schedule import Schedules, wbs_paths

MEASURES = ["bac", "pv", "ev", "ac", "etc"]


def activity_values(s: Schedules, baseline: Schedules | None = None) -> DataFrame:
    """file, task_id, wbs_id, pct, planned and bac, pv, ev, ac, etc for cost and (with _q) quantity; summary activities left out."""
    total = lambda *c: F.sum(sum(F.col(x) for x in c))
    sums = s.assigned.groupBy("file", "task_id").agg(
        F.sum("target_cost").alias("cost"), F.sum("target_qty").alias("qty"), total("reg_cost", "ot_cost").alias("ac"), total("reg_qty", "ot_qty").alias("ac_q"), F.sum("remain_cost").alias("etc"), F.sum("remain_qty").alias("etc_q")
    )
    t = s.mine.where(~F.col("summary")).join(sums, ["file", "task_id"], "left").na.fill(0.0, ["cost", "qty", "ac", "ac_q", "etc", "etc_q"])
    has_budgets = bool(baseline) and not baseline.assigned.join(baseline.mine.select("file", "task_id"), ["file", "task_id"], "left_semi").isEmpty()
    t = t.join(baseline_of(s, baseline), baseline_keys(baseline), "left")
    zero = F.lit(0.0)
    pct = (
        F.when(F.col("complete"), 1.0)
        .when(F.col("pct_type") == "CP_Drtn", F.when(F.col("target_h") != 0, F.greatest(zero, (F.col("target_h") - F.col("remain_h")) / F.col("target_h"))).otherwise(zero))
        .when(F.col("pct_type") == "CP_Units", F.coalesce(F.col("ac_q") / F.nullif(F.col("ac_q") + F.col("etc_q"), zero), zero))
        .otherwise(F.col("phys_pct") / 100.0)
    )
    t = cal.with_hours_between(t, s.days, "cal_id", "bl_start", "bl_finish", "__span")
    t = cal.with_hours_between(t, s.days, "cal_id", "bl_start", "data_date", "__gone")
    dated = F.col("bl_start").isNotNull() & F.col("bl_finish").isNotNull() & F.col("data_date").isNotNull()
    planned = (
        F.when(~dated, zero).when(F.col("data_date") >= F.col("bl_finish"), 1.0)
        .when(F.col("data_date") > F.col("bl_start"), F.when(F.col("__span") > 0, F.col("__gone") / F.col("__span")).otherwise(1.0)).otherwise(zero)
    )
    # an activity that the baseline lacks keeps its own budget
    budget = lambda own, bl: F.coalesce(F.col(bl), F.col(own)) if has_budgets else F.col(own)
    t = t.withColumns({"pct": pct, "planned": planned, "bac": budget("cost", "bl_cost"), "bac_q": budget("qty", "bl_qty")})
    value = lambda q: [(F.col("bac" + q) * F.col("planned")).alias("pv" + q), (F.col("bac" + q) * F.col("pct")).alias("ev" + q)]
    return t.select("file", "task_id", "wbs_id", "pct", "planned", "bac", "bac_q", *value(""), *value("_q"), "ac", "ac_q", "etc", "etc_q")


def earned_value(s: Schedules, baseline: Schedules | None = None) -> DataFrame:
    """file, scope (null: the project), unit (cost or quantity), the measures and cv, sv, cpi, spi, eac_cpi, eac_etc.

    A scope is the code of the top-level WBS element, with its name where it stands below the project node, or '(root)'.
    Scopes without budget and actuals in a unit have no row for it. Indices with a zero denominator are null.
    """
    top = wbs_paths(s.wbs).select("file", "wbs_id", F.get("code_list", 0).alias("top"), F.get("ancestors", 0).alias("top_id"))
    nodes = s.wbs.where(F.col("project_node") == "Y").select("file", F.col("wbs_id").alias("parent"))
    known = s.wbs.join(s.projects.select("file", "proj_id"), ["file", "proj_id"], "left_semi").join(nodes, ["file", "parent"], "left_semi")
    known = known.groupBy("file", F.col("short_name").alias("top")).agg(F.min_by("name", "line_no").alias("top_name"))
    v = activity_values(s, baseline).join(top, ["file", "wbs_id"], "left").join(known, ["file", "top"], "left")
    label = F.when(F.col("top_name").isNotNull(), F.concat("top", F.lit(" "), "top_name")).when(F.coalesce("top", F.lit("")) == "", "(root)").otherwise(F.col("top"))
    each = F.explode(F.array(F.struct(F.lit("cost").alias("unit"), *MEASURES), F.struct(F.lit("quantity").alias("unit"), *[F.col(m + "_q").alias(m) for m in MEASURES])))
    rows = v.select("file", label.alias("scope"), each.alias("v")).select("file", "scope", "v.*")
    sums = [F.sum(m).alias(m) for m in MEASURES]
    by = rows.groupingSets([["file", "unit", "scope"], ["file", "unit"]], "file", "unit", "scope").agg(*sums)
    ratio = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    cpi = ratio(c("ev"), c("ac"))
    return by.where((c("bac") != 0) | (c("ac") != 0)).select(
        "file", "scope", "unit", *MEASURES, (c("ev") - c("ac")).alias("cv"), (c("ev") - c("pv")).alias("sv"), cpi.alias("cpi"), ratio(c("ev"), c("pv")).alias("spi"),
        F.when(cpi != 0, c("bac") / cpi).alias("eac_cpi"), (c("ac") + c("etc")).alias("eac_etc"),
    )
