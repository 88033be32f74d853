"""Relationship gaps, driving logic and the longest path.

*Gap* of a relationship: how many working hours its successor waits beyond what the
relationship asks for. It is computed for every relationship at once, by the joins of
``calendar``. A gap within ``TOLERANCE`` is driving.

*Longest path*: everything that the ends lead back to along driving relationships.
While no file has more than ``WALK_EDGES`` driving relationships, as counted, the walk is done
per file (files in parallel); beyond that it goes round by round over the whole
cluster. ``walk`` ("file", "frontier") names one of the two, which give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.values import labelled
from quarrystone.operators import calendar as cal
from quarrystone.operators.reach import reached
from quarrystone.operators.schedule import CONSTRAINT, RELATION, SUMMARIES, ScheduleError, Schedules
from quarrystone.session import checkpointed, ship

#: hours
TOLERANCE = 0.1
#: driving relationships of one file that one task may hold
WALK_EDGES = 1_000_000

ship(__name__)

PRED = ["code", "name", "type", "status", "start", "finish", "early_start", "restart", "cal_id", "day_hr", "complete", "mine", "proj_id"]
SUCC = [*PRED, "early_end", "reend", "summary"]


def ends_of(s: Schedules) -> DataFrame:
    """Relationships with both ends' columns, as p_... and s_..., and the options that matter."""
    side = lambda name, cols: s.tasks.select(F.col("file").alias(f"{name}_file"), F.col("task_id").alias(f"{name}_task"), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    p, q = side("p", PRED), side("s", SUCC)
    o = s.per_file.select("file", "lag_calendar", "retained", "override", "lag_early_start", F.col("cal_id").alias("project_cal"), "has_options")
    rows = s.rels.withColumnRenamed("type", "rel_type")
    rows = rows.join(p, (F.col("file") == F.col("p_file")) & (F.col("pred_id") == F.col("p_task")))
    rows = rows.join(q, (F.col("file") == F.col("s_file")) & (F.col("succ_id") == F.col("s_task")))
    return rows.drop("p_file", "s_file").join(o, "file")


def gaps(s: Schedules) -> DataFrame:
    """``ends_of`` with gap_h (null where the relationship can't hold anything), driving and violated."""
    r = ends_of(s)
    rel = F.when(F.col("rel_type") == "", "PR_FS").otherwise(F.col("rel_type"))
    active = F.col("s_status") == "TK_Active"
    retained = F.coalesce(F.when(F.col("retained") == "", "Y").otherwise(F.col("retained")), F.lit("Y")) == "Y"
    retained = retained & ~F.coalesce(F.col("override") == "Y", F.lit(False))
    held_finish = F.coalesce("s_early_end", "s_reend")
    # what the relationship holds: the start; of a started successor what is left of it, if logic is retained
    due = (
        F.when(rel == "PR_FS", F.when(~active | retained, F.col("s_early_start")))
        .when(rel == "PR_SS", F.when(~active, F.col("s_early_start")).when(retained, held_finish))
        .otherwise(held_finish)
    )
    lag_start = F.when((F.col("p_status") == "TK_Active") & (F.col("lag_early_start") == "Y"), F.coalesce("p_early_start", "p_restart", "p_start")).otherwise(F.col("p_start"))
    since = F.when(rel.isin("PR_FS", "PR_FF"), F.col("p_finish")).otherwise(lag_start)
    lag_cal = (
        F.when(F.col("lag_calendar") == "rcal_Successor", F.col("s_cal_id")).when(F.col("lag_calendar") == "rcal_24Hour", F.lit(cal.ALWAYS))
        .when(F.col("lag_calendar") == "rcal_ProjDefault", F.col("project_cal")).otherwise(F.col("p_cal_id"))
    )
    holds = ~F.col("s_complete") & ~F.col("s_summary")
    r = r.withColumn("__due", F.when(holds, due)).withColumn("__since", F.when(holds & due.isNotNull(), since)).withColumn("__lag_cal", lag_cal)
    r = cal.with_added_work(r, s.days, "__lag_cal", "__since", "lag_h", "__ready")
    r = cal.with_hours_between(r, s.days, "s_cal_id", "__ready", "__due", "gap_h")
    near = F.coalesce(F.abs("gap_h") <= TOLERANCE, F.lit(False))
    return r.withColumn("driving", near).withColumn("violated", F.coalesce(F.col("gap_h") < -TOLERANCE, F.lit(False))).drop("__due", "__since", "__ready", "__lag_cal")


def driving_edges(s: Schedules, gap: DataFrame | None = None) -> DataFrame:
    """file, src (successor), dst (driving predecessor), rel_type, lag_h, p_code, p_day_hr."""
    g = s.gaps if gap is None else gap
    held = F.col("driving") & ~F.col("p_complete") & (F.col("p_type") != "TT_WBS") & (F.col("s_type") != "TT_LOE")
    return g.where(held).select("file", F.col("succ_id").alias("src"), F.col("pred_id").alias("dst"), "rel_type", "lag_h", "p_code", "p_day_hr")


def default_ends(s: Schedules) -> DataFrame:
    """file, node: the incomplete activities that finish last, all that tie."""
    open_ = s.mine.where(~F.col("complete") & ~F.col("summary") & F.col("early_end").isNotNull()).select("file", "task_id", "early_end")
    last = open_.groupBy("file").agg(F.max("early_end").alias("last"))
    return open_.join(last, "file").where(F.col("early_end") == F.col("last")).select("file", F.col("task_id").alias("node"))


def named_ends(s: Schedules, code: str) -> DataFrame:
    """file, node of the activity with a code: of several the last in the file. An error where a file has none."""
    hits = s.mine.where(F.col("code") == code).groupBy("file").agg(F.max_by("task_id", "line_no").alias("node"))
    lacking = s.projects.select("file", "short_name").join(hits, "file", "left_anti").limit(1).collect()
    if lacking:
        raise ScheduleError(f"activity {code!r} not found in {lacking[0]['short_name']}")
    return hits


def _walk(seeds: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one file that the seeds lead to."""
    after: dict[str, list[str]] = {}
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        after.setdefault(a, []).append(b)
    seen = set(seeds["node"])
    todo = list(seen)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    file = seeds["file"].iloc[0] if len(seeds) else ""
    return pd.DataFrame({"file": [file] * len(seen), "node": sorted(seen)})


def path_nodes(s: Schedules, to: str | None = None, walk: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """file, node: the activities on the longest path to the ends (or to the activity ``to``)."""
    edges = driving_edges(s) if edges is None else edges
    seeds = named_ends(s, to) if to else default_ends(s)
    if walk is None:
        most = edges.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        walk = "file" if most <= WALK_EDGES else "frontier"
    if walk == "frontier":
        return reached(edges, seeds, ["file"]).select("file", "node")
    # both sides stem from the same tables: the keys are named anew, so that each is known for its own
    left, right = seeds.select(F.col("file").alias("file"), "node"), edges.select(F.col("file").alias("of"), "src", "dst")
    return checkpointed(left.groupBy("file").cogroup(right.groupBy("of")).applyInPandas(_walk, "file string, node string"))


def with_reasons(s: Schedules, tasks: DataFrame) -> DataFrame:
    """Adds ``reason``: why an activity without a driving predecessor starts when it does (eight cases, the first that fits)."""
    t = tasks.withColumn("__when1", _held_by(1)).withColumn("__when2", _held_by(2))
    for i in (1, 2):
        t = cal.with_hours_between(t, s.days, "cal_id", f"cstr_date{i}", f"__when{i}", f"__off{i}")
    t = cal.with_hours_between(t, s.days, "cal_id", "data_date", "early_start", "__off0")
    has_pred = s.rels.select("file", F.col("succ_id").alias("task_id")).distinct().withColumn("__pred", F.lit(True))
    t = t.join(has_pred, ["file", "task_id"], "left")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    by = lambda i: F.concat(F.lit("constraint: "), labelled(F.col(f"cstr{i}"), CONSTRAINT), F.lit(" "), day(F.col(f"cstr_date{i}")))
    near = lambda i: F.coalesce(F.abs(f"__off{i}") <= TOLERANCE, F.lit(False))
    reason = (
        F.when(F.col("type") == "TT_LOE", "level of effort (its dates follow the activities it spans)")
        .when(F.coalesce((F.col("cstr1") == "CS_ALAP") | (F.col("cstr2") == "CS_ALAP"), F.lit(False)), "As Late As Possible (scheduled back from its successor)")
        .when(F.col("status") == "TK_Active", F.concat(F.lit("in progress (started "), day(F.col("act_start")), F.lit("; remaining duration drives finish)")))
        .when(near(1), by(1))
        .when(near(2), by(2))
        .when(near(0), F.concat(F.lit("data date ("), day(F.col("data_date")), F.lit(")")))
        .when(F.col("__pred").isNull(), "no predecessor (open start)")
        .otherwise("unexplained gap (check external dates, leveling, or out-of-sequence progress)")
    )
    return t.withColumn("reason", reason).drop("__when1", "__when2", "__off0", "__off1", "__off2", "__pred")


def _held_by(i: int) -> Column:
    """The date that a start or finish constraint holds, where the activity starts at all."""
    c = F.col(f"cstr{i}")
    return F.when(F.col("early_start").isNull(), F.lit(None).cast("timestamp_ntz")).when(c.isin("CS_MSO", "CS_MSOA", "CS_MANDSTART"), F.col("early_start")).when(c.isin("CS_MEO", "CS_MEOA", "CS_MANDFIN"), F.col("early_end"))


def longest_path(s: Schedules, to: str | None = None, walk: str | None = None) -> DataFrame:
    """The activities on the path with their columns, driven_by (array of structs code, rel, lag_d), reason (of those without), is_end.

    Order them by start, then finish, nulls last.
    """
    edges = driving_edges(s)
    nodes = path_nodes(s, to, walk, edges)
    drivers = edges.groupBy("file", F.col("src").alias("task_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("p_code").alias("code"), labelled(F.col("rel_type"), RELATION).alias("rel"), (F.col("lag_h") / F.col("p_day_hr")).alias("lag_d")))).alias("driven_by")
    )
    seeds = (named_ends(s, to) if to else default_ends(s)).select("file", F.col("node").alias("task_id"), F.lit(True).alias("__end"))
    on = s.tasks.join(nodes.select("file", F.col("node").alias("task_id")), ["file", "task_id"], "left_semi")
    on = on.join(drivers, ["file", "task_id"], "left").join(seeds, ["file", "task_id"], "left")
    reasoned = with_reasons(s, on)
    return reasoned.withColumn("reason", F.when(F.col("driven_by").isNull(), F.col("reason"))).withColumn("is_end", F.col("__end").isNotNull()).drop("__end")


def flag_agreement(s: Schedules, nodes: DataFrame) -> DataFrame:
    """file, both, only_here, only_flagged: the path against the flags that the export carries for incomplete activities."""
    flags = s.mine.where((F.col("driving_flag") == "Y") & ~F.col("complete")).select("file", F.col("task_id").alias("node"), F.lit(True).alias("flag"))
    both = nodes.withColumn("here", F.lit(True)).join(flags, ["file", "node"], "full_outer")
    here, flag = F.col("here").isNotNull(), F.col("flag").isNotNull()
    return both.groupBy("file").agg(F.count_if(here & flag).alias("both"), F.count_if(here & ~flag).alias("only_here"), F.count_if(~here & flag).alias("only_flagged"))


def near_longest(s: Schedules, nodes: DataFrame, within: float) -> DataFrame:
    """Incomplete activities off the path whose float is at most the path's least float (none counts as 0) plus ``within`` days."""
    on = s.tasks.join(nodes.select("file", F.col("node").alias("task_id")), ["file", "task_id"], "left_semi")
    least = on.groupBy("file").agg(F.min(F.coalesce("float_d", F.lit(0.0))).alias("__least"))
    off = s.mine.where(~F.col("complete") & ~F.col("summary") & F.col("float_d").isNotNull()).join(nodes.select("file", F.col("node").alias("task_id")), ["file", "task_id"], "left_anti")
    return off.join(least, "file").where(F.col("float_d") <= F.col("__least") + within).drop("__least")


def float_paths(s: Schedules) -> DataFrame:
    """Activities with a float-path number: path, place (by order, then start), least_float_d (of the path) and the activity's columns."""
    rows = s.mine.where(F.col("float_path") != "").withColumn("path", F.coalesce(F.trim("float_path").try_cast("double"), F.lit(0.0)).cast("int"))
    of = Window.partitionBy("file", "path")
    rows = rows.withColumn("least_float_d", F.min(F.coalesce("float_d", F.lit(0.0))).over(of))
    return rows.withColumn("place", F.row_number().over(of.orderBy("float_order", F.col("start").asc_nulls_last(), "line_no")))
