"""The star tables read as a schedule: orders are activities, a customer's next order follows the one before.

So the schedule operators can be run, and checked against SQL, over tables of any size. Two versions
(``old``, ``new``) of the same orders make an update to compare with. ``sql(version)`` is the
same mapping for DuckDB, written on its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators import calendar as cal
from quarrystone.operators.schedule import Schedules
from quarrystone.session import stored

DATA_DATE = {"old": "1998-07-01 00:00:00", "new": "1998-08-01 00:00:00"}
CLOSED, HALF = dt.date(1996, 12, 25), dt.date(1997, 7, 5)


def _serial(d: dt.date) -> int:
    return (d - dt.date(1899, 12, 30)).days


def _node(name: str, children: str = "", attributes: str = "") -> str:
    return f"(0||{name}({attributes})({children}))"


def _span(i: int, start: str, end: str) -> str:
    return _node(str(i), attributes=f"s|{start}|f|{end}")


def calendar_rows() -> list[tuple]:
    """A week of five days of eight hours with two exceptions, and one that never rests."""
    work = _span(0, "08:00", "12:00") + _span(1, "13:00", "17:00")
    week = _node("DaysOfWeek", "".join(_node(str(d), work if 2 <= d <= 6 else "") for d in range(1, 8)))
    special = _node("Exceptions", _node("0", attributes=f"d|{_serial(CLOSED)}") + _node("1", _span(0, "08:00", "12:00"), f"d|{_serial(HALF)}"))
    always = _node("DaysOfWeek", "".join(_node(str(d), _span(0, "00:00", "00:00")) for d in range(1, 8)))
    return [("1", 1, "Five days", "CA_Base", "Y", "8", "40", _node("CalendarData", week + special)), ("2", 2, "Always", "CA_Base", "N", "24", "168", _node("CalendarData", always))]


def _choice(k: Column, cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both versions are made of, stored: the orders with their customer's order before."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_orderdate").cast("date").alias("d"))
    nation = t("customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"))
    b = o.join(lines, "k", "left").join(nation, "c", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hour = lambda day, h: F.timestamp_add("HOUR", F.lit(h), day.cast("timestamp_ntz"))
    b = b.withColumn("s0", hour(F.col("d"), 8)).withColumn("f0", hour(F.date_add("d", F.col("n").cast("int")), 17))
    before = Window.partitionBy("c").orderBy("d", "k")
    return stored(b.withColumn("pf", F.lag("f0").over(before)).withColumn("pk", F.lag("k").over(before)))


def schedule(spark: SparkSession, sf_dir: str, version: str = "old", orders: DataFrame | None = None) -> Schedules:
    """The schedule of a version; ``orders`` is what ``base`` gave, where two versions share it."""
    b, k, new = base(spark, sf_dir) if orders is None else orders, F.col("k"), version == "new"
    shift = F.when(k % 13 == 0, k % 5).otherwise(0).cast("int") if new else F.lit(0)
    moved = lambda c, days: F.timestamp_add("DAY", days, c)
    start = moved(F.when((k % 2 == 0) & F.col("pf").isNotNull(), F.col("pf")).otherwise(F.col("s0")), shift)
    status = F.when(F.col("st") == "F", "TK_Complete").when(F.col("st") == "P", "TK_Active").otherwise("TK_NotStart")
    if new:
        status = F.when((F.col("st") == "O") & (k % 37 == 0), "TK_Active").when((F.col("st") == "P") & (k % 37 == 1), "TK_Complete").when((F.col("st") == "F") & (k % 371 == 2), "TK_Active").otherwise(status)
    gone = (k % 17 == 0) if new else (k % 31 == 0)
    b = b.where(~gone).withColumn("s", start).withColumn("f", moved(F.col("f0"), shift)).withColumn("status", status)
    text = F.lit("")
    none = F.lit(None).cast("timestamp_ntz")
    started, done = F.col("status") != "TK_NotStart", F.col("status") == "TK_Complete"
    act_start = moved(F.col("s"), F.when(k % 23 == 0, -1).otherwise(0)) if new else F.col("s")
    target = F.col("n") * 40.0 + (F.when(k % 43 == 0, 8.0).otherwise(0.0) if new else 0.0)
    held = k % 40
    tasks = b.select(
        F.lit(version).alias("file"), k.alias("line_no"), k.cast("string").alias("task_id"), F.lit("P").alias("proj_id"), F.concat(F.lit("N"), F.col("nation").cast("string")).alias("wbs_id"),
        _choice(k, [(k % (14 if new else 7) == 0, "2")], "1").alias("clndr_id"), F.concat(F.lit("A"), k.cast("string")).alias("code"),
        F.concat(F.lit("Order "), k.cast("string"), F.lit(" ["), "pr", F.lit("]"), F.when(k % 19 == 0, F.lit(" revised")).otherwise("") if new else text).alias("name"),
        _choice(k, [(k % 20 == 0, "TT_Mile"), (k % 20 == 1, "TT_FinMile"), (k % 50 == 2, "TT_LOE"), (k % 10 == 3, "TT_Rsrc")], "TT_Task").alias("type"), "status",
        _choice(k, [(k % 3 == 0, "CP_Drtn"), (k % 3 == 1, "CP_Units")], "CP_Phys").alias("pct_type"), (k % 101).cast("double").alias("phys_pct"),
        target.alias("target_h"), F.when(done, 0.0).when(F.col("status") == "TK_Active", target / 2).otherwise(target).alias("remain_h"),
        F.when(k % 11 != 0, (k % 97 - 20) * 8.0).alias("float_h"), F.lit(0.0).alias("free_h"),
        _choice(k, [(held == 5, "CS_MSO"), (held == 6, "CS_MEOB"), (held == 7, "CS_ALAP"), (held == 8, "CS_MSOA")], "").alias("cstr1"), text.alias("cstr2"),
        F.when(held.isin(5, 8), F.col("s")).when(held == 6, F.col("f")).alias("cstr_date1"), none.alias("cstr_date2"),
        F.when(k % 9 == 0, "Y").otherwise("N").alias("driving_flag"), F.when(k % 30 == 0, (k % 7).cast("string")).otherwise("").alias("float_path"), (k % 100).cast("double").alias("float_order"),
        F.when(started, act_start).alias("act_start"), F.when(done, F.col("f")).alias("act_end"), F.when(~done, F.col("s")).alias("early_start"), F.when(~done, F.col("f")).alias("early_end"),
        none.alias("late_start"), none.alias("late_end"), F.col("s0").alias("target_start"), F.col("f0").alias("target_end"), none.alias("restart"), none.alias("reend"),
    )
    lag = F.when(k % 6 == 0, 16.0).when(k % 12 == 1, -8.0).otherwise(0.0) + (F.when(k % 29 == 0, 8.0).otherwise(0.0) if new else 0.0)
    rels = b.where(F.col("pk").isNotNull()).select(
        F.lit(version).alias("file"), k.alias("line_no"), k.cast("string").alias("rel_id"), k.cast("string").alias("succ_id"), F.col("pk").cast("string").alias("pred_id"), F.lit("P").alias("succ_proj"), F.lit("P").alias("pred_proj"),
        _choice(k, [(k % 25 == 9, "PR_SF"), (k % 5 == 3, "PR_SS"), (k % 5 == 4, "PR_FF")], "PR_FS").alias("type"), lag.alias("lag_h"),
    )
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    node = lambda df, id_, parent, name, flag: df.select(F.lit(version).alias("file"), F.lit(0).alias("line_no"), id_.alias("wbs_id"), F.lit("P").alias("proj_id"), parent.alias("parent"), id_.alias("short_name"), name.alias("name"), F.lit(flag).alias("project_node"), F.lit(0.0).alias("seq"))
    region, nation = t("region"), t("nation")
    rid = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    wbs = node(region, rid("r_regionkey"), F.lit("ROOT"), F.col("r_name"), "N").unionByName(node(nation, F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), rid("n_regionkey"), F.col("n_name"), "N"))
    wbs = wbs.unionByName(node(spark.range(1), F.lit("ROOT"), F.lit(""), F.lit("Orders"), "Y"))
    s = F.col("s_suppkey")
    rsrc = t("supplier").select(F.lit(version).alias("file"), s.alias("line_no"), s.cast("string").alias("rsrc_id"), F.concat(F.lit("S"), s.cast("string")).alias("short_name"), F.col("s_name").alias("name"), _choice(s, [(s % 5 == 0, "RT_Mat"), (s % 5 == 1, "RT_Equip")], "RT_Labor").alias("type"), F.lit("1").alias("clndr_id"))
    rates = t("supplier").select(F.lit(version).alias("file"), s.alias("line_no"), s.cast("string").alias("rsrc_id"), F.explode(F.array(F.struct(F.lit("1996-01-01").alias("d"), (s % 4).cast("double").alias("l")), F.struct(F.lit("1997-01-01").alias("d"), (s % 3 * 2).cast("double").alias("l")))).alias("x"))
    rates = rates.select("file", "line_no", "rsrc_id", F.col("x.d").cast("timestamp_ntz").alias("start"), F.col("x.l").alias("limit"))
    state = b.select("k", "status")
    lines = t("lineitem").join(state, F.col("l_orderkey") == F.col("k"))
    part = F.when(F.col("status") == "TK_Complete", 1.0).when(F.col("status") == "TK_Active", 0.5).otherwise(0.0)
    assigned = lines.select(
        F.lit(version).alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_suppkey").cast("string").alias("rsrc_id"),
        F.col("l_quantity").alias("target_qty"), (F.col("l_quantity") * part).alias("reg_qty"), F.lit(0.0).alias("ot_qty"), (F.col("l_quantity") * (1 - part)).alias("remain_qty"),
        F.col("l_extendedprice").alias("target_cost"), (F.col("l_extendedprice") * part * (1 + F.col("l_tax"))).alias("reg_cost"), F.lit(0.0).alias("ot_cost"), (F.col("l_extendedprice") * (1 - part)).alias("remain_cost"), none.alias("restart"), none.alias("reend"),
    )
    raw = spark.createDataFrame(calendar_rows(), "clndr_id string, line_no int, clndr_name string, clndr_type string, default_flag string, day_hr_cnt string, week_hr_cnt string, clndr_data string").withColumn("file", F.lit(version))
    projects = spark.createDataFrame([(version, 1, "P", "Orders", "Y", "1", "", "", "CT_DrivPath", "0")], "file string, line_no int, proj_id string, short_name string, export_flag string, clndr_id string, plan_start string, plan_end string, critical_type string, critical_h string")
    projects = projects.withColumns({"recalc": F.lit(DATA_DATE[version]).cast("timestamp_ntz"), "next_date": none, "scd_end": none})
    options = spark.createDataFrame([(version, 1, "P", "rcal_Predecessor", "Y", "N", "N", "", "N")], "file string, line_no int, proj_id string, lag_calendar string, retained string, override string, lag_early_start string, key_activity string, use_total_float string")
    return Schedules.of(projects, options, cal.calendars(raw), wbs, tasks, rels, rsrc, rates, assigned)


# ---------------------------------------------------------------- the same in SQL


def sql(version: str = "old", name: str = "t") -> str:
    """CTEs {name}_tasks, {name}_rels, {name}_asg (and cd, the calendars' days) for DuckDB."""
    new = version == "new"
    shift = "CASE WHEN k % 13 = 0 THEN k % 5 ELSE 0 END" if new else "0"
    status = "CASE st WHEN 'F' THEN 'TK_Complete' WHEN 'P' THEN 'TK_Active' ELSE 'TK_NotStart' END"
    if new:
        status = f"CASE WHEN st = 'O' AND k % 37 = 0 THEN 'TK_Active' WHEN st = 'P' AND k % 37 = 1 THEN 'TK_Complete' WHEN st = 'F' AND k % 371 = 2 THEN 'TK_Active' ELSE {status} END"
    act = "s - to_days(CAST(CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS INT))" if new else "s"
    target = "n * 40.0" + (" + CASE WHEN k % 43 = 0 THEN 8.0 ELSE 0.0 END" if new else "")
    lag = "CASE WHEN k % 6 = 0 THEN 16.0 WHEN k % 12 = 1 THEN -8.0 ELSE 0.0 END" + (" + CASE WHEN k % 29 = 0 THEN 8.0 ELSE 0.0 END" if new else "")
    return f"""
    {name}_b0 AS (
      SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS d, coalesce(li.n, 0) AS n, c_nationkey AS nation,
             CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR AS s0, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_days(CAST(coalesce(li.n, 0) AS INT)) + INTERVAL 17 HOUR AS f0
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) li ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    ),
    {name}_b1 AS (SELECT *, lag(f0) OVER w AS pf, lag(k) OVER w AS pk FROM {name}_b0 WINDOW w AS (PARTITION BY c ORDER BY d, k)),
    {name}_b AS (
      SELECT *, (CASE WHEN k % 2 = 0 AND pf IS NOT NULL THEN pf ELSE s0 END) + to_days(CAST({shift} AS INT)) AS s, f0 + to_days(CAST({shift} AS INT)) AS f, {status} AS status
      FROM {name}_b1 WHERE k % {17 if new else 31} <> 0
    ),
    {name}_tasks AS (
      SELECT *, 'A' || k AS code, 'Order ' || k || ' [' || pr || ']'{" || CASE WHEN k % 19 = 0 THEN ' revised' ELSE '' END" if new else ''} AS name,
        CASE WHEN k % {14 if new else 7} = 0 THEN '2' ELSE '1' END AS cal, CASE WHEN k % {14 if new else 7} = 0 THEN 24.0 ELSE 8.0 END AS day_hr,
        CASE WHEN k % 20 = 0 THEN 'TT_Mile' WHEN k % 20 = 1 THEN 'TT_FinMile' WHEN k % 50 = 2 THEN 'TT_LOE' WHEN k % 10 = 3 THEN 'TT_Rsrc' ELSE 'TT_Task' END AS type,
        {target} AS target_h, CASE WHEN k % 11 <> 0 THEN (k % 97 - 20) * 8.0 END AS float_h,
        CASE k % 40 WHEN 5 THEN 'CS_MSO' WHEN 6 THEN 'CS_MEOB' WHEN 7 THEN 'CS_ALAP' WHEN 8 THEN 'CS_MSOA' ELSE '' END AS cstr,
        CASE WHEN k % 40 IN (5, 8) THEN s WHEN k % 40 = 6 THEN f END AS cstr_date,
        CASE WHEN status <> 'TK_NotStart' THEN {act} END AS act_start, CASE WHEN status = 'TK_Complete' THEN f END AS act_end,
        CASE WHEN status <> 'TK_Complete' THEN s END AS early_start, CASE WHEN status <> 'TK_Complete' THEN f END AS early_end,
        status = 'TK_Complete' AS complete, k % 20 <> 0 AND k % 20 <> 1 AND k % 50 = 2 AS summary, k % 20 IN (0, 1) AS milestone,
        TIMESTAMP '{DATA_DATE[version]}' AS dd
      FROM {name}_b
    ),
    {name}_t AS (SELECT *, coalesce(act_start, early_start) AS start, coalesce(act_end, early_end) AS finish, float_h / day_hr AS float_d FROM {name}_tasks),
    {name}_rels AS (
      SELECT a.k AS succ, a.pk AS pred, CASE WHEN a.k % 25 = 9 THEN 'PR_SF' WHEN a.k % 5 = 3 THEN 'PR_SS' WHEN a.k % 5 = 4 THEN 'PR_FF' ELSE 'PR_FS' END AS type, {lag.replace('k %', 'a.k %')} AS lag_h
      FROM {name}_b a JOIN {name}_b p ON a.pk = p.k
    ),
    {name}_asg AS (
      SELECT l_orderkey AS k, l_suppkey AS r, l_quantity AS tq, l_quantity * part AS aq, l_quantity * (1 - part) AS rq, l_extendedprice AS tc, l_extendedprice * part * (1 + l_tax) AS ac, l_extendedprice * (1 - part) AS rc
      FROM lineitem JOIN (SELECT k, CASE status WHEN 'TK_Complete' THEN 1.0 WHEN 'TK_Active' THEN 0.5 ELSE 0.0 END AS part FROM {name}_b) ON k = l_orderkey
    )"""


DAYS_SQL = f"""
    cd0 AS (
      SELECT id, CAST(g.d AS DATE) AS d, CASE WHEN id = '2' THEN 86400 WHEN CAST(g.d AS DATE) = DATE '{CLOSED}' THEN 0 WHEN CAST(g.d AS DATE) = DATE '{HALF}' THEN 14400 WHEN isodow(g.d) <= 5 THEN 28800 ELSE 0 END AS sec
      FROM (VALUES ('1'), ('2')) c(id), generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', INTERVAL 1 DAY) g(d)
    ),
    cd AS (SELECT *, sum(sec) OVER (PARTITION BY id ORDER BY d) - sec AS cum FROM cd0)"""


def worked_sql(calendar: str, at: str) -> str:
    """Working seconds before an instant, as a scalar subquery over cd."""
    tod = f"(epoch({at}) - epoch(CAST({at} AS DATE)))"
    part = f"CASE WHEN cd.id = '2' THEN {tod} WHEN cd.sec = 0 THEN 0 ELSE greatest(0, least({tod}, 43200) - 28800) + CASE WHEN cd.sec = 28800 THEN greatest(0, least({tod}, 61200) - 46800) ELSE 0 END END"
    return f"(SELECT CAST(cd.cum AS DOUBLE) + {part} FROM cd WHERE cd.id = {calendar} AND cd.d = CAST({at} AS DATE))"


def hours_sql(calendar: str, a: str, b: str) -> str:
    return f"(({worked_sql(calendar, b)} - {worked_sql(calendar, a)}) / 3600.0)"


def gaps_sql(name: str = "t") -> str:
    """CTE {name}_gaps: succ, pred, type, lag_h, gap_h, for the CTEs of ``sql``."""
    return f"""
    {name}_r0 AS (
      SELECT r.*, p.cal AS p_cal, s.cal AS s_cal, p.complete AS p_complete, p.type AS p_type, s.type AS s_type, s.complete OR s.summary AS idle, p.day_hr AS p_day_hr, s.day_hr AS s_day_hr, p.code AS p_code, s.code AS s_code,
        CASE WHEN s.complete OR s.summary THEN NULL WHEN r.type = 'PR_FS' THEN s.early_start WHEN r.type = 'PR_SS' THEN CASE WHEN s.status <> 'TK_Active' THEN s.early_start ELSE s.early_end END ELSE s.early_end END AS due,
        CASE WHEN r.type IN ('PR_FS', 'PR_FF') THEN p.finish ELSE p.start END AS since
      FROM {name}_rels r JOIN {name}_t p ON p.k = r.pred JOIN {name}_t s ON s.k = r.succ
    ),
    {name}_r1 AS (SELECT *, {worked_sql('p_cal', 'since')} + lag_h * 3600 AS target FROM {name}_r0),
    {name}_r2 AS (
      SELECT r.*, cd.d AS rd, r.target - cd.cum AS rest, cd.id AS rid FROM {name}_r1 r
      LEFT JOIN cd ON r.lag_h <> 0 AND cd.id = r.p_cal AND cd.sec > 0 AND CASE WHEN r.lag_h > 0 THEN cd.cum < r.target AND r.target <= cd.cum + cd.sec ELSE cd.cum <= r.target AND r.target < cd.cum + cd.sec END
    ),
    {name}_r3 AS (
      SELECT *, CASE WHEN rd IS NULL THEN since ELSE CAST(rd AS TIMESTAMP) + to_seconds(CASE WHEN rid = '2' THEN rest WHEN lag_h > 0 THEN CASE WHEN rest <= 14400 THEN 28800 + rest ELSE 46800 + rest - 14400 END ELSE CASE WHEN rest < 14400 THEN 28800 + rest ELSE 46800 + rest - 14400 END END) END AS ready
      FROM {name}_r2
    ),
    {name}_gaps AS (SELECT *, {hours_sql('s_cal', 'ready', 'due')} AS gap_h FROM {name}_r3)"""
