import datetime as dt
import random

import pytest
import xer_files as x
from pyspark.sql import functions as F

from quarrystone import reports
from quarrystone.__main__ import main
from quarrystone.functions.values import loose_date, moment, tenths
from quarrystone.operators import calendar as cal
from quarrystone.operators import dcma, diff, earned, path, rollups
from quarrystone.operators.schedule import ScheduleError, from_exports, wbs_paths
from quarrystone.sources.xer import read_lines, rows_of, table_of


@pytest.fixture(scope="module")
def tables():
    return x.schedule(seed=3)


@pytest.fixture(scope="module")
def file(tmp_path_factory, tables):
    return x.write(tmp_path_factory.mktemp("xer") / "one.xer", tables)


@pytest.fixture(scope="module")
def s(spark, file):
    return from_exports(spark, file)


# ---------------------------------------------------------------- values


def test_tenths_round_as_the_exact_value_does(spark):
    rng = random.Random(0)
    xs = [0.05, 0.15, 0.25, 0.35, 0.45, 2.675, -0.05, -0.25, -0.35, 0.0, 1e13 + 0.25, 123456.75, 0.1 + 0.2, -1.05] + [k / 20 for k in range(-400, 400)] + [rng.uniform(-1e4, 1e4) for _ in range(500)] + [round(rng.uniform(-99, 99), 2) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in xs], "v double").select("v", tenths(F.col("v")).alias("r")).collect()
    assert all(r["r"] == round(r["v"], 1) for r in got), [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], 1)][:5]


def test_dates(spark):
    ok = {"2024-01-05 07:30": "2024-01-05 07:30:00", "2024-01-05 07:30:09": "2024-01-05 07:30:09", "2024-01-05": "2024-01-05 00:00:00", " 2024-1-5 ": "2024-01-05 00:00:00", "": None, "x": None, "2024": None, "2024-02-31": None, None: None}
    got = spark.createDataFrame([(k,) for k in ok], "s string").select("s", moment(F.col("s")).cast("string").alias("t")).collect()
    assert {r["s"]: r["t"] for r in got} == ok
    loose = {"45356": "2024-03-05", "45356.7": "2024-03-05", "2024-03-05": "2024-03-05", "2024-03-05 10:00": "2024-03-05", "3/5/2024": "2024-03-05", "03/05/24": "2024-03-05", "5-Mar-24": "2024-03-05", "05-mar-2024": "2024-03-05", "1/1/70": "1970-01-01", "": None, None: None}
    got = spark.createDataFrame([(k,) for k in loose], "s string").select("s", loose_date(F.col("s")).cast("string").alias("t")).collect()
    assert {r["s"]: r["t"] for r in got} == loose
    with pytest.raises(Exception, match="unrecognised date"):
        spark.createDataFrame([("soon",)], "s string").select(loose_date(F.col("s"))).collect()


# ---------------------------------------------------------------- exports


def test_malformed_exports(spark, tmp_path):
    text = "%R\tlost\n%T\tPROJECT\n%F\ta\tb\tb\n%R\t1\n%R\t2\tx\ty\tz\n\n%X\tz\n%T\tTASK\n%R\tno fields yet\n%F\tc\n%R\tÉté\x81\n%T\tPROJECT\n%F\tb\ta\n%R\tq\tr\n"
    for encoding, word in (("latin-1", "Été\x81"), ("utf-8", "Été\x81")):
        f = tmp_path / f"{encoding}.xer"
        f.write_bytes(text.encode(encoding))
        rows = rows_of(read_lines(spark, str(f)))
        p = [tuple(r)[2:] for r in table_of(rows, "PROJECT", ["a", "b", "zz"]).orderBy("line_no").collect()]
        assert p == [("1", "", ""), ("2", "y", ""), ("r", "q", "")]
        assert [r["c"] for r in table_of(rows, "TASK", ["c"]).collect()] == [word]
    (tmp_path / "w.xer").write_bytes("%T\tTASK\n%F\tc\n%R\t“x”\n".encode("cp1252"))
    assert table_of(rows_of(read_lines(spark, str(tmp_path / "w.xer"))), "TASK", ["c"]).first()["c"] == "“x”"
    with pytest.raises(ScheduleError):
        from_exports(spark, str(tmp_path / "w.xer"))


def test_projects_are_chosen(spark, file):
    assert from_exports(spark, file).projects.first()["short_name"] == "Main"
    assert from_exports(spark, file, "oth").projects.first()["short_name"] == "Other"
    assert from_exports(spark, file, "2").mine.count() == 1
    with pytest.raises(ScheduleError, match="Main, Other"):
        from_exports(spark, file, "none")


# ---------------------------------------------------------------- calendars


def test_calendar_parser():
    ok, week, special = cal.parse_calendar(x.calendar_data(), 8.0)
    assert ok and week[2] == [(28800, 43200), (46800, 61200)] and not week[1] and special == {x.HOLIDAY: [], x.SATURDAY: [(32400, 45000)]}
    for text in ("", "(0||x", "(0||CalendarData()((0||DaysOfWeek()((0||2()())))))", None):
        assert cal.parse_calendar(text, 7.5) == (False, {d: [(28800, 55800)] for d in range(2, 7)}, {})
    late = cal.parse_calendar(x.calendar_data().replace("d|", "d|x"), 8.0)
    assert not late[0] and late[1] == week and late[2] == {}


def test_working_time_matches_a_walk_through_the_days(spark, s):
    rng = random.Random(7)
    t = lambda: dt.datetime(2024, 2, 20) + dt.timedelta(minutes=rng.randint(0, 40 * 1440))
    rows = [(i, rng.choice("12"), t(), t(), rng.choice([0.0, 0.5, 4.0, 8.0, 16.0, 37.25, -1.0, -8.0, -20.5, 100.0, -64.0])) for i in range(500)]
    name = s.projects.first()["file"]
    df = spark.createDataFrame([(i, c, str(a), str(b), h) for i, c, a, b, h in rows], "i int, c string, a string, b string, h double").select("i", "c", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"), "h", F.lit(name).alias("file"))
    days = cal.calendar_days(s.calendars, "2024-01-01", "2024-12-31")
    out = {r["i"]: r for r in cal.with_added_work(cal.with_hours_between(df, days, "c", "a", "b", "hours"), days, "c", "a", "h", "to").collect()}
    for i, c, a, b, h in rows:
        assert out[i]["hours"] == pytest.approx(x.hours(c, a, b), abs=1e-9)
        assert out[i]["to"] == x.moved(c, a, h), (c, a, h)
    # without room the instant stays
    far = df.limit(1).withColumn("h", F.lit(1e6))
    r = cal.with_added_work(far, days, "c", "a", "h", "to").first()
    assert r["to"] == r["a"]


# ---------------------------------------------------------------- logic


@pytest.mark.parametrize("seed", [1, 3])
def test_gaps_and_paths_match_a_plain_model(spark, tmp_path, seed):
    tables = x.schedule(seed)
    s = from_exports(spark, x.write(tmp_path / "a.xer", tables))
    want = x.model_gaps(tables)
    got = {int(r["rel_id"]): r["gap_h"] for r in s.gaps.collect()}
    assert got.keys() == want.keys()
    for k, g in want.items():
        assert (got[k] is None) == (g is None) and (g is None or got[k] == pytest.approx(g, abs=1e-6)), k
    code = {r["task_id"]: r["code"] for r in s.tasks.collect()}
    want_path = x.model_path(tables)
    for walk in ("file", "frontier"):
        assert {code[r["node"]] for r in path.path_nodes(s, walk=walk).collect()} == want_path
    rows = path.longest_path(s).collect()
    assert {r["code"] for r in rows} == want_path and all((r["reason"] is None) == (r["driven_by"] is not None) for r in rows)
    on = {r["code"] for r in rows}
    assert all(d["code"] in on for r in rows for d in r["driven_by"] or [])


def test_named_ends(s):
    assert path.longest_path(s, "A005").where("is_end").first()["code"] == "A005"
    with pytest.raises(ScheduleError):
        path.path_nodes(s, "nowhere")


def test_wbs(s, tables):
    paths = {r["wbs_id"]: (r["codes"], r["names"], r["depth"]) for r in wbs_paths(s.wbs).collect()}
    assert paths == {"11": ("A", "ROMP 01", 1), "12": ("A.A1", "ROMP 01 > Inside", 2), "13": ("A.A1.A1a", "ROMP 01 > Inside > Deep", 3), "14": ("B", "Bee", 1)}
    rows = rollups.wbs_rollup(s).orderBy("sort_key").collect()
    assert [r["codes"] for r in rows] == ["B", "A", "A.A1", "A.A1.A1a"]
    n = lambda *ids: sum(t["wbs_id"] in ids for t in tables["TASK"] if t["proj_id"] == 1)
    assert [r["n_activities"] for r in rows] == [n(14), n(11, 12, 13), n(12, 13), n(13)]
    assert rollups.wbs_rollup(s, 1).count() == 2


def test_wbs_in_a_loop_ends(spark, s):
    loop = spark.createDataFrame([("f", 1, "a", "P", "b", "A", "a", "", 0.0), ("f", 2, "b", "P", "a", "B", "b", "", 0.0)], "file string, line_no int, wbs_id string, proj_id string, parent string, short_name string, name string, project_node string, seq double")
    assert {r["wbs_id"]: r["codes"] for r in wbs_paths(loop).collect()} == {"a": "B.A", "b": "A.B"}


def test_daily_load_and_limits(s, tables):
    from collections import defaultdict

    task = {t["task_id"]: t for t in tables["TASK"]}
    load = defaultdict(float)
    for a in tables["TASKRSRC"]:
        t = task[a["task_id"]]
        if t["status_code"] == "TK_Complete" or a["remain_qty"] <= 0 or a["rsrc_id"] == 3:
            continue
        b, e = x.parse(t["early_start_date"]), x.parse(t["early_end_date"])
        if not b or not e or e <= b or not (total := x.hours(t["clndr_id"], b, e)):
            continue
        day = b.date()
        while day <= e.date():
            zero = dt.datetime.combine(day, dt.time())
            h = x.hours(t["clndr_id"], max(b, zero), min(e, zero + dt.timedelta(days=1))) if max(b, zero) < min(e, zero + dt.timedelta(days=1)) else 0
            if h > 0:
                load[str(a["rsrc_id"]), day] += a["remain_qty"] * h / total
            day += dt.timedelta(days=1)
    got = {(r["rsrc_id"], r["day"]): r["qty"] for r in rollups.daily_load(s).collect()}
    assert got.keys() == load.keys() and all(got[k] == pytest.approx(load[k]) for k in load)
    assert {r["rsrc_id"]: r["limit"] for r in rollups.rate_limits(s).collect()} == {"1": 0.25, "2": 2.0}
    over = {r["rsrc_id"]: r for r in rollups.overallocation(s).collect()}
    cap = lambda d: 0.25 * (sum(e - b for b, e in x.periods("1", d)) / 3600 or 8)
    bad = [d for (r, d), q in load.items() if r == "1" and q > cap(d) + 1e-6]
    assert over["1"]["days_over"] == len(bad) and over["1"]["first_over"] == min(bad)


# ---------------------------------------------------------------- quality, value, comparison


def test_quality_checks(s, tables):
    got = {r["check"]: r for r in dcma.assess(s).collect()}
    mine = [t for t in tables["TASK"] if t["proj_id"] == 1]
    inc = [t for t in mine if t["status_code"] != "TK_Complete" and t["task_type"] not in ("TT_LOE", "TT_WBS")]
    hr = {"1": 8.0, "2": 24.0}
    tf = lambda t: (t["total_float_hr_cnt"] or 0) / hr[t["clndr_id"]]
    assert len(got) == 14 and got[5]["count"] == sum(t["cstr_type"] in ("CS_MSO", "CS_MEO") for t in inc)
    assert got[6]["count"] == sum(tf(t) > 44 for t in inc) and got[7]["count"] == sum(tf(t) < 0 for t in inc) and got[7]["denominator"] == len(inc)
    ids = {t["task_id"] for t in inc}
    rels = [r for r in tables["TASKPRED"][:-1] if r["task_id"] in ids or r["pred_task_id"] in ids]
    assert got[2]["count"] == sum(float(r["lag_hr_cnt"]) < 0 for r in rels) and got[2]["denominator"] == len(rels)
    for c in range(1, 12):
        n = dcma.offenders(s, c).count()
        assert n == (got[c]["denominator"] - got[c]["count"] if c == 4 else got[c]["count"]), c


def test_earned_value_adds_up(s, tables):
    rows = earned.earned_value(s).collect()
    cost = {r["scope"]: r for r in rows if r["unit"] == "cost"}
    work = [t["task_id"] for t in tables["TASK"] if t["proj_id"] == 1 and t["task_type"] not in ("TT_LOE", "TT_WBS")]
    n = sum(a["task_id"] in work for a in tables["TASKRSRC"])
    assert cost[None]["bac"] == 1000 * n and cost[None]["ac"] == 350 * n and cost[None]["cv"] == pytest.approx(cost[None]["ev"] - 350 * n)
    assert cost[None]["ev"] == pytest.approx(sum(r["ev"] for k, r in cost.items() if k)) and set(cost) - {None} <= {"A ROMP 01", "B Bee"}
    assert earned.earned_value(s, s).where("scope is null and unit = 'cost'").first()["bac"] == 1000 * n


def test_comparison_with_itself_is_empty(s):
    both = diff.compare(s, s)
    for f in (diff.milestone_movement, diff.rewritten_actuals, diff.slips, diff.duration_changes, diff.constraint_changes, diff.calendar_changes, diff.type_changes, diff.renamed, diff.added, diff.deleted):
        assert f(both).isEmpty(), f.__name__
    assert diff.logic_changes(s, s).isEmpty() and diff.path_changes(s, s, both).isEmpty()


def test_comparison_finds_what_was_changed(spark, tmp_path, s, tables):
    import copy

    new = copy.deepcopy(tables)
    t = {r["task_code"]: r for r in new["TASK"]}
    started = next(r for r in new["TASK"] if r.get("act_start_date"))
    started["act_start_date"] = "2024-01-02 08:00"
    t["A010"]["task_name"], t["A011"]["clndr_id"] = "Renamed", "2" if t["A011"]["clndr_id"] == "1" else "1"
    t["A012"]["target_drtn_hr_cnt"] = 1234
    new["TASK"] = [r for r in new["TASK"] if r["task_code"] != "A013"] + [t["A013"] | {"task_code": "NEW", "task_id": 7777}]
    gone = {t["A013"]["task_id"]}
    open_ = next(r for r in new["TASK"] if r.get("early_end_date") and r["status_code"] == "TK_NotStart" and r["task_type"] == "TT_Task" and r["task_code"] not in ("A010", "A011", "A012", "NEW"))
    open_["early_end_date"] = x.stamp(x.parse(open_["early_end_date"]) + dt.timedelta(days=14))
    rel = next(r for r in new["TASKPRED"] if not {r["task_id"], r["pred_task_id"]} & gone)
    rel["lag_hr_cnt"] = 80
    n = from_exports(spark, x.write(tmp_path / "new.xer", new))
    both = diff.compare(s, n)
    assert [r["code"] for r in diff.added(both).collect()] == ["NEW"] and [r["code"] for r in diff.deleted(both).collect()] == ["A013"]
    assert [tuple(r) for r in diff.renamed(both).collect()] == [("A010", tables["TASK"][10]["task_name"], "Renamed")]
    assert [r["code"] for r in diff.calendar_changes(both).collect()] == ["A011"] and "A012" in [r["code"] for r in diff.duration_changes(both).collect()]
    assert ("actual start", "2024-01-02 08:00") in [(r["field"], r["new"]) for r in diff.rewritten_actuals(both).collect()]
    assert {r["code"]: r["shift_d"] for r in diff.slips(both).collect()}[open_["task_code"]] > 0
    assert any(r["change"] == "changed" and "+10" in r["new"] or "+3.3" in r["new"] for r in diff.logic_changes(s, n).collect())
    text = reports.comparison(s, n).markdown()
    assert "## Renamed activities" in text and "| A010 |" in text


# ---------------------------------------------------------------- gaps


def test_milestone_gaps(spark, tmp_path):
    from quarrystone.operators import gaps

    (tmp_path / "a.csv").write_text("﻿group,MILESTONE,Date\nROMP 01,NEA,2024-01-01\nromp-1,H2C,1/11/2024\nROMP 2,NEA,2024-02-01\nROMP 2,H2C,2024-02-05\nROMP 10,NEA,45352\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Group,Milestone,Date\nROMP 1,NEA,2024-01-01\nROMP 1,H2C,2024-01-04\nROMP 2,NEA,2024-02-01\nROMP 2,H2C,2024-01-31\nROMP 10,NEA,\n")
    a, b = gaps.sheet(spark, str(tmp_path / "a.csv"), "A"), gaps.sheet(spark, str(tmp_path / "b.csv"), "B")
    dates = a.unionByName(b).drop("n")
    groups, order = gaps.groups_in_order(dates), gaps.majority_order(dates)
    assert [r["grp"] for r in groups.orderBy("g").collect()] == ["ROMP 1", "ROMP 2", "ROMP 10"] and [r["key"] for r in order.orderBy("k").collect()] == ["NEA", "H2C"]
    rows = {(r["grp"], r["label"]): r for r in gaps.compare(gaps.gap_values(dates, gaps.gap_definitions(dates, groups, order)), "A", "B", min_gap=5, shrink=4).collect()}
    one = rows["ROMP 1", "NEA to H2C"]
    assert (one["ref"], one["focus"], one["change"], one["why"]) == (10.0, 3.0, -7.0, "under 5 cd; squeezed 7 cd")
    assert rows["ROMP 2", "NEA to H2C"]["why"] == "out of sequence (new); squeezed 5 cd" and rows["ROMP 2", "NEA stagger (vs ROMP 1)"]["change"] == 0
    assert [tuple(r) for r in gaps.missing(dates).select("version", "grp", "key").collect()] == [("B", "ROMP 10", "NEA")]
    text = reports.milestone_gaps(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], min_gap=5).markdown()
    assert "| ROMP 1 | NEA to H2C | 10.0 | 3.0 | -7.0 |" in text
    with pytest.raises(ScheduleError):
        (tmp_path / "c.csv").write_text("x,y\n1,2\n")
        gaps.sheet(spark, str(tmp_path / "c.csv"), "C")


def test_milestones_of_an_export(spark, s, file, tables):
    from quarrystone.operators import gaps

    found = gaps.milestones_of(s, "v")
    want = {}
    for t in sorted(tables["TASK"], key=lambda t: t["task_code"]):
        if t.get("task_type") in ("TT_Mile", "TT_FinMile"):
            want.setdefault((f"ROMP {int(t['task_code'][1:]) % 4 + 1}", ["NEA", "H2C", "PFHO"][int(t["task_code"][1:]) % 3]), t["task_code"])
    assert {(r["grp"], r["key"]): r["code"] for r in found.where("n = 1").collect()} == want
    assert "Milestone gap check" in reports.milestone_gaps(spark, [file, file], labels=["a", "b"], workdays=True).title


# ---------------------------------------------------------------- command line


@pytest.mark.parametrize("args", [
    ["projects"], ["summary"], ["activities", "--status", "incomplete", "--limit", "3"], ["activity", "A005"], ["wbs"], ["relationships", "--code", "A005"], ["calendars", "--holidays", "2024"], ["resources"], ["assignments", "--rsrc", "lab"],
    ["longest-path", "--near", "5"], ["float-paths"], ["dcma", "--details", "2"], ["earned-value"],
])
def test_commands_report(spark, file, capsys, args):
    assert main([args[0], file, *args[1:]]) == 0
    assert capsys.readouterr().out.startswith("# ")


def test_output_forms(spark, file, tmp_path, capsys):
    import json

    assert main(["projects", file, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["sections"][1]["rows"][0]["Short name"] == "Main"
    assert main(["wbs", file, "--csv", str(tmp_path / "c"), "--out", str(tmp_path / "r.md")]) == 0
    assert (tmp_path / "c/WBS_Main.csv").read_bytes().startswith(b"\xef\xbb\xbfWBS,Name") and (tmp_path / "r.md").read_text().startswith("# WBS")
    assert main(["activity", file, "nothing like it"]) == 2
    assert main(["export", file, str(tmp_path / "x"), "--tables", "task,NONE"]) == 0
    out = capsys.readouterr().out
    assert "| TASK | 41 |" in out and "| NONE | missing |" in out
    r = reports.Report("T")
    r.add(reports.Listing("H", ["a"], [["x|y\nz"], [None]]))
    r.add(reports.Listing(None, ["a"], []))
    assert "| x\\|y z |" in r.markdown() and "_None._" in r.markdown()
