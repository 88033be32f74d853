"""Writes schedule exports for tests, and a plain model of one to compare with."""

from __future__ import annotations

import datetime as dt
import random

from quarrystone.operators.schedule import ASSIGN_FIELDS, CALENDAR_FIELDS, OPTION_FIELDS, PROJECT_FIELDS, RATE_FIELDS, REL_FIELDS, RSRC_FIELDS, TASK_FIELDS, WBS_FIELDS
from quarrystone.plans.orders_schedule import _node, _serial, _span

FIELDS = {"PROJECT": PROJECT_FIELDS, "SCHEDOPTIONS": OPTION_FIELDS, "CALENDAR": CALENDAR_FIELDS, "PROJWBS": WBS_FIELDS, "TASK": TASK_FIELDS, "TASKPRED": REL_FIELDS, "RSRC": RSRC_FIELDS, "RSRCRATE": RATE_FIELDS, "TASKRSRC": ASSIGN_FIELDS}
HOLIDAY, SATURDAY = dt.date(2024, 3, 6), dt.date(2024, 3, 16)
#: periods in seconds by week day (Monday is 0)
FIVE = {d: [(28800, 43200), (46800, 61200)] for d in range(5)} | {5: [], 6: []}
ROUND = {d: [(0, 86400)] for d in range(7)}


def calendar_data() -> str:
    work = _span(0, "08:00", "12:00") + _span(1, "13:00", "17:00")
    week = _node("DaysOfWeek", "".join(_node(str(d), work if 2 <= d <= 6 else "") for d in range(1, 8)))
    special = _node("Exceptions", _node("0", attributes=f"d|{_serial(HOLIDAY)}") + _node("1", _span(0, "09:00", "12:30"), f"d|{_serial(SATURDAY)}"))
    return _node("CalendarData", week + special)


def always_data() -> str:
    return _node("CalendarData", _node("DaysOfWeek", "".join(_node(str(d), _span(0, "00:00", "00:00")) for d in range(1, 8))))


def write(path, tables: dict[str, list[dict]], encoding: str = "cp1252", tail: str = "") -> str:
    lines = ["ERMHDR\t19.12\t2024-03-01\tProject\tadmin\tJo\tdb"]
    for name, rows in tables.items():
        fields = list(FIELDS[name])
        lines += [f"%T\t{name}", "%F\t" + "\t".join(fields)]
        lines += ["%R\t" + "\t".join(str(r.get(f, "")) for f in fields) for r in rows]
    path.write_bytes(("\r\n".join([*lines, "%E"]) + tail).encode(encoding))
    return str(path)


def periods(cal: str, day: dt.date) -> list[tuple[int, int]]:
    if cal == "2":
        return ROUND[day.weekday()]
    if day == HOLIDAY:
        return []
    return [(32400, 45000)] if day == SATURDAY else FIVE[day.weekday()]


def hours(cal: str, a: dt.datetime, b: dt.datetime) -> float:
    """Working hours, day by day."""
    if b < a:
        return -hours(cal, b, a)
    total, day = 0.0, a.date()
    while day <= b.date():
        zero = dt.datetime.combine(day, dt.time())
        for s, e in periods(cal, day):
            lo, hi = max(a, zero + dt.timedelta(seconds=s)), min(b, zero + dt.timedelta(seconds=e))
            total += max(0.0, (hi - lo).total_seconds() / 3600)
        day += dt.timedelta(days=1)
    return total


def moved(cal: str, a: dt.datetime, h: float) -> dt.datetime:
    """``a`` moved by working hours, day by day."""
    left, day, step = abs(h) * 3600, a.date(), 1 if h > 0 else -1
    for _ in range(5000):
        if not left:
            break
        zero = dt.datetime.combine(day, dt.time())
        for s, e in periods(cal, day)[::step]:
            lo, hi = zero + dt.timedelta(seconds=s), zero + dt.timedelta(seconds=e)
            lo, hi = (max(lo, a), hi) if step > 0 else (lo, min(hi, a))
            have = (hi - lo).total_seconds()
            if have <= 0:
                continue
            if have >= left:
                return lo + dt.timedelta(seconds=left) if step > 0 else hi - dt.timedelta(seconds=left)
            left -= have
        day += dt.timedelta(days=step)
    return a


def stamp(t: dt.datetime | None) -> str:
    return t.strftime("%Y-%m-%d %H:%M") if t else ""


def schedule(seed: int = 1, n: int = 40, shift: int = 0) -> dict[str, list[dict]]:
    """A random project of n activities in a chain of logic, with two calendars, lags, all relation types, constraints and resources."""
    rng = random.Random(seed)
    dd = dt.datetime(2024, 3, 4, 8) + dt.timedelta(days=shift)
    tasks, rels, at = [], [], []
    for i in range(n):
        cal = "2" if i % 7 == 3 else "1"
        preds = rng.sample(range(max(0, i - 6), i), min(i, rng.randint(0, 3)))
        start = dt.datetime(2024, 2, 26, 8) + dt.timedelta(days=rng.randint(0, 10), hours=rng.choice([0, 0, 5]))
        typed = []
        for p in preds:
            kind, lag = rng.choice(["PR_FS", "PR_FS", "PR_SS", "PR_FF", "PR_SF"]), rng.choice([0, 0, 0, 4, 16, -6, 1.5])
            typed.append((p, kind, lag))
            base = at[p][1] if kind in ("PR_FS", "PR_FF") else at[p][0]
            if kind in ("PR_FS", "PR_SS"):
                start = max(start, moved(at[p][2], base, lag))
        finish = moved(cal, start, rng.choice([8, 20, 40, 6.5]))
        at.append((start, finish, cal))
        status = "TK_Complete" if finish <= dd and rng.random() < 0.8 else "TK_Active" if start < dd and rng.random() < 0.7 else "TK_NotStart"
        kind = rng.choice(["TT_Task"] * 6 + ["TT_Mile", "TT_FinMile", "TT_Rsrc", "TT_LOE", "TT_WBS"])
        started, done = status != "TK_NotStart", status == "TK_Complete"
        cstr = rng.choice([""] * 6 + ["CS_MSO", "CS_MEO", "CS_ALAP", "CS_MSOA"])
        tasks.append({
            "task_id": 1000 + i, "proj_id": 1, "wbs_id": rng.choice([11, 12, 13, 14]), "clndr_id": cal, "task_code": f"A{i:03}", "task_name": f"ROMP {i % 4 + 1}: Étape {i} ({['NEA', 'H2C', 'PFHO'][i % 3]})", "task_type": kind, "status_code": status,
            "complete_pct_type": rng.choice(["CP_Drtn", "CP_Units", "CP_Phys"]), "phys_complete_pct": rng.randint(0, 100), "target_drtn_hr_cnt": rng.choice([0, 8, 40, 400]), "remain_drtn_hr_cnt": 0 if done else rng.choice([4, 8, 40]),
            "total_float_hr_cnt": "" if done else rng.choice(["", -8, 0, 16, 400]), "free_float_hr_cnt": 0, "cstr_type": cstr, "cstr_date": stamp(start if cstr != "CS_MEO" else finish) if cstr not in ("", "CS_ALAP") else "", "driving_path_flag": rng.choice("YN"),
            "float_path": rng.choice(["", "1", "2"]), "float_path_order": i % 5, "act_start_date": stamp(start) if started else "", "act_end_date": stamp(finish) if done else "", "early_start_date": "" if done else stamp(start if not started else max(start, dd)),
            "early_end_date": "" if done else stamp(finish), "target_start_date": stamp(start), "target_end_date": stamp(finish), "restart_date": "" if done else stamp(max(start, dd)), "reend_date": "" if done else stamp(finish),
        })
        rels += [{"task_pred_id": 10_000 + len(rels) + k, "task_id": 1000 + i, "pred_task_id": 1000 + p, "proj_id": 1, "pred_proj_id": 1, "pred_type": kind_, "lag_hr_cnt": lag} for k, (p, kind_, lag) in enumerate(typed)]
    rels.append({"task_pred_id": 99, "task_id": 1000, "pred_task_id": 77, "proj_id": 1, "pred_type": "PR_FS"})  # an end that does not exist
    assigned = [{"task_id": 1000 + i, "rsrc_id": 1 + i % 3, "target_qty": 40, "act_reg_qty": 10, "act_ot_qty": 2, "remain_qty": rng.choice([0, 16, 30]), "target_cost": 1000, "act_reg_cost": 300, "act_ot_cost": 50, "remain_cost": 500} for i in range(0, n, 2)]
    return {
        "PROJECT": [{"proj_id": 1, "proj_short_name": "Main", "export_flag": "Y", "clndr_id": "1", "last_recalc_date": stamp(dd), "critical_path_type": "CT_DrivPath"}, {"proj_id": 2, "proj_short_name": "Other", "export_flag": "N", "clndr_id": "1"}],
        "SCHEDOPTIONS": [{"proj_id": 1, "sched_calendar_on_relationship_lag": "rcal_Predecessor", "sched_retained_logic": "Y", "sched_progress_override": "N", "sched_lag_early_start_flag": "Y"}],
        "CALENDAR": [{"clndr_id": "1", "clndr_name": "Five", "clndr_type": "CA_Base", "default_flag": "Y", "day_hr_cnt": 8, "week_hr_cnt": 40, "clndr_data": calendar_data()}, {"clndr_id": "2", "clndr_name": "Round", "day_hr_cnt": 24, "week_hr_cnt": 168, "clndr_data": always_data()}, {"clndr_id": "3", "clndr_name": "Broken", "day_hr_cnt": "", "clndr_data": "(0||x"}],
        "PROJWBS": [{"wbs_id": 10, "proj_id": 1, "wbs_short_name": "Main", "wbs_name": "Main", "proj_node_flag": "Y"}, {"wbs_id": 11, "proj_id": 1, "parent_wbs_id": 10, "wbs_short_name": "A", "wbs_name": "ROMP 01", "seq_num": 2}, {"wbs_id": 12, "proj_id": 1, "parent_wbs_id": 11, "wbs_short_name": "A1", "wbs_name": "Inside", "seq_num": 1}, {"wbs_id": 13, "proj_id": 1, "parent_wbs_id": 12, "wbs_short_name": "A1a", "wbs_name": "Deep", "seq_num": 1}, {"wbs_id": 14, "proj_id": 1, "parent_wbs_id": 10, "wbs_short_name": "B", "wbs_name": "Bee", "seq_num": 1}],
        "TASK": [*tasks, {"task_id": 5000, "proj_id": 2, "task_code": "X1", "task_name": "Other", "task_type": "TT_Task", "status_code": "TK_NotStart"}], "TASKPRED": rels,
        "RSRC": [{"rsrc_id": 1, "rsrc_short_name": "L", "rsrc_name": "Labour", "rsrc_type": "RT_Labor", "clndr_id": "1"}, {"rsrc_id": 2, "rsrc_short_name": "E", "rsrc_name": "Equipment", "rsrc_type": "RT_Equip"}, {"rsrc_id": 3, "rsrc_short_name": "M", "rsrc_name": "Material", "rsrc_type": "RT_Mat"}],
        "RSRCRATE": [{"rsrc_id": 1, "start_date": "2024-01-01 00:00", "max_qty_per_hr": 1}, {"rsrc_id": 1, "start_date": "2024-02-01 00:00", "max_qty_per_hr": 0.5}, {"rsrc_id": 1, "start_date": "2024-02-01 00:00", "max_qty_per_hr": 0.25}, {"rsrc_id": 2, "start_date": "", "max_qty_per_hr": 2}],
        "TASKRSRC": assigned,
    }


def parse(s: str) -> dt.datetime | None:
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M") if s else None


def model_gaps(tables: dict) -> dict[int, float | None]:
    """Gap of each relationship whose ends exist, by the rules, one by one."""
    task = {t["task_id"]: t for t in tables["TASK"]}
    d = lambda t, *keys: next((parse(t.get(k, "")) for k in keys if t.get(k)), None)
    out = {}
    for r in tables["TASKPRED"]:
        p, s = task.get(r["pred_task_id"]), task.get(r["task_id"])
        if not p or not s:
            continue
        gap, kind, active = None, r["pred_type"], s["status_code"] == "TK_Active"
        if s["status_code"] != "TK_Complete" and s["task_type"] not in ("TT_LOE", "TT_WBS"):
            late = d(s, "early_end_date", "reend_date")
            due = d(s, "early_start_date") if kind == "PR_FS" or kind == "PR_SS" and not active else late
            if kind in ("PR_FS", "PR_FF"):
                since = d(p, "act_end_date", "early_end_date", "reend_date")
            elif p["status_code"] == "TK_Active":
                since = d(p, "early_start_date", "restart_date", "act_start_date")
            else:
                since = d(p, "act_start_date", "early_start_date", "restart_date")
            if due and since:
                lag = float(r["lag_hr_cnt"] or 0)
                gap = hours(s["clndr_id"], moved(p["clndr_id"], since, lag) if lag else since, due)
        out[r["task_pred_id"]] = gap
    return out


def model_path(tables: dict) -> set[str]:
    task = {t["task_id"]: t for t in tables["TASK"] if t["proj_id"] == 1}
    gap = model_gaps(tables)
    before: dict = {}
    for r in tables["TASKPRED"]:
        g, p = gap.get(r["task_pred_id"]), task.get(r["pred_task_id"])
        if g is not None and abs(g) <= 0.1 and p["status_code"] != "TK_Complete" and p["task_type"] != "TT_WBS" and task[r["task_id"]]["task_type"] != "TT_LOE":
            before.setdefault(r["task_id"], []).append(r["pred_task_id"])
    open_ = [t for t in task.values() if t["status_code"] != "TK_Complete" and t["task_type"] not in ("TT_LOE", "TT_WBS") and t["early_end_date"]]
    last = max(t["early_end_date"] for t in open_)
    todo, seen = [t["task_id"] for t in open_ if t["early_end_date"] == last], set()
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += before.get(x, [])
    return {task[x]["task_code"] for x in seen}
