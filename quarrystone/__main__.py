"""Command line: python -m quarrystone COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from quarrystone import reports
from quarrystone.operators.schedule import ScheduleError, from_exports
from quarrystone.session import session


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrystone", description="Schedules, notes and documents on Spark.")
    top.add_argument("--master", help="Spark master (default: as configured, else local[*])")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--proj", help="project id or short name")
    common.add_argument("--json", action="store_true")
    common.add_argument("--out", help="write the report to this file")
    common.add_argument("--csv", help="write each table as CSV into this folder")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, parents=(common,)):
        p = sub.add_parser(name, parents=list(parents))
        for a in arguments:
            p.add_argument(a)
        return p

    for name in ("projects", "summary", "resources", "float-paths", "digest"):
        command(name, "xer")
    p = command("activities", "xer")
    p.add_argument("--status", choices=["not_started", "active", "complete", "incomplete"])
    p.add_argument("--type", choices=["task", "milestone", "loe", "wbs"])
    p.add_argument("--wbs")
    p.add_argument("--search")
    p.add_argument("--float-lt", type=float)
    p.add_argument("--longest-path", action="store_true")
    p.add_argument("--limit", type=int, default=500)
    command("activity", "xer", "code")
    command("wbs", "xer").add_argument("--depth", type=int)
    p = command("relationships", "xer")
    p.add_argument("--code")
    p.add_argument("--limit", type=int, default=500)
    command("calendars", "xer").add_argument("--holidays", type=int)
    p = command("assignments", "xer")
    p.add_argument("--rsrc")
    p.add_argument("--limit", type=int, default=500)
    p = command("longest-path", "xer")
    p.add_argument("--to")
    p.add_argument("--near", type=float)
    p = command("dcma", "xer")
    p.add_argument("--details", type=int, default=0)
    for q in (p, command("earned-value", "xer")):
        q.add_argument("--baseline")
        q.add_argument("--bl-proj")
    p = command("diff", "old", "new")
    p.add_argument("--new-proj")
    p.add_argument("--top", type=int, default=50)
    p.add_argument("--to")
    p = command("gaps")
    p.add_argument("files", nargs="+")
    for name in ("labels", "ref", "focus", "keys", "group", "key", "search"):
        p.add_argument(f"--{name}")
    p.add_argument("--all-types", action="store_true")
    p.add_argument("--workdays", action="store_true")
    p.add_argument("--min-gap", type=float)
    p.add_argument("--shrink", type=float)
    command("export", "xer", "out_dir").add_argument("--tables")
    p = command("search", "vault", "query", parents=())
    p.add_argument("-k", type=int, default=8)
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("--alias-boost", type=float, default=2.5)
    p.add_argument("--index")
    p.add_argument("--json", action="store_true")
    p.add_argument("--show-chars", type=int, default=600)
    command("build-index", "vault", "index", parents=())
    command("audit", "vault", parents=())
    command("verify-links", "vault", parents=())
    p = command("link-hubs", "vault", parents=())
    p.add_argument("--write", action="store_true")
    p.add_argument("--from-links", action="store_true")
    p = command("view", "base", "vault", parents=())
    p.add_argument("--name")
    p = command("intake", "upload", "root", "folder", parents=())
    p.add_argument("--name")
    command("inventory", "root", parents=())
    return top


def _report(spark, a) -> reports.Report | str:
    c = a.command
    if c == "gaps":
        split = lambda x: [v.strip() for v in x.split(",")] if x else None
        return reports.milestone_gaps(spark, a.files, split(a.labels), a.ref, a.focus, split(a.keys), a.group, a.key, a.search, a.all_types, a.workdays, a.min_gap, a.shrink, a.proj)
    if c == "diff":
        return reports.comparison(from_exports(spark, a.old, a.proj), from_exports(spark, a.new, a.new_proj or a.proj), a.top, a.to)
    if c == "export":
        from quarrystone.sources.xer import export_tables

        rep = reports.Report(f"Export of {a.xer.rsplit('/', 1)[-1]}")
        rows = export_tables(spark, a.xer, a.tables.split(",") if a.tables else None, a.out_dir).collect()
        rep.add(reports.Listing(None, ["Table", "Rows", "Folder"], [[r["table"], "missing" if r["n_rows"] is None else r["n_rows"], "" if r["n_rows"] is None else f"{a.out_dir}/{r['table']}"] for r in rows]))
        return rep
    if c == "digest":
        return reports.digest(spark, a.xer)
    s = from_exports(spark, a.xer, a.proj)
    baseline = from_exports(spark, a.baseline, a.bl_proj) if getattr(a, "baseline", None) else None
    return {
        "projects": lambda: reports.projects(s), "summary": lambda: reports.summary(s), "resources": lambda: reports.resources(s), "float-paths": lambda: reports.float_paths(s),
        "activities": lambda: reports.activities(s, a.limit, status=a.status, type=a.type, wbs=a.wbs, search=a.search, float_lt=a.float_lt, on_longest_path=a.longest_path),
        "activity": lambda: reports.activity(s, a.code), "wbs": lambda: reports.wbs(s, a.depth), "relationships": lambda: reports.relationships(s, a.code, a.limit), "calendars": lambda: reports.calendars(s, a.holidays),
        "assignments": lambda: reports.assignments(s, a.rsrc, a.limit), "longest-path": lambda: reports.longest_path(s, a.to, a.near), "dcma": lambda: reports.quality(s, baseline, a.details), "earned-value": lambda: reports.earned_value(s, baseline),
    }[c]()


def _notes(spark, a) -> int:
    from pyspark.sql import functions as F

    from quarrystone.operators import links, search
    from quarrystone.sources import notes as source

    c = a.command
    if c == "search":
        chunks = search.prefiltered(source.load_chunks(spark, a.vault, a.index), a.path, a.tag)
        found = search.search(chunks, a.query, ["path", "n"], a.k, "text", "headings", "boost", a.alias_boost, keep=["title", "headings", "section", "tags", "text"]).orderBy("rank").collect()
        if a.json:
            print(json.dumps({"query": a.query, "results": [{k: r[k] for k in ("score", "path", "title", "headings", "section", "tags", "text")} for r in found]}, ensure_ascii=False, indent=2))
        for r in [] if a.json else found:
            body = " ".join(r["text"].split())
            print(f"[{r['rank']}] {r['path']}" + (f"  ›  {r['headings']}" if r["headings"] else "") + (f"  [{', '.join(r['section'])}]" if r["section"] else "") + f"   (score {r['score']})\n    {body[: a.show_chars]}" + ("…" if len(body) > a.show_chars else "") + "\n")
        return 0
    if c == "build-index":
        print(source.build_index(spark, a.vault, a.index).count(), "chunks")
        return 0
    if c == "view":
        from quarrystone.plans.bases import Base, notes_table

        text = spark.read.text(a.base, wholetext=True).first()[0]
        view = Base.of(text).view(notes_table(source.read_notes(spark, a.vault)), a.name or 0)
        view.rows(tie=["file_name"], display_names=True).show(1000, truncate=False)
        if view.spec.get("summaries"):
            view.summaries().show(1000, truncate=False)
        return 0
    rows = source.read_notes(spark, a.vault, strict=True)
    if c == "verify-links":
        bad = links.broken_links(rows).orderBy("target").collect()
        print("\n".join([f"UNRESOLVED ({len(bad)}):", *(f"  [[{r['target']}]]  <- {', '.join(r['notes'])}" for r in bad)]) if bad else "All links resolve.")
        return int(bool(bad))
    if c == "audit":
        parts = links.audit(rows)
        for name in ("unresolved", "orphans", "spread", "hubs", "copies", "unreadable"):
            found = parts[name].collect()
            print(f"{name.upper()}: {len(found)}")
            for r in sorted(map(tuple, found), key=str):
                print("  ", *r)
        return 0
    new = links.hub_additions(rows, links.hub_members(rows, a.from_links)).orderBy("hub").collect()
    for r in new:
        print(f"{r['hub']}: +{len(r['missing'])} -> {', '.join(r['missing'])}")
        if a.write:
            file = f"{a.vault.rstrip('/')}/{r['hub']}"
            text = rows.where(F.col("path") == r["hub"]).first()["text"]
            with open(file, "w", encoding="utf-8") as f:
                f.write(links.with_links_added(text, r["section"], r["missing"]))
    print("links added:" if a.write else "links that would be added (--write adds them):", sum(len(r["missing"]) for r in new))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = session(a.master, spark__ui__showConsoleProgress="false")
    try:
        if a.command == "intake":
            from quarrystone.sources.files import intake

            print(json.dumps(intake(spark, a.upload, a.root, a.folder, a.name)))
            return 0
        if a.command == "inventory":
            from quarrystone.sources.files import ingest, inventory

            rep = reports.Report("Source Inventory")
            rep.add(reports.Listing(None, ["File", "Size", "Pages", "Extract"], [list(r) for r in inventory(ingest(spark, a.root)).orderBy("file").collect()]))
            print(rep.markdown())
            return 0
        if a.command in ("search", "build-index", "audit", "verify-links", "link-hubs", "view"):
            return _notes(spark, a)
        rep = _report(spark, a)
    except ScheduleError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if not isinstance(rep, str) and a.csv:
        rep.csv(a.csv)
    text = rep if isinstance(rep, str) else rep.json() if a.json else rep.markdown()
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
