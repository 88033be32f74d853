"""Ingest, canvases, templates, pages, streaming."""

import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import html, template
from quarrystone.operators import canvas
from quarrystone.sources import files
from quarrystone.streaming import refresh


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


S, R = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = {
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Tag</t></si><si><r><t>Pump </t></r><r><t>1</t></r></si></sst>", "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c></row><row><c/></row><row><c><v>4.5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
}
PPTX = {"ppt/slides/slide10.xml": "<a:t>ten</a:t>", "ppt/slides/slide2.xml": "<x><a:t> two </a:t><a:t>more</a:t></x>", "ppt/slides/slide3.xml": "<pic/>"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.xlsx").write_bytes(zipped(XLSX))
    (root / "sub dir/b.pptx").write_bytes(zipped(PPTX))
    (root / "c.msg").write_bytes(b"\x00ab\x01" + "Subject: wide text".encode("utf-16le") + b"\xff\xffplain ascii run\x00short\x00")
    (root / "d.txt").write_text("plain é")
    (root / "d.csv").write_text("x,y")
    (root / "bad.xlsx").write_bytes(b"no zip")
    (root / "e.docx").write_bytes(b"zz")
    (root / "~$a.xlsx").write_bytes(b"lock")
    (root / "noext").write_bytes(b"1")
    return root


def test_ingest_and_again(spark, tree):
    one = files.ingest(spark, str(tree)).cache()
    got = {r["path"]: r for r in one.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.xlsx": "ok", "sub dir/b.pptx": "ok", "c.msg": "ok", "d.txt": "ok", "d.csv": "ok", "bad.xlsx": "FAILED", "e.docx": "skipped (unsupported)", "noext": "skipped (unsupported)"}
    assert got["a.xlsx"]["text"] == "\n## Sheet: One\nTag | Pump 1\n4.5 | in\n"
    assert got["sub dir/b.pptx"]["text"] == "\n===== SLIDE 1 =====\ntwo more\n\n===== SLIDE 2 =====\n\n\n===== SLIDE 3 =====\nten\n" and files.slides_without_text(zipped(PPTX)) == (1, 3)
    assert "Subject: wide text" in got["c.msg"]["text"].split("ASCII")[0] and "plain ascii run" in got["c.msg"]["text"] and "short" not in got["c.msg"]["text"]
    time.sleep(1.1)
    (tree / "d.txt").write_text("changed")
    two = {r["path"]: r for r in files.ingest(spark, str(tree), one).collect()}
    assert two["d.txt"]["text"] == "changed" and two["d.txt"]["status"] == "ok" and two["a.xlsx"]["status"] == "ok (cached)" and two["a.xlsx"]["text"] == got["a.xlsx"]["text"] and len(two) == len(got)
    assert {r["status"] for r in files.ingest(spark, str(tree), one, force=True).where("path = 'a.xlsx'").collect()} == {"ok"}
    assert ("d.csv", "0 KB", "", "ok") in pairs(files.inventory(one))


def test_text_names_keep_files_apart(spark):
    rows = spark.createDataFrame([("a/b c.pdf",), ("a/b c.csv",), ("x" * 300 + ".txt",)], "p string").select(files.text_name(F.col("p")).alias("n"))
    names = [r["n"] for r in rows.collect()]
    assert names[:2] == ["a__b_c.pdf.txt", "a__b_c.csv.txt"] and len(names[2]) == 213


def test_manifests(spark, tree):
    listed = files.manifest(files.list_files(spark, str(tree)))
    one = spark.createDataFrame(listed.collect(), listed.schema)
    os.remove(tree / "noext")
    (tree / "d.csv").write_text("x,y,z")
    (tree / "new.md").write_text("n")
    os.utime(tree / "d.txt", (time.time() + 5, time.time() + 5))
    assert pairs(files.manifest_diff(one, files.manifest(files.list_files(spark, str(tree))))) == [("d.csv", "changed"), ("d.txt", "changed"), ("new.md", "new"), ("noext", "removed")]


def test_intake_never_overwrites(spark, tmp_path):
    root, up = tmp_path / "root", tmp_path / "up.txt"
    (root / "in").mkdir(parents=True)
    up.write_text("one")
    take = lambda **k: files.intake(spark, str(up), str(root), "in", day="2024-03-15", **k)
    first = take()
    assert first["saved"] == "in/up.txt" and first["duplicate_of"] is None and len(first["sha1"]) == 40
    assert take() == {"saved": None, "duplicate_of": "in/up.txt", "sha1": first["sha1"]}
    for text, name in (("two", "up (uploaded copy).txt"), ("three", "up (uploaded 2024-03-15).txt"), ("four", "up (uploaded 2024-03-15) 2.txt")):
        up.write_text(text)
        assert take()["saved"] == f"in/{name}"
    up.write_text("five")
    assert take(name="Given.md")["saved"] == "in/Given.md" and (root / "in/up.txt").read_text() == "one"


def test_names_of_one_batch_differ(spark):
    wanted = spark.createDataFrame([("a.txt",)] * 3 + [("b",), ("a (uploaded copy).txt",), ("c.md",), ("c.md",)], "name string")
    existing = spark.createDataFrame([("a.txt",), ("b",)], "name string")
    got = pairs(files.free_names(wanted, existing, "2024-03-15"))
    assert got == sorted([("a.txt", f"a (uploaded 2024-03-15){n}.txt") for n in ("", " 2", " 3")] + [("a (uploaded copy).txt",) * 2, ("b", "b (uploaded copy)"), ("c.md", "c.md"), ("c.md", "c (uploaded copy).md")])
    many = files.free_names(spark.range(105).selectExpr("'x.y' AS name"), existing, "2024-03-15").collect()
    assert len(many) == 105 and len({r["saved_as"] for r in many} - {None}) == 101
    assert files.free_names(wanted.limit(0), existing, "2024-03-15").count() == 0


def test_pdf_text_by_tool(tmp_path, monkeypatch):
    tool = tmp_path / "pdftotext"
    tool.write_text("""#!/bin/sh\ngrep -q '^%PDF' || exit 1\nprintf 'left   right\\n\\fsecond \\303\\251\\n\\f'\n""")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert files.extract("pdf", b"%PDF-1.4\n...") == ("left   right\n\x0csecond é\n\x0c", 2, "ok")
    assert files.extract("pdf", b"no such thing") == (None, None, "FAILED")


# ---------------------------------------------------------------- canvases

GOOD = {"nodes": [{"id": "g", "type": "group", "x": 0, "y": 0, "width": 100, "height": 100}, {"id": "a", "type": "text", "x": 10, "y": 10, "width": 20, "height": 20, "text": "t"}, {"id": "b", "type": "file", "x": 90, "y": 10, "width": 20, "height": 20, "file": "f.md", "color": "6"}], "edges": [{"id": "e1", "fromNode": "a", "toNode": "b", "fromSide": "top", "color": "#ff0000"}, {"id": "e2", "fromNode": "b", "toNode": "a"}]}


def broken(**changes):
    c = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        kind, i, field = path.split("_")
        item = c[{"n": "nodes", "e": "edges"}[kind]][int(i)]
        item.pop(field, None)
        if value is not None:
            item[field] = value
    return json.dumps(c)


def test_canvas_rules(spark):
    cases = {
        "good": (json.dumps(GOOD), set()), "twice": (broken(e_0_id="a"), {1}), "dangling": (broken(e_1_toNode="zz"), {2}), "no text": (broken(n_1_text=None), {3}), "no x": (broken(n_2_x=None), {3}), "type": (broken(n_1_type="shape"), {4}), "side": (broken(e_0_fromSide="up"), {5}), "end": (broken(e_0_toEnd="dot"), {6}),
        "color": (broken(n_2_color="7"), {7}), "edge color": (broken(e_0_color="red"), {7}), "json": ('{"nodes": [', {8}), "empty": ("{}", set()),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "canvas string, json string")
    got = {k: set() for k in cases}
    for r in canvas.violations(df).collect():
        got[r["canvas"]].add(r["rule"])
    assert got == {k: v[1] for k, v in cases.items()}


def test_canvas_graph(spark):
    df = spark.createDataFrame([("c", json.dumps(GOOD))], "canvas string, json string")
    assert [r["id"] for r in canvas.nodes(df).orderBy("z").collect()] == ["g", "a", "b"] and canvas.edges(df).where("id = 'e2'").first()["toEnd"] == "arrow"
    assert pairs(canvas.contained(df)) == [("c", "g", "a")]
    start = spark.createDataFrame([("c", "a")], "canvas string, node string")
    assert pairs(canvas.reachable(df, start)) == [("c", "a", 0), ("c", "b", 1)]


# ---------------------------------------------------------------- templates and pages


def test_templates(spark, tmp_path):
    t = '---\n{{ title | yaml_property:"title" }}\n{{ tags | yaml_property:"tags" }}\n---\n# {{ title | trim }}\n{% if author and not hidden %}\nBy {{ author.name | upper }}\n{% elif n > 2 %}\nmany\n{% else %}\nnone\n{% endif %}\n{% for x in tags %}\n- {{ loop.index }} {{ x }}\n{% endfor %}\n{{ missing | default:"-" }}{{ d | date:"DD.MM.YYYY" }}'
    out = template.render(t, {"title": ' A "b" ', "tags": ["x", "y"], "author": {"name": "jo"}, "d": "2024-03-05"})
    assert out == '---\ntitle: " A \\"b\\" "\ntags:\n  - "x"\n  - "y"\n---\n# A "b"\nBy JO\n- 1 x\n- 2 y\n-05.03.2024'
    assert "many" in template.render(t, {"n": 3, "d": "2024-01-01"}) and template.render("{{ a }}", {"a": 1}, a="set") == "set"
    for bad in ("{{ a | nope }}", "{% if a %}", "{% endfor %}", "{% what %}", "{{ }}", "{% for in x %}{% endfor %}"):
        assert template.validate(bad)
    assert template.validate(t) is None
    (tmp_path / "d.csv").write_text("title,n\nOne: x,1\nTwo,02\n")
    data = template.read_data(spark, str(tmp_path / "d.csv"))
    assert pairs(template.batch(data, "{{ n }}", "{{ title | safe_name }}.md")) == [("One x.md", "1"), ("Two.md", "02")]
    assert [f for f, _ in pairs(template.batch(data, "x"))] == ["1.md", "2.md"]
    there = spark.createDataFrame([("Two.md",)], "file string")
    for args in ((data, "x", "same.md"), (data, "x", "a/{{ n }}.md"), (data, "x", "{{ title | safe_name }}.md", there)):
        with pytest.raises(template.TemplateError):
            template.batch(*args)
    assert template.batch(data, "x", "{{ title | safe_name }}.md", there, overwrite=True).count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/one.json").write_text('{"title": "T", "list": [1, 2]}')
    (tmp_path / "j/many.json").write_text('[{"title": "A"}, {"title": "B"}]')
    assert pairs(template.batch(template.read_data(spark, str(tmp_path / "j")), "{{ title }}{{ list | length }}"))[-1] == ("one.md", "T2")


def test_pages(spark):
    page = '<html><head><title> A &amp; B </title><meta content="Said &lt;so&gt;" name="description"></head><body><nav><a href="/no">n</a></nav><article><h1>Head</h1><p>Some <b>bold</b> <a href="/x">link</a><br>next</p><ul><li>one<li>two</ul><script>bad()</script><pre>a  b</pre></article><footer>f</footer></body></html>'
    r = html.clean(spark.createDataFrame([("http://u@www.Example.com:80/p?q", page), (None, None)], "url string, html string")).orderBy(F.desc_nulls_last("url")).collect()
    assert (r[0]["title"], r[0]["description"], r[0]["domain"]) == ("A & B", "Said <so>", "example.com")
    assert r[0]["content"] == "# Head\n\nSome **bold** [link](/x)\nnext\n\n- one\n- two\n\n```\na  b\n```" and r[1]["content"] == "" and r[1]["domain"] == ""
    plain = spark.createDataFrame([(page,)], "h string").select(html.plain_text(F.col("h")).alias("t"), html.hrefs(F.col("h")).alias("l")).first()
    assert plain["t"] == "Head Some bold link next one two a b" and plain["l"] == ["/no", "/x"]


# ---------------------------------------------------------------- streaming


def test_new_files_are_taken_up_once(spark, tmp_path):
    root, table, mark = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "~$b.txt").write_text("lock")
    refresh.keep_texts(spark, str(root), table, mark).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(table).collect()] == ["one"]
    (root / "c.md").write_text("two")
    (root / "d.zip").write_bytes(b"z")
    refresh.keep_texts(spark, str(root), table, mark).awaitTermination()
    rows = refresh.latest(spark.read.parquet(table))
    assert sorted((r["path"].rsplit("/", 1)[-1], r["text"], r["status"]) for r in rows.collect()) == [("a.txt", "one", "ok"), ("c.md", "two", "ok"), ("d.zip", None, "skipped (unsupported)")]


def test_windows_are_the_same_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = refresh.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("windows")) == key(refresh.event_windows(events))
    seen = []
    refresh.each_run(refresh.arriving_files(spark, str(tmp_path / "e"), "*.parquet"), lambda df, i: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) >= 1
