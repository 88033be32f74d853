"""Steps that must not grow faster than their input: what their plans shuffle, store and read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import search


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    words = ["pump", "valve 1.2", "duct", "fan", "pump fan", "cable"]
    return spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 9))) for i in range(60)], "n int, text string")


def test_a_batch_of_queries_scores_chunks_where_they_are(spark, texts):
    """F1: a score of every query and chunk was shuffled; now only what may be among the best is, and ties at the end all are."""
    asked = spark.createDataFrame([("a", "pump fan"), ("b", "valve 1.2 cable cable"), ("c", "nothing")], "q string, t string")
    got = search.search_many(texts, asked, ["n"], "q", "t", 5)
    assert "hashpartitioning(q" not in plan_of(got) and "hashpartitioning(n" not in plan_of(got)
    found = sorted((r["q"], r["rank"], r["score"], r["n"]) for r in got.collect())
    want = [(q, r["rank"], r["score"], r["n"]) for q, t in (("a", "pump fan"), ("b", "valve 1.2 cable cable")) for r in search.search(texts, t, ["n"], 5).collect()]
    assert found == sorted(want)


def test_batches_beyond_a_workers_hold_give_the_same(spark, texts, monkeypatch):
    asked = spark.createDataFrame([(1, "pump fan"), (2, "valve 1.2 cable cable")], "q int, t string")
    few = search.search_many(texts, asked, ["n"], "q", "t", 5).collect()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert sorted(few) == sorted(search.search_many(texts, asked, ["n"], "q", "t", 5).collect())


def test_postings_are_counted_without_a_shuffle(texts):
    """each posting was shuffled to be counted before it was shuffled to its folder."""
    rows = search.postings(texts, ["n"])
    assert "Exchange" not in plan_of(rows)
    assert rows.groupBy("n").agg(F.sum("tf").alias("t"), F.max("dl").alias("dl")).where("t <> dl").count() == 0
    assert "valve" in {r["term"] for r in rows.collect()} and "1.2" in {r["term"] for r in rows.collect()}


def test_one_query_reads_its_chunks_once(spark, texts):
    """the chunks were made and tokenised twice, once for the statistics and once for the scores."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = texts.mapInArrow(count, texts.schema)
    assert search.search(rows, "pump fan", ["n"], 5).count() == 5 and seen.value == 60


def test_python_sees_no_text_below_the_frontmatter(spark):
    """whole texts went to Python and came back as bodies."""
    from quarrystone.sources.notes import frontmatter, with_properties

    texts = ["---\na: [x, y]\n---\nbody é\n", "---\na: 1\n---", "no front", "---\nopen", "---\n\n---\n---\n", "", "---\nk: ü\n---\n---\nb: 2\n---\nrest", None]
    rows = with_properties(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    for r in rows.collect():
        assert r["body"] == frontmatter(r["text"])[1]
        assert json.loads(r["props_json"]) == {k: v for k, v in frontmatter(r["text"])[0].items()}
    python = [line for line in plan_of(rows).splitlines() if "ArrowEvalPython" in line]
    assert python and "__head" in python[0] and "body" not in python[0]


def test_chunks_are_passed_on_before_a_batch_ends(spark, monkeypatch):
    """F16: the chunks of a whole batch of notes were held beside it."""
    from quarrystone.sources import notes

    df = spark.createDataFrame([(f"{i}.md", f"n{i}", f"---\ntags: [t{i}]\n---\n# A\nx{i}\n## B\n" + "y" * i) for i in range(50)], "path string, name string, text string").coalesce(1)
    want = sorted(map(str, notes.chunks(df).collect()))
    monkeypatch.setattr(notes, "CUT_CHARS", 60)
    assert sorted(map(str, notes.chunks(df).collect())) == want and len(want) == 99


def test_canvases_are_checked_where_they_are(spark):
    """F8 and F17: canvases were parsed for each rule and their nodes shuffled."""
    from quarrystone.operators import canvas

    odd = '{"nodes":[{"id":"a","type":"group","x":0,"y":0,"width":9,"height":9},null,{"id":"a","type":"text","x":1,"y":1,"width":1,"height":1},{"id":"b","type":"file","x":1,"y":1,"width":1,"height":1,"file":"f","color":"9"}],"edges":[{"id":"b","fromNode":"a","toNode":"z","toEnd":"dot"},{"id":"e","fromNode":"b"},{"id":"e2","fromNode":"b","toNode":"a","fromSide":"in"}]}'
    df = spark.createDataFrame([("c", odd), ("d", '{"nodes":[]}'), ("e", '{"nodes":['), ("f", "{}")], "canvas string, json string")
    got = sorted((r["canvas"], r["rule"], r["id"] or "", r["what"]) for r in canvas.violations(df).collect())
    assert got == sorted([
        ("c", 1, "a", "id is used more than once"), ("c", 1, "b", "id is used more than once"), ("c", 2, "b", "toNode names no node"), ("c", 2, "e", "toNode names no node"), ("c", 3, "", "height is missing"),
        ("c", 3, "a", "text is missing"), ("c", 5, "e2", "fromSide in"), ("c", 6, "b", "toEnd dot"), ("c", 7, "b", "color 9"), ("e", 8, "", "not valid JSON"),
    ])
    assert [tuple(r) for r in canvas.contained(df).collect()] == [("c", "a", "b")]
    assert "Exchange" not in plan_of(canvas.violations(df)) + plan_of(canvas.contained(df))


def _orders(tmp_path, spark, twice=False):
    """A folder of tables in which every order is the next one's predecessor."""
    src = "/root/testdata/sf0.001"
    for name in os.listdir(src):
        os.symlink(f"{src}/{name}", tmp_path / name)
    return str(tmp_path)


def test_activities_are_not_shuffled_whole(spark, tmp_path):
    """F5 and what shares its step: whole activities were shuffled to find copies, and by their file to meet its one project."""
    from quarrystone.plans.orders_schedule import schedule

    s = schedule(spark, _orders(tmp_path, spark))
    assert "Exchange hashpartitioning" not in plan_of(s.tasks)
    # a column is read alone
    assert s.tasks.select("finish").where("finish is not null").count() > 0 and "FileScan parquet" in plan_of(s.rels)
    assert "target_h" not in plan_of(s.tasks.select("code", "mine"))


def test_copies_of_activities_still_leave_the_last(spark):
    from quarrystone.operators.schedule import _once

    rows = spark.createDataFrame([("f", "1", 1, "a"), ("f", "1", 2, "b"), ("f", "2", 3, "c"), ("g", "1", 4, "d")], "file string, task_id string, line_no int, name string")
    assert sorted(r["name"] for r in _once(rows, "file", "task_id").collect()) == ["b", "c", "d"]
    assert sorted(r["name"] for r in _once(rows.where("line_no <> 1"), "file", "task_id").collect()) == ["b", "c", "d"]


def test_two_versions_share_their_orders(spark, monkeypatch):
    """F6 and the other comparisons: lineitem and orders were joined and sorted for each version and each of its tables."""
    from quarrystone import queries

    made = []
    monkeypatch.setattr(queries, "base", lambda *a, f=queries.base: made.append(1) or f(*a))
    old, new, _ = queries._both(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    for s in (old, new):
        assert "lineitem" not in plan_of(s.tasks) + plan_of(s.rels)
