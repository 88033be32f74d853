"""The view language: one expression per function, the rules of filters, whole views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrystone.plans.bases import Base, condition, scope_of
from quarrystone.plans.expression import ExpressionError, col, compile_expression, parse

NOW = "2024-03-15 10:30:00"
ROW = "1.5D as price, 4 as quantity, true as done, 'Some Text' as name, '' as blank, cast(null as string) as missing, timestamp_ntz'2024-03-10 08:05:07.250' as due, array('b', 'a', 'b') as items, array(3, 1, 2) as numbers, map('k', 'v') as obj, 'tag/one' as x, array(array(1, 2), array(3)) as nested"
FILE = "'Notes/Sub/My Note.md' as file_path, 'My Note.md' as file_name, 'My Note' as file_basename, 'Notes/Sub' as file_folder, 'md' as file_ext, 500L as file_size, timestamp_ntz'2024-03-01 00:00:00' as file_ctime, timestamp_ntz'2024-03-02 12:00:00' as file_mtime, array('book', 'area/north') as file_tags, array('Other', 'Textbook#h') as file_links, map('name', array('x')) as file_properties"

CASES = {
    # operators
    "1 + 2 * 3 - 4 / 2": 5.0, "(1 + 2) * 3": 9.0, "price * quantity": 6.0, "-price": -1.5, "1 / 0": None, "7 % 4": 3.0, '"a" + 1': "a1", 'price.toFixed(2) + " dollars"': "1.50 dollars", "quantity > 3 && !blank": True, "missing == null": True, 'missing != "done"': True, "missing > 1": False, "price >= 1.5 || false": True,
    '"10" > 9': True, "done == true": True, "[1, 2].length": 2.0, "numbers[0]": 3.0, 'obj["k"]': "v", "obj.k": "v", "note.price": 1.5, "nowhere": None,
    # global functions
    'date("2024-01-05").year': 2024.0, 'if(done, "yes", "no")': "yes", 'if(missing, 1, "")': None, 'if(blank, 1)': None, "min(3, 1, 2)": 1.0, "max(3, price)": 3.0, 'number("4.5")': 4.5, 'number("x")': None, 'link("A/B.md", "shown").toString()': "shown", 'list("a").length': 1.0, "list(items).length": 3.0, 'file("A/B c.md").basename': "B c", 'escapeHTML("<a & \'b\'>")': "&lt;a &amp; &#39;b&#39;&gt;", 'image("p.png").toString()': "p.png", 'icon("x").toString()': "x", 'html("<b>").toString()': "<b>",
    "today().toString()": "2024-03-15", "now().hour": 10.0, "(now() - due).days.floor()": 5.0, '(today() + "7d").toString()': "2024-03-22", '(today() + "1M").toString()': "2024-04-15", '(date("2024-01-31") + "1M").toString()': "2024-02-29", "(today() + (duration('1d') * 2)).toString()": "2024-03-17", '(due - "2h").hour': 6.0, "(due - date('2024-03-09')).hours.round(2)": 32.09, "duration('1w').days": 7.0, "duration('90 minutes').hours": 1.5,
    # any
    "quantity.isTruthy()": True, "blank.isTruthy()": False, 'price.isType("number")': True, 'name.isType("number")': False, "quantity.toString()": "4", "done.toString()": "true", "items.toString()": "b, a, b",
    # date
    "due.month": 3.0, "due.day": 10.0, "due.minute": 5.0, "due.second": 7.0, "due.millisecond": 250.0, "due.date().toString()": "2024-03-10", 'due.format("DD/MM/YY dddd [at] HH:mm")': "10/03/24 Sunday at 08:05", "due.time()": "08:05:07", "due.isEmpty()": False,
    # string
    "name.length": 9.0, 'name.contains("Te")': True, 'name.containsAll("S", "x")': True, 'name.containsAny("q", "x")': True, 'name.startsWith("Some")': True, 'name.endsWith("Some")': False, "blank.isEmpty()": True, "missing.isEmpty()": True, "name.lower()": "some text", '"ab cd".title()': "Ab Cd", '" x ".trim()': "x", 'name.replace("e", "3")': "Som3 T3xt", "name.replace(/[A-Z]/, '_')": "_ome _ext", '"ab".repeat(3)': "ababab", '"abc".reverse()': "cba", "name.slice(1, 4)": "ome", "name.slice(-4)": "Text", "name.slice(-4, -1)": "Tex", 'name.split(" ").length': 2.0, '"a,b,c".split(",", 2).join("+")': "a+b", "'a1b22'.split(/[0-9]+/).join('|')": "a|b|",
    # number
    "(-2.5).abs()": 2.5, "price.ceil()": 2.0, "price.floor()": 1.0, "2.345.round(1)": 2.3, "price.round()": 2.0, "price.isEmpty()": False, "1234.5.toFixed(0)": "1235",
    # list
    'items.contains("a")': True, 'items.containsAll("a", "z")': False, 'items.containsAny("a", "z")': True, "numbers.filter(value > 1).length": 2.0, "numbers.map(value * 10 + index).join('-')": "30-11-22", "numbers.reduce(acc + value * index, 100)": 105.0, "nested.flat().length": 3.0, "items.join('/')": "b/a/b", "numbers.reverse().join()": "2,1,3", "numbers.slice(-2).join()": "1,2", "numbers.sort().join()": "1,2,3", "items.unique().length": 2.0, "items.isEmpty()": False, "numbers.mean()": 2.0,
    # file, link, object, pattern
    "file.name": "My Note.md", "file.size": 500.0, "(file.size / 5).round(0)": 100.0, 'file.hasTag("area")': True, 'file.hasTag("are", "nope")': False, 'file.hasLink("Textbook")': True, 'file.hasLink("nope")': False, 'file.hasProperty("name")': True, 'file.inFolder("Notes")': True, 'file.inFolder("Not")': False, "file.asLink('d').toString()": "d", 'link("Dir/My Note").linksTo(file)': True, 'link("x.md").asFile().basename': "x", "obj.keys().join()": "k", "obj.values().join()": "v", "obj.isEmpty()": False, "/^\\d{4}-\\d{2}$/.matches('2024-03')": True, "/TEXT/i.matches(name)": True, "/TEXT/.matches(name)": False, "this.file.name": "Base.md", 'file.ctime.format("YYYY-MM-DD")': "2024-03-01",
}


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(f"select {ROW}, {FILE}")


def test_every_function(row):
    scope = scope_of(row, now=F.lit(NOW).cast("timestamp_ntz"), this={"path": "Bases/Base.md"})
    got = row.select(*[col(compile_expression(e, scope)).alias(f"c{i}") for i, e in enumerate(CASES)]).first()
    wrong = {e: (g, w) for (e, w), g in zip(CASES.items(), got) if not (g == w and type(g) is type(w) or isinstance(w, float) and g == pytest.approx(w))}
    assert not wrong


@pytest.mark.parametrize("bad", ["(now() - file.ctime) / 2", "(now() - file.ctime).round(0)", "1 +", "name.nope()", "nofunc(1)", "a b", '"open', "due + due", "duration(name)", "price.year"])
def test_errors(row, bad):
    with pytest.raises(ExpressionError):
        compile_expression(bad, scope_of(row))


def test_filters(row, spark):
    scope = scope_of(row)
    holds = lambda spec: row.where(condition(spec, scope)).count() == 1
    assert holds(None) and holds("done") and holds({"and": ["done", "price > 1"]}) and holds({"or": ["blank", "done"]}) and not holds({"not": ["blank", "done"]}) and holds({"not": ["blank", {"and": ["done", "blank"]}]})
    assert holds({"or": ['file.hasTag("tag")', {"and": ['file.hasTag("book")', 'file.hasLink("Textbook")']}, {"not": ['file.hasTag("book")']}]}) and not holds({"and": ["done", {"not": "done"}]})
    for bad in ({"and": ["done"], "or": ["done"]}, {"xor": []}, 3):
        with pytest.raises(ExpressionError):
            condition(bad, scope)


def test_formulas_refer_to_each_other_but_not_in_circles(row):
    base = Base.of({"formulas": {"a": "formula.b + 1", "b": "price * 2"}, "views": [{"name": "v", "order": ["formula.a", "formula.none"]}]})
    assert base.formula_order() == ["b", "a"] and base.undefined_formulas() == ["formula.none"]
    assert tuple(base.view(row, "v").rows().first()) == (4.0, None)
    with pytest.raises(ExpressionError, match="circle"):
        Base.of({"formulas": {"a": "formula.b", "b": "formula.a"}})
    with pytest.raises(ExpressionError):
        base.view(row, "w")
    assert parse("a - b").value == "-"


TRACKER = """
filters:
  and:
    - file.hasTag("task")
    - 'file.ext == "md"'
formulas:
  days_left: 'if(due, (date(due) - today()).days, "")'
  late: 'if(due, date(due) < today() && status != "done", false)'
  rank: 'if(priority == 1, "🔴 High", if(priority == 2, "🟡 Medium", "🟢 Low"))'
properties:
  status: {displayName: Status}
  formula.rank: {displayName: Priority}
summaries:
  rounded: 'values.mean().round(1)'
views:
  - type: table
    name: Active
    filters: {and: ['status != "done"']}
    order: [file.name, status, formula.rank, due, formula.days_left]
    groupBy: {property: status, direction: ASC}
    summaries: {formula.days_left: [Average, rounded], formula.late: Checked, due: [Earliest, Range], status: [Empty, Unique]}
  - {type: cards, name: Cut, limit: 2, order: [file.name]}
"""


def test_a_task_tracker(spark):
    rows = [("b.md", ["task"], "open", 1, "2024-03-10"), ("a.md", ["task/x"], "open", 2, None), ("c.md", ["task"], "done", 1, "2024-03-01"), ("d.md", ["other"], "open", 1, None), ("e.md", ["task"], None, None, "2024-03-20")]
    df = spark.createDataFrame(rows, "file_name string, file_tags array<string>, status string, priority int, due string").selectExpr("*", "'md' as file_ext")
    base = Base.of(TRACKER)
    view = base.view(df, "Active", now=F.lit(NOW).cast("timestamp_ntz"))
    shown = view.rows(tie=["file_name"], display_names=True)
    assert shown.columns == ["file.name", "Status", "Priority", "due", "formula.days_left"]
    assert [tuple(r) for r in shown.collect()] == [("a.md", "open", "🟡 Medium", None, None), ("b.md", "open", "🔴 High", "2024-03-10", -5.0), ("e.md", None, "🟢 Low", "2024-03-20", 5.0)]
    s = {(r["grp"], r["total"]): r for r in view.summaries().collect()}
    assert s[None, True]["formula.days_left.Average"] == 0.0 and s[None, True]["formula.late.Checked"] == 1 and s[None, True]["status.Empty"] == 1 and s[None, True]["status.Unique"] == 1
    assert s["open", False]["formula.days_left.rounded"] == -5.0 and (None, False) in s
    assert [r[0] for r in base.view(df, "Cut").rows(tie=["file_name"]).collect()] == ["a.md", "b.md"]


def test_all_summaries(spark):
    df = spark.sql("select * from values (1.0D, true, timestamp_ntz'2024-01-01', 'a'), (2.0D, false, timestamp_ntz'2024-01-03', ''), (6.0D, null, null, 'a'), (null, true, null, null) t(n, b, d, s)")
    view = Base.of({"views": [{"name": "v", "summaries": {"n": ["Average", "Min", "Max", "Sum", "Range", "Median", "Stddev", "Empty", "Filled"], "b": ["Checked", "Unchecked"], "d": ["Earliest", "Latest", "Range"], "s": ["Unique", "Empty"]}}]}).view(df)
    r = view.summaries().first()
    assert [r[f"n.{k}"] for k in ("Average", "Min", "Max", "Sum", "Range", "Median", "Empty", "Filled")] == [3.0, 1.0, 6.0, 9.0, 5.0, 2.0, 1, 3] and r["n.Stddev"] == pytest.approx(14**0.5 / 3**0.5)
    assert (r["b.Checked"], r["b.Unchecked"], r["d.Range"], r["s.Unique"], r["s.Empty"]) == (2, 2, 2.0, 1, 2) and r["d.Latest"] == dt.datetime(2024, 1, 3)
    with pytest.raises(ExpressionError):
        Base.of({"views": [{"summaries": {"n": "Nope"}}]}).view(df).summaries()


def test_views_push_their_filters_and_columns_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    view = Base.of({"filters": "o_totalprice > 1000 && o_orderstatus == \"F\"", "views": [{"order": ["o_orderkey"]}]}).view(df)
    plan = view.rows()._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "o_orderdate" not in plan and "GreaterThan(o_totalprice,1000.0)" in plan and "EqualNullSafe(o_orderstatus,F)" in plan
