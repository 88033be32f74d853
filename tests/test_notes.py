"""Notes, links, search, views over notes, against plain models and worked cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import links, search
from quarrystone.sources import notes as N

VAULT = {
    "00 - Home.md": "# Home\n[[Mechanical]] [[Power System]] [[Pump 1]] [[nothing here]]",
    "README.md": "[[also nothing]]",
    "98 - Templates/T.md": "[[Template Link]]",
    "02 - Disciplines/Mechanical.md": "---\naliases: [Mech, \"HVAC\"]\n---\n# Mechanical\n\n## Indexed equipment\n[[Pump 1]]\n\n## Notes\nx",
    "03 - Systems/Power System.md": "---\naliases:\n  - Power\n  - 'Strom'  \n---\n# Power\n## Related\n- [[Pump 2|second]]",
    "05 - Spaces/Room 9.md": "# Room",
    "04 - Equipment/Pump 1.md": "---\ndiscipline: mechanical\nsystems: [[Power System]], [[Mech]]\nspaces: \"[[Room 9#North]]\"\ntags: [task, area/north]\naliases: P1 # short\npages: 12\ndue: 2024-03-10\n---\n# Pump One\nSee [[Power]] and `[[Code]]` and <!-- [[Comment]] --> ![[plan.png]].\n```\n[[Fenced]]\n```\n[[Pump 1]] [[#Heading]] [[Room 9#North|the room]] [[Pump 2^block]] #hot\n## Spec 26.08.01\nPart 3 of 26 08 01 and §3.1 and E565. #dup\n### Deep\nmore E565 words\n##### five\ntail",
    "04 - Equipment/Pump 2.md": "---\ndiscipline: [HVAC, Other]\nsystem: Power\ntags: single\nstatus: done\npages: 30\n---\nThe power system is only mentioned. Étude naïve.\n# Title Two\n\n",
    "04 - Equipment/Pump 1-LAPTOP7X2.md": "---\ndiscipline: Mechanical\n---\ncopy [[Pump 1]]",
    "04 - Equipment/Pump 1-LAPTOP7X2-2.md": "copy of copy",
    "04 - Equipment/Pump 1-South side7abc.md": "no copy",
    "Lonely.md": "# Only headings\n## Two",
    ".hidden/x.md": "[[never]]",
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for path, body in VAULT.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body, encoding="utf-8")
    (root / "Bad bytes.md").write_bytes(b"[[Pump 1]] \xff\xfe text")
    return str(root)


@pytest.fixture(scope="module")
def notes(spark, vault):
    return N.read_notes(spark, vault, strict=True).cache()


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_notes_are_read(spark, vault, notes):
    got = {r["path"]: r for r in notes.collect()}
    assert set(got) == {p for p in VAULT if not p.startswith(".")} | {"Bad bytes.md"}
    assert got["04 - Equipment/Pump 1.md"]["name"] == "Pump 1" and got["04 - Equipment/Pump 1.md"]["folder"] == "04 - Equipment" and got["README.md"]["folder"] == ""
    assert got["Bad bytes.md"]["text"] is None and not got["Bad bytes.md"]["readable"]
    assert N.read_notes(spark, vault).where("path = 'Bad bytes.md'").first()["text"] == "[[Pump 1]]  text"


@pytest.mark.parametrize("key, unwrap, many, want", [
    ("inline", True, False, ["a", "b c"]), ("block", True, False, ["one", "Note"]), ("block", False, False, ["one", "[[Note|x]]"]), ("scalar", True, False, ["word"]), ("links", True, True, ["A", "B"]), ("empty", True, False, []), ("none", True, False, []), ("comment", True, False, []),
])
def test_property_values(spark, key, unwrap, many, want):
    front = "inline: [a, 'b c', ]\nblock:\n  - one # said\n  - \"[[Note|x]]\"\nscalar: \"word\" # c\nlinks: \"[[A#h]], [[B|b]]\"\nempty:\ncomment: # nothing\nlast: z"
    got = spark.createDataFrame([(front,)], "f string").select(N.values_of(F.col("f"), key, unwrap, many).alias("v")).first()["v"]
    assert got == want


def test_audit(notes):
    a = links.audit(notes)
    assert pairs(a["unresolved"]) == [("00 - Home.md", "nothing here"), ("04 - Equipment/Pump 1.md", "plan.png")]
    e = set(pairs(a["edges"]))
    assert ("04 - Equipment/Pump 1.md", "03 - Systems/Power System.md") in e and ("04 - Equipment/Pump 1.md", "04 - Equipment/Pump 1.md") in e and ("04 - Equipment/Pump 1.md", "04 - Equipment/Pump 2.md") in e
    assert pairs(a["copies"]) == [("04 - Equipment/Pump 1-LAPTOP7X2-2.md", "Pump 1-LAPTOP7X2-2", "Pump 1"), ("04 - Equipment/Pump 1-LAPTOP7X2.md", "Pump 1-LAPTOP7X2", "Pump 1")]
    assert pairs(a["orphans"]) == [("04 - Equipment/Pump 1-South side7abc.md",), ("Bad bytes.md",), ("Lonely.md",)]
    assert pairs(a["hubs"]) == [("mechanical", "02 - Disciplines/Mechanical.md", 1, 1)]
    assert sum(n for _, n in pairs(a["spread"])) == notes.count() and pairs(a["unreadable"]) == [("Bad bytes.md",)]


def conflict(name, names):
    """The rule for copies, piece by piece."""
    base, seen, found = name, False, None
    for _ in range(40):
        base, dash, piece = base.rpartition("-")
        if not dash or not piece or re.search(r"\s", piece):
            break
        seen = seen or len(piece) >= 6 and bool(re.search(r"\d", piece)) and bool(re.search("[A-Za-z]", piece))
        if seen and base.lower() in names:
            found = base
    return found


def test_copies_follow_the_rule(spark):
    rng = random.Random(3)
    names = sorted({"-".join(rng.choice(["Note", "A", "LAPTOP7X2", "2", "dev1ce", "", "x y", "abcdef", "123456"]) for _ in range(rng.randint(1, 5))) for _ in range(400)} - {""})
    known = {n.lower() for n in names}
    got = {r["name"]: r["copy_of"] for r in links.sync_copies(spark.createDataFrame([(n, n) for n in names], "path string, name string")).collect()}
    assert got == {n: c for n in names if (c := conflict(n, known))}


def test_link_check(notes):
    assert pairs(links.broken_links(notes.where(~F.col("path").contains("README")))) == [("Pump 2^block", ["Pump 1.md"]), ("nothing here", ["00 - Home.md"]), ("plan.png", ["Pump 1.md"])]
    with pytest.raises(ValueError, match="nothing here"):
        links.assert_links(notes)


def test_hubs(notes):
    members = links.hub_members(notes)
    m, p, r = "02 - Disciplines/Mechanical.md", "03 - Systems/Power System.md", "05 - Spaces/Room 9.md"
    assert pairs(members) == [(m, "Pump 1"), (m, "Pump 2"), (p, "Pump 1"), (p, "Pump 2"), (r, "Pump 1")]
    new = {x["hub"]: x for x in links.hub_additions(notes, members).collect()}
    assert {k: v["missing"] for k, v in new.items()} == {m: ["Pump 2"], p: ["Pump 1"], r: ["Pump 1"]}
    assert links.with_links_added(VAULT[m], new[m]["section"], ["Pump 2"]).count("[[Pump 1]] · [[Pump 2]]") == 1
    text = links.with_links_added(VAULT[p], new[p]["section"], ["Pump 1"])
    assert "## Related equipment\n[[Pump 1]]\n" in text and text.index("## Related equipment") < text.index("## Related\n")
    assert links.with_links_added("x\n## S", "## S", ["A"]) == "x\n## S\n[[A]]"
    assert pairs(links.hub_members(notes, from_links=True)) == pairs(members)


def test_registers(spark):
    rows = spark.createDataFrame([("X-9 and G-2, X-10; ABCD-1, x-3",), ("G-2 X-0010",)], "text string")
    assert pairs(links.id_marks(rows)) == [("G", 2, 1), ("X", 10, 2)]
    ids = spark.createDataFrame([("X", 1, "a", 1), ("X", 1, "b", 2), ("X", 1, "c", 3), ("X", 7, "d", 4), ("X", 1, "a", 9)], "prefix string, number long, meaning string, at long")
    assert pairs(links.id_collisions(ids)) == [("X", 1, "b", 8), ("X", 1, "c", 9)]


def test_colors_and_embedded_search(spark, notes):
    rows = N.with_properties(notes.where("text is not null")).withColumn("tags", F.coalesce(F.try_element_at("props", F.lit("tags")), F.array().cast("array<string>")))
    color = links.color_groups([('["discipline":"mech"]', 1), ('path:"00 - Home" OR path:"README"', 2), ('path:"04"', 3)])
    got = {r["path"]: r["c"] for r in rows.select("path", color.alias("c")).collect()}
    assert got["04 - Equipment/Pump 1.md"] == 1 and got["README.md"] == 2 and got["04 - Equipment/Pump 2.md"] == 3 and got["Lonely.md"] is None
    found = lambda q: {r["path"] for r in rows.where(links.embedded_search(q)).collect()}
    assert found("tag:#area") == {"04 - Equipment/Pump 1.md"} and found("status:done mentioned") == {"04 - Equipment/Pump 2.md"} and found("status:done nowhere") == set()


# ---------------------------------------------------------------- chunks and search


def test_chunks(notes):
    got = N.chunks(notes).where("path = '04 - Equipment/Pump 1.md'").orderBy("n").collect()
    assert [(r["title"], r["headings"]) for r in got] == [("Pump One", "Pump One"), ("Pump One", "Pump One > Spec 26.08.01"), ("Pump One", "Pump One > Spec 26.08.01 > Deep")]
    assert got[1]["section"] == ["26 08 01", "§3.1", "E565"] or got[1]["section"] == ["Part 3", "26 08 01", "§3.1", "E565"]
    assert got[2]["text"] == "more E565 words\n##### five\ntail" and got[0]["tags"] == ["task", "area/north"] and got[0]["boost"][:2] == ["Pump 1", "P1 # short"]  # the block is no YAML, so it is read by lines
    alone = N.chunks(notes).where("path = 'Lonely.md'").collect()
    assert len(alone) == 1 and alone[0]["headings"] == "" and alone[0]["text"].startswith("# Only")


def plain_bm25(chunks, query, weight):
    tok = lambda t: [x for m in re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", t.lower()) for x in ([m, *m.split(".")] if "." in m else [m])]
    tf = []
    for text, heads, boost in chunks:
        c = Counter(tok(f"{text} {heads}"))
        for t in tok(" ".join(boost)):
            c[t] += weight
        tf.append(c)
    n, avg = len(tf), sum(sum(c.values()) for c in tf) / len(tf)
    out = []
    for c in tf:
        s = 0.0
        for t in tok(query):
            df = sum(t in d for d in tf)
            if c[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
        out.append(s)
    return out


def test_search_matches_a_plain_ranking(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["pump", "é", "26.08.01", "x1", "Power", "room", "e565", "a", "b", "c"])
    rows = [(f"p{i % 7}", i, " ".join(word() for _ in range(rng.randint(0, 30))), word(), [word() for _ in range(rng.randint(0, 3))]) for i in range(120)]
    df = spark.createDataFrame(rows, "path string, n int, text string, headings string, boost array<string>").repartition(5)
    query = "Power power pump 26.08.01 unknown"
    for weight in (2.5, 0.2):
        want = plain_bm25([r[2:] for r in rows], query, search.boost_weight(weight))
        order = sorted((-round(s, 9), rows[i][0], rows[i][1]) for i, s in enumerate(want) if s > 0)[:10]
        got = search.search(df, query, ["path", "n"], 10, headings="headings", boost="boost", alias_boost=weight).orderBy("rank").collect()
        assert [(r["path"], r["n"]) for r in got] == [o[1:] for o in order]
        assert [r["score"] for r in got] == pytest.approx([-o[0] for o in order], abs=1e-4)
    q = spark.createDataFrame([(1, query), (2, "room"), (3, "unknown"), (4, None)], "q long, t string")
    many = search.search_many(df, q, ["path", "n"], "q", "t", 10, headings="headings", boost="boost")
    assert {r["q"] for r in many.collect()} == {1, 2}
    first = search.search(df, query, ["path", "n"], 10, headings="headings", boost="boost")
    assert pairs(many.where("q = 1").select("rank", "score", "path", "n")) == pairs(first)
    assert search.boost_weight(2.5) == 2 and search.search(df, "nothing", ["n"]).count() == 0 and search.search(df.limit(0), "pump", ["n"]).count() == 0
    total = search.postings(df, ["n"], headings="headings", boost="boost").groupBy("n", "dl").agg(F.sum("tf").alias("t")).where("t <> dl").count()
    assert total == 0


def test_written_index_ranks_as_search_does(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: rng.choice(["pump", "26.08.01", "x1", "room", "a", "b"])
    rows = [(f"p{i % 7}", i // 2, " ".join(word() for _ in range(rng.randint(0, 30))), [word()] * rng.randint(0, 2)) for i in range(80)] + [("q", 1, None, None)]
    df = spark.createDataFrame(rows, "path string, n int, text string, boost array<string>").repartition(4)
    search.write_index(df, str(tmp_path / "i"), ["path", "n"], boost="boost", buckets=16)
    for query in ("pump pump 26.08.01", "room unknown", "unknown", ""):
        want = search.search(df, query, ["path", "n"], 12, boost="boost")
        got = search.search_index(spark, str(tmp_path / "i"), query, ["path", "n"], 12)
        assert got.schema.names == want.schema.names and pairs(got) == pairs(want)
    found = search.search_index(spark, str(tmp_path / "i"), "pump", ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    for empty in (df.limit(0), df.where("text is null")):
        search.write_index(empty, str(tmp_path / "e"), ["path", "n"], boost="boost", buckets=4)
        assert search.search_index(spark, str(tmp_path / "e"), "pump", ["path", "n"]).count() == 0
    with pytest.raises(ValueError):
        search.write_index(df, str(tmp_path / "c"), ["path", "term"])


def test_index_is_used_while_fresh(spark, vault, tmp_path):
    index = str(tmp_path / "index")
    assert not N.index_is_fresh(spark, index, vault)
    built = N.build_index(spark, vault, index)
    assert N.index_is_fresh(spark, index, vault) and N.load_chunks(spark, vault, index).count() == built.count()


# ---------------------------------------------------------------- elements


def test_markdown_elements(spark):
    md = "# H\n> [!FAQ]- Why?\n> > [!note] In\n- [ ] do\n  * [x] done it\n1. [-] odd\n%%hid%% #tag-a #a/b #1no `#code` x#not\n[[N#^b1|shown]] [[N#Head]]\n"
    r = spark.createDataFrame([(md,)], "t string").select(T.callouts(F.col("t")).alias("c"), T.tasks(F.col("t")).alias("k"), T.hidden_comments(F.col("t")).alias("h"), T.inline_tags(F.col("t")).alias("g"), F.transform(T.wiki_links(F.col("t")), T.link_parts).alias("l"), T.headings(F.col("t")).alias("d")).first()
    assert [tuple(c) for c in r["c"]] == [("question", "-", "Why?"), ("note", "", "In")]
    assert [tuple(k) for k in r["k"]] == [(False, "do"), (True, "done it"), (True, "odd")]
    assert r["h"] == ["hid"] and r["g"] == ["tag-a", "a/b"] and [tuple(d) for d in r["d"]] == [(1, "H")]
    assert [tuple(x) for x in r["l"]] == [("N", None, "b1", "shown"), ("N", "Head", None, None)]


def test_document_indexes(spark):
    text = "E-101 POWER PLAN 01/02/2024 E-102 LIGHTING PLAN LEVEL 2 2024-03-04 E-101 POWER PLAN 01/02/2024\nDIVISION 26 ELECTRICAL\n26 05 00 Common Work Results .... 12\nOFCI by others pump AHU TBD"
    r = spark.createDataFrame([(text,)], "t string").select(T.drawing_index(F.col("t")).alias("d"), T.spec_contents(F.col("t")).alias("s"), T.sweeps(F.col("t")).alias("w")).first()
    assert [tuple(x) for x in r["d"]] == [("E-101", "POWER PLAN", "01/02/2024"), ("E-102", "LIGHTING PLAN LEVEL 2", "2024-03-04")]
    assert ("26", None, "ELECTRICAL") in [tuple(x) for x in r["s"]] and (None, "26 05 00", "Common Work Results") in [tuple(x) for x in r["s"]]
    assert r["w"]["scope"] == 2 and r["w"]["equipment"] == 2 and r["w"]["placeholder"] == 1
