"""Registered queries of the document operators: file names, uploads, inventories, templates, indexes in texts, and the view language over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.queries import PAGES_SQL, _page_links, query, table
from quarrystone.queries_more import HUBS_SQL, _canvases, _hub_notes

# ---------------------------------------------------------------- files


@query(r"""
    WITH b AS (SELECT doc_id, regexp_replace(replace(coalesce(source, '') || '/' || substr(coalesce(text, ''), 1, CAST(doc_id % 400 AS INT)) || '.pdf', '/', '__'), '[^A-Za-z0-9._-]+', '_', 'g') AS base FROM documents)
    SELECT doc_id, CASE WHEN length(base) > 200 THEN substr(base, 1, 200) || '_' || substr(sha1(base), 1, 8) ELSE base END || '.txt' AS name FROM b""")
def j3_text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat names for paths that hold any characters, short and long."""
    from quarrystone.sources.files import text_name

    start = F.left(F.coalesce("text", F.lit("")), (F.col("doc_id") % 400).cast("int"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), start, F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", text_name(path).alias("name"))


@query("""
    SELECT 'd/' || doc_id || '.txt' AS file, (strlen(coalesce(text, '')) // 1024) || ' KB' AS size, CASE WHEN n_chars // 500 > 0 THEN (n_chars // 500) || ' pp' ELSE '' END AS pages, CASE WHEN text IS NULL THEN 'FAILED' ELSE 'ok' END AS extract FROM documents""")
def b8_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ingested files, as the inventory shows them."""
    from quarrystone.sources.files import FAILED, OK, inventory

    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return inventory(table(spark, sf_dir, "documents").select(path.alias("path"), size.alias("size"), F.floor(F.col("n_chars") / 500).alias("pages"), F.when(F.col("text").isNull(), FAILED).otherwise(OK).alias("status")))


@query("""
    WITH d AS (SELECT doc_id, coalesce(source, '') || '/' || doc_id AS path, md5(coalesce(text, '')) AS h FROM documents)
    SELECT doc_id, min(path) OVER (PARTITION BY h) AS duplicate_of FROM d""")
def d13_known_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file with an upload's content, of uploads that are all there."""
    from quarrystone.sources.files import find_duplicates, with_digest

    t = F.coalesce("text", F.lit(""))
    docs = with_digest(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(t).alias("size"), t.alias("content")))
    return find_duplicates(docs.select("doc_id", "size", "sha1"), docs.select("path", "size", "sha1")).select("doc_id", "duplicate_of")


@query("""
    WITH wanted AS (SELECT 'N' || (c_custkey // 3) AS stem, row_number() OVER (PARTITION BY c_custkey // 3) AS turn FROM customer),
    tails AS (SELECT i, CASE i WHEN 0 THEN '' WHEN 1 THEN ' (uploaded copy)' WHEN 2 THEN ' (uploaded 2024-05-06)' ELSE ' (uploaded 2024-05-06) ' || (i - 1) END AS tail FROM range(0, 101) t(i)),
    there AS (SELECT 'N' || s_suppkey || '.pdf' AS f FROM supplier UNION SELECT 'N' || (2 * s_suppkey) || ' (uploaded copy).pdf' FROM supplier),
    free AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY i) AS turn, stem || tail || '.pdf' AS saved_as FROM (SELECT DISTINCT stem FROM wanted), tails WHERE stem || tail || '.pdf' NOT IN (SELECT f FROM there))
    SELECT stem || '.pdf' AS name, saved_as FROM wanted LEFT JOIN free USING (stem, turn)""")
def b9_free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for uploads of which three want one, some of them taken."""
    from quarrystone.sources.files import free_names

    named = lambda n, tail: F.concat(F.lit("N"), n.cast("long").cast("string"), F.lit(tail)).alias("name")
    wanted = table(spark, sf_dir, "customer").select(named(F.floor(F.col("c_custkey") / 3), ".pdf"))
    s = table(spark, sf_dir, "supplier")
    there = s.select(named(F.col("s_suppkey"), ".pdf")).unionAll(s.select(named(F.col("s_suppkey") * 2, " (uploaded copy).pdf")))
    return free_names(wanted, there, "2024-05-06")


# ---------------------------------------------------------------- indexes in texts

SHEETS_SQL = "s AS (SELECT o_orderkey AS k, 'A-' || (100 + o_orderkey % 900) AS id, coalesce(o_orderpriority, 'none') || ' plan' AS title, coalesce(strftime(o_orderdate, '%m/%d/%Y'), '01/01/2000') AS date FROM orders)"


@query(f"WITH {SHEETS_SQL} SELECT k, id, title, date FROM s UNION ALL SELECT k, 'M201.1', 'Roof', '2024-02-03' FROM s")
def j7_drawing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of a drawing index for every order, one of them listed twice."""
    from quarrystone.functions.text import drawing_index

    k = F.col("o_orderkey")
    line = F.concat(F.lit("A-"), (k % 900 + 100).cast("string"), F.lit("  "), F.coalesce("o_orderpriority", F.lit("none")), F.lit(" plan\t"), F.coalesce(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("01/01/2000")), F.lit("\n"))
    text = F.concat(F.lit("SHEET INDEX\n"), line, F.lit("M201.1 Roof 2024-02-03\nno sheet 12\n"), line)
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(drawing_index(text)).alias("s")).select("k", "s.*")


@query("""
    SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 50 AS VARCHAR), 2, '0') AS division, NULL AS section, 'Electrical' AS title FROM orders
    UNION ALL SELECT o_orderkey, NULL, '26 05 ' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), 'Cables ' || coalesce(o_orderpriority, 'none') FROM orders""")
def j7_spec_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions and sections of a specification's contents for every order."""
    from quarrystone.functions.text import spec_contents

    k = F.col("o_orderkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    text = F.concat(F.lit("CONTENTS\nDIVISION "), two(50), F.lit(" - Electrical\n  26 05 "), two(100), F.lit(" Cables "), F.coalesce("o_orderpriority", F.lit("none")), F.lit(" ........ 12\nend of it"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(spec_contents(text)).alias("s")).select("k", "s.*")


@query(r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') || ' AHU-1 pumps by others TBD' AS t FROM documents)
    SELECT doc_id, len(regexp_extract_all(t, '(?i)(?:AHU|RTU|EF-|P-[0-9]|CH-|MS-|transformer|switchboard|panelboard|pump|fan)')) AS equipment, len(regexp_extract_all(t, '(?i)(?:OFCI|OFOI|NIC|owner[- ]furnish|by others|by owner|not in contract)')) AS scope,
      len(regexp_extract_all(t, '(?i)(?:NETA|special inspection|testing agency|commission|hydrostatic|TAB|ASTM E)')) AS testing, len(regexp_extract_all(t, '(?i)\b(?:XX|TBD|TODO)\b')) AS placeholder FROM t""")
def j8_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each family of patterns occurs in every text."""
    from quarrystone.functions.text import sweeps

    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" AHU-1 pumps by others TBD"))
    rows = table(spark, sf_dir, "documents").select("doc_id", sweeps(t).alias("s")).select("doc_id", "s.*")
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in rows.columns[1:]])


# ---------------------------------------------------------------- templates

LETTER = """{% set who = o_orderpriority | default:"nobody" %}{{ who | lower | replace:"-":" " }}{% if o_totalprice > 100000 and o_orderstatus == "O" %} (large){% elif o_totalprice <= 50000 %} (small){% else %}.{% endif %}
{% for w in words %}{{ loop.index }}={{ w | upper | wikilink }}{% if not loop.last %}, {% endif %}{% endfor %} {{ words | length }} {{ o_orderdate | date:"DD/MM/YYYY" }}"""


@query("""
    WITH w AS (SELECT *, string_split(coalesce(o_orderpriority, ''), '-') AS w FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL)
    SELECT o_orderkey AS k, replace(lower(coalesce(nullif(o_orderpriority, ''), 'nobody')), '-', ' ') || CASE WHEN o_totalprice > 100000 AND coalesce(o_orderstatus, '') = 'O' THEN ' (large)' WHEN o_totalprice <= 50000 THEN ' (small)' ELSE '.' END
      || array_to_string(list_transform(range(1, len(w) + 1), lambda i: i || '=[[' || upper(w[i]) || ']]'), ', ') || ' ' || len(w) || ' ' || strftime(o_orderdate, '%d/%m/%Y') AS text FROM w""")
def j9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with filters, conditions, a loop and a variable, filled for every order that has a date and a price; a line end after a tag goes with the tag."""
    from quarrystone.functions.template import rendered

    o = table(spark, sf_dir, "orders").where("o_orderdate is not null and o_totalprice is not null").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.split(F.coalesce("o_orderpriority", F.lit("")), "-").alias("words"))
    return rendered(o, LETTER).select(F.col("o_orderkey").alias("k"), "text")


@query("""SELECT 'K ' || c_custkey || ' ' || coalesce(lower(c_mktsegment), '') || '.md' AS file, '# ' || c_name || chr(10) || 'segment: "' || c_mktsegment || '"' AS text FROM customer""")
def b10_batch_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every customer, none of them there yet."""
    from quarrystone.functions.template import batch

    c = table(spark, sf_dir, "customer")
    data = c.select(F.col("c_custkey").cast("string").alias("name"), F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("json"))
    there = c.select(F.concat(F.lit("K "), F.col("c_custkey").cast("string"), F.lit(".md")).alias("file"))
    return batch(data, '# {{ c_name }}\n{{ c_mktsegment | yaml_property:"segment" }}', 'K {{ c_custkey }} {{ c_mktsegment | lower }}.md', there)


# ---------------------------------------------------------------- views over notes

NOTE_VIEW = r"""
properties:
  doc_id: {displayName: Number}
  formula.where: {displayName: Place}
formulas:
  where: 'file.folder + "|" + file.basename + "|" + file.ext'
  tagged: 'file.hasTag("en", "origin/src1")'
  nested: 'file.hasTag("origin")'
  inside: 'file.inFolder("notes/src1")'
  linked: 'file.hasLink("d7")'
  prop: 'file.hasProperty("lang")'
  kb: '(file.size / 1024).round(2)'
  made: 'file.ctime.format("YYYY-MM-DD")'
  same: 'link("elsewhere/" + file.name).linksTo(file)'
  shown: 'file.asLink("x").toString()'
  target: 'link("a/b.md").asFile().basename'
  keys: 'meta.keys().join("+")'
  values: 'meta.values().join("+")'
  held: 'meta.src1'
  bare: 'meta.isEmpty()'
  truthy: 'source.isTruthy()'
  kind: 'n_chars.isType("number")'
  said: 'n_chars.toString()'
  safe: 'escapeHTML("<" + source + ">")'
  own: 'this.file.name'
  listed: 'list(source).length'
  least: 'min(n_chars, 300, number("250"))'
views:
  - type: table
    name: Notes
    order: [doc_id, formula.where, formula.tagged, formula.nested, formula.inside, formula.linked, formula.prop, formula.kb, formula.made, formula.same, formula.shown, formula.target, formula.keys, formula.values, formula.held, formula.bare, formula.truthy, formula.kind, formula.said, formula.safe, formula.own, formula.listed, formula.least]
"""


@query("""
    WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, n_chars FROM documents WHERE n_chars IS NOT NULL)
    SELECT CAST(doc_id AS DOUBLE) AS "Number", 'notes/' || source || '|d' || doc_id || '|md' AS "Place", lang = 'en' OR source = 'src1' AS tagged, true AS nested, source = 'src1' AS inside, (doc_id + 1) % 10 = 7 AS linked, doc_id % 2 = 0 AS prop,
      round(n_chars / 1024.0::DOUBLE, 2) AS kb, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)), '%Y-%m-%d') AS made, true AS same, 'x' AS shown, 'b' AS target, source AS keys, lang AS values, CASE WHEN source = 'src1' THEN lang END AS held, false AS bare,
      source <> '' AS truthy, true AS kind, CAST(n_chars AS VARCHAR) AS said, '&lt;' || source || '&gt;' AS safe, 'Home.md' AS own, 1.0::DOUBLE AS listed, least(n_chars, 250)::DOUBLE AS least FROM d""")
def c15_note_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File, link, object, any and global functions over documents as notes, with display names."""
    from quarrystone.plans.bases import Base

    d = table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), "n_chars")
    k = F.col("doc_id").cast("string")
    name = F.concat(F.lit("d"), k)
    notes = d.select(
        "doc_id", "source", "n_chars", F.create_map("source", "lang").alias("meta"), F.concat(F.lit("notes/"), "source", F.lit("/"), name, F.lit(".md")).alias("file_path"), F.concat(name, F.lit(".md")).alias("file_name"), name.alias("file_basename"),
        F.concat(F.lit("notes/"), "source").alias("file_folder"), F.lit("md").alias("file_ext"), F.col("n_chars").cast("long").alias("file_size"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("timestamp_ntz").alias("file_ctime"),
        F.array("lang", F.concat(F.lit("origin/"), "source")).alias("file_tags"), F.array(F.concat(F.lit("d"), ((F.col("doc_id") + 1) % 10).cast("string"), F.lit("#part"))).alias("file_links"), F.create_map(F.when(F.col("doc_id") % 2 == 0, "lang").otherwise("other"), F.array("lang")).alias("file_properties"),
    )
    rows = Base.of(NOTE_VIEW).view(notes, "Notes", this={"path": "Bases/Home.md"}).rows(display_names=True)
    return rows.select(*[F.col(f"`{c}`").alias(c.removeprefix("formula.")) for c in rows.columns])


# ---------------------------------------------------------------- links, hubs and canvases


@query(f"WITH {PAGES_SQL.strip()}, top AS (SELECT dst FROM edges GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1) SELECT src FROM edges WHERE dst IN (FROM top)")
def i11_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links to the page that most pages link to."""
    from quarrystone.operators.links import backlinks, edges

    graph = edges(_page_links(spark, sf_dir)[1])
    top = graph.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).collect()
    return backlinks(graph, top[0]["dst"] if top else "")


@query(f"WITH {HUBS_SQL.strip()} SELECT name AS member, linked AS by_discipline, false AS by_system, false AS by_space FROM eq")
def e15_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of hubs lead to each equipment note."""
    from quarrystone.operators.links import aliases_of, connectivity, edges, links_of, names_of, resolved, targets

    notes = _hub_notes(spark, sf_dir)
    graph = edges(resolved(links_of(notes), targets(names_of(notes), aliases_of(notes))))
    return connectivity(notes, graph)


@query("SELECT 'c' || o_orderkey AS canvas, id, z FROM orders, (VALUES ('g', 0), ('t', 1)) n(id, z) WHERE o_orderkey % 17 <> 0")
def j6_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from the bottom layer up; a canvas that isn't JSON has none."""
    from quarrystone.operators.canvas import nodes

    return nodes(_canvases(spark, sf_dir)).select("canvas", "id", "z")


@query("SELECT 'c' || o_orderkey AS canvas, node, CAST(hops AS INT) AS hops FROM orders, (VALUES ('a', 0), ('b', 1), ('d', 2), ('e', 3)) n(node, hops) WHERE hops < 2 OR o_orderkey % 3 > 0")
def j5b_canvas_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a start leads to in canvases with a cycle, some of them cut."""
    from quarrystone.operators.canvas import reachable

    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("canvas"), F.when(F.col("o_orderkey") % 3 > 0, "d").otherwise("b").alias("to"))
    edge = lambda a, b: F.concat(F.lit(f'{{"id":"{a}","fromNode":"{a}","toNode":"'), b, F.lit('"}'))
    arrows = F.concat_ws(",", edge("a", F.lit("b")), edge("b", F.col("to")), edge("d", F.lit("a")), F.lit('{"id":"x","fromNode":"d","toNode":"e"}'))
    return reachable(o.select("canvas", F.concat(F.lit('{"nodes":[],"edges":['), arrows, F.lit("]}")).alias("json")), o.select("canvas", F.lit("a").alias("node")))
