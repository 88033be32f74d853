"""More registered queries: exports, calendars, notes, hubs, canvases and the schedule operators that ``queries`` leaves out.

Notes, canvases and export lines are written out of the supplied tables, row by row, and read by the library's own operators;
the SQL says what must come out of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.plans.orders_schedule import DAYS_SQL, calendar_rows, gaps_sql, schedule
from quarrystone.queries import BOTH_SQL, EVENTS_SQL, LONGEST_SQL, OLD, PATH_SELECT, _both, _event_dates, longest_sql, query, r4, table

# ---------------------------------------------------------------- exports and calendars

FIELDS = "task_id\ttask_code\ttask_name\tearly_start_date\ttarget_drtn_hr_cnt\tnot_read\ttotal_float_hr_cnt"


@query("""
    SELECT 'f' || (o_custkey % 64) AS file, CAST(o_orderkey AS VARCHAR) AS task_id, 'A' || o_orderkey AS code, o_orderpriority AS name, date_trunc('minute', o_orderdate) AS early_start,
           CAST(o_custkey AS DOUBLE) AS target_h, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) - 20 END AS float_h FROM orders""")
def a1_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of many exports, with short rows and a field that nobody reads, read back as activities."""
    from quarrystone.operators.schedule import TASK_FIELDS, typed
    from quarrystone.sources.xer import rows_of

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("f"), (F.col("o_custkey") % 64).cast("string")))
    cells = [k.cast("string"), F.concat(F.lit("A"), k.cast("string")), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.col("o_custkey").cast("string")]
    rest = F.when(k % 5 != 0, F.concat(F.lit("\tx\t"), F.when(k % 11 != 0, (k % 97 - 20).cast("string")).otherwise(""))).otherwise("")
    rows = o.select("file", (k + 10).cast("long").alias("line_no"), F.lit("%R").alias("tag"), F.concat(F.concat_ws("\t", *cells), rest).alias("rest"))
    heads = F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(tag).alias("tag"), F.lit(text).alias("rest")) for n, tag, text in ((0, "ERMHDR", "19.12"), (1, "%T", "TASK"), (2, "%F", FIELDS))])
    lines = o.select("file").distinct().select("file", F.explode(heads).alias("h")).select("file", "h.*").unionByName(rows)
    return typed(rows_of(lines), "TASK", TASK_FIELDS).select("file", "task_id", "code", "name", "early_start", "target_h", "float_h")


@query(f"""
    WITH {DAYS_SQL.strip()},
    every AS (SELECT id, d, sec FROM cd UNION ALL SELECT '3', d, CASE WHEN isodow(d) <= 5 THEN 28800 ELSE 0 END FROM cd WHERE id = '2'),
    span AS (SELECT * FROM every WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')
    SELECT id AS clndr_id, id <> '3' AS parsed, d AS day, sec / 3600.0 AS hours, CAST(sum(sec) OVER (PARTITION BY id ORDER BY d) - sec AS DOUBLE) / 3600 AS hours_before FROM span""")
def a2_calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars read from their nested texts, one of them broken, as days with working hours."""
    from quarrystone.operators import calendar as cal

    texts = [*calendar_rows(), ("3", 3, "Broken", "CA_Base", "N", "8", "40", "(0||CalendarData()(")]
    raw = spark.createDataFrame(texts, "clndr_id string, line_no int, clndr_name string, clndr_type string, default_flag string, day_hr_cnt string, week_hr_cnt string, clndr_data string").withColumn("file", F.lit("x"))
    cals = cal.calendars(raw)
    days = cal.calendar_days(cals, "1996-01-01", "1998-12-31")
    return days.join(cals.select("file", "clndr_id", "parsed"), ["file", "clndr_id"]).select("clndr_id", "parsed", "day", (F.col("day_sec") / 3600.0).alias("hours"), (F.col("cum") / 3600.0).alias("hours_before"))


@query(f"""
    WITH {OLD.strip()}
    SELECT c.*, (SELECT count(*) FROM t_t WHERE cal = clndr_id) AS n_activities, true AS parsed
    FROM (VALUES ('1', 'Five days', 'Base', 8.0::DOUBLE, 40.0::DOUBLE, 'Mon 08:00-12:00,13:00-17:00; Tue 08:00-12:00,13:00-17:00; Wed 08:00-12:00,13:00-17:00; Thu 08:00-12:00,13:00-17:00; Fri 08:00-12:00,13:00-17:00', 2),
      ('2', 'Always', 'Base', 24.0::DOUBLE, 168.0::DOUBLE, 'Mon 00:00-24:00; Tue 00:00-24:00; Wed 00:00-24:00; Thu 00:00-24:00; Fri 00:00-24:00; Sat 00:00-24:00; Sun 00:00-24:00', 0)) c(clndr_id, name, type, day_hr, week_hr, work_week, n_exceptions)""")
def c6_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import calendar_list

    return calendar_list(schedule(spark, sf_dir)).select("clndr_id", "name", "type", "day_hr", "week_hr", "work_week", "n_exceptions", "n_activities", "parsed")


@query("SELECT * FROM (VALUES ('Five days', DATE '1996-12-25', 'Wed', 0, 0.0::DOUBLE), ('Five days', DATE '1997-07-05', 'Sat', 1, 4.0::DOUBLE)) h(name, day, weekday, n_periods, hours)")
def c6_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import holidays

    s = schedule(spark, sf_dir)
    return holidays(s, 1996).unionByName(holidays(s, 1997)).select("name", "day", "weekday", "n_periods", "hours")


@query(f"WITH {OLD.strip()} SELECT 'P' AS proj_id, 'Orders' AS short_name, 'Y' AS export_flag, count(*) AS n_activities FROM t_t")
def a4_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import projects

    return projects(schedule(spark, sf_dir)).select("proj_id", "short_name", "export_flag", "n_activities")


# ---------------------------------------------------------------- schedules

def _chain_sql(drv: str) -> str:
    """The activity with the last id before which three driving relationships follow each other (else two, else one), of those that both updates have."""
    last = "(SELECT CAST(max(CAST(a.src AS VARCHAR)) AS BIGINT) FROM {} WHERE a.src % 17 <> 0)"
    joins = [f"{drv} a JOIN {drv} b ON a.dst = b.src JOIN {drv} c ON b.dst = c.src", f"{drv} a JOIN {drv} b ON a.dst = b.src", f"{drv} a"]
    return f"SELECT coalesce({', '.join(last.format(j) for j in joins)}) AS k"


def _chain_code(s) -> str:
    from quarrystone.operators.path import driving_edges
    from quarrystone.session import checkpointed

    e = checkpointed(driving_edges(s).select("src", "dst"))
    step = lambda df, n: df.join(e.select(F.col("src").alias("at"), F.col("dst").alias(f"d{n}")), F.col(f"d{n - 1}") == F.col("at")).drop("at")
    one = e.where(F.col("src").cast("long") % 17 != 0).select("src", F.col("dst").alias("d1"))
    two = step(one, 2)
    last = [df.agg(F.max("src")).first()[0] for df in (step(two, 3), two, one)]
    return "A" + next(x for x in last if x is not None)


@query(f"WITH RECURSIVE {longest_sql(OLD.strip(), ends=_chain_sql('drv'))} {PATH_SELECT}")
def e6_path_to_an_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driving path of an activity with a chain before it, of several activities."""
    from quarrystone.operators.path import longest_path

    s = schedule(spark, sf_dir)
    rows = longest_path(s, _chain_code(s))
    by = F.coalesce(F.array_join(F.array_sort(F.transform("driven_by", lambda d: d["code"])), ";"), F.lit(""))
    return rows.select("code", *r4("float_d"), "start", "finish", "is_end", by.alias("driven_by"), "reason")


@query(f"""
    WITH RECURSIVE {LONGEST_SQL.format(OLD.strip())}, f AS (SELECT k FROM t_t WHERE k % 9 = 0 AND NOT complete)
    SELECT count(*) FILTER (p.k IS NOT NULL AND f.k IS NOT NULL) AS "both", count(*) FILTER (f.k IS NULL) AS only_here, count(*) FILTER (p.k IS NULL) AS only_flagged FROM path p FULL JOIN f ON p.k = f.k""")
def e9_flag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.path import flag_agreement, path_nodes

    s = schedule(spark, sf_dir)
    return flag_agreement(s, path_nodes(s)).select("both", "only_here", "only_flagged")


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}, {gaps_sql().strip()},
    g AS (SELECT *, CASE WHEN abs(gap_h) <= 0.1 THEN 'DRIVING' WHEN gap_h < -0.1 THEN 'violated' ELSE '' END AS state FROM t_gaps)
    SELECT 'pred' AS side, CAST(succ AS VARCHAR) AS task_id, p_code AS code, substr(type, 4) AS rel, round(lag_h / p_day_hr, 4) AS lag_d, round(gap_h / s_day_hr, 4) AS gap_d, state FROM g
    UNION ALL SELECT 'succ', CAST(pred AS VARCHAR), s_code, substr(type, 4), round(lag_h / s_day_hr, 4), round(gap_h / s_day_hr, 4), state FROM g""")
def c3_activity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessors and successors of every activity, as its own page lists them."""
    from quarrystone.operators.rollups import relations_of

    s = schedule(spark, sf_dir)
    return relations_of(s, s.mine, s.gaps).select("side", "task_id", "code", "rel", *r4("lag_d", "gap_d"), "state")


@query(f"""
    WITH {BOTH_SQL}, f AS (SELECT (SELECT max(finish) FROM t_t WHERE NOT summary) AS a, (SELECT max(finish) FROM u_t WHERE NOT summary) AS b)
    SELECT a AS old_finish, b AS new_finish, round(epoch(b - a) / 86400.0, 1) AS shift_cd, 31.0::DOUBLE AS data_date_cd, (SELECT count(*) FROM t_t) AS n_old, (SELECT count(*) FROM u_t) AS n_new,
      (SELECT count(*) FROM u_t WHERE k NOT IN (SELECT k FROM t_t)) AS n_added, (SELECT count(*) FROM t_t WHERE k NOT IN (SELECT k FROM u_t)) AS n_deleted FROM f""")
def g1_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import headline

    return headline(*_both(spark, sf_dir)).select("old_finish", "new_finish", "shift_cd", "data_date_cd", "n_old", "n_new", "n_added", "n_deleted")


@query(f"""
    WITH RECURSIVE {BOTH_SQL}, {longest_sql('', 't', 'old_', _chain_sql('old_drv')).strip()}, {longest_sql('', 'u', 'new_', 'SELECT k FROM old_ends').strip()},
    x AS (SELECT coalesce(p.k, q.k) AS k, p.k IS NULL AS joined FROM old_path p FULL JOIN new_path q ON p.k = q.k WHERE p.k IS NULL OR q.k IS NULL)
    SELECT 'A' || x.k AS code, coalesce(u.name, t.name) AS name, CASE WHEN joined THEN 'joined' ELSE 'left' END AS change, round(t.float_d, 4) AS old_float_d, round(u.float_d, 4) AS new_float_d FROM x LEFT JOIN t_t t ON t.k = x.k LEFT JOIN u_t u ON u.k = x.k""")
def g3_path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joined or left the path of one activity between two updates."""
    from quarrystone.operators.diff import path_changes

    old, new, both = _both(spark, sf_dir)
    return path_changes(old, new, both, _chain_code(old)).select("code", "name", "change", *r4("old_float_d", "new_float_d"))


@query(f"""
    WITH {OLD.strip()}
    SELECT code, start AS bl_start, finish AS bl_finish, round(coalesce(sum(tc), 0), 3) AS bl_cost, round(coalesce(sum(tq), 0), 3) AS bl_qty FROM t_t LEFT JOIN t_asg USING (k) GROUP BY ALL""")
def d7_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline that another update gives."""
    from quarrystone.operators.dcma import baseline_of

    rows = baseline_of(schedule(spark, sf_dir, "new"), schedule(spark, sf_dir, "old"))
    return rows.select("code", "bl_start", "bl_finish", F.round("bl_cost", 3).alias("bl_cost"), F.round("bl_qty", 3).alias("bl_qty"))


MILESTONES_SQL = f"""
    {OLD.strip()}, found AS (
      SELECT ' ' || substr(CAST(k AS VARCHAR), 1, 1) AS grp, substr(pr, 1, 1) AS key, CAST(CASE WHEN type = 'TT_Mile' THEN start ELSE finish END AS DATE) AS date, code,
             CAST(row_number() OVER (PARTITION BY substr(CAST(k AS VARCHAR), 1, 1), substr(pr, 1, 1) ORDER BY code) AS INT) AS n
      FROM t_t WHERE milestone)"""


def _milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.gaps import milestones_of

    return milestones_of(schedule(spark, sf_dir), "old", group=r"Order (\d)", key=r"\[(\d)")


@query(f"WITH {MILESTONES_SQL.strip()} SELECT grp, key, date, code, n FROM found")
def h1_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, keys and dates that the names of milestones give."""
    return _milestones(spark, sf_dir).select("grp", "key", "date", "code", "n")


@query(f"WITH {MILESTONES_SQL.strip()} SELECT grp, key, first_value(code) OVER (PARTITION BY grp, key ORDER BY n) AS kept, code AS dropped FROM found QUALIFY n > 1")
def h4_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.gaps import doubles

    return doubles(_milestones(spark, sf_dir)).select("grp", "key", "kept", "dropped")


@query(f"""
    WITH {EVENTS_SQL.strip()}, v AS (SELECT grp, key, max(date) FILTER (version = 'week 0') AS v0, max(date) FILTER (version = 'week 1') AS v1 FROM d GROUP BY 1, 2),
    own AS (SELECT grp, key, CAST(max(gap) FILTER (kind = 'stagger') AS DOUBLE) AS stagger, CAST(max(gap) FILTER (kind = 'step') AS DOUBLE) AS step FROM vals WHERE version = 'week 1' GROUP BY 1, 2)
    SELECT grp, key, v0, v1, CAST(datediff('day', v0, v1) AS DOUBLE) AS delta, stagger, step FROM v LEFT JOIN own USING (grp, key)""")
def d16_gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators import gaps

    dates = _event_dates(spark, sf_dir).withColumn("code", F.lit(""))
    groups, keys = gaps.groups_in_order(dates), gaps.majority_order(dates)
    values = gaps.gap_values(dates, gaps.gap_definitions(dates, groups, keys))
    return gaps.matrix(dates, groups, keys, ["week 0", "week 1"], values, "week 0", "week 1").select("grp", "key", "v0", "v1", "delta", "stagger", "step")


@query("""
    WITH d AS (SELECT DISTINCT lang AS version, source AS grp, CAST(n_chars // 500 AS VARCHAR) AS key FROM documents)
    SELECT v.version, a.grp, a.key FROM (SELECT DISTINCT grp, key FROM d) a, (SELECT DISTINCT version FROM d) v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.version = v.version AND d.grp = a.grp AND d.key = a.key)""")
def h10_missing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents: sizes that a source has in one language and lacks in another."""
    from quarrystone.operators.gaps import missing

    return missing(table(spark, sf_dir, "documents").select(F.col("lang").alias("version"), F.col("source").alias("grp"), F.floor(F.col("n_chars") / 500).cast("string").alias("key")))


# ---------------------------------------------------------------- notes

NOTES_SQL = r"""
    notes AS (SELECT doc_id, 'd' || doc_id AS name, source, lang, regexp_replace(replace(coalesce(text, ''), '#', ''), '^\s+|\s+$', '', 'g') AS body FROM documents),
    chunks AS (
      SELECT name || '.md' AS path, 0 AS n, 'T ' || source AS title, 'T ' || source AS headings, 'intro ' || lang AS text, lang AS tags, name || '|' || source || '|' || lang || '|' || lang AS boost FROM notes
      UNION ALL SELECT name || '.md', 1, 'T ' || source, 'T ' || source || ' > Part', body, lang, name || '|' || source || '|' || lang || '|' || lang FROM notes WHERE body <> '')"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with frontmatter and two headings."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit(""))
    text = F.concat(F.lit("---\naliases: ["), "source", F.lit(", "), "lang", F.lit("]\ntags:\n  - "), "lang", F.lit("\n---\n# T "), "source", F.lit("\nintro "), "lang", F.lit("\n## Part\n"), body)
    return d.select(F.concat(name, F.lit(".md")).alias("path"), name.alias("name"), text.alias("text"))


@query(f"WITH {NOTES_SQL.strip()} SELECT path, n, title, headings, tags, boost, md5(text) AS text_md5 FROM chunks")
def i2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every note with headings, tags and boost terms."""
    from quarrystone.sources.notes import chunks

    return chunks(_notes(spark, sf_dir)).select("path", "n", "title", "headings", F.array_join("tags", "|").alias("tags"), F.array_join("boost", "|").alias("boost"), F.md5("text").alias("text_md5"))


TOKENS = r"list_concat([t], CASE WHEN contains(t, '.') THEN string_split(t, '.') ELSE [] END)"
FOUND = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[a-z0-9]+)*')"


@query(f"""
    WITH {NOTES_SQL.strip()},
    tok AS (SELECT path, n, unnest({TOKENS}) AS term, w FROM (SELECT path, n, unnest({FOUND.format("text || ' ' || headings")}) AS t, 1 AS w FROM chunks UNION ALL SELECT path, n, unnest({FOUND.format("replace(boost, '|', ' ')")}), 2 FROM chunks)),
    tf AS (SELECT path, n, term, sum(w) AS tf FROM tok GROUP BY ALL), len AS (SELECT path, n, sum(tf) AS dl FROM tf GROUP BY ALL), st AS (SELECT count(*) AS total, (SELECT sum(dl) FROM len) / count(*) AS avgdl FROM chunks), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT path, n, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN len USING (path, n), st WHERE term IN ('src1', 'secret', 'report', 'part') GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY score DESC, path, n) AS rank, round(score, 4) AS score, path, n FROM s ORDER BY score DESC, path, n LIMIT 20""")
def i6_boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over chunks whose names, aliases and tags count twice."""
    from quarrystone.operators.search import search
    from quarrystone.sources.notes import chunks

    return search(chunks(_notes(spark, sf_dir)), "src1 secret report part", ["path", "n"], k=20, headings="headings", boost="boost")


@query(f"WITH {NOTES_SQL.strip()} SELECT name, source || '|' || lang AS aliases, lang AS tags, source || '|' || lang AS parsed_aliases, lang AS parsed_tags FROM notes")
def a8_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter values by expressions, and the same by the parser."""
    from quarrystone.sources.notes import front_of, values_of, with_properties

    n = with_properties(_notes(spark, sf_dir))
    one = lambda c: F.array_join(c, "|")
    return n.select("name", *[one(values_of(front_of(F.col("text")), k)).alias(k) for k in ("aliases", "tags")], *[one(F.element_at("props", k)).alias(f"parsed_{k}") for k in ("aliases", "tags")])


@query("SELECT tag, count(*) AS n FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def f14_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import tag_counts

    return tag_counts(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1' AND contains(lower(text), 'on')")
def c12_embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import embedded_search

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang").alias("tags"), F.create_map(F.lit("source"), F.array("source")).alias("props"))
    return d.where(embedded_search("tag:#en source:SRC1 on")).select("doc_id")


@query("""
    SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' OR contains('p/' || o_orderkey, 'p/1') THEN 'red' WHEN contains(lower(o_orderpriority), 'high') THEN 'blue' END AS color FROM orders""")
def c11_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import color_groups

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.create_map(F.lit("st"), F.array("o_orderstatus"), F.lit("pr"), F.array("o_orderpriority")).alias("props"))
    return o.select("k", color_groups([('["st":"p"] OR path:"P/1"', "red"), ('["pr":"high"]', "blue")]).alias("color"))


@query(r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '…' ELSE flat END AS excerpt FROM t""")
def i10_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.functions.text import squeezed

    return table(spark, sf_dir, "documents").select("doc_id", squeezed(F.coalesce("text", F.lit("")), 200).alias("excerpt"))


@query("""
    SELECT o_orderkey AS k, '1 H ' || o_orderkey AS heads, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ' pay ' || o_orderkey AS todo, 'note + Title ' || o_orderkey AS calls, 'img ' || o_orderkey || '.png' AS embedded, 'tag/' || (o_orderkey % 5) AS tags, 'hid ' || o_orderkey AS hidden FROM orders""")
def j10_markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, tasks, callouts, embeds, tags and comments of a note for every order."""
    from quarrystone.functions import text as t

    k = F.col("o_orderkey").cast("string")
    note = F.concat(F.lit("# H "), k, F.lit("\n```\n# no heading\n```\n- ["), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(" "), F.lit("] pay "), k, F.lit("\n> [!note]+ Title "), k, F.lit("\n![[img "), k, F.lit(".png]] #tag/"), (F.col("o_orderkey") % 5).cast("string"), F.lit(" %%hid "), k, F.lit("%%"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), note.alias("x"))
    said = lambda c, *fields: F.array_join(F.transform(c, lambda r: F.concat_ws(" ", *[r[f].cast("string") for f in fields])), ";")
    x = F.col("x")
    return rows.select("k", said(t.headings(x), "level", "title").alias("heads"), said(t.tasks(x), "done", "text").alias("todo"), said(t.callouts(x), "type", "fold", "title").alias("calls"), F.array_join(t.embeds(x), ";").alias("embedded"), F.array_join(t.inline_tags(x), ";").alias("tags"), F.array_join(t.hidden_comments(x), ";").alias("hidden"))


# ---------------------------------------------------------------- hubs

HUBS_SQL = """
    eq AS (SELECT replace(c_name, '#', ' ') AS name, n_name || ' ' || (c_custkey // 100) AS discipline, c_mktsegment AS system, c_custkey % 2 = 0 AS linked FROM customer JOIN nation ON n_nationkey = c_nationkey),
    members AS (SELECT '02 - Disciplines/' || discipline || '.md' AS hub, name AS member, linked FROM eq UNION ALL SELECT '03 - Systems/' || system || '.md', name, false FROM eq)"""


def _hub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as equipment, hubs of at most a hundred of them by nation, and segments as systems; hubs link every second customer."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    c = c.withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit(" "))).withColumn("d", F.concat("n_name", F.lit(" "), F.floor(F.col("c_custkey") / 100).cast("string")))
    file = lambda folder, name: F.concat(F.lit(f"{folder}/"), name, F.lit(".md")).alias("path")
    eq = c.select(file("04 - Equipment", F.col("c_name")), F.col("c_name").alias("name"), F.concat(F.lit("---\ndiscipline: "), "d", F.lit("\nsystem: "), "c_mktsegment", F.lit("\n---\nbody")).alias("text"))
    links = F.array_join(F.collect_list(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("[["), "c_name", F.lit("]]")))), " · ")
    hubs = c.groupBy("d").agg(links.alias("l")).select(file("02 - Disciplines", F.col("d")), F.col("d").alias("name"), F.concat(F.lit("# "), "d", F.lit("\n"), "l").alias("text"))
    systems = c.select("c_mktsegment").distinct().select(file("03 - Systems", F.col("c_mktsegment")), F.col("c_mktsegment").alias("name"), F.lit("# A system").alias("text"))
    return eq.unionByName(hubs).unionByName(systems)


@query(f"WITH {HUBS_SQL.strip()} SELECT hub, member FROM members")
def d11_hub_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import hub_members

    return hub_members(_hub_notes(spark, sf_dir)).select("hub", "member")


@query(f"WITH {HUBS_SQL.strip()} SELECT discipline, '02 - Disciplines/' || discipline || '.md' AS hub, count(*) AS n_equipment, count(*) FILTER (linked) AS n_indexed FROM eq GROUP BY 1")
def d12_hub_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import aliases_of, edges, hub_completeness, links_of, names_of, resolved, sync_copies, targets

    notes = _hub_notes(spark, sf_dir)
    names = names_of(notes)
    graph = edges(resolved(links_of(notes), targets(names, aliases_of(notes))))
    return hub_completeness(notes, graph, sync_copies(names)).select("discipline", "hub", "n_equipment", "n_indexed")


@query(f"""WITH {HUBS_SQL.strip()}
    SELECT hub, CASE WHEN starts_with(hub, '02') THEN '## Indexed equipment' ELSE '## Related equipment' END AS section, count(*) AS n_missing, md5(string_agg(member, ',' ORDER BY member)) AS missing_md5 FROM members WHERE NOT linked GROUP BY 1""")
def b7_hub_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hub should link and does not."""
    from quarrystone.operators.links import hub_additions, hub_members

    notes = _hub_notes(spark, sf_dir)
    return hub_additions(notes, hub_members(notes)).select("hub", "section", F.size("missing").cast("long").alias("n_missing"), F.md5(F.array_join("missing", ",")).alias("missing_md5"))


@query("SELECT 'c/' || c_custkey AS path, c_name || '-DESKTOP' || c_custkey || '-1' AS name, c_name AS copy_of FROM customer WHERE c_custkey % 4 = 0")
def c10_sync_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes named after another note and a device."""
    from quarrystone.operators.links import sync_copies

    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    own = c.select(F.concat(F.lit("n/"), k).alias("path"), F.col("c_name").alias("name"))
    copies = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("c/"), k).alias("path"), F.concat("c_name", F.lit("-DESKTOP"), k, F.lit("-1")).alias("name"))
    return sync_copies(own.unionByName(copies)).select("path", "name", "copy_of")


# ---------------------------------------------------------------- canvases


def _canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canvas for every order: a group, a node in or outside it, an edge; some break a rule."""
    k = F.col("o_orderkey")
    if_ = lambda n, a, b: F.when(k % n == 0, F.lit(a)).otherwise(F.lit(b))
    json = F.concat(
        F.lit('{"nodes":[{"id":"g","type":"group","x":0,"y":0,"width":100,"height":100},{"id":"t","type":"'), if_(11, "blob", "text"), F.lit('","text":"x","x":'), (k % 120).cast("string"), F.lit(',"y":5,"width":10,"height":10'), if_(13, ',"color":"red"', ""),
        F.lit('}],"edges":[{"id":"e","fromNode":"g","toNode":"'), if_(7, "gone", "t"), F.lit('"}]'), if_(17, "", "}"),
    )
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), k.cast("string")).alias("canvas"), json.alias("json"))


CANVAS_SQL = "k AS (SELECT o_orderkey AS k, 'c' || o_orderkey AS canvas FROM orders), whole AS (SELECT * FROM k WHERE k % 17 <> 0)"


@query(f"""WITH {CANVAS_SQL}
    SELECT canvas, 2 AS rule, 'e' AS id, 'toNode names no node' AS what FROM whole WHERE k % 7 = 0 UNION ALL SELECT canvas, 4, 't', 'type blob' FROM whole WHERE k % 11 = 0
    UNION ALL SELECT canvas, 7, 't', 'color red' FROM whole WHERE k % 13 = 0 UNION ALL SELECT canvas, 8, NULL, 'not valid JSON' FROM k WHERE k % 17 = 0""")
def j5_canvas_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.canvas import violations

    return violations(_canvases(spark, sf_dir)).select("canvas", "rule", "id", "what")


@query(f"WITH {CANVAS_SQL} SELECT canvas, 'g' AS grp, 't' AS id FROM whole WHERE k % 120 <= 90")
def d20_canvas_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.canvas import contained

    return contained(_canvases(spark, sf_dir)).select("canvas", "grp", "id")


@query(f"WITH {CANVAS_SQL} SELECT canvas, 'g' AS node, 0 AS hops FROM whole UNION ALL SELECT canvas, CASE WHEN k % 7 = 0 THEN 'gone' ELSE 't' END, 1 FROM whole")
def e16_canvas_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.canvas import nodes, reachable

    c = _canvases(spark, sf_dir)
    return reachable(c, nodes(c).where("type = 'group'").select("canvas", F.col("id").alias("node"))).select("canvas", "node", "hops")
