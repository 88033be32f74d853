"""The registered queries over the supplied tables and their SQL twins.

to whole tables; the SQL is written separately and says the same. Doubles are rounded to four places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.plans.orders_schedule import DAYS_SQL, base, gaps_sql, hours_sql, schedule, sql, worked_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(*names: str) -> list:
    return [F.round(F.col(n), 4).alias(n) for n in names]


# ---------------------------------------------------------------- search

WORDS = "secret network system report 2024 token license"
TOKENS_SQL = """
    tokens AS (
      SELECT doc_id, unnest(list_concat([t], CASE WHEN contains(t, '.') THEN string_split(t, '.') ELSE [] END)) AS term
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)*')) AS t FROM docs)
    ),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
    len AS (SELECT d.doc_id, coalesce(sum(tf.tf), 0) AS dl FROM docs d LEFT JOIN tf USING (doc_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


def _bm25_sql(docs: str, k: int) -> str:
    asked = ", ".join(f"('{w}', 1.0)" for w in WORDS.split())
    return f"""
    WITH docs AS ({docs}), {TOKENS_SQL.strip()},
    q(term, times) AS (VALUES {asked}),
    s AS (
      SELECT doc_id, round(sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
      FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1
    )
    SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 4) AS score, doc_id FROM s ORDER BY score DESC, doc_id LIMIT {k}"""


@query(_bm25_sql("SELECT doc_id, text FROM documents", 8))
def i8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents for a few words."""
    from quarrystone.operators.search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS, ["doc_id"])


@query(_bm25_sql("SELECT doc_id, text FROM documents", 8))
def i8_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written index of the whole table, which is deleted once the best are known."""
    import uuid

    from quarrystone.operators.search import search_index, write_index
    from quarrystone.session import checkpoint_folder, checkpointed, remove_folder

    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, ["doc_id"])
    best = checkpointed(search_index(spark, folder, WORDS, ["doc_id"]))
    remove_folder(spark, folder)
    return best


@query(_bm25_sql("SELECT doc_id, text FROM documents WHERE lang = 'en' AND contains(source, '1')", 20))
def c8_bm25_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among documents of one language and of sources with a 1; statistics are those of what is left."""
    from quarrystone.operators.search import prefiltered, search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.array("lang").alias("tags"))
    return search(prefiltered(docs, ["1"], ["EN"], path_column="source"), WORDS, ["doc_id"], k=20)


@query(f"""
    WITH docs AS (SELECT doc_id, text FROM documents), {TOKENS_SQL.strip()},
    items AS (SELECT item_id, unnest(list_concat([t], CASE WHEN contains(t, '.') THEN string_split(t, '.') ELSE [] END)) AS term
      FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)*')) AS t FROM benchmark)),
    q AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY 1, 2),
    s AS (
      SELECT item_id, doc_id, round(sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
      FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2
    )
    SELECT item_id, rank, round(score, 4) AS score, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 8""")
def i9_bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents for every benchmark item."""
    from quarrystone.operators.search import search_many

    return search_many(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"], "item_id")


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {TOKENS_SQL.strip()} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1")
def f10_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.search import term_statistics

    return term_statistics(table(spark, sf_dir, "documents"))


@query(r"""
    WITH m AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\b\d{2}\s?\d{2}\s?\d{2}(?:\.\d+)?\b|§\s?[0-9A-Z][0-9A-Z.\-]*|\b(?:Part|Item|Section|Note|Sheet)\s+\d+[A-Za-z.\-]*|\b[EMAPSGCVF]\d{3}(?:\.\d+)?[A-Z]?\b|\b[XGCS]-\d+\b'), lambda x: trim(x))) AS l FROM documents)
    SELECT doc_id, CAST(least(len(l), 10) AS INT) AS n_references, CASE WHEN len(l) <= 10 THEN array_to_string(list_sort(l), ',') END AS refs FROM m""")
def i4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References (section numbers, sheets, items) in every document."""
    from quarrystone.functions.text import references

    docs = table(spark, sf_dir, "documents").select("doc_id", references(F.coalesce("text", F.lit(""))).alias("r"))
    return docs.select("doc_id", F.size("r").alias("n_references"), F.array_join(F.array_sort("r"), ",").alias("refs"))


# ---------------------------------------------------------------- views

ORDER_VIEWS = r"""
filters:
  and:
    - 'o_totalprice > 1000'
    - not:
        - 'o_orderstatus == "P"'
        - 'o_orderpriority.startsWith("5")'
formulas:
  price_k: '(o_totalprice / 10).floor() / 100'
  size: 'if(formula.price_k > 200, "large", if(formula.price_k > 100, "medium", "small"))'
  age: '(date("2002-01-01") - o_orderdate).days'
  label: 'o_orderpriority.slice(2).lower() + " " + o_orderkey.toString()'
  due: '(o_orderdate + "1M").format("YYYY-MM-DD")'
summaries:
  spread: 'values.mean().round(1)'
views:
  - type: table
    name: Open
    filters: 'o_orderstatus == "O" && o_orderdate >= date("1997-01-01")'
    groupBy: {property: formula.size, direction: DESC}
    order: [o_orderkey, formula.price_k, formula.size, formula.age, formula.label, formula.due]
    summaries: {o_totalprice: [Average, Min, Max, Sum, Range, Median, Stddev], o_orderdate: [Earliest, Latest], o_orderstatus: [Filled, Empty, Unique], formula.price_k: spread}
  - type: list
    name: Largest
    limit: 25
    groupBy: {property: o_orderpriority, direction: ASC}
    order: [o_orderkey, o_orderpriority, o_totalprice]
"""
KEPT_SQL = "o_totalprice > 1000 AND NOT (coalesce(o_orderstatus = 'P', false) OR coalesce(starts_with(o_orderpriority, '5'), false))"
OPEN_SQL = f"""
    x AS (
      SELECT *, floor(o_totalprice / 10) / 100 AS price_k FROM orders WHERE {KEPT_SQL} AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01'
    ),
    y AS (SELECT *, CASE WHEN price_k > 200 THEN 'large' WHEN price_k > 100 THEN 'medium' ELSE 'small' END AS size FROM x)"""


def _order_view(spark: SparkSession, sf_dir: str, name: str):
    from quarrystone.plans.bases import Base

    return Base.of(ORDER_VIEWS).view(table(spark, sf_dir, "orders"), name)


@query(f"""
    WITH {OPEN_SQL.strip()}
    SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, price_k, size, round(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400.0, 4) AS age,
           lower(substr(o_orderpriority, 3)) || ' ' || o_orderkey AS label, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS due
    FROM y""")
def c14_view_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with nested filters and formulas."""
    rows = _order_view(spark, sf_dir, "Open").rows()
    return rows.select("o_orderkey", *[F.col(f"`formula.{c}`").alias(c) for c in ("price_k", "size")], F.round("`formula.age`", 4).alias("age"), *[F.col(f"`formula.{c}`").alias(c) for c in ("label", "due")])


@query(f"""
    WITH {OPEN_SQL.strip()}
    SELECT CASE WHEN grouping(size) = 1 THEN NULL ELSE size END AS grp, grouping(size) = 1 AS total, round(avg(o_totalprice), 4) AS average, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most,
           round(sum(o_totalprice), 2) AS sum, round(max(o_totalprice) - min(o_totalprice), 4) AS spread, round(median(o_totalprice), 4) AS median, round(stddev_pop(o_totalprice), 4) AS stddev,
           min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(*) FILTER (o_orderstatus <> '') AS filled, count(*) FILTER (coalesce(o_orderstatus, '') = '') AS empty, count(DISTINCT o_orderstatus) AS uniq, round(avg(price_k), 1) AS mean_k
    FROM y GROUP BY GROUPING SETS ((size), ())""")
def f15_view_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by group and over all rows."""
    s = _order_view(spark, sf_dir, "Open").summaries()
    p = lambda n: F.col(f"`o_totalprice.{n}`")
    return s.select(
        "grp", "total", F.round(p("Average"), 4).alias("average"), F.round(p("Min"), 4).alias("least"), F.round(p("Max"), 4).alias("most"), F.round(p("Sum"), 2).alias("sum"), F.round(p("Range"), 4).alias("spread"), F.round(p("Median"), 4).alias("median"),
        F.round(p("Stddev"), 4).alias("stddev"), F.col("`o_orderdate.Earliest`").alias("earliest"), F.col("`o_orderdate.Latest`").alias("latest"), F.col("`o_orderstatus.Filled`").alias("filled"), F.col("`o_orderstatus.Empty`").alias("empty"), F.col("`o_orderstatus.Unique`").alias("uniq"), F.col("`formula.price_k.spread`").alias("mean_k"),
    )


@query(f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE {KEPT_SQL} ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def f17_view_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped view's first rows."""
    return _order_view(spark, sf_dir, "Largest").rows(tie=["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


DOCUMENT_VIEW = r"""
formulas:
  words: 'text.split(" ").filter(value.length > 3)'
  few: 'formula.words.slice(0, 5).map(value.lower()).unique().sort().join("|")'
  long: 'formula.words.filter(value.length > 8).length'
  tail: 'text.slice(-12).trim().reverse()'
  has: 'if(text.containsAny("secret", "token"), "yes", "no")'
  digits: '/[0-9]{3}/.matches(text)'
  swapped: 'source.replace("src", "source-").title()'
  total: 'text.slice(0, 40).split(" ").reduce(acc + value.length, 0)'
views:
  - type: table
    name: Documents
    order: [doc_id, formula.few, formula.long, formula.tail, formula.has, formula.digits, formula.swapped, formula.total]
"""


@query(r"""
    WITH w AS (SELECT doc_id, text, source, list_filter(string_split(text, ' '), lambda x: length(x) > 3) AS words FROM documents WHERE text IS NOT NULL)
    SELECT CAST(doc_id AS DOUBLE) AS doc_id, array_to_string(list_sort(list_distinct(list_transform(words[1:5], lambda x: lower(x)))), '|') AS few, CAST(len(list_filter(words, lambda x: length(x) > 8)) AS DOUBLE) AS long,
           reverse(trim(substr(text, greatest(length(text) - 11, 1), 12))) AS tail, CASE WHEN contains(text, 'secret') OR contains(text, 'token') THEN 'yes' ELSE 'no' END AS has,
           regexp_matches(text, '[0-9]{3}') AS digits, upper(substr(replace(source, 'src', 'source-'), 1, 1)) || lower(substr(replace(source, 'src', 'source-'), 2)) AS swapped,
           CAST(length(replace(substr(text, 1, 40), ' ', '')) AS DOUBLE) AS total
    FROM w""")
def c14_list_and_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List, string and pattern functions of the view language over every document."""
    from quarrystone.plans.bases import Base

    rows = Base.of(DOCUMENT_VIEW).view(table(spark, sf_dir, "documents").where("text is not null"), "Documents").rows()
    return rows.select("doc_id", *[F.col(f"`formula.{c}`").alias(c) for c in ("few", "long", "tail", "has", "digits", "swapped", "total")])


EVENT_VIEW = r"""
filters: 'ts.hour >= 6 && ts.day != 13'
formulas:
  day: 'ts.format("YYYY-MM-DD")'
  weekday: 'ts.format("ddd")'
  later: '(ts + "2h 30m").time()'
  since: '(ts - date("2024-01-01")).hours.floor()'
  week: 'ts.date() - "1w" < date("2024-01-10")'
  capped: 'min(max(value.round(1), 5), 50).toFixed(1)'
  up: 'value.ceil() - value.floor()'
views:
  - {type: table, name: Events, order: [event_id, formula.day, formula.weekday, formula.later, formula.since, formula.week, formula.capped, formula.up]}
"""


@query(r"""
    SELECT CAST(event_id AS DOUBLE) AS event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%a') AS weekday, strftime(ts + INTERVAL 150 MINUTE, '%H:%M:%S') AS later,
           floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600.0) AS since, CAST(ts AS DATE) - INTERVAL 7 DAY < TIMESTAMP '2024-01-10' AS week, format('{:.1f}', least(greatest(round(value, 1), 5), 50)) AS capped, ceil(value) - floor(value) AS up
    FROM events WHERE hour(ts) >= 6 AND day(ts) <> 13""")
def c14_date_and_number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, duration and number functions of the view language over every event."""
    from quarrystone.plans.bases import Base

    rows = Base.of(EVENT_VIEW).view(table(spark, sf_dir, "events"), "Events").rows()
    return rows.select("event_id", *[F.col(f"`formula.{c}`").alias(c) for c in ("day", "weekday", "later", "since", "week", "capped", "up")])


# ---------------------------------------------------------------- links and pages

PAGES_SQL = r"""
    n0 AS (SELECT page_id, CAST(page_id AS VARCHAR) AS path, string_split(trim(replace(replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), ' ') AS w, html FROM pages),
    names AS (SELECT path, w[1] AS name FROM n0 WHERE w[1] <> ''),
    alias AS (SELECT path, unnest(w[2:]) AS alias FROM n0),
    links AS (SELECT DISTINCT path, trim(replace(h, '/', '')) AS target FROM (SELECT path, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS h FROM n0) WHERE trim(replace(h, '/', '')) <> ''),
    known AS (SELECT key, arg_min(path, r) AS p FROM (SELECT lower(name) AS key, max(path) AS path, 0 AS r FROM names GROUP BY 1 UNION ALL SELECT lower(alias), min(path), 1 FROM alias WHERE alias <> '' GROUP BY 1) GROUP BY 1),
    res AS (SELECT l.path, l.target, k.p AS dst FROM links l LEFT JOIN known k ON k.key = lower(l.target)),
    edges AS (SELECT DISTINCT path AS src, dst FROM res WHERE dst IS NOT NULL),
    deg AS (SELECT n0.path, coalesce(c, 0) AS in_degree FROM (SELECT DISTINCT path FROM names) n0 LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) e ON e.dst = n0.path)"""


def _page_links(spark: SparkSession, sf_dir: str):
    """Pages as notes: the first word of the title is the name, the others are aliases, hrefs are links."""
    from quarrystone.functions.html import hrefs, title
    from quarrystone.operators.links import resolved, targets

    page = F.coalesce("html", F.lit(""))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.split(title(page), " ").alias("w"), F.array_distinct(F.transform(hrefs(page), lambda h: F.trim(F.replace(h, F.lit("/"), F.lit(""))))).alias("h"))
    names = rows.select("path", F.get("w", 0).alias("name")).where(F.col("name") != "")
    aliases = rows.select("path", F.explode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).alias("alias")).where(F.col("alias") != "")
    links = rows.select("path", F.explode("h").alias("target")).where(F.col("target") != "")
    return names, resolved(links, targets(names, aliases))


@query(f"WITH {PAGES_SQL.strip()} SELECT src, dst FROM edges")
def d8_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import edges

    return edges(_page_links(spark, sf_dir)[1])


@query(f"WITH {PAGES_SQL.strip()} SELECT DISTINCT path, target FROM res WHERE dst IS NULL")
def d9_unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import unresolved

    return unresolved(_page_links(spark, sf_dir)[1])


@query(f"""WITH {PAGES_SQL.strip()}
    SELECT CASE WHEN in_degree = 0 THEN '0' WHEN in_degree = 1 THEN '1' WHEN in_degree <= 4 THEN '2-4' WHEN in_degree <= 9 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n FROM deg GROUP BY 1""")
def e14_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import degree_spread, edges, in_degrees

    names, found = _page_links(spark, sf_dir)
    return degree_spread(in_degrees(names, edges(found)))


@query(f"WITH {PAGES_SQL.strip()} SELECT path FROM deg WHERE in_degree = 0")
def d10_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import edges, in_degrees, orphans

    names, found = _page_links(spark, sf_dir)
    return orphans(in_degrees(names, edges(found)))


@query(r"""
    SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title,
           regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS domain,
           len(regexp_extract_all(coalesce(html, ''), '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS n_links
    FROM pages""")
def a22_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.functions.html import domain, hrefs, title

    page = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", title(page).alias("title"), domain(F.coalesce("url", F.lit(""))).alias("domain"), F.size(hrefs(page)).cast("long").alias("n_links"))


@query()
def a22_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable content of every page (a parser's work: tests compare it with brute force)."""
    from quarrystone.functions.html import clean

    return clean(table(spark, sf_dir, "pages")).select("page_id", "title", "domain", "content", "word_count")


@query("""
    WITH ids AS (SELECT substr(c_mktsegment, 1, 1) AS prefix, c_custkey AS n, 'see ' || substr(c_mktsegment, 1, 1) || '-' || c_custkey || ', G-' || (c_custkey % 50) || ' and x-1' AS t FROM customer)
    SELECT prefix, max(n) AS highest, count(DISTINCT n) AS n_ids FROM (SELECT prefix, n FROM ids UNION ALL SELECT 'G', n % 50 FROM ids) GROUP BY 1""")
def f12_register_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest number of each register over texts that cite ids."""
    from quarrystone.operators.links import id_marks

    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("see "), F.substring("c_mktsegment", 1, 1), F.lit("-"), F.col("c_custkey").cast("string"), F.lit(", G-"), (F.col("c_custkey") % 50).cast("string"), F.lit(" and x-1"))
    return id_marks(c.select(text.alias("text")))


@query("""
    WITH r AS (SELECT substr(c_mktsegment, 1, 1) AS prefix, c_custkey % 400 AS number, 'm' || (c_nationkey % 5) AS meaning, c_custkey AS entry FROM customer),
    f AS (SELECT prefix, number, meaning, min(entry) AS entry FROM r GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY prefix, number ORDER BY entry, meaning) AS n FROM f)
    SELECT prefix, number, meaning, m.highest + row_number() OVER (PARTITION BY prefix ORDER BY number, n) AS new_number FROM l JOIN (SELECT prefix, max(number) AS highest FROM r GROUP BY 1) m USING (prefix) WHERE n > 1""")
def f13_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.links import id_collisions

    c = table(spark, sf_dir, "customer")
    return id_collisions(c.select(F.substring("c_mktsegment", 1, 1).alias("prefix"), (F.col("c_custkey") % 400).alias("number"), F.concat(F.lit("m"), (F.col("c_nationkey") % 5).cast("string")).alias("meaning"), F.col("c_custkey").alias("at")))


# ---------------------------------------------------------------- files


@query("SELECT sha1(coalesce(text, '')) AS sha1, CAST(strlen(coalesce(text, '')) AS INT) AS size, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2")
def j4_duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.sources.files import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"), "doc_id")


@query("""
    WITH a AS (SELECT 'p/' || o_orderkey AS path, o_custkey AS size, CAST(epoch(o_orderdate) AS BIGINT) AS m FROM orders WHERE o_orderkey % 11 <> 0),
    b AS (SELECT 'p/' || o_orderkey AS path, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size, CAST(epoch(o_orderdate) AS BIGINT) AS m FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT path, CASE WHEN a.size IS NULL THEN 'new' WHEN b.size IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.size IS DISTINCT FROM b.size OR a.m IS DISTINCT FROM b.m""")
def d19_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of the same files compared by path, size and whole second."""
    from quarrystone.sources.files import manifest_diff

    o = table(spark, sf_dir, "orders")
    files = lambda df, size: df.select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), size.alias("size"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("mtime_s"))
    return manifest_diff(files(o.where("o_orderkey % 11 <> 0"), F.col("o_custkey")), files(o.where("o_orderkey % 13 <> 0"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)))


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def k1_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the batch form of the streaming refresh's windows."""
    from quarrystone.streaming.refresh import event_windows

    rows = event_windows(table(spark, sf_dir, "events"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---------------------------------------------------------------- schedules

OLD, NEW = sql("old"), sql("new", "u")
PATHS_SQL = "wb AS (SELECT n_nationkey AS nation, 'R' || r_regionkey || '.N' || n_nationkey AS codes, r_name || ' > ' || n_name AS names, 'R' || r_regionkey AS region, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""
    WITH {OLD.strip()}, {PATHS_SQL}
    SELECT code, name, CASE status WHEN 'TK_Active' THEN 'In Progress' ELSE 'Not Started' END AS status_label, start, finish, round(float_d, 4) AS float_d, round(target_h / day_hr, 4) AS target_d,
           CASE type WHEN 'TT_Rsrc' THEN 'Resource Dependent' ELSE 'Task' END AS type_label, codes AS wbs
    FROM t_t JOIN wb USING (nation) WHERE status <> 'TK_Complete' AND type IN ('TT_Task', 'TT_Rsrc') AND float_d < 20 AND contains(lower(name), 'urgent') AND (contains(lower(codes), 'r1') OR contains(lower(names), 'r1'))""")
def c1_activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks of one branch with little float and a word in their name."""
    from quarrystone.operators.rollups import activities

    rows = activities(schedule(spark, sf_dir), "incomplete", "task", "R1", "urgent", 20.0)
    return rows.select("code", "name", "status_label", "start", "finish", *r4("float_d", "target_d"), "type_label", "wbs")


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}, f AS (SELECT max(finish) AS fin FROM t_t WHERE NOT summary),
    c AS (SELECT count(*) AS n_activities, count(*) FILTER (status = 'TK_NotStart') AS n_not_started, count(*) FILTER (status = 'TK_Active') AS n_active, count(*) FILTER (complete) AS n_complete, count(*) FILTER (type IN ('TT_Task', 'TT_Rsrc')) AS n_tasks,
      count(*) FILTER (milestone) AS n_milestones, count(*) FILTER (summary) AS n_loe, count(*) FILTER (NOT complete AND coalesce(float_d, 0) < 0) AS n_negative_float FROM t_t)
    SELECT c.*, (SELECT count(*) FROM t_rels) AS n_relationships, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1 AS n_wbs, (SELECT count(*) FROM t_asg) AS n_assignments, fin AS forecast_finish,
           round({hours_sql("'1'", "TIMESTAMP '1998-07-01'", "f.fin")} / 8, 4) AS remaining_d FROM c, f""")
def c2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import summary

    names = ["n_activities", "n_not_started", "n_active", "n_complete", "n_tasks", "n_milestones", "n_loe", "n_negative_float", "n_relationships", "n_wbs", "n_assignments"]
    return summary(schedule(spark, sf_dir)).select(*names, "forecast_finish", *r4("remaining_d"))


DAY_OF_START = "date_trunc('day', s0)"


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}
    SELECT code, round({hours_sql('cal', DAY_OF_START, 'f')}, 4) AS from_order, round({hours_sql('cal', 'f', 's')}, 4) AS back FROM t_t""")
def e1_working_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working hours between dates of every order, forwards and backwards."""
    from quarrystone.operators.calendar import with_hours_between

    s = schedule(spark, sf_dir)
    t = s.tasks.withColumn("s0", F.date_trunc("DAY", "target_start").cast("timestamp_ntz")).withColumn("f", F.coalesce("act_end", "early_end")).withColumn("s", F.coalesce("act_start", "early_start"))
    t = with_hours_between(with_hours_between(t, s.days, "cal_id", "s0", "f", "from_order"), s.days, "cal_id", "f", "s", "back")
    return t.select("code", *r4("from_order", "back"))


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}, {gaps_sql().strip()}
    SELECT p_code AS pred, s_code AS succ, substr(type, 4) AS rel, round(lag_h / p_day_hr, 4) AS lag_d, round(gap_h / s_day_hr, 4) AS gap_d, coalesce(abs(gap_h) <= 0.1, false) AS driving FROM t_gaps""")
def e4_relationship_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap of every relationship, and whether it is driving."""
    from quarrystone.operators.rollups import relationships

    return relationships(schedule(spark, sf_dir)).select(F.col("pred_code").alias("pred"), F.col("succ_code").alias("succ"), "rel", *r4("lag_d", "gap_d"), "driving")


@query(f"""
    WITH {OLD.strip()}
    SELECT substr(type, 4) AS rel, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, count(*) FILTER (lag_h < 0) AS n_leads, count(*) FILTER (lag_h > 0) AS n_lags FROM t_rels GROUP BY 1""")
def c5_relationship_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import relationship_mix
    from quarrystone.operators.schedule import RELATION
    from quarrystone.functions.values import labelled

    rows = schedule(spark, sf_dir).rels.withColumn("rel", labelled(F.col("type"), RELATION))
    signs = rows.groupBy("rel").agg(F.count_if(F.col("lag_h") < 0).alias("n_leads"), F.count_if(F.col("lag_h") > 0).alias("n_lags"))
    return relationship_mix(rows).join(signs, "rel").select("rel", "n", *r4("pct"), "n_leads", "n_lags")


def longest_sql(before: str, t: str = "t", prefix: str = "", ends: str | None = None) -> str:
    """CTEs drv, ends and path (with a prefix) over the schedule's CTEs of the name ``t``, which ``before`` has; without it the days are there too."""
    last = f"SELECT k FROM {t}_t WHERE NOT complete AND NOT summary AND early_end = (SELECT max(early_end) FROM {t}_t WHERE NOT complete AND NOT summary)"
    return f"""
    {before + ', ' + DAYS_SQL.strip() + ', ' if before else ''}{gaps_sql(t).strip()},
    {prefix}drv AS (SELECT succ AS src, pred AS dst FROM {t}_gaps WHERE abs(gap_h) <= 0.1 AND NOT p_complete AND s_type <> 'TT_LOE'),
    {prefix}ends AS ({ends or last}),
    {prefix}path(k) AS (SELECT k FROM {prefix}ends UNION SELECT dst FROM {prefix}path JOIN {prefix}drv ON src = {prefix}path.k)"""


LONGEST_SQL = longest_sql("{}")
REASON_SQL = f"""CASE WHEN EXISTS (SELECT 1 FROM drv WHERE src = t_t.k) THEN NULL WHEN type = 'TT_LOE' THEN 'level of effort (its dates follow the activities it spans)' WHEN cstr = 'CS_ALAP' THEN 'As Late As Possible (scheduled back from its successor)'
        WHEN status = 'TK_Active' THEN 'in progress (started ' || strftime(act_start, '%Y-%m-%d') || '; remaining duration drives finish)'
        WHEN cstr IN ('CS_MSO', 'CS_MSOA') THEN 'constraint: ' || CASE cstr WHEN 'CS_MSO' THEN 'Start On ' ELSE 'Start On or After ' END || strftime(cstr_date, '%Y-%m-%d')
        WHEN abs({hours_sql('cal', 'dd', 'early_start')}) <= 0.1 THEN 'data date (1998-07-01)' WHEN NOT EXISTS (SELECT 1 FROM t_rels r WHERE r.succ = t_t.k) THEN 'no predecessor (open start)'
        ELSE 'unexplained gap (check external dates, leveling, or out-of-sequence progress)' END"""
PATH_SELECT = f"""
    SELECT code, round(float_d, 4) AS float_d, start, finish, k IN (SELECT k FROM ends) AS is_end, coalesce((SELECT string_agg('A' || dst, ';' ORDER BY 'A' || dst) FROM drv WHERE src = t_t.k), '') AS driven_by,
      {REASON_SQL} AS reason
    FROM t_t WHERE k IN (SELECT k FROM path)"""


@query(f"WITH RECURSIVE {LONGEST_SQL.format(OLD.strip())} {PATH_SELECT}")
def e6_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest path with what drives each activity, or why nothing does."""
    from quarrystone.operators.path import longest_path

    rows = longest_path(schedule(spark, sf_dir))
    by = F.coalesce(F.array_join(F.array_sort(F.transform("driven_by", lambda d: d["code"])), ";"), F.lit(""))
    return rows.select("code", *r4("float_d"), "start", "finish", "is_end", by.alias("driven_by"), "reason")


@query(f"""
    WITH RECURSIVE {LONGEST_SQL.format(OLD.strip())}
    SELECT code, round(float_d, 4) AS float_d FROM t_t WHERE NOT complete AND NOT summary AND float_d IS NOT NULL AND k NOT IN (SELECT k FROM path)
      AND float_d <= (SELECT min(coalesce(float_d, 0)) FROM t_t WHERE k IN (SELECT k FROM path)) + 10""")
def e10_near_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.path import near_longest, path_nodes

    s = schedule(spark, sf_dir)
    return near_longest(s, path_nodes(s), 10.0).select("code", *r4("float_d"))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_suppkey < l_partkey),
    r(node) AS (SELECT max(src) FROM e UNION SELECT dst FROM r JOIN e ON src = node)
    SELECT node FROM r WHERE node IS NOT NULL""")
def e6_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last part leads to, through suppliers that are parts again: the frontier walk."""
    from quarrystone.operators.reach import reached

    e = table(spark, sf_dir, "lineitem").where("l_suppkey < l_partkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct().withColumn("g", F.lit(1))
    seeds = e.agg(F.max("src").alias("node")).withColumn("g", F.lit(1)).where(F.col("node").isNotNull())
    return reached(e, seeds, ["g"]).select("node")


@query(f"""
    WITH {OLD.strip()}
    SELECT CAST(k % 7 AS INT) AS path, code, CAST(row_number() OVER (PARTITION BY k % 7 ORDER BY k % 100, start NULLS LAST, k) AS INT) AS place, round(min(coalesce(float_d, 0)) OVER (PARTITION BY k % 7), 4) AS least_float_d FROM t_t WHERE k % 30 = 0""")
def e11_float_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.path import float_paths

    return float_paths(schedule(spark, sf_dir)).select("path", "code", "place", *r4("least_float_d"))


@query(f"""
    WITH {OLD.strip()}, {PATHS_SQL}, up AS (SELECT codes AS w, names, t_t.* FROM t_t JOIN wb USING (nation) UNION ALL SELECT region, r_name, t_t.* FROM t_t JOIN wb USING (nation)),
    every AS (SELECT codes AS w, 2 AS depth FROM wb UNION ALL SELECT DISTINCT 'R' || r_regionkey, 1 FROM region)
    SELECT every.w AS wbs, depth, count(k) AS n_activities, count(k) FILTER (complete) AS n_complete, min(start) AS start, max(finish) AS finish, round(min(float_d) FILTER (NOT complete), 4) AS min_float_d FROM every LEFT JOIN up USING (w) GROUP BY 1, 2""")
def e13_wbs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import wbs_rollup

    return wbs_rollup(schedule(spark, sf_dir)).select(F.col("codes").alias("wbs"), "depth", "n_activities", "n_complete", "start", "finish", *r4("min_float_d"))


LOAD_SQL = f"""
    a0 AS (SELECT a.r, a.rq, t.cal, t.early_start AS s, t.early_end AS f FROM t_asg a JOIN t_t t USING (k) WHERE NOT complete AND rq > 0 AND r % 5 <> 0 AND early_end > early_start),
    a1 AS (SELECT *, {hours_sql('cal', 's', 'f')} AS total FROM a0),
    a2 AS (SELECT r, rq, cal, total, greatest(s, g.d) AS lo, least(f, g.d + INTERVAL 1 DAY) AS hi, CAST(g.d AS DATE) AS day FROM a1, generate_series(CAST(CAST(s AS DATE) AS TIMESTAMP), CAST(CAST(f AS DATE) AS TIMESTAMP), INTERVAL 1 DAY) g(d) WHERE total > 0),
    a3 AS (SELECT r, day, rq * {hours_sql('cal', 'lo', 'hi')} / total AS q FROM a2),
    load AS (SELECT r, day, sum(q) AS qty FROM a3 WHERE q > 0 GROUP BY 1, 2)"""


@query(f"WITH {OLD.strip()}, {DAYS_SQL.strip()}, {LOAD_SQL.strip()} SELECT CAST(r AS VARCHAR) AS rsrc_id, day, round(qty + 1e-7, 4) AS qty FROM load")
def f3_daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaining quantity of every resource by day."""
    from quarrystone.operators.rollups import daily_load

    # many loads are exact ties at four places, which sums in another order leave by 1e-15: both sides are moved off them
    return daily_load(schedule(spark, sf_dir)).select("rsrc_id", "day", F.round(F.col("qty") + 1e-7, 4).alias("qty"))


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}, {LOAD_SQL.strip()},
    lim AS (SELECT s_suppkey AS r, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 * 2 WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS l FROM supplier),
    ov AS (SELECT load.r, max(qty / cap) AS peak, count(*) FILTER (qty > cap + 1e-6) AS days_over, min(day) FILTER (qty > cap + 1e-6) AS first_over
      FROM (SELECT load.*, l * CASE WHEN cd.sec > 0 THEN cd.sec / 3600.0 ELSE 8 END AS cap FROM load JOIN lim ON lim.r = load.r AND l IS NOT NULL JOIN cd ON cd.id = '1' AND cd.d = load.day) load GROUP BY 1)
    SELECT 'S' || x.r AS resource, n_assignments, target_qty, actual_qty, remain_qty, target_cost, actual_cost, remain_cost, CAST(l AS DOUBLE) AS "limit", round(peak, 4) AS peak, days_over, first_over
    FROM (SELECT r, count(*) AS n_assignments, round(sum(tq), 4) AS target_qty, round(sum(aq), 4) AS actual_qty, round(sum(rq), 4) AS remain_qty, round(sum(tc), 4) AS target_cost, round(sum(ac), 4) AS actual_cost, round(sum(rc), 4) AS remain_cost FROM t_asg GROUP BY 1) x LEFT JOIN lim ON lim.r = x.r LEFT JOIN ov ON ov.r = x.r""")
def f2_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, limits and overallocation of every resource."""
    from quarrystone.operators.rollups import resources

    r2 = [F.round(c, 4).alias(c) for c in ("target_qty", "actual_qty", "remain_qty", "target_cost", "actual_cost", "remain_cost")]
    return resources(schedule(spark, sf_dir)).select("resource", "n_assignments", *r2, "limit", *r4("peak"), "days_over", "first_over")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS rsrc_id, CAST(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 * 2 ELSE s_suppkey % 4 END AS DOUBLE) AS \"limit\" FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 > 0")
def d15_latest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import rate_limits

    return rate_limits(schedule(spark, sf_dir)).select("rsrc_id", "limit")


@query(f"""
    WITH {OLD.strip()}
    SELECT code, 'S' || r AS resource, round(tq, 4) AS target_qty, round(aq, 4) AS actual_qty, round(rq, 4) AS remain_qty FROM t_asg JOIN t_t USING (k) JOIN supplier ON s_suppkey = r WHERE contains(lower(s_name || 'S' || r), 's1')""")
def c7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.rollups import assignments

    return assignments(schedule(spark, sf_dir), "S1").select("code", "resource", *r4("target_qty", "actual_qty", "remain_qty"))


@query(f"""
    WITH RECURSIVE {LONGEST_SQL.format(OLD.strip())},
    x AS (SELECT *, NOT complete AND NOT summary AS inc, NOT complete AND NOT summary AND NOT milestone AS work, coalesce(start, TIMESTAMP '9999-12-31') AS st0, k NOT IN (SELECT succ FROM t_rels) AS nop, k NOT IN (SELECT pred FROM t_rels) AS nos, k IN (SELECT k FROM ends) AS is_end, k IN (SELECT k FROM t_asg) AS asg, f0 AS bl_f FROM t_t),
    m AS (SELECT min(st0) AS first FROM x WHERE inc),
    y AS (SELECT x.*, inc AND (nop AND st0 <> first OR nos AND NOT is_end) AS c1, NOT summary AND bl_f <= dd AS due FROM x, m),
    a AS (SELECT count(*) FILTER (inc) AS inc, count(*) FILTER (work) AS work, count(*) AS n, count(*) FILTER (c1) AS c1, count(*) FILTER (inc AND cstr IN ('CS_MSO', 'CS_MEOB')) AS c5, count(*) FILTER (inc AND coalesce(float_d, 0) > 44) AS c6, count(*) FILTER (inc AND coalesce(float_d, 0) < 0) AS c7,
      count(*) FILTER (work AND target_h / day_hr > 44) AS c8, count(*) FILTER (coalesce(act_start > dd, false) OR coalesce(act_end > dd, false) OR status = 'TK_NotStart' AND early_start < dd OR status = 'TK_Active' AND early_end < dd) AS c9,
      count(*) FILTER (work AND target_h > 0 AND NOT asg) AS c10, count(*) FILTER (due) AS due, count(*) FILTER (due AND (act_end IS NULL OR CAST(act_end AS DATE) > CAST(bl_f AS DATE))) AS c11, count(*) FILTER (NOT summary AND act_end <= dd) AS done FROM y),
    why AS (SELECT {REASON_SQL} AS reason FROM t_t WHERE k IN (SELECT k FROM path)),
    last AS (SELECT {hours_sql("'1'", 'dd', 'finish')} / 8 AS cpl, coalesce(float_d, 0) AS fd FROM t_t WHERE k = (SELECT min(k) FROM ends)),
    r AS (SELECT count(*) AS rels, count(*) FILTER (lag_h < 0) AS c2, count(*) FILTER (lag_h > 0) AS c3, count(*) FILTER (r.type = 'PR_FS') AS c4 FROM t_rels r JOIN x s ON s.k = r.succ JOIN x p ON p.k = r.pred WHERE s.inc OR p.inc)
    SELECT CAST(c AS INT) AS "check", n AS "count", d AS denominator, ok AS passed FROM (
      SELECT 1 AS c, c1 AS n, inc AS d, 100.0 * c1 / inc <= 5 AS ok FROM a UNION ALL SELECT 2, c2, rels, c2 = 0 FROM r UNION ALL SELECT 3, c3, rels, 100.0 * c3 / rels <= 5 FROM r UNION ALL SELECT 4, c4, rels, 100.0 * c4 / rels >= 90 FROM r
      UNION ALL SELECT 5, c5, inc, 100.0 * c5 / inc <= 5 FROM a UNION ALL SELECT 6, c6, inc, 100.0 * c6 / inc <= 5 FROM a UNION ALL SELECT 7, c7, inc, c7 = 0 FROM a UNION ALL SELECT 8, c8, work, CASE WHEN work = 0 THEN true ELSE 100.0 * c8 / work <= 5 END FROM a
      UNION ALL SELECT 9, c9, n, c9 = 0 FROM a UNION ALL SELECT 10, c10, work, c10 = 0 FROM a UNION ALL SELECT 11, c11, due, 100.0 * c11 / due <= 5 FROM a
      UNION ALL SELECT 12, n, 1, n = 0 FROM (SELECT count(DISTINCT reason) FILTER (NOT regexp_matches(reason, '^(data date|in progress|level of effort|As Late)')) AS n FROM why)
      UNION ALL SELECT 13, NULL, NULL, coalesce((SELECT cpl > 0 AND (cpl + fd) / cpl >= 0.95 FROM last), false) UNION ALL SELECT 14, NULL, NULL, done / due >= 0.95 FROM a)""")
def f8_quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen checks."""
    from quarrystone.operators.dcma import assess

    return assess(schedule(spark, sf_dir)).select("check", "count", "denominator", "passed")


@query(f"""
    WITH {OLD.strip()}, {DAYS_SQL.strip()}, {PATHS_SQL},
    g AS (SELECT k, sum(tc) AS tc, sum(tq) AS tq, sum(ac) AS ac, sum(aq) AS aq, sum(rc) AS rc, sum(rq) AS rq FROM t_asg GROUP BY 1),
    v AS (SELECT region || ' ' || r_name AS scope, coalesce(tc, 0) AS bac, coalesce(tq, 0) AS bac_q, coalesce(g.ac, 0) AS ac, coalesce(aq, 0) AS ac_q, coalesce(rc, 0) AS etc, coalesce(rq, 0) AS etc_q,
      CASE WHEN complete THEN 1.0 WHEN k % 3 = 0 THEN CASE WHEN target_h = 0 THEN 0 WHEN status = 'TK_Active' THEN 0.5 ELSE 0 END WHEN k % 3 = 1 THEN coalesce(aq / nullif(aq + rq, 0), 0) ELSE (k % 101) / 100.0 END AS pct,
      CASE WHEN dd >= f0 THEN 1.0 WHEN dd > s0 THEN CASE WHEN {hours_sql('cal', 's0', 'f0')} > 0 THEN {hours_sql('cal', 's0', 'dd')} / {hours_sql('cal', 's0', 'f0')} ELSE 1 END ELSE 0 END AS frac
      FROM t_t JOIN wb USING (nation) LEFT JOIN g USING (k) WHERE NOT summary),
    u AS (SELECT scope, 'cost' AS unit, bac, bac * frac AS pv, bac * pct AS ev, ac, etc FROM v UNION ALL SELECT scope, 'quantity', bac_q, bac_q * frac, bac_q * pct, ac_q, etc_q FROM v),
    s AS (SELECT scope, unit, sum(bac) AS bac, sum(pv) AS pv, sum(ev) AS ev, sum(ac) AS ac, sum(etc) AS etc FROM u GROUP BY GROUPING SETS ((scope, unit), (unit)))
    SELECT scope, unit, round(bac, 3) AS bac, round(pv, 3) AS pv, round(ev, 3) AS ev, round(ac, 3) AS ac, round(ev / nullif(ac, 0), 4) AS cpi, round(ev / nullif(pv, 0), 4) AS spi, round(bac / nullif(ev / nullif(ac, 0), 0), 3) AS eac_cpi, round(ac + etc, 3) AS eac_etc FROM s WHERE bac <> 0 OR ac <> 0""")
def f5_earned_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earned value by region and in all, for cost and quantity."""
    from quarrystone.operators.earned import earned_value

    r2 = lambda *n: [F.round(c, 3).alias(c) for c in n]
    return earned_value(schedule(spark, sf_dir)).select("scope", "unit", *r2("bac", "pv", "ev", "ac"), *r4("cpi", "spi"), *r2("eac_cpi", "eac_etc"))


BOTH_SQL = f"{OLD.strip()}, {NEW.strip()}, {DAYS_SQL.strip()}, c AS (SELECT a.k, a.code, b.name, a.name AS old_name, a.status AS a_status, b.status AS b_status, a.complete AS ac, b.complete AS bc, a.milestone AS ms, a.summary AS su, a.finish AS af, b.finish AS bf, a.act_start AS a_as, b.act_start AS b_as, a.act_end AS a_ae, b.act_end AS b_ae, a.float_d AS a_fd, b.float_d AS b_fd, a.target_h / a.day_hr AS a_td, b.target_h / b.day_hr AS b_td, a.cal AS a_cal, b.cal AS b_cal, a.cstr AS a_c, b.cstr AS b_c, a.cstr_date AS a_cd, b.cstr_date AS b_cd, round({hours_sql(chr(39) + '1' + chr(39), 'a.finish', 'b.finish')} / 8, 1) AS shift FROM t_t a JOIN u_t b USING (k))"


def _both(spark: SparkSession, sf_dir: str):
    from quarrystone.operators.diff import compare

    orders = base(spark, sf_dir)
    old, new = schedule(spark, sf_dir, "old", orders), schedule(spark, sf_dir, "new", orders)
    return old, new, compare(old, new)


@query(f"WITH {BOTH_SQL} SELECT code, name, af AS old_finish, bf AS new_finish, shift AS shift_d FROM c WHERE ms AND shift <> 0")
def g2_milestone_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import milestone_movement

    return milestone_movement(_both(spark, sf_dir)[2]).select("code", "name", "old_finish", "new_finish", "shift_d")


@query(f"WITH {BOTH_SQL} SELECT count(*) FILTER (NOT ac AND af <= TIMESTAMP '1998-08-01' AND NOT su) AS n_planned, count(*) FILTER (NOT ac AND af <= TIMESTAMP '1998-08-01' AND NOT su AND bc) AS n_achieved, count(*) FILTER (a_status = 'TK_NotStart' AND b_status <> 'TK_NotStart') AS n_started, count(*) FILTER (NOT ac AND bc) AS n_finished FROM c")
def g4_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import progress

    return progress(*_both(spark, sf_dir))


@query(f"""
    WITH {BOTH_SQL}
    SELECT code, name, 'actual start' AS field, strftime(a_as, '%Y-%m-%d %H:%M') AS old, coalesce(strftime(b_as, '%Y-%m-%d %H:%M'), '(removed)') AS new FROM c WHERE a_as IS NOT NULL AND a_as IS DISTINCT FROM b_as
    UNION ALL SELECT code, name, 'actual finish', strftime(a_ae, '%Y-%m-%d %H:%M'), coalesce(strftime(b_ae, '%Y-%m-%d %H:%M'), '(removed)') FROM c WHERE a_ae IS NOT NULL AND a_ae IS DISTINCT FROM b_ae
    UNION ALL SELECT code, name, 'status', 'Complete', 'In Progress' FROM c WHERE ac AND NOT bc""")
def g5_rewritten_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import rewritten_actuals

    return rewritten_actuals(_both(spark, sf_dir)[2])


@query(f"WITH {BOTH_SQL} SELECT code, name, shift AS shift_d, round(coalesce(b_fd, 0) - coalesce(a_fd, 0), 4) AS float_change_d FROM c WHERE NOT bc AND NOT su AND abs(shift) >= 0.5")
def g6_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import slips

    return slips(_both(spark, sf_dir)[2]).select("code", "name", "shift_d", *r4("float_change_d"))


@query(f"""
    WITH {BOTH_SQL}
    SELECT 'duration' AS what, code, CAST(round(a_td, 4) AS VARCHAR) AS old, CAST(round(b_td, 4) AS VARCHAR) AS new FROM c WHERE abs(a_td - b_td) >= 0.05
    UNION ALL SELECT 'calendar', code, CASE a_cal WHEN '1' THEN 'Five days' ELSE 'Always' END, CASE b_cal WHEN '1' THEN 'Five days' ELSE 'Always' END FROM c WHERE a_cal <> b_cal
    UNION ALL SELECT 'name', code, old_name, name FROM c WHERE old_name <> name
    UNION ALL SELECT 'constraint', code, l || strftime(a_cd, '%Y-%m-%d'), l || strftime(b_cd, '%Y-%m-%d') FROM (SELECT *, CASE a_c WHEN 'CS_MSO' THEN 'Start On ' WHEN 'CS_MEOB' THEN 'Finish On or Before ' ELSE 'Start On or After ' END AS l FROM c) WHERE CAST(a_cd AS DATE) IS DISTINCT FROM CAST(b_cd AS DATE)""")
def g7_structural_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of duration, calendar, name and constraints."""
    from quarrystone.operators import diff

    both = _both(spark, sf_dir)[2]
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), "code", a.alias("old"), b.alias("new"))
    text = lambda c: F.round(c, 4).cast("string")
    old, new = F.col("old"), F.col("new")
    out = row(diff.duration_changes(both), "duration", text("old_d"), text("new_d"))
    for what, f in (("calendar", diff.calendar_changes), ("name", diff.renamed), ("constraint", diff.constraint_changes)):
        out = out.unionByName(row(f(both), what, old, new))
    return out


def _logic_text(lag: str) -> str:
    return f"substr(r.type, 4) || CASE WHEN {lag} = 0 THEN '' ELSE ' ' || CASE WHEN {lag} > 0 THEN '+' ELSE '' END || regexp_replace(CAST({lag} AS VARCHAR), '\\.0+$', '') END"


@query(f"""
    WITH {OLD.strip()}, {NEW.strip()},
    a AS (SELECT p.code AS pred, s.code AS succ, {_logic_text('lag')} AS txt FROM (SELECT r.*, round(lag_h / p.day_hr, 1) AS lag FROM t_rels r JOIN t_t p ON p.k = r.pred) r JOIN t_t p ON p.k = r.pred JOIN t_t s ON s.k = r.succ),
    b AS (SELECT p.code AS pred, s.code AS succ, {_logic_text('lag')} AS txt FROM (SELECT r.*, round(lag_h / p.day_hr, 1) AS lag FROM u_rels r JOIN u_t p ON p.k = r.pred) r JOIN u_t p ON p.k = r.pred JOIN u_t s ON s.k = r.succ)
    SELECT pred, succ, CASE WHEN a.txt IS NULL THEN 'added' WHEN b.txt IS NULL THEN 'deleted' ELSE 'changed' END AS change, coalesce(a.txt, '-') AS old, coalesce(b.txt, '-') AS new FROM a FULL JOIN b USING (pred, succ) WHERE a.txt IS DISTINCT FROM b.txt""")
def g8_logic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.diff import logic_changes

    orders = base(spark, sf_dir)
    return logic_changes(schedule(spark, sf_dir, "old", orders), schedule(spark, sf_dir, "new", orders))


@query(f"WITH {OLD.strip()}, {NEW.strip()} SELECT 'added' AS change, code, name, finish FROM u_t WHERE k NOT IN (SELECT k FROM t_t) UNION ALL SELECT 'deleted', code, name, finish FROM t_t WHERE k NOT IN (SELECT k FROM u_t)")
def g9_added_and_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators import diff

    both = _both(spark, sf_dir)[2]
    return diff.added(both).select(F.lit("added").alias("change"), "code", "name", "finish").unionByName(diff.deleted(both).select(F.lit("deleted").alias("change"), "code", "name", F.col("old_finish").alias("finish")))


# ---------------------------------------------------------------- milestone gaps

EVENTS_SQL = """
    d AS (SELECT 'week ' || (day(ts) - 1) // 15 AS version, 'USER ' || (user_id % 30) AS grp, event_type AS key, min(CAST(ts AS DATE)) AS date FROM events GROUP BY 1, 2, 3),
    gr AS (SELECT grp, row_number() OVER (ORDER BY CAST(substr(grp, 6) AS INT)) AS g FROM (SELECT DISTINCT grp FROM d)),
    pairs AS (SELECT x.key AS a, y.key AS b, sum(CASE WHEN x.date < y.date THEN 1 ELSE -1 END) AS lead FROM d x JOIN d y ON x.version = y.version AND x.grp = y.grp AND x.key <> y.key AND x.date <> y.date GROUP BY 1, 2),
    ko AS (SELECT key, coalesce(score, 0) AS score, row_number() OVER (ORDER BY coalesce(score, 0) DESC, key) AS k FROM (SELECT DISTINCT key FROM d) LEFT JOIN (SELECT a, count(*) FILTER (lead > 0) AS score FROM pairs GROUP BY 1) ON a = key),
    have AS (SELECT DISTINCT grp, key, g, k FROM d JOIN gr USING (grp) JOIN ko USING (key)),
    defs AS (
      SELECT 'step' AS kind, grp, key, grp AS from_grp, pk AS from_key FROM (SELECT *, lag(key) OVER (PARTITION BY grp ORDER BY k) AS pk FROM have) WHERE pk IS NOT NULL
      UNION ALL SELECT 'stagger', h.grp, h.key, p.grp, h.key FROM have h JOIN gr p ON p.g = h.g - 1
    ),
    vals AS (SELECT defs.*, t.version, datediff('day', f.date, t.date) AS gap FROM defs JOIN d t ON t.grp = defs.grp AND t.key = defs.key JOIN d f ON f.version = t.version AND f.grp = defs.from_grp AND f.key = defs.from_key)"""


def _event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the month are versions, users are groups, kinds of event milestones."""
    e = table(spark, sf_dir, "events")
    version = F.concat(F.lit("week "), F.floor((F.dayofmonth("ts") - 1) / 15).cast("string"))
    grp = F.concat(F.lit("USER "), (F.col("user_id") % 30).cast("string"))
    return e.groupBy(version.alias("version"), grp.alias("grp"), F.col("event_type").alias("key")).agg(F.min(F.col("ts").cast("date")).alias("date"))


@query(f"WITH {EVENTS_SQL.strip()} SELECT key, CAST(score AS BIGINT) AS score, CAST(k AS INT) AS k FROM ko")
def h6_majority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.gaps import majority_order

    return majority_order(_event_dates(spark, sf_dir))


@query(f"""
    WITH {EVENTS_SQL.strip()}, r AS (SELECT kind, grp, key, from_grp, from_key, max(gap) FILTER (version = 'week 0') AS ref, max(gap) FILTER (version = 'week 1') AS foc FROM vals GROUP BY 1, 2, 3, 4, 5)
    SELECT kind, grp, key, from_grp, from_key, CAST(ref AS DOUBLE) AS ref, CAST(foc AS DOUBLE) AS focus, CAST(foc - ref AS DOUBLE) AS change, coalesce(foc - ref < 0, false) AS squeezed,
      nullif(concat_ws('; ', CASE WHEN foc < 0 THEN 'out of sequence' || CASE WHEN ref <= 0 THEN ' (already so in week 0)' ELSE ' (new)' END WHEN foc = 0 THEN 'no gap' || CASE WHEN ref <= 0 THEN ' (already so in week 0)' ELSE ' (new)' END END,
        CASE WHEN foc > 0 AND foc < 2 THEN 'under 2 cd' END, CASE WHEN ref - foc >= 3 THEN 'squeezed ' || (ref - foc) || ' cd' END), '') AS why
    FROM r""")
def h9_milestone_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap in two versions, its change and what is wrong with it."""
    from quarrystone.operators import gaps

    dates = _event_dates(spark, sf_dir)
    definitions = gaps.gap_definitions(dates, gaps.groups_in_order(dates), gaps.majority_order(dates))
    rows = gaps.compare(gaps.gap_values(dates, definitions), "week 0", "week 1", min_gap=2, shrink=3)
    return rows.select("kind", "grp", "key", "from_grp", "from_key", "ref", "focus", "change", "squeezed", "why")


@query(f"""WITH {EVENTS_SQL.strip()} SELECT version, kind, CASE kind WHEN 'step' THEN from_key || ' to ' || key ELSE key || ' stagger' END AS cadence, CAST(min(gap) AS DOUBLE) AS least, round(avg(gap), 4) AS mean, CAST(max(gap) AS DOUBLE) AS most, count(*) AS n FROM vals GROUP BY 1, 2, 3""")
def f9_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators import gaps

    dates = _event_dates(spark, sf_dir)
    values = gaps.gap_values(dates, gaps.gap_definitions(dates, gaps.groups_in_order(dates), gaps.majority_order(dates)))
    return gaps.cadence(values).select("version", "kind", "cadence", "least", *r4("mean"), "most", "n")


@query(f"WITH {EVENTS_SQL.strip()} SELECT v.version, a.grp, a.key FROM (SELECT DISTINCT grp, key FROM d) a, (SELECT DISTINCT version FROM d) v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.version = v.version AND d.grp = a.grp AND d.key = a.key)")
def h10_missing_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.gaps import missing

    return missing(_event_dates(spark, sf_dir))


from quarrystone import queries_more, queries_text  # noqa: E402  registers the rest

__all__ = ["ORACLES", "QUERIES", "queries_more", "queries_text", "worked_sql"]
