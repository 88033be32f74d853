"""The link graph of notes: resolution, audit, hubs, copies made by sync, register ids.

Inputs are DataFrames of notes with ``path``, ``name`` and ``text`` (as ``sources.notes``
reads them) or, one step on, of links and names. A link resolves to a note of that
name, else to one with that alias, in any case; everything else is joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import link_target, register_ids, wiki_links, without_code, without_noise
from quarrystone.sources.notes import front_of, values_of

# Folders and names with a meaning.
TEMPLATES, EQUIPMENT, DISCIPLINES, SYSTEMS, SPACES = "98 - Templates", "04 - Equipment", "02 - Disciplines", "03 - Systems", "05 - Spaces"
NO_ORPHANS = ["00 - Home", "98 - Templates", "README", "Change Log"]
BUCKETS = [("0", 0, 0), ("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10+", 10, None)]
HUB_HEADERS = {DISCIPLINES: "## Indexed equipment", SYSTEMS: "## Related equipment", SPACES: "## Equipment & systems here"}
SECTION_ANCHORS = ["## Issues", "## Interdependencies", "## Related", "## Ties", "## Notes", "## Open"]
MEMBERSHIP = [("system", SYSTEMS), ("systems", SYSTEMS), ("space", SPACES), ("spaces", SPACES), ("location", SPACES)]


def in_folder(path: Column, folder: str) -> Column:
    return F.contains(F.concat(F.lit("/"), path), F.lit(f"/{folder}/"))


def targets(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """key (lower case), path: what a link may name. A name goes before an alias; of equal names the last path counts, of equal aliases the first.

    ``names`` and ``aliases`` have path and name (or alias).
    """
    n = names.select(F.lower("name").alias("key"), "path").groupBy("key").agg(F.max("path").alias("path"), F.lit(0).alias("rank"))
    a = aliases.select(F.lower("alias").alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"), F.lit(1).alias("rank"))
    return n.unionByName(a).groupBy("key").agg(F.min_by("path", "rank").alias("path"))


def names_of(notes: DataFrame) -> DataFrame:
    return notes.select("path", "name")


def aliases_of(notes: DataFrame, many_links: bool = False) -> DataFrame:
    return notes.where(F.col("text").isNotNull()).select("path", F.explode(values_of(front_of(F.col("text")), "aliases", many_links=many_links)).alias("alias"))


def links_of(notes: DataFrame, strict_order: bool = False) -> DataFrame:
    """path, target: distinct link targets of each note, outside code and comments.

    ``strict_order`` removes comments, fences and inline code one after the other and keeps block marks, as the link check does.
    """
    text = without_noise(F.col("text")) if strict_order else without_code(F.col("text"))
    each = notes.where(F.col("text").isNotNull()).select("path", F.explode(F.array_distinct(F.transform(wiki_links(text), lambda x: link_target(x, blocks=not strict_order)))).alias("target"))
    return each.where(F.col("target") != "")


def resolved(links: DataFrame, known: DataFrame) -> DataFrame:
    """path, target, to (null: unresolved). Known targets are joined by key; a target that many notes link is split by adaptive execution."""
    k = known.select(F.col("key"), F.col("path").alias("to"))
    return links.withColumn("key", F.lower("target")).join(k, "key", "left").drop("key")


def edges(found: DataFrame) -> DataFrame:
    """src, dst: distinct, self-links included."""
    return found.where(F.col("to").isNotNull()).select(F.col("path").alias("src"), F.col("to").alias("dst")).distinct()


def unresolved(found: DataFrame) -> DataFrame:
    """path, target without a note, but for templates and README notes."""
    return found.where(F.col("to").isNull() & ~in_folder(F.col("path"), TEMPLATES) & ~F.contains("path", F.lit("README"))).select("path", "target").distinct()


def in_degrees(names: DataFrame, graph: DataFrame) -> DataFrame:
    """path, in_degree: distinct notes that link to each note."""
    n = graph.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))
    return names.select("path").distinct().join(n, "path", "left").na.fill(0, ["in_degree"])


def degree_spread(degrees: DataFrame) -> DataFrame:
    """bucket, n of 0, 1, 2-4, 5-9, 10+ inbound links."""
    d = F.col("in_degree")
    bucket = None
    for name, low, high in BUCKETS:
        hit = (d >= low) if high is None else d.between(low, high)
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    return degrees.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def orphans(degrees: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """path of notes without inbound links that ought to have some; copies made by sync are none."""
    out = degrees.where(F.col("in_degree") == 0).select("path")
    for x in NO_ORPHANS:
        out = out.where(~F.contains("path", F.lit(x)))
    return out.join(copies.select("path"), "path", "left_anti") if copies is not None else out


def sync_copies(names: DataFrame) -> DataFrame:
    """path, name, copy_of: notes named like another note with a device's name (and numbers) put behind hyphens.

    The name is cut at its last hyphens, one by one; a piece of six or more characters with a digit
    and a letter is a device. Of the shorter names from there on that exist, the shortest is the original.
    """
    p = names.select("path", "name").where(F.contains("name", F.lit("-")))
    parts = F.split("name", "-")
    n = F.size("parts")
    # cutting ends before a piece that is empty or has white space, and after forty
    tail = F.reverse("parts")
    bad = F.array_position(F.transform(tail, lambda x: (x == "") | x.rlike(r"(?U)\s")), True)
    cuts = F.least(n - 1, F.when(bad > 0, bad - 1).otherwise(n), F.lit(40)).cast("int")
    device = lambda x: (F.char_length(x) >= 6) & x.rlike(r"\d") & x.rlike("[A-Za-z]")
    first = F.array_position(F.transform(tail, device), True).cast("int")
    p = p.withColumn("parts", parts).withColumn("cuts", cuts).withColumn("first", first).where((F.col("first") > 0) & (F.col("first") <= F.col("cuts")))
    bases = F.transform(F.sequence("first", "cuts"), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - i), "-").alias("base")))
    each = p.select("path", "name", F.explode(bases).alias("b")).select("path", "name", "b.i", F.col("b.base").alias("base"), F.lower("b.base").alias("key"))
    known = names.select(F.lower("name").alias("key")).distinct()
    hit = each.join(known, "key", "left_semi")
    return hit.groupBy("path", "name").agg(F.max_by("base", "i").alias("copy_of"))


def audit(notes: DataFrame) -> dict[str, DataFrame]:
    """All parts of the audit, by name."""
    names = names_of(notes)
    copies = sync_copies(names)
    found = resolved(links_of(notes), targets(names, aliases_of(notes)))
    graph = edges(found)
    degrees = in_degrees(names, graph)
    return {
        "unresolved": unresolved(found), "edges": graph, "in_degrees": degrees, "spread": degree_spread(degrees), "orphans": orphans(degrees, copies), "copies": copies,
        "unreadable": notes.where(F.col("text").isNull()).select("path"), "hubs": hub_completeness(notes, graph, copies),
    }


def hub_completeness(notes: DataFrame, graph: DataFrame, copies: DataFrame) -> DataFrame:
    """discipline, hub, n_equipment, n_indexed: how much of its equipment each discipline's hub links. The hub is found by its file name."""
    eq = notes.where(in_folder(F.col("path"), EQUIPMENT)).join(copies.select("path"), "path", "left_anti")
    first = F.get(values_of(front_of(F.coalesce("text", F.lit(""))), "discipline"), 0)
    eq = eq.select(F.col("path").alias("dst"), first.alias("discipline")).where(F.col("discipline").isNotNull())
    hubs = notes.select(F.lower("name").alias("key"), "path").groupBy("key").agg(F.max("path").alias("hub"))
    eq = eq.withColumn("key", F.lower("discipline")).join(hubs, "key")
    linked = graph.select(F.col("src").alias("hub"), "dst", F.lit(1).alias("linked"))
    return eq.join(linked, ["hub", "dst"], "left").groupBy("discipline", "hub").agg(F.count(F.lit(1)).alias("n_equipment"), F.count("linked").alias("n_indexed"))


def broken_links(notes: DataFrame) -> DataFrame:
    """target, notes (names of files, sorted): the link check over all notes but templates; aliases count, block marks are part of a name."""
    alias = notes.where(F.col("text").isNotNull()).select(F.explode(values_of(front_of(F.col("text")), "aliases", unwrap=False)).alias("n"))
    known = notes.select(F.lower("name").alias("key")).union(alias.select(F.lower("n"))).distinct()
    own = links_of(notes.where(~in_folder(F.col("path"), TEMPLATES)), strict_order=True)
    bad = own.withColumn("key", F.lower("target")).join(known, "key", "left_anti")
    return bad.groupBy("target").agg(F.array_sort(F.collect_set(F.substring_index("path", "/", -1))).alias("notes"))


def assert_links(notes: DataFrame) -> None:
    """An error unless every link resolves."""
    bad = broken_links(notes).orderBy("target").limit(20).collect()
    if bad:
        raise ValueError("unresolved links: " + ", ".join(r["target"] for r in bad))


def hub_members(notes: DataFrame, from_links: bool = False) -> DataFrame:
    """hub (path), member (name of an equipment note): as the equipment's own properties declare it, and with ``from_links`` also as it links."""
    copies = sync_copies(names_of(notes))
    text = F.coalesce("text", F.lit(""))
    front = front_of(text)
    eq = notes.where(in_folder(F.col("path"), EQUIPMENT)).join(copies.select("path"), "path", "left_anti")
    of = lambda key, folder: F.transform(values_of(front, key, many_links=True), lambda v: F.struct(F.lower(v).alias("key"), F.lit(folder).alias("folder")))
    declared = eq.select("name", F.explode(F.concat(of("discipline", DISCIPLINES), *[of(k, f) for k, f in MEMBERSHIP])).alias("d")).select("name", "d.key", "d.folder")
    if from_links:
        linked = eq.select("name", F.explode(F.regexp_extract_all(text, F.lit(r"\[\[([^\]#|]+)"), F.lit(1))).alias("l")).select("name", F.lower(F.trim("l")).alias("key"))
        declared = declared.unionByName(linked.withColumn("folder", F.explode(F.array(F.lit(SYSTEMS), F.lit(SPACES)))))
    known = targets(names_of(notes), aliases_of(notes, many_links=True))
    hit = declared.join(known, "key").withColumnRenamed("path", "hub")
    folder_of = lambda f: (F.col("folder") == f) & in_folder(F.col("hub"), f)
    hit = hit.where(folder_of(DISCIPLINES) | folder_of(SYSTEMS) | folder_of(SPACES))
    # a discipline's hub counts by its own name even where another note of that name is resolved first
    byname = declared.where(F.col("folder") == DISCIPLINES).join(notes.where(in_folder(F.col("path"), DISCIPLINES)).select(F.lower("name").alias("key"), F.col("path").alias("hub")), "key")
    return hit.select("hub", F.col("name").alias("member")).union(byname.select("hub", "name")).distinct()


def hub_additions(notes: DataFrame, members: DataFrame) -> DataFrame:
    """hub, section, missing (sorted names): members that a hub's text does not link yet."""
    hubs = notes.where(F.col("text").isNotNull()).select(F.col("path").alias("hub"), "text")
    link = lambda end: F.contains("text", F.concat(F.lit("[["), F.col("member"), F.lit(end)))
    gone = members.join(hubs, "hub").where(~link("]]") & ~link("|"))
    section = F.when(in_folder(F.col("hub"), DISCIPLINES), HUB_HEADERS[DISCIPLINES]).when(in_folder(F.col("hub"), SYSTEMS), HUB_HEADERS[SYSTEMS]).otherwise(HUB_HEADERS[SPACES])
    return gone.groupBy("hub").agg(F.array_sort(F.collect_set("member")).alias("missing")).withColumn("section", section)


def with_links_added(text: str, section: str, missing: list[str]) -> str:
    """The hub's text with the links put into its section: behind the section's first line, else in a new section before the first known one, else at the end."""
    links = " · ".join(f"[[{m}]]" for m in missing)
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line.startswith(section):
            rest = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), None)
            if rest is None:
                return "\n".join([*lines[: i + 1], links, *lines[i + 1 :]])
            lines[rest] = f"{lines[rest].rstrip()} · {links}"
            return "\n".join(lines)
    starts, at = [], 0
    for line in lines:
        if any(line.startswith(a) for a in SECTION_ANCHORS):
            starts.append(at)
        at += len(line) + 1
    cut = min(starts, default=len(text))
    return f"{text[:cut]}\n{section}\n{links}\n\n{text[cut:]}"


def connectivity(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """member, by_discipline, by_system, by_space: whether each equipment note is linked from a hub of each kind."""
    eq = notes.where(in_folder(F.col("path"), EQUIPMENT)).select("path", F.col("name").alias("member"))
    from_ = lambda f: F.coalesce(F.bool_or(in_folder(F.col("src"), f)), F.lit(False))
    return eq.join(graph, F.col("path") == F.col("dst"), "left").groupBy("member").agg(from_(DISCIPLINES).alias("by_discipline"), from_(SYSTEMS).alias("by_system"), from_(SPACES).alias("by_space"))


def backlinks(graph: DataFrame, path: str) -> DataFrame:
    return graph.where(F.col("dst") == path).select("src")


def id_marks(texts: DataFrame, text: str = "text") -> DataFrame:
    """prefix, highest, n_ids: the highest number of each register's ids over all texts, copies included."""
    each = texts.select(F.explode(register_ids(F.col(text))).alias("x")).select("x.*")
    return each.groupBy("prefix").agg(F.max("number").alias("highest"), F.count_distinct("number").alias("n_ids"))


def id_collisions(rows: DataFrame) -> DataFrame:
    """prefix, number, meaning, new_number: ids with several meanings. The earliest keeps its number, the others get numbers above the highest.

    ``rows``: prefix, number, meaning, at (order of entry).
    """
    first = rows.groupBy("prefix", "number", "meaning").agg(F.min("at").alias("at"))
    same = Window.partitionBy("prefix", "number").orderBy("at", "meaning")
    later = first.withColumn("n", F.row_number().over(same)).where("n > 1")
    marks = rows.groupBy("prefix").agg(F.max("number").alias("highest"))
    order = Window.partitionBy("prefix").orderBy("number", "n")
    return later.join(marks, "prefix").select("prefix", "number", "meaning", (F.col("highest") + F.row_number().over(order)).alias("new_number"))


def color_groups(queries: list[tuple[str, object]], props: str = "props", path: str = "path") -> Column:
    """The value of the first query that a note fits: ["property":"part"], path:"part", and OR between them."""
    import re

    def term(q: str) -> Column:
        if m := re.fullmatch(r'\["([^"]+)":"([^"]+)"\]', q.strip()):
            values = F.coalesce(F.try_element_at(F.col(props), F.lit(m[1])), F.array().cast("array<string>"))
            return F.exists(values, lambda v: F.contains(F.lower(v), F.lit(m[2].lower())))
        if m := re.fullmatch(r'path:"([^"]+)"', q.strip()):
            return F.contains(F.lower(path), F.lit(m[1].lower()))
        raise ValueError(f"not a color query: {q}")

    out = None
    for query, value in queries:
        hit = F.lit(False)
        for q in query.split(" OR "):
            hit = hit | term(q)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if out is not None else F.lit(None)


def embedded_search(query: str, tags: str = "tags", props: str = "props") -> Column:
    """``tag:#x key:value words``: all must hold; words are looked for in the text."""
    out = F.lit(True)
    for part in query.split():
        key, colon, value = part.partition(":")
        if key == "tag" and colon:
            want = value.lstrip("#").lower()
            out = out & F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: (F.lower(t) == want) | F.lower(t).startswith(want + "/"))
        elif colon and value:
            out = out & F.exists(F.coalesce(F.try_element_at(F.col(props), F.lit(key)), F.array().cast("array<string>")), lambda v: F.lower(v) == value.lower())
        else:
            out = out & F.contains(F.lower("text"), F.lit(part.lower()))
    return out


def tag_counts(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    return tagged.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
