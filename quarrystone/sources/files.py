"""Document ingest: inventory, text extraction, incremental runs, manifests, duplicates.

Files are listed and read by Spark (``binaryFile``), so any store that it reads will do.
Extraction runs per row in Python over the bytes; a file that cannot be read gives a row with
status FAILED, never an error. Runs are incremental by a left join with the previous inventory.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quarrystone.session import ship

OK, CACHED, FAILED, SKIPPED = "ok", "ok (cached)", "FAILED", "skipped (unsupported)"
COPIED = ["csv", "tsv", "txt", "md"]
EXTRACTED = ["pdf", "xlsx", "xlsm", "pptx", "msg", "xer", *COPIED]
#: a file on which the PDF tool takes longer is FAILED
PDF_SECONDS = 600
MANIFEST = ["path", "size", "mtime_s"]
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

ship(__name__)


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (relative), name, ext, size, mtime (and content) of all files but the lock files that editors leave."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    path = F.when(F.col("path").startswith(prefix), F.substring(F.col("path"), F.lit(len(prefix) + 1), F.char_length("path"))).otherwise(F.col("path"))
    path = F.when(path.rlike("%[0-9A-Fa-f]{2}"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    name = F.substring_index("path", "/", -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return rows.withColumn("name", name).withColumn("ext", ext).where(~F.col("name").startswith("~$"))


def _xlsx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(SHEET_NS + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET_NS + "si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(SHEET_NS + "sheet"):
        target = rels[sheet.get(REL_NS + "id")].lstrip("/")
        out.append(f"\n## Sheet: {sheet.get('name')}\n")
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(SHEET_NS + "row"):
            cells = []
            for c in row.iter(SHEET_NS + "c"):
                v = c.find(SHEET_NS + "v")
                kind = c.get("t")
                if kind == "s":
                    text = shared[int(v.text)] if v is not None else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(SHEET_NS + "t"))
                elif kind == "b":
                    text = str(v is not None and v.text == "1")
                else:
                    text = v.text or "" if v is not None else ""
                if text.strip():
                    cells.append(text)
            if cells:
                out.append(" | ".join(cells) + "\n")
    return "".join(out)


def _pptx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    numbers = sorted(int(m[1]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
    out = []
    for i, number in enumerate(numbers, 1):
        xml = z.read(f"ppt/slides/slide{number}.xml").decode("utf-8", "ignore")
        texts = [t.strip() for t in re.findall(r"(?s)<a:t>(.*?)</a:t>", xml)]
        out.append(f"\n===== SLIDE {i} =====\n" + " ".join(t for t in texts if t) + "\n")
    return "".join(out)


def slides_without_text(data: bytes) -> tuple[int, int]:
    """(slides that are pictures only, slides)."""
    parts = re.split(r"\n===== SLIDE \d+ =====\n", _pptx(data))[1:]
    return sum(not p.strip() for p in parts), len(parts)


def _msg(data: bytes, least: int = 6) -> str:
    """Printable runs of a message, read as UTF-16 and as bytes."""
    # a run of two-byte characters starts at an even place
    wide_run = re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % least)
    wide, at = [], 0
    while m := wide_run.search(data, at):
        if m.start() % 2:
            at = m.start() + 1
            continue
        wide.append(m[0][::2].decode("ascii"))
        at = m.end()
    narrow = [m[0].decode("ascii") for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]
    return "=== UTF-16 strings ===\n" + "\n".join(wide) + "\n=== ASCII strings ===\n" + "\n".join(narrow)


def _pdf(data: bytes) -> tuple[str, int]:
    """Text and pages, by poppler's ``pdftotext`` where a worker has it (columns stay side by side), else by ``pypdf``."""
    if tool := shutil.which("pdftotext"):
        # bytes go through pipes, so no file is left on the worker; each page ends with a form feed
        text = subprocess.run([tool, "-layout", "-enc", "UTF-8", "-", "-"], input=data, capture_output=True, check=True, timeout=PDF_SECONDS).stdout.decode("utf-8", "replace")
        return text, text.count("\f")
    import pypdf

    pages = pypdf.PdfReader(io.BytesIO(data), strict=False).pages
    return "".join(f"\n\n===== PAGE {i} =====\n{p.extract_text() or ''}" for i, p in enumerate(pages, 1)), len(pages)


def extract(ext: str, data: bytes) -> tuple[str | None, int | None, str]:
    """(text, pages, status) of one file."""
    try:
        if ext == "pdf":
            return *_pdf(data), OK
        if ext in ("xlsx", "xlsm"):
            return _xlsx(data), None, OK
        if ext == "pptx":
            return _pptx(data), None, OK
        if ext == "msg":
            return _msg(data), None, OK
        if ext in COPIED or ext == "xer":
            return data.decode("utf-8", "replace"), None, OK
    except Exception:  # whatever is wrong with a file, the run goes on
        return None, None, FAILED
    return None, None, SKIPPED


def _extract_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(r.path, r.size, r.mtime, *extract(r.ext, bytes(r.content))) for r in b.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["path", "size", "mtime", "text", "pages", "status"]).astype({"pages": "Int32"})


def ingest(spark: SparkSession, root: str, previous: DataFrame | None = None, force: bool = False) -> DataFrame:
    """path, size, mtime, text, pages, status of every file below ``root``.

    Files that the previous result has with the same or a later modification are not read
    again: they keep its text with status ``ok (cached)``. The whole relative path is the key, so files that differ in
    the extension only do not share a text. Schedules (xer) keep their raw text; ``reports.digest`` makes their digest.
    """
    listed = list_files(spark, root)
    done = None
    if previous is not None and not force:
        old = previous.where(F.col("status").isin(OK, CACHED)).select("path", F.col("mtime").alias("__done"), F.col("text").alias("__text"), F.col("pages").alias("__pages"))
        done = listed.join(old, "path").where(F.col("__done") >= F.col("mtime")).select("path", "size", "mtime", F.col("__text").alias("text"), F.col("__pages").alias("pages"), F.lit(CACHED).alias("status"))
        listed = listed.join(done.select("path"), "path", "left_anti")
    supported = F.col("ext").isin(EXTRACTED)
    skipped = listed.where(~supported).select("path", "size", "mtime", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit(SKIPPED).alias("status"))
    todo = list_files(spark, root, content=True).where(supported)
    if done is not None:
        todo = todo.join(done.select("path"), "path", "left_anti")
    out = todo.select("path", "size", "mtime", "ext", "content").mapInPandas(_extract_rows, "path string, size long, mtime timestamp, text string, pages int, status string").unionByName(skipped)
    return out.unionByName(done) if done is not None else out


def inventory(ingested: DataFrame) -> DataFrame:
    """file, size, pages, extract: as the inventory shows them."""
    return ingested.select(F.col("path").alias("file"), F.concat(F.floor(F.col("size") / 1024).cast("string"), F.lit(" KB")).alias("size"), F.when(F.col("pages") > 0, F.concat(F.col("pages").cast("string"), F.lit(" pp"))).otherwise("").alias("pages"), F.col("status").alias("extract"))


def text_name(path: Column, room: int = 200) -> Column:
    """A flat file name for a path's text: separators become __, other characters _, long names are cut and marked by a hash; the extension stays."""
    base = F.regexp_replace(F.regexp_replace(path, "/", "__"), r"[^A-Za-z0-9._-]+", "_")
    short = F.concat(F.left(base, F.lit(room)), F.lit("_"), F.left(F.sha1(base), F.lit(8)))
    return F.concat(F.when(F.char_length(base) > room, short).otherwise(base), F.lit(".txt"))


def manifest(files: DataFrame) -> DataFrame:
    """path, size, mtime_s (whole seconds)."""
    return files.select("path", "size", F.unix_seconds(F.col("mtime")).alias("mtime_s"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (new, changed, removed): by path, size and whole second, never by which is newer."""
    side = lambda df, s: df.select("path", F.struct("size", "mtime_s").alias(s))
    both = side(old, "a").join(side(new, "b"), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha1", F.sha1(F.col(content)))


def find_duplicates(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """The uploads (size, sha1 and other columns) with duplicate_of: the first path of an existing file of that size and hash."""
    known = existing.groupBy("size", "sha1").agg(F.min("path").alias("duplicate_of"))
    return uploads.join(known, ["size", "sha1"], "left")


def duplicate_groups(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """sha1, size, n, first (smallest key): groups of rows with equal texts; copies are counted where they are before they meet."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.groupBy(F.sha1(t).alias("sha1"), F.octet_length(t).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))


def free_names(wanted: DataFrame, existing: DataFrame, day: str) -> DataFrame:
    """name, saved_as: each wanted name or, if a file has it, the first free one of its (uploaded ...) forms; null if none is free.

    ``wanted`` and ``existing`` have a column name; ``day`` is YYYY-MM-DD. Of uploads that want one name each takes the next free
    form, and a form that another upload wants as its name is left to it: no two are saved as one file.
    """
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    turn = lambda key, order: F.row_number().over(Window.partitionBy(key).orderBy(order))
    names = wanted.select("name").distinct()
    # forms are numbered rows, not a hundred expressions: generated code stays small
    each = names.select("name", stem.alias("stem"), F.explode(F.sequence(F.lit(0), F.lit(100))).alias("at"))
    ext = F.substring(F.col("name"), F.char_length("stem") + 1, F.char_length("name"))
    dated = F.when(F.col("at") == 2, f" (uploaded {day})").otherwise(F.concat(F.lit(f" (uploaded {day}) "), (F.col("at") - 1).cast("string")))
    tail = F.when(F.col("at") == 0, "").when(F.col("at") == 1, " (uploaded copy)").otherwise(dated)
    each = each.select("name", "at", F.concat("stem", tail, ext).alias("candidate"))
    others = names.select(F.col("name").alias("candidate"), F.lit(True).alias("asked"))
    free = each.join(existing.select(F.col("name").alias("candidate")).distinct(), "candidate", "left_anti").join(others, "candidate", "left")
    free = free.where((F.col("at") == 0) | F.col("asked").isNull()).select("name", turn("name", "at").alias("turn"), F.col("candidate").alias("saved_as"))
    return wanted.select("name", turn("name", "name").alias("turn")).join(free, ["name", "turn"], "left").select("name", "saved_as")


def intake(spark: SparkSession, upload: str, root: str, folder: str, name: str | None = None, day: str | None = None) -> dict:
    """Takes one uploaded file into ``root/folder`` unless an equal file is there: {"saved", "duplicate_of", "sha1"}, paths relative to ``root``.

    Nothing is overwritten. Files are hashed by Spark, where their size is the same.
    """
    import datetime as dt

    up = with_digest(spark.read.format("binaryFile").load(upload).select(F.col("length").alias("size"), "content")).drop("content").first()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    if any(True for _ in fs.listStatus(target)):
        same = with_digest(list_files(spark, f"{root}/{folder}", content=True).where(F.col("size") == up["size"])).where(F.col("sha1") == up["sha1"]).agg(F.min("path").alias("p")).first()["p"]
        if same:
            return {"saved": None, "duplicate_of": f"{folder}/{same}", "sha1": up["sha1"]}
    names = spark.createDataFrame([(s.getPath().getName(),) for s in fs.listStatus(target)], "name string")
    wanted = spark.createDataFrame([(name or upload.rstrip("/").rsplit("/", 1)[-1],)], "name string")
    saved = free_names(wanted, names, day or dt.date.today().isoformat()).first()["saved_as"]
    if saved is None:
        raise FileExistsError(f"no free name in {folder}")
    src = jvm.org.apache.hadoop.fs.Path(upload)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, fs, jvm.org.apache.hadoop.fs.Path(target, saved), False, False, conf):
        raise OSError(f"{upload} could not be copied")
    return {"saved": f"{folder}/{saved}", "duplicate_of": None, "sha1": up["sha1"]}
