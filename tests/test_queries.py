"""Registered queries against their SQL, and what the entry module promises."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, normal
from quarrystone import queries

SF = "/root/testdata/sf0.001"
#: a few of the schedule's queries stand for all: compare.py runs every one
SLOW = {"c2_summary", "e10_near_longest", "f2_resources", "f8_quality_checks", "g2_milestone_moves", "g4_progress", "g5_rewritten_actuals", "g7_structural_edits", "g9_added_and_deleted", "c5_relationship_mix", "e11_float_paths", "e13_wbs_rollup", "d15_latest_rates", "e1_working_time", "c7_assignments"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert queries.QUERIES.keys() - queries.ORACLES.keys() == {"a22_page_markdown"}


def test_everything_else_works_without_the_llm_folders(tmp_path):
    """The entry module imports with the folders and the pipeline gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("__spark_entry__.py", "compare.py"):
        (tmp_path / p).write_bytes(open(os.path.join(root, p), "rb").read())
    import shutil

    shutil.copytree(os.path.join(root, "quarrystone"), tmp_path / "quarrystone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'i8_bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
