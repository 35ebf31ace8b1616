"""Registered queries against their SQL twins, and what the entry does without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm.queries import BUILDERS, SQL

FOLDER = "/root/testdata/sf0.001"
TEXT_TABLES = "documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parents[2]


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_twin(spark, name):
    db = duckdb.connect()
    for table in TEXT_TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = BUILDERS[name](spark, FOLDER)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ordered(frame.columns, map(tuple, frame.collect())) == ordered(columns, found.fetchall())


@pytest.mark.parametrize("name", BUILDERS)
def test_names_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    table = {4: "embeddings", 8: "pages", 9: "pages"}.get(number, "documents")
    frame = BUILDERS[name](spark, FOLDER)
    if number == 5:
        assert frame.where("conv_id = -7").count() == 1
    elif number not in (2, 11, 12):
        assert frame.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in BUILDERS) == list(range(1, 14))


def test_entry_stands_without_this_part(tmp_path):
    for part in ("ledgerloom", "__spark_entry__.py"):
        source = REPO / part
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / part)
    shutil.rmtree(tmp_path / "ledgerloom/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'region_sales' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
