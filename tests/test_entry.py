"""The driver's contract: every query against its SQL, run by DuckDB."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import TESTDATA

ROOT = Path(__file__).parents[1]
TYPES = {"VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean"}


def by_duckdb(folder, sql):
    with duckdb.connect() as db:
        for path in glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
        result = db.execute(sql)
        types = {name: TYPES[str(kind)] for name, kind, *_ in result.description}
        return types, sorted(result.fetchall(), key=repr)


def test_sql_belongs_to_queries():
    assert "pricing_summary" in contract.oracle_sql()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query_equals_its_sql(spark, name, sf):
    folder = f"{TESTDATA}/sf{sf}"
    frame = contract.queries()[name](spark, folder)
    types, rows = by_duckdb(folder, contract.oracle_sql()[name])
    assert dict(frame.dtypes) == types
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == rows
    assert rows


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "l_returnflag",
        "l_linestatus",
        "sum_qty",
        "sum_disc_price",
        "avg_disc",
        "count_order",
    ]
    rows = frame.collect()
    assert len(rows) == 6 and all(r.sum_disc_price > 0 for r in rows)


def test_bench_prints_one_json_line():
    env = os.environ | {"BENCH_SF_DIR": f"{TESTDATA}/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1"}
    done = subprocess.run(
        [sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600, check=True
    )
    (report,) = [json.loads(text) for text in done.stdout.splitlines()]
    assert report["queries"].keys() == contract.queries().keys()
    assert report["unit"] == "sec" and report["value"] > 0
