"""Every query with SQL against DuckDB, on tables with odd rows."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import TESTDATA

SHARED = "This very line stands in a good many documents."


def by_duckdb(folder, sql):
    with duckdb.connect() as db:
        for name in ("documents", "labels", "pages", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def in_order(rows):
    return sorted((tuple((k, r[k]) for k in sorted(r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def odd_folder(tmp_path_factory):
    """Few documents: null ids, hosts and texts, repeated rows, ties, lines and runs at the limits."""
    folder = tmp_path_factory.mktemp("odd")
    long = " ".join(f"w{i % 700}" for i in range(9000))
    rows = [(None, SHARED + "\nwith no id " + "x y " * 9, "en", None)]
    rows += [(i, f"{SHARED}\nown {i} " + "and some more words of its own here " * 1, None, None) for i in range(40)]
    rows += [(7, f"{SHARED}\nown 7 and some more words of its own here ", None, None)]
    rows += [(100 + i, "a b " * i + "c", "en", "s1") for i in range(8)]
    rows += [(200 + i, f"  {SHARED.upper()}\t\n\n{SHARED}\n" + "tail\n" * i, "fr", "s2") for i in range(4)]
    rows += [(300, "z " * 5000, "en", "s1"), (301, long, "en", "s1"), (302, "é à " * 40 + "\n" * 50, "fr", "é")]
    rows += [(400 + i, f"alpha beta gamma {'delta ' * (i % 3)} {chr(97 + i % 26)}{chr(98 + i % 7)}", "xx", f"h{i % 3}") for i in range(60)]
    rows += [(500, None, None, ""), (501, "", "xx", "lone"), (502, " \n ", "", "s1")]
    schema = pq.read_schema(f"{TESTDATA}/sf0.001/documents.parquet")
    columns = dict(zip(("doc_id", "text", "lang", "source"), zip(*rows, strict=True), strict=True))
    table = pa.table([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)
    pq.write_table(table, folder / "documents.parquet")
    for name in ("labels", "pages", "benchmark"):
        pq.write_table(pq.read_table(f"{TESTDATA}/sf0.001/{name}.parquet"), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_small_tables(result, folder, name):
    assert in_order(result(name)) == in_order(by_duckdb(folder, ORACLE_SQL[name]))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_odd_tables(spark, odd_folder, name):
    rows = [r.asDict() for r in QUERIES[name](spark, odd_folder).collect()]
    assert rows and in_order(rows) == in_order(by_duckdb(odd_folder, ORACLE_SQL[name]))
