from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerline.llm.queries import QUERIES
from tests.conftest import TESTDATA

TABLES = ["documents", "labels", "pages", "benchmark"]
#: Null, empty and blank texts, a repeated row, nulls in other columns, a long line.
ODD = [
    (90001, None, "en", "s", None),
    (90002, "", None, None, 0),
    (90003, " \n\t ", "en", "s", 4),
    (90004, "one short text", "en", "s", 14),
    (90004, "one short text", "en", "s", 14),
    (90005, "x" * 300_000, "en", "s", 300_000),
    (90006, "mail a@b.co or 10.0.0.1, 4111 1111 1111 1111 or +1 (555) 010-9999 é", None, None, None),
]


def _tables(folder: Path, keep: bool) -> str:
    for name in TABLES:
        table = pq.read_table(f"{TESTDATA}/sf0.001/{name}.parquet")
        if not keep:
            table = table.slice(0, 0)
        elif name == "documents":
            odd = [pa.array(c, t) for c, t in zip(zip(*ODD), table.schema.types, strict=True)]
            table = pa.concat_tables([table, pa.table(odd, schema=table.schema)])
            # names that the operators use themselves
            for extra in ("node", "cell", "n", "text_key", "host", "words", "key", "component"):
                table = table.append_column(extra, pa.array(["x"] * len(table)))
        elif name == "pages":
            odd = pa.table([pa.array([9001, 9002, 9003], table.schema.types[0])] + [
                pa.array([None, "", "no scheme"] if f.name == "url" else [None] * 3, f.type)
                for f in list(table.schema)[1:]
            ], schema=table.schema)
            table = pa.concat_tables([table, odd])
        pq.write_table(table, folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    return _tables(tmp_path_factory.mktemp("small"), True)


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    return _tables(tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="session")
def texts(folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"] or "") for r in rows]


@pytest.fixture(scope="session")
def result(spark, folder):
    """The rows of a query on the small tables, worked out once."""
    made = {}

    def of(name):
        if name not in made:
            made[name] = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
        return made[name]

    return of
