"""Every query that has SQL, against DuckDB."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_entry(spark):
    assert {r.label for r in entry.entry(spark).collect()} == {0, 1}


def test_main_library_does_not_import_the_operators():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "tallyloom", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert not re.search(r"\bllm\b", open(path).read()), path
