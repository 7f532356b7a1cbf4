"""Every registered query beside its SQL on the smallest tables, as the driver does."""

import math
import os

import duckdb
import pytest

from typica.plans.registered import load_all

QUERIES, SQL = load_all()
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert table(df.columns, rows) == table(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(SQL) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)
