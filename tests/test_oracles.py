"""Every core query against its DuckDB text."""

import duckdb
import pytest

from lectern import queries, queries_rules, queries_tools  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equal_to_the_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got, "a query without rows proves nothing"
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        rows = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
        assert sorted(got, key=repr) == sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
