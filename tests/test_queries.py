"""Every query with SQL beside it gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from literal_cases import CASE_SQL, CASES

from lexiloom.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def bag(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)].astype(object)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(repr(plain(v)) for v in r) for r in d.where(d.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):  # noqa: ANN001, ANN201
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert bag(got) == bag(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):  # noqa: ANN001, ANN201
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(CASES))
def test_case_of_a_few_rows(spark, con, name):  # noqa: ANN001, ANN201
    want, got = con.execute(CASE_SQL[name]).df(), CASES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert bag(got) == bag(want)


def test_every_query_reads_the_tables(spark, tmp_path):  # noqa: ANN001, ANN201
    """With no tables there, no query can even be planned."""
    for name, f in QUERIES.items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            f(spark, str(tmp_path / "nowhere"))
            raise AssertionError(name)
