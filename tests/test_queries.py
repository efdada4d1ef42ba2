"""Every registered query against its SQL oracle in DuckDB, on the smallest fixture."""

import os

import duckdb
import pandas as pd
import pytest

from voxelloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    """Rows as sorted tuples, numbers as floats to six places."""

    def value(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        return v if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else round(float(v), 6) + 0.0

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
@pytest.mark.parametrize("name", ["w_gate", "f_pairs", "m_8pt", "w_loss", "m_ba"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
