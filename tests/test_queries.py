"""Every registered query of the library against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from meshcast import queries

SF = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, str(SF))
    wanted = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = plain(found.toPandas()), plain(wanted)
    assert len(a) == len(b)
    assert a == b
