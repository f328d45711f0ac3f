"""Every query of the reference's operators against its SQL, on the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quarrymill.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    df = df.astype({c: "float64" for c, kind in df.dtypes.items() if str(kind) in ("Int32", "Int64")})  # as Spark gives integers with nulls
    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_registry_imports_without_the_training_operators():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    for file in Path("quarrymill").rglob("*.py"):
        if "llm" not in file.parts:
            assert "quarrymill.llm" not in file.read_text() and "from ..llm" not in file.read_text()
