"""Every registered traffic query against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from packetloom.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def norm(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    return repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def rows(df, columns):
    return sorted(tuple(map(norm, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize(("n", "kinds"), [(1, 1), (20, 20), (36, 30), (3000, 25), (5200, 5150)])
def test_local_outliers_of_all_rows(spark, tmp_path, n, kinds):
    """Few rows, copies of vectors (distances of 0 and ties) and more rows than a detector fits."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(kinds, 3)).round(1 if kinds < 100 else 6).astype("float32")
    of = np.arange(n) % kinds if n < 3000 else np.concatenate([np.arange(kinds), np.zeros(40, int), rng.integers(0, kinds, n)])[:n]
    pd.DataFrame({"vec_id": rng.permutation(n), "embedding": list(x[of])}).to_parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    ours, theirs = QUERIES["local_outlier_factor"](spark, str(tmp_path)).toPandas(), con.execute(SQL["local_outlier_factor"]).df()
    ours, theirs = (df.sort_values("vec_id").reset_index(drop=True) for df in (ours, theirs))
    assert list(ours["vec_id"]) == list(theirs["vec_id"])
    # Beside a vector with over 35 copies, whose density is 1e10, sums of doubles leave 15 digits.
    assert np.allclose(ours["anomaly_score"], theirs["anomaly_score"], rtol=1e-12, atol=1e-9)
