"""Every core query against its SQL."""

import duckdb
import pandas as pd
import pytest

from kbspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    a, b = rows(got), rows(want)
    assert all(x == y or all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-8) for p, q in zip(x, y)) for x, y in zip(a, b))
