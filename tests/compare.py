"""Rows of a query against rows of its SQL."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def normal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        if rows[c].dtype == object:
            rows[c] = rows[c].map(lambda x: None if x is None else str(x))
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def check(spark, query, sql: str, data: Path = DATA) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = normal(query(spark, str(data)).toPandas()), normal(con.execute(sql).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
