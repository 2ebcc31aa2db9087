"""Holds a Spark result to the rows that DuckDB gives for the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, bool | np.bool_ | int | np.integer):
            return str(int(x))
        return str(round(x, 6) + 0.0) if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)

    columns = sorted(df.columns)
    return sorted(tuple(map(one, row)) for row in df[columns].astype(object).itertuples(index=False))


def duck(sql: str, sf: str = SF, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        if name not in tables:
            con.sql(f"create view {name} as select * from '{path}'")
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()
