"""Compares a registered query with its SQL on the given tables."""

import duckdb
import numpy as np
import pandas as pd

from basketry.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        known = df[c].dropna()
        if len(known) and known.map(lambda v: isinstance(v, (bool, np.bool_))).all():
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(bool(v))).astype(object)
        elif df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v)).astype(object)
        else:
            df[c] = pd.to_numeric(df[c]).astype(float).round(9)
    return sorted([tuple("NULL" if v is None or v != v else v for v in r) for r in df.itertuples(index=False, name=None)], key=str)


def agrees(spark, query, sql):
    got, want = query(spark, SF).toPandas(), connect().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    return len(got)
