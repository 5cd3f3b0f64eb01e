"""Hold queries against their SQL on one folder of tables."""

import glob
import os

import duckdb
import numpy as np

SMALL = "/root/testdata/sf0.001"


def connect(folder: str):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(a, b) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)

    def norm(df):
        df = df[sorted(df.columns)].copy()
        for k in df:
            df[k] = df[k].round(6) + 0.0 if df[k].dtype.kind == "f" else df[k].map(str) if df[k].dtype == object else df[k]
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    a, b = norm(a), norm(b)
    for k in a:
        if a[k].dtype.kind in "fiub" and b[k].dtype.kind in "fiub":
            assert np.allclose(a[k].astype(float), b[k].astype(float), atol=2e-6, rtol=0, equal_nan=True), k
        else:
            assert (a[k].map(str) == b[k].map(str)).all(), k
