"""Compare a query's rows with its SQL's, without order; floats to six places."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=repr)
