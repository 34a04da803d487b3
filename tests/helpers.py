"""Rows compared without regard to order, columns by name."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    return sorted((tuple(plain(v) for v in r) for r in pdf.values.tolist()), key=lambda r: [str(x) for x in r])
