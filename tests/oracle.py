"""Comparing a query with its SQL on the same tables."""

import datetime
import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def differences(df, con, sql):
    """Rows that one side has more of, and the columns; both empty if they agree."""
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != names:
        return names, sorted(columns)
    at = [columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
