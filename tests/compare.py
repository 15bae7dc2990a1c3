"""Side-by-side run of a registered query and its SQL counterpart."""

import math
import time
from collections import Counter

import duckdb

from incognita.plans.inputs import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql, sf_dir):
    """'' if both agree, else a short account of the difference; and both times."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    mid = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    end = time.time()
    times = (round(mid - start, 2), round(end - mid, 2))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", times
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return "", times
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return (
        f"{sum(a.values())} / {sum(b.values())} rows; only here {len(only_a)} {sorted(map(str, only_a))[:2]}; "
        f"only there {len(only_b)} {sorted(map(str, only_b))[:2]}",
        times,
    )
