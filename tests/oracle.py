"""Compare a query with its SQL: same columns and the same rows in any order."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v if v is None else repr(v)


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in at) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = _rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual != expected:
        return (
            f"{sum(actual.values())} vs {sum(expected.values())} rows; only here "
            f"{list((actual - expected).items())[:3]}; only SQL {list((expected - actual).items())[:3]}"
        )
    if not expected:
        return "no rows"
    return None
