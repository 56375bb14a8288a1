"""Compare a query's rows with those its SQL gives in DuckDB, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One form for values that both engines write differently."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.7g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """An empty text if both sides agree, else what differs."""
    cursor = con.execute(sql)
    their_columns = [c[0] for c in cursor.description]
    theirs = rows_of(their_columns, cursor.fetchall())
    ours = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(their_columns):
        return f"columns {sorted(df.columns)} against {sorted(their_columns)}"
    if ours != theirs:
        return (f"{sum(ours.values())} rows against {sum(theirs.values())}; "
                f"only ours {list((ours - theirs).items())[:3]}; "
                f"only theirs {list((theirs - ours).items())[:3]}")
    return ""
