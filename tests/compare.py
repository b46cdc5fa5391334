"""Compare a Spark query with its DuckDB text: names, row counts, values and type families."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, dt.datetime):
        return "datetime"
    return type(value).__name__


def difference(spark_df, con, text: str) -> str | None:
    """None if both agree, else what differs."""
    result = con.execute(text)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order = sorted(names)
    pick = [names.index(c) for c in order]
    right = [tuple(r[i] for i in pick) for r in theirs]
    left = [tuple(r) for r in spark_df.select(*order).collect()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    kinds = [({_kind(r[i]) for r in left} - {"NoneType"}, {_kind(r[i]) for r in right} - {"NoneType"}) for i in range(len(order))]
    for c, (a, b) in zip(order, kinds):
        if a != b:
            return f"types of {c}: {a} vs {b}"
    for i, c in enumerate(order):
        if kinds[i][0] == {"Decimal"}:
            scales = [{r[i].as_tuple().exponent for r in rows if isinstance(r[i], Decimal)} for rows in (left, right)]
            if scales[0] != scales[1]:
                return f"scale of {c}: {scales}"
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    left.sort(key=key)
    right.sort(key=key)
    for a, b in zip(left, right):
        if a != b:
            return f"values\n  {a}\n  {b}"
    return None
