"""Rows of a Spark query against rows of its SQL twin, in any order."""

import math
from collections import Counter


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
