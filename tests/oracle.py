"""Comparison of a Spark result with the rows of its SQL, as multisets, columns by name."""

from __future__ import annotations

from collections import Counter


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


def same_rows(df, con, sql: str) -> None:
    got = con.sql(sql)
    columns = list(got.columns)
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
    have = Counter(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
