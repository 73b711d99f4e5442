"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import decimal


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 7) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows_of(names, rows, own):
    at = [own.index(n) for n in sorted(names)]
    return sorted([str(plain(row[i])) for i in at] for row in rows)


def assert_same(frame, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = rows_of(names, cursor.fetchall(), names)
    got = rows_of(names, [tuple(r) for r in frame.collect()], frame.columns)
    assert got == want
