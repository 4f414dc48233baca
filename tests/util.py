"""Order-insensitive comparison of a Spark result with its SQL oracle."""

import math


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_norm(r[i]) for i in order]) for r in rows)


def same(df, relation):
    got, want = [tuple(r) for r in df.collect()], relation.fetchall()
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, got) == rows_of(relation.columns, want)
