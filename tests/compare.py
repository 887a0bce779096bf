"""Order-insensitive comparison of a DataFrame with an Arrow table."""

from __future__ import annotations

import math


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(value, v))
    if isinstance(v, dict):
        return tuple((k, value(x)) for k, x in sorted(v.items()))
    return v


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(map(value, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


def same(df, expected) -> None:
    got = df.toArrow()
    assert sorted(got.column_names) == sorted(expected.column_names)
    assert rows(got) == rows(expected)
