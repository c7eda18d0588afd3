"""Metadata filters as nested dicts, compiled to columns that reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparisons and connectives of a filter.
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c.eqNullSafe(v), "$ne": lambda c, v: ~c.eqNullSafe(v), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
}
JOIN = {"$and": lambda a, b: a & b, "$or": lambda a, b: a | b}


def compiled(where: dict | None) -> Column:
    """The condition that a filter states; none or an empty one lets everything through.

    {"year": 2024} is equality (with None: null), {"year": {"$gte": 2020, "$lt": 2024}} a range, {"$and": [...]} and {"$or": [...]} hold filters; several keys of
    a dict hold together. A null fails ranges and $in and passes $ne and $nin. Unknown operators are a ValueError.
    """
    parts = [_one(k, v) for k, v in (where or {}).items()]
    return reduce(JOIN["$and"], parts) if parts else F.lit(True)


def _one(key: str, value: object) -> Column:
    if key in JOIN:
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{key} needs a list of filters")
        return reduce(JOIN[key], map(compiled, value))
    if key.startswith("$"):
        raise ValueError(f"unknown operator {key}")
    tests = value if isinstance(value, dict) else {"$eq": value}
    if unknown := tests.keys() - COMPARE.keys():
        raise ValueError(f"unknown operator {', '.join(sorted(unknown))}")
    if not tests:
        raise ValueError(f"no test for {key}")
    return reduce(JOIN["$and"], [COMPARE[op](F.col(key), v) for op, v in tests.items()])
