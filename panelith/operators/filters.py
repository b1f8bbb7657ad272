"""Row filters as column predicates, so that scans can push them down.

Missing values: ``ne`` and ``nin`` keep them; every other filter drops them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., Column | None]] = {}


def register(name: str):
    def put(f):
        REGISTRY[name] = f
        return f

    return put


@register("equality_filter")
def equality(column: str, value) -> Column:
    if value is None:
        raise ValueError("equality_filter needs a value")
    return F.col(column) == value


_COMPARE = {
    "=": lambda c, v: c == v, "==": lambda c, v: c == v, "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


@register("comparison_filter")
def comparison(column: str, operator: str, value) -> Column:
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator!r}")
    if value is None:
        raise ValueError("comparison_filter needs a value")
    return _COMPARE[operator](F.col(column), value)


@register("in_filter")
def in_(column: str, values: list) -> Column:
    return F.col(column).isin(list(values))


@register("not_in_filter")
def not_in(column: str, values: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(list(values))


@register("range_filter")
def range_(column: str, min_value=None, max_value=None) -> Column:
    parts = []
    if min_value is not None:
        parts.append(F.col(column) >= min_value)
    if max_value is not None:
        parts.append(F.col(column) <= max_value)
    if not parts:
        raise ValueError("range_filter needs a bound")
    return reduce(Column.__and__, parts)


@register("date_range_filter")
def date_range(date_column: str, start_date=None, end_date=None) -> Column | None:
    parts = []
    if start_date is not None:
        parts.append(F.col(date_column) >= F.lit(start_date).cast("timestamp_ntz"))
    if end_date is not None:
        parts.append(F.col(date_column) <= F.lit(end_date).cast("timestamp_ntz"))
    return reduce(Column.__and__, parts) if parts else None


_SUFFIX = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def parse_keyed(filters: dict) -> list[dict]:
    """{"column__suffix": value} as a list of filters.  Keys date__... are left to the date range
    and skipped with a warning; a bare ``date`` is kept."""
    out = []
    for key, value in filters.items():
        column, _, suffix = key.partition("__")
        if column == "date":
            warnings.warn(f"{key}: give dates as a date range", stacklevel=2)
            if suffix:
                continue
        if suffix in ("", *_SUFFIX):
            kind = {"type": "equality_filter", "column": column, "value": value} if suffix in ("", "eq") else {"type": "comparison_filter", "column": column, "operator": _SUFFIX[suffix], "value": value}
        elif suffix in ("in", "nin"):
            kind = {"type": "in_filter" if suffix == "in" else "not_in_filter", "column": column, "values": value}
        elif suffix == "range":
            kind = {"type": "range_filter", "column": column, "min_value": value[0], "max_value": value[1]}
        else:
            raise ValueError(f"unknown filter suffix {suffix!r} in {key!r}")
        out.append(kind)
    return out


def create(spec: dict) -> Column | None:
    spec = dict(spec)
    kind = spec.pop("type", None)
    if kind not in REGISTRY:
        raise ValueError(f"unknown filter {kind!r}")
    return REGISTRY[kind](**spec)


def apply(df: DataFrame, filters: dict | list | None) -> DataFrame:
    """Keyed filters, a list of filters (all must hold), or none."""
    if not filters:
        return df
    predicates = [p for f in (parse_keyed(filters) if isinstance(filters, dict) else filters) if (p := create(f)) is not None]
    return df.where(reduce(Column.__and__, predicates)) if predicates else df
