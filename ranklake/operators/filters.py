"""Structured filters: a document of column -> operation, as a condition."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import QueryError

MOST_PREDICATES, MOST_VALUES = 32, 4096
BOUNDS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _scalar(v) -> bool:
    return v is None or isinstance(v, str | int | float | bool)


def _list(name: str, values) -> list:
    if not isinstance(values, list | tuple) or not all(map(_scalar, values)):
        raise QueryError(f"{name} takes a list of plain values")
    if len(values) > MOST_VALUES:
        raise QueryError(f"{name} takes {MOST_VALUES} values at most")
    return list(values)


def _likes(column: Column, kind: T.DataType, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: reduce(lambda a, b: a | b, [x.ilike(p) for p in patterns]))
    return reduce(lambda a, b: a | b, [column.ilike(p) for p in patterns])


def condition(df: DataFrame, filters: dict | str) -> Column:
    """All predicates of a filter document: eq, in, overlap, ilike, ilike_any, range (or gt, gte, lt, lte)."""
    spec = json.loads(filters) if isinstance(filters, str) else filters
    if not isinstance(spec, dict):
        raise QueryError("a filter is an object")
    if len(spec) > MOST_PREDICATES:
        raise QueryError(f"a filter has {MOST_PREDICATES} predicates at most")
    parts = []
    for name, operation in spec.items():
        if name not in df.columns:
            raise QueryError(f"no column {name}")
        if not isinstance(operation, dict) or not operation:
            raise QueryError(f"the predicate of {name} is an object")
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        strings = isinstance(kind, T.StringType) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType))
        if "range" in operation and len(operation) == 1:
            operation = operation["range"]
            if not isinstance(operation, dict) or not operation or not set(operation) <= set(BOUNDS):
                raise QueryError(f"the range of {name} has bounds {', '.join(BOUNDS)}")
        if set(operation) <= set(BOUNDS):
            if any(v is None or not _scalar(v) for v in operation.values()):
                raise QueryError(f"bounds of {name} are plain values")
            parts += [getattr(column, BOUNDS[b])(F.lit(v).cast(kind)) for b, v in operation.items()]
            continue
        if len(operation) != 1:
            raise QueryError(f"{name} has one operation")
        ((what, value),) = operation.items()
        if what == "eq":
            if not _scalar(value):
                raise QueryError("eq takes a plain value")
            parts.append(column.isNull() if value is None else column == F.lit(value).cast(kind))
        elif what == "in":
            values = [v for v in _list("in", value) if v is not None]
            parts.append(column.isin(*[F.lit(v).cast(kind) for v in values]) if values else F.lit(False))
        elif what == "overlap":
            if not isinstance(kind, T.ArrayType):
                raise QueryError(f"overlap needs an array; {name} is none")
            values = _list("overlap", value)
            parts.append(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values]).cast(kind)) if values else F.lit(False))
        elif what in ("ilike", "ilike_any"):
            if not strings:
                raise QueryError(f"{what} needs strings; {name} has none")
            patterns = _list(what, value if what == "ilike_any" else [value])
            parts.append(_likes(column, kind, [str(p) for p in patterns]))
        else:
            raise QueryError(f"no operation {what}")
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
