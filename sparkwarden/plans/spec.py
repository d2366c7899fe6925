"""QuerySpec: a stored query (filters, sorts, columns, limit, offset) that becomes a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("byte", "short", "int", "long", "bigint", "smallint", "tinyint", "float", "double", "decimal")


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class QuerySpec:
    filters: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()  # (field, asc or desc)
    columns: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0
    sortable: tuple[str, ...] = field(default=())  # empty: every column


def condition(df: DataFrame, f: Filter) -> Column:
    """Text operators ignore case; numeric ones take null as 0; an operator that is not known holds for every row."""
    c = F.col(f.field)
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    value = F.lit("" if f.value is None else str(f.value).lower())
    number = F.coalesce(c.cast("double"), F.lit(0.0))
    if f.operator in ("greater_than", "less_than", "greater_than_or_equal", "less_than_or_equal"):
        limit = F.lit(float(f.value or 0))
        return {"greater_than": number > limit, "less_than": number < limit, "greater_than_or_equal": number >= limit, "less_than_or_equal": number <= limit}[f.operator]
    table = {
        "equals": lambda: text == value,
        "not_equals": lambda: text != value,
        "contains": lambda: text.contains(value),
        "not_contains": lambda: ~text.contains(value),
        "starts_with": lambda: text.startswith(value),
        "ends_with": lambda: text.endswith(value),
        "is_empty": lambda: text == "",
        "is_not_empty": lambda: text != "",
    }
    return table.get(f.operator, lambda: F.lit(True))()


def clamp(limit: int | None, default: int = 100, most: int = 1000) -> int:
    return default if limit is None else max(1, min(int(limit), most))


def apply(df: DataFrame, spec: QuerySpec, tie: str | None = None) -> DataFrame:
    """Filters are ANDed; filters, sorts and columns on fields that df lacks are dropped; ties go by `tie`."""
    have = set(df.columns)
    for f in spec.filters:
        if f.field in have:
            df = df.where(condition(df, f))
    allowed = have & set(spec.sortable) if spec.sortable else have
    order = [F.col(c).desc_nulls_first() if way == "desc" else F.col(c).asc_nulls_last() for c, way in spec.sort if c in allowed]
    if order:
        df = df.orderBy(*order, *([tie] if tie else []))
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    columns = [c for c in spec.columns if c in have]
    return df.select(*columns) if columns else df


def pages(total: int, per_page: int) -> int:
    return -(-total // per_page)


def check_dates(start: Any, end: Any, most_days: int = 730) -> None:
    """Reports need both dates, in order, at most most_days apart."""
    if start is None or end is None:
        raise ValueError("a date range is needed")
    if end < start or (end - start).days > most_days:
        raise ValueError(f"the date range must run forward and span {most_days} days at most")
