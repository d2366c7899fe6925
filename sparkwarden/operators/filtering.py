"""Filter builders.  Each returns one condition that reaches the scan; a part that is not given does not restrict."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(parts: Iterable[Column | None]) -> Column:
    out = F.lit(True)
    for p in parts:
        if p is not None:
            out = out & p
    return out


def between(c: Column | str, low: Any = None, high: Any = None, keep_null: bool = False) -> Column | None:
    """Inclusive range with open ends; null rows fail unless keep_null."""
    c = F.col(c) if isinstance(c, str) else c
    if low is None and high is None:
        return None
    got = all_of([c >= low if low is not None else None, c <= high if high is not None else None])
    return c.isNull() | got if keep_null else got


def search(text: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring in any of the columns; % and _ in the text are plain characters."""
    if not text:
        return None
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return out


def equals(c: str, value: Any) -> Column | None:
    return None if value is None else F.col(c) == value


def one_of(c: str, value: Any, allowed: Iterable[Any]) -> Column | None:
    """Equality with a listed value; a value outside the list is ignored."""
    return F.col(c) == value if value in set(allowed) else None


def member(array: str, value: Any) -> Column:
    return F.array_contains(array, value)


def repeat(cases: Column, notices: Column, more_than: int = 2) -> Column:
    return F.coalesce(cases, F.lit(0)) + F.coalesce(notices, F.lit(0)) > more_than


def iso_date(text: str | None) -> Column | None:
    """A date from text; None (no restriction) where the text is no date."""
    from datetime import date

    try:
        return None if text is None else F.lit(date.fromisoformat(text))
    except ValueError:
        return None


def older_than(c: str, as_of: Column, days: int) -> Column:
    return F.col(c) < F.date_sub(as_of, days)


def well_formed(c: str, pattern: str = "^[0-9]{8}$") -> Column:
    return F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the names of the rules they break); a rule that is null passes."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def recency_split(df: DataFrame, date: str, as_of: Column, months: int = 36) -> tuple[DataFrame, DataFrame]:
    """Rows from the last months, and older ones; rows without a date are in neither."""
    cut = F.add_months(as_of, -months)
    return df.where(F.col(date) >= cut), df.where(F.col(date) < cut)


#: What the address of a news item on enforcement holds, any of them, in any case (fixed values).
ENFORCEMENT_SLUGS = ["-fined-", "-prosecuted-", "-sentenced-", "-prosecution", "-guilty-", "-convicted-", "-illegal-", "-court-", "-ordered-to-pay-"]


def enforcement_url(url: Column) -> Column:
    """False for a null URL."""
    return F.coalesce(F.lower(url).rlike("|".join(ENFORCEMENT_SLUGS)), F.lit(False))
