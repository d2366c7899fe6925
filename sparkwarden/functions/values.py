"""Dates, money and other values: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names (fixed values).
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y != "") & (m != "") & (d != ""), text.try_cast("date"))


def parse_date(c: Column) -> Column:
    """y-m-d, d/m/y, d-m-y or d Month y; null where the text is no date."""
    t = F.trim(c)
    get = lambda p, i: F.regexp_extract(t, p, i)
    iso, slash, dash, long = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(get(long, 2)))
    named = F.when(month > 0, _date(get(long, 3), month.cast("string"), get(long, 1)))
    return F.coalesce(_date(get(iso, 1), get(iso, 2), get(iso, 3)), _date(get(slash, 3), get(slash, 2), get(slash, 1)), _date(get(dash, 3), get(dash, 2), get(dash, 1)), named)


def parse_ordinal_date(c: Column) -> Column:
    """As parse_date, with 1st, 2nd, 3rd, 4th and leading words before the day allowed."""
    t = F.regexp_replace(F.trim(c), r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1")
    return parse_date(F.regexp_replace(t, r"^[^0-9]+", ""))


def uk_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def period_label(c: Column, unit: str) -> Column:
    """day, week, month, quarter or year.  Weeks are counted from the Sunday-based week of January 1, not by ISO."""
    if unit == "week":
        first = F.make_date(F.year(c), F.lit(1), F.lit(1))
        week = F.ceil((F.dayofyear(c) - 1 + (F.dayofweek(first) - 1) + 1) / 7)
        return F.concat(F.year(c), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    if unit == "quarter":
        return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))
    return F.date_format(c, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def compliance(due: Column, as_of: Column) -> Column:
    return F.when(due.isNull(), "unknown").when(due <= as_of, "complied").otherwise("pending")


def _amount(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([0-9,]+\.?[0-9]*)", 1), ",", "").try_cast("decimal(18,2)")


def money(c: Column) -> Column:
    """The first amount in a text; 0 where there is none."""
    return F.coalesce(_amount(c), F.lit(0).cast("decimal(18,2)"))


def money_or_null(c: Column) -> Column:
    """The first amount after a pound sign, in millions where the text says so; null where there is none."""
    amount = F.regexp_replace(F.regexp_extract(c, r"£\s*([0-9,]+(?:\.[0-9]+)?)", 1), ",", "").try_cast("decimal(18,4)")
    return F.when(c.rlike(r"(?i)£\s*[0-9,.]+\s*(?:million|m\b)"), amount * 1000000).otherwise(amount).cast("decimal(18,2)")


def clean_fine(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[£,$\s]", "").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def sum_known(*parts: Column) -> Column:
    """Sum of what is not null; null if all are."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def total_penalty(fine: Column, costs: Column) -> Column:
    return F.coalesce(fine, F.lit(0)) + F.coalesce(costs, F.lit(0))


def short_number(c: Column) -> Column:
    """Thousands as K, millions as M, with one decimal; below a thousand as it is, to the penny, without trailing zeros.

    The quotient's exact binary value is rounded: 358,650 gives 358.6K, since its quotient lies below 358.65.  Halves, which
    only quarters have exactly, go up.
    """

    def tenths(q: Column) -> Column:
        half_up = F.when(q * 4 == F.floor(q * 4), F.floor(q * 10 + 0.5) / 10).otherwise(q)
        return F.replace(F.format_number(half_up, 1), F.lit(","), F.lit(""))

    x = c.cast("double")
    small = F.regexp_replace(c.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    return F.when(x >= 1e6, F.concat(tenths(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(tenths(x / 1e3), F.lit("K"))).otherwise(small)


def risk(fines: Column, last_seen_days: Column, actions: Column, agencies: Column) -> Column:
    """(score, level, factors) of an offender."""
    parts = [(agencies > 1, 30, "Multiple agencies involved"), (fines > 100000, 25, "Escalating fines"), (last_seen_days < 365, 20, "Recent activity"), (actions > 5, 25, "Multiple violations")]
    score = sum((F.when(c, n).otherwise(0) for c, n, _ in parts[1:]), F.when(parts[0][0], parts[0][1]).otherwise(0))
    level = F.when(score >= 70, "High Risk").when(score >= 40, "Medium Risk").otherwise("Low Risk")
    factors = F.filter(F.array(*[F.when(c, name) for c, _, name in parts]), lambda x: x.isNotNull())
    return F.struct(score.alias("score"), level.alias("level"), factors.alias("factors"))


def action_band(fine: Column) -> Column:
    return F.when(fine >= 100000, "Major").when(fine >= 10000, "Significant").otherwise("Standard")


def canonical_score(title: Column, year: Column, number: Column) -> Column:
    """Which of several equal entries is the fullest."""
    return F.when(year.isNotNull() & number.isNotNull(), 100).when(year.isNotNull(), 50).otherwise(0) + F.when(F.lower(title).contains("etc."), 25).otherwise(0) + F.length(title)


def progress(done: Column, found: Column) -> Column:
    return F.when(found > 0, F.least(F.lit(100.0), F.round(done * 100.0 / found, 1))).otherwise(0.0)


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any pair differs, as trimmed text, nulls equal."""
    out = F.lit(False)
    for old, new in pairs:
        out = out | ~F.trim(old.cast("string")).eqNullSafe(F.trim(new.cast("string")))
    return out


def json_payload(c: Column) -> Column:
    """JSON text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def swap_date(c: Column) -> Column:
    """d/m/y text to y-m-d text and back, parts as written."""
    p = F.split(c, "[/-]")
    return F.when(F.size(p) == 3, F.concat_ws("-", p[2], p[1], p[0]))


def pending(since: Column, as_of: Column) -> Column:
    """(months, days, total_days) from one date to another: whole months first, then the days that are left."""
    months = F.floor(F.months_between(as_of, since)).cast("int")
    return F.struct(months.alias("months"), F.datediff(as_of, F.add_months(since, months)).alias("days"), F.datediff(as_of, since).alias("total_days"))
