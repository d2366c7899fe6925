"""Records from HTML and labelled text, by column expressions; nested markup is reduced to its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references that plain pages use (fixed values).
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&pound;": "£"}


def strip_tags(c: Column) -> Column:
    """Text of a fragment: tags removed, common character references resolved (&amp; last), white space collapsed."""
    out = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, to in sorted(ENTITIES.items(), key=lambda x: x[0] == "&amp;"):
        out = F.replace(out, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def elements(c: Column, tag: str) -> Column:
    """Inner HTML of every element of a tag that does not hold itself."""
    return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), 1)


def element(c: Column, tag: str) -> Column:
    return strip_tags(F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1))


def table_rows(c: Column) -> Column:
    """Cells of every table row, as text."""
    return F.transform(elements(c, "tr"), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), 1), strip_tags))


def table_records(df: DataFrame, html: str, names: list[str], keep: list[str]) -> DataFrame:
    """A record for each table row with as many cells as names; other rows (headings, layout) are dropped."""
    rows = df.select(*keep, F.explode(table_rows(F.col(html))).alias("_r")).where(F.size("_r") == len(names))
    return rows.select(*keep, *[F.col("_r")[i].alias(n) for i, n in enumerate(names)])


def labelled(c: Column) -> Column:
    """Label -> value from definition lists and from two-cell table rows; the first value of a label stays."""
    terms = F.arrays_zip(F.transform(elements(c, "dt"), strip_tags).alias("k"), F.transform(elements(c, "dd"), strip_tags).alias("v"))
    pairs = F.transform(F.filter(table_rows(c), lambda r: F.size(r) == 2), lambda r: F.struct(r[0].alias("k"), r[1].alias("v")))
    both = F.concat(F.transform(terms, lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"))), pairs)
    clean = F.filter(F.transform(both, lambda t: F.struct(F.lower(F.regexp_replace(t["k"], r":$", "")).alias("k"), t["v"].alias("v"))), lambda t: t["k"].isNotNull() & (t["k"] != ""))
    first = F.filter(clean, lambda t, i: F.array_position(F.transform(clean, lambda u: u["k"]), t["k"]) == i + 1)
    return F.map_from_entries(first)


def details(df: DataFrame, html: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """One record for each page: field name -> the value of a label, null where the page lacks it."""
    m = df.withColumn("_m", labelled(F.col(html)))
    return m.select(*keep, *[F.nullif(F.try_element_at("_m", F.lit(label.lower())), F.lit("")).alias(name) for name, label in fields.items()])


def headed_blocks(df: DataFrame, html: str, outer: str, inner: str, keep: list[str]) -> DataFrame:
    """Blocks below inner headings (say h3), each with the outer heading (say h2) that stands before it.

    The page is cut at its headings; the outer heading is carried forward inside the page by an aggregate over its parts.
    """
    parts = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<(?:{outer}|{inner})(?:\s[^>]*)?>.*?)(?=<(?:{outer}|{inner})[\s>]|\z)"), 1)
    start = F.struct(F.lit("").alias("head"), F.array().cast("array<struct<category:string,title:string,body:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        is_outer = p.rlike(rf"(?i)^<{outer}[\s>]")
        title = element(p, inner)
        body = strip_tags(F.regexp_replace(p, rf"(?is)^<{inner}(?:\s[^>]*)?>.*?</{inner}\s*>", ""))
        row = F.struct(acc["head"].alias("category"), title.alias("title"), body.alias("body"))
        return F.struct(F.when(is_outer, element(p, outer)).otherwise(acc["head"]).alias("head"), F.when(is_outer, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    return df.select(*keep, F.explode(F.aggregate(parts, start, step, lambda a: a["out"])).alias("_b")).select(*keep, "_b.category", "_b.title", "_b.body")


def split_records(df: DataFrame, text: str, label: str, keep: list[str]) -> DataFrame:
    """Labelled plain text (say from a PDF) cut into records, each from one label to the next; what stands before goes."""
    parts = F.split(F.col(text), rf"(?={label})")
    return df.select(*keep, F.posexplode(parts).alias("record", "body")).where(F.col("body").rlike(rf"^{label}"))


def labelled_fields(c: Column, labels: list[str]) -> dict[str, Column]:
    """Value after each label up to the next label or the end; null where the label is missing."""
    stop = "|".join(labels)
    return {x: F.nullif(F.trim(F.regexp_extract(c, rf"(?s){x}\s*(.*?)\s*(?=(?:{stop})|\z)", 1)), F.lit("")) for x in labels}


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in patterns])
