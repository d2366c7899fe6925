"""Operator 7: URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens that any match must hold.  Token counts over
all URLs pick each rule's rarest token; exploding a URL's tokens and joining them with that index fetches its candidate
rules, and only those run their expression.  The rule of the highest class, then the longest, wins.

Only DataFrame functions run here.  Distinct URLs are judged, so a URL that a third of the pages have is judged once,
and it is joined back to its pages apart from the others, by broadcast.  The rule table is broadcast by Spark only
below its own threshold; larger ones are joined by shuffle.

Defined cases: a null URL or one without `://` has an empty host and path and no rule; repeated pages each get a row; a
URL without a fitting rule gets the verdict of the pattern rules, or else the default; ties in length go to block,
then to the smaller rule text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import join_unique, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[A-Za-z0-9\\x{80}-\\x{10ffff}]+"


@dataclass(frozen=True)
class Rule:
    """pattern must only match subjects that hold every one of tokens as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0  # rules of a higher rank win


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix."""
    ended = path if re.search(r"[^A-Za-z0-9]$", path) and ord(path[-1]) < 128 else re.sub(r"[A-Za-z0-9\x80-\U0010ffff]+$", "", path)
    tokens = tuple(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", f"{host} {ended}"))
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{quoted}", tokens, 1)


def word_rule(word: str) -> Rule:
    """Blocks a word that stands as a whole token of host or path."""
    return Rule(f"~{word}", "block", rf"(?:^|[^A-Za-z0-9\x{{80}}-\x{{10ffff}}]){word}(?:$|[^A-Za-z0-9\x{{80}}-\x{{10ffff}}])", (word,))


#: The rules that the contract states (fixed values).
HOST_RULES = [host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"), host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"), host_rule("block", "com", "/de/")]
#: What decides elsewhere: words that mark a page as junk.
WORD_RULES = [word_rule(w) for w in ("spam", "casino", "porn", "xxx", "viagra", "torrent", "warez", "escort")]


def _after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row for each row of pages: the id, host, path, rule (a host rule's name, or null), verdict, matched (the deciding rule of any kind).
    rules: a list, or a table with the columns of Rule (name, verdict, pattern, tokens, rank).
    """
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    spark = pages.sparkSession
    kept = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    urls = kept.where(F.col("_url").contains("://")).groupBy("_url").agg(F.count("*").alias("_n"))
    subject = urls.select("_url", "_n", F.concat(host_of(F.col("_url")), path_of(F.col("_url"))).alias("_subject"))
    tokens = subject.select("_url", "_n", "_subject", F.explode(F.array_distinct(F.regexp_extract_all("_subject", F.lit(f"({TOKEN})")))).alias("_token"))
    # Candidates of a URL are joined with each rule's index token; one regular expression for each candidate.
    index = rarest_tokens(spark, rules, tokens)
    hits = tokens.join(index, "_token").where(F.expr("_subject rlike _pattern"))
    order = F.struct(F.col("_rank"), F.length("_name"), F.col("_verdict") == "block", F.expr("transform(split(_name, ''), c -> -ascii(c))"))
    best = hits.groupBy("_url").agg(F.max_by(F.struct("_name", "_verdict", "_rank"), order).alias("_best"), F.max("_n").alias("_n"))
    out = join_unique(kept, save(best, "judged-urls"), "_url", "_n", how="left")
    return out.select(
        F.col("_id").alias(id_col),
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.when(F.col("_best._rank") > 0, F.col("_best._name")).alias("rule"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
        F.col("_best._name").alias("matched"),
    )


def rarest_tokens(spark: SparkSession, rules: list[Rule] | DataFrame, tokens: DataFrame) -> DataFrame:
    """The index: (_token, _name, _verdict, _pattern, _rank), each rule under that token of its own which the fewest URLs have."""
    schema = "_name string, _verdict string, _pattern string, _tokens array<string>, _rank int"
    if isinstance(rules, DataFrame):
        listed = rules.select(*[F.col(c).alias(f"_{c}") for c in ("name", "verdict", "pattern", "tokens", "rank")])
    else:
        listed = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules], schema)
    literal = listed.select("_name", "_verdict", "_pattern", "_rank", F.explode("_tokens").alias("_token"))
    counts = tokens.join(literal.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_name", "_verdict", "_pattern").orderBy(F.coalesce("_n", F.lit(0)), F.length("_token").desc(), "_token")
    ranked = literal.join(counts, "_token", "left").withColumn("_place", F.row_number().over(w))
    return ranked.where("_place = 1").select("_token", "_name", "_verdict", "_pattern", "_rank")
