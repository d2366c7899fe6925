"""Text similarity: trigrams and token sets inside the JVM, Jaro over arrays of pairs (see spelling)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions.spelling import jaro as jaro


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def token_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(F.split(F.lower(F.trim(a)), r"\s+")), F.array_distinct(F.split(F.lower(F.trim(b)), r"\s+")))


def name_similarity(a: Column, b: Column) -> Column:
    """Token overlap, or 0.9 where the spelling is close, whichever is more."""
    tokens = token_similarity(a, b)
    return F.when(jaro(a, b) > 0.85, F.greatest(tokens, F.lit(0.9))).otherwise(tokens)
