"""Entity resolution: duplicates, upserts, tiered matching and merging.

Every tier is an equi-join on a key whose right side has one row for each key; fuzzy tiers compare distinct
texts that meet under rare trigrams or characters, which no pair within the threshold lacks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import similarity, spelling, text, values


def duplicate_members(df: DataFrame, keys: dict[str, Column], member: Column, least: int = 2) -> DataFrame:
    """(keys, n, member): the rows of groups that share all keys; rows with a null or blank key are in none.

    Groups are counted map-side and joined back, so no group, however large, is gathered anywhere.
    """
    named = df.select(*[c.alias(k) for k, c in keys.items()], member.alias("member"))
    for k in keys:
        named = named.where(F.trim(F.col(k).cast("string")) != "")
    counts = named.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return named.join(counts, list(keys)).select(*keys, "n", "member")


def largest_groups(members: DataFrame, group: str) -> DataFrame:
    """members: (group, n, member).  Overlapping groups resolved: each member keeps its largest group (of equals the least
    id); the rows of groups that nobody keeps go."""
    best = members.groupBy("member").agg(F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias(group))
    return members.join(best.select(group).distinct(), group, "left_semi")


def reconcile(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """New rows with a status: created, updated (some compared field differs as trimmed text) or existing."""
    o = old.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in compare], F.lit(True).alias("_known"))
    both = new.join(o, key, "left")
    differs = values.changed([(F.col(f"_old_{c}"), F.col(c)) for c in compare])
    status = F.when(F.col("_known").isNull(), "created").when(differs, "updated").otherwise("existing")
    return both.withColumn("status", status).select(*new.columns, "status")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The next snapshot: new rows, and old ones that have none."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def similar_spellings(a: DataFrame, b: DataFrame, block: str, name: str, least: float) -> DataFrame:
    """(block, name, other): the pairs of distinct names of a and b in one block whose characters allow a Jaro similarity of
    least (above 2/3) or more.

    Of n characters, told apart by occurrence, such a name shares (3 least - 2) n at least with the other.  With all
    characters in one order, the rarest first, both then have two of their first few in common, so names meet under pairs of
    those and not all with all; names so short that one common character may do meet under single ones too.  What meets is
    tested by lengths, by 64 bits of the characters, and by the characters themselves: no pair above the threshold is lost.
    """
    share = 3 * least - 2
    if share <= 0.01:
        raise ValueError("least must be above 2/3")
    names = [x.select(block, F.col(name).alias("_t")).where(F.col(block).isNotNull() & (F.length(name) > 0)).distinct() for x in (a, b)]
    sides = [x.select(block, "_t", F.length("_t").alias("_n"), F.explode(spelling.characters(F.col("_t"))).alias("_x")) for x in names]
    counts = sides[0].unionByName(sides[1]).groupBy("_x").agg(F.count("*").alias("_c"))

    def index(side: DataFrame, end: str) -> DataFrame:
        ordered = side.join(counts, "_x").groupBy(block, "_t", "_n").agg(F.sort_array(F.collect_list(F.struct("_c", "_x"))).alias("_o"), F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(_x), 64) as int)))").alias("_bits"))
        need = F.greatest(F.ceil(F.col("_n") * share - 1e-9), F.lit(1)).cast("int")
        first = F.transform(F.slice("_o", F.lit(1), F.greatest(F.col("_n") - need + 2, F.lit(1))), lambda s: s["_x"])
        made = ordered.withColumn("_f", first)
        pairs = F.flatten(F.transform("_f", lambda p, i: F.transform(F.slice("_f", i + 2, F.size("_f")), lambda q: F.concat(F.least(p, q), F.lit("\u0000"), F.greatest(p, q)))))
        keys = F.when(need < 2, F.concat(pairs, F.col("_f"))).otherwise(pairs)
        return made.select(block, F.explode(keys).alias("_key"), F.col("_t").alias(f"_t{end}"), F.col("_n").alias(f"_n{end}"), F.col("_bits").alias(f"_bits{end}"))

    met = index(sides[0], "1").join(index(sides[1], "2"), [block, "_key"])
    need = spelling.common_needed(F.col("_n1"), F.col("_n2"), least)
    apart = F.bit_count(F.col("_bits1").bitwiseXOR(F.col("_bits2")))  # each bit stands for one character at least that is not common
    near = met.where((need <= F.least("_n1", "_n2")) & (apart <= F.col("_n1") + F.col("_n2") - 2 * need)).select(block, "_t1", "_t2", need.alias("_need")).distinct()
    common = F.size(F.array_intersect(spelling.characters(F.col("_t1")), spelling.characters(F.col("_t2"))))
    return near.where(common >= F.col("_need")).select(block, F.col("_t1").alias(name), F.col("_t2").alias("other"))


def fuzzy_best(left: DataFrame, right: DataFrame, block: str, name: str, least: float, id_: str = "id") -> DataFrame:
    """For each (block, name) of left, the most similar name of right in its block: (block, name, best_id, score).

    Distinct names only; of equal scores the least id.  Only pairs with enough characters in common are compared.
    """
    ids = right.where(F.col(name).isNotNull()).groupBy(block, F.col(name).alias("other")).agg(F.min(id_).alias("_id"))
    scored = similar_spellings(left, right, block, name, least).withColumn("score", similarity.jaro(F.col(name), F.col("other"))).where(F.col("score") >= least)
    return scored.join(ids, [block, "other"]).groupBy(block, name).agg(F.max_by(F.struct("_id", "score"), F.struct("score", -F.col("_id"))).alias("_b")).select(block, name, F.col("_b._id").alias("best_id"), F.col("_b.score").alias("score"))


def spelled_like(names: DataFrame, name: str, wanted: str, least: float) -> DataFrame:
    """The distinct names whose Jaro similarity to wanted is least or more, with score; only those with enough characters in
    common are compared."""
    letters = F.lit(wanted)
    need = spelling.common_needed(F.length(name), F.length(letters), least)
    common = F.size(F.array_intersect(spelling.characters(F.col(name)), spelling.characters(letters)))
    may = names.select(name).distinct().where((F.col(name) == letters) | (need <= F.least(F.length(name), F.length(letters))) & (common >= need))
    return may.withColumn("score", similarity.jaro(F.col(name), letters)).where(F.col("score") >= least)


def similar_texts(a: DataFrame, b: DataFrame, name: str, least: float) -> DataFrame:
    """(name, other, score): every pair of distinct texts of a and b whose trigrams are alike by least or more.

    Prefix filter: with the trigrams of all texts in one order, the rarest first, two texts of similarity least share one of
    their first n - ceil(least n) + 1.  So pairs meet in an inverted index of rare trigrams only, and none is lost.  There
    are some 50,000 trigrams of letters and digits at most, so their counts may be broadcast.
    """
    texts = [x.select(F.col(name).alias("_t")).where(F.col(name).isNotNull()).distinct() for x in (a, b)]
    bits = F.expr("aggregate(_all, 0L, (s, g) -> s | shiftleft(1L, cast(pmod(xxhash64(g), 64) as int)))")
    grams = [x.withColumn("_all", similarity.trigrams(F.col("_t"))).select("_t", F.size("_all").alias("_n"), bits.alias("_bits"), F.explode("_all").alias("_g")) for x in texts]
    counts = grams[0].unionByName(grams[1]).groupBy("_g").agg(F.count("*").alias("_c"))

    def index(g: DataFrame) -> DataFrame:
        ordered = g.join(F.broadcast(counts), "_g").groupBy("_t", "_n", "_bits").agg(F.sort_array(F.collect_list(F.struct("_c", "_g"))).alias("_o"))
        return ordered.select("_t", "_n", "_bits", F.explode(F.slice("_o", F.lit(1), (F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).cast("int"))).alias("_x")).select("_t", "_n", "_bits", F.col("_x._g").alias("_g"))

    left = index(grams[0]).select("_g", F.col("_t").alias("_a"), F.col("_n").alias("_size1"), F.col("_bits").alias("_bits1"))
    right = index(grams[1]).select("_g", F.col("_t").alias("_b"), F.col("_n").alias("_size2"), F.col("_bits").alias("_bits2"))
    # Sizes, and how many trigrams only one of them has: each differing bit stands for one at least.
    apart = F.bit_count(F.col("_bits1").bitwiseXOR(F.col("_bits2"))) <= (F.col("_size1") + F.col("_size2")) * ((1 - least) / (1 + least)) + 1e-9
    near = (F.least("_size1", "_size2") >= F.greatest("_size1", "_size2") * least - 1e-9) & apart
    pairs = left.join(right, "_g").where(near).select(F.col("_a").alias(name), F.col("_b").alias("other")).distinct()
    return pairs.withColumn("score", similarity.trigram_similarity(F.col(name), F.col("other"))).where(F.col("score") >= least)


def best_similar(left: DataFrame, right: DataFrame, name: str, least: float, id_: str = "id") -> DataFrame:
    """(name, best_id, score): for each text of left the most similar of right above least; of equal scores the least id."""
    ids = right.groupBy(F.col(name).alias("other")).agg(F.min(id_).alias("_id"))
    met = similar_texts(left, right, name, least).where(F.col("score") > least).join(ids, "other")
    return met.groupBy(name).agg(F.max_by(F.struct("_id", "score"), F.struct("score", -F.col("_id"))).alias("_b")).select(name, F.col("_b._id").alias("best_id"), F.col("_b.score").alias("score"))


def partial_matches(refs: DataFrame, known: DataFrame, part: str, name: str, id_: str = "id") -> DataFrame:
    """(part, found_id): the least id of the known names that hold the part, in any case.

    A name that holds a part holds each three letters of it, so they meet under its rarest three; parts of one or two letters
    meet under themselves.
    """
    parts = refs.select(F.lower(part).alias("_p"), F.col(part).alias(part)).where(F.length(part) > 0).distinct()
    names = known.groupBy(F.lower(name).alias("_t")).agg(F.min(id_).alias("_id"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3))))
    short = parts.where(F.length("_p") < 3)
    index = names.select("_t", "_id", F.explode(grams(F.col("_t"))).alias("_g"))
    counts = index.groupBy("_g").agg(F.count("*").alias("_c"))
    each = parts.where(F.length("_p") >= 3).select(part, "_p", F.explode(grams(F.col("_p"))).alias("_g")).join(counts, "_g", "left")
    rarest = each.groupBy(part, "_p").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_g")).alias("_r")).select(part, "_p", F.col("_r._g").alias("_g"))
    met = rarest.join(index, "_g").where(F.col("_t").contains(F.col("_p"))).select(part, "_id")
    two = names.select("_id", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.array(F.substr(F.col("_t"), i, F.lit(1)), F.substr(F.col("_t"), i, F.lit(2))))))).alias("_p"))
    return met.unionByName(short.join(two, "_p").select(part, "_id")).groupBy(part).agg(F.min("_id").alias("found_id"))


def match_legislation(refs: DataFrame, legislation: DataFrame, least: float = 0.85) -> DataFrame:
    """Six tiers, the first that fits wins: year, type and number; title, year and number; title, year and type; title and
    year; similar title of the year; none (to be created).  refs and legislation have title, year, type, number; refs keep
    their columns and gain legislation_id and tier.  Without a year only the last tier applies.
    """
    keys = [("year", "type", "number"), ("title", "year", "number"), ("title", "year", "type"), ("title", "year")]
    out = refs
    for i, key in enumerate(keys, 1):
        one = legislation.groupBy(*key).agg(F.min("id").alias(f"_t{i}"))
        out = out.join(one, list(key), "left")
    tiers = [F.col(f"_t{i}") for i in range(1, 5)]
    # Only what no equal key has found is compared by similarity.
    left = out.where(F.coalesce(*tiers).isNull())
    close = fuzzy_best(left, legislation, "year", "title", least).select("year", "title", F.col("best_id").alias("_t5"))
    out = out.join(close, ["year", "title"], "left")
    number = F.lit(6)
    for i in range(5, 0, -1):
        number = F.when(F.col(f"_t{i}").isNotNull(), i).otherwise(number)
    return out.select(*refs.columns, F.coalesce(*tiers, F.col("_t5")).alias("legislation_id"), number.alias("tier"))


def match_offenders(incoming: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """Tiers: name and postcode; name; similar name (trigrams above least), whatever the postcode; none.  Without a postcode
    the second tier is the first.  Both have name and postcode; incoming gains offender_id and tier."""
    norm = lambda df: df.withColumn("_n", text.company_name(F.col("name"))).withColumn("_p", text.postcode(F.col("postcode")))
    a, b = norm(incoming), norm(known)
    both = b.groupBy("_n", "_p").agg(F.min("id").alias("_t1"))
    return _tiers(a.join(both, ["_n", "_p"], "left"), b, incoming.columns, least)


def match_by_number(incoming: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """Tiers: company number (cleaned; blank ones are none); name; similar name; none.  Both have name and number."""
    number = F.upper(F.regexp_replace("number", r"\s+", ""))
    norm = lambda df: df.withColumn("_n", text.company_name(F.col("name"))).withColumn("_p", F.when(number != "", number))
    a, b = norm(incoming), norm(known)
    same = b.where("_p is not null").groupBy("_p").agg(F.min("id").alias("_t1"))
    return _tiers(a.join(same, "_p", "left"), b, incoming.columns, least)


def _tiers(out: DataFrame, known: DataFrame, columns: list[str], least: float) -> DataFrame:
    out = out.join(known.groupBy("_n").agg(F.min("id").alias("_t2")), "_n", "left")
    # Only what no equal key has found is compared by similarity.
    close = best_similar(out.where("_t1 is null and _t2 is null"), known, "_n", least).select("_n", F.col("best_id").alias("_t3"))
    out = out.join(close, "_n", "left")
    tier = F.when(F.col("_t1").isNotNull(), 1).when(F.col("_t2").isNotNull(), 2).when(F.col("_t3").isNotNull(), 3).otherwise(4)
    return out.select(*columns, F.coalesce("_t1", "_t2", "_t3").alias("offender_id"), tier.alias("tier"))


def best_candidate(incoming: DataFrame, known: DataFrame, search: float = 0.5) -> DataFrame:
    """The best known candidate of each incoming row (ref, name, postcode), or null: candidates are found by trigrams, scored
    by name_similarity; two different postcodes exclude, equal ones add 0.15 above 0.6 (1 at most); above 0.7 the highest
    score wins, then an equal postcode, then the least id.

    Rows of one name and postcode are judged once, and of a known name only three rows can win: the least id of the same
    postcode, of none, and (for those who have none) of any.  So the work does not grow with how often a name is there.
    """
    norm = lambda df: df.withColumn("_n", text.company_name(F.col("name"))).withColumn("_p", F.upper(F.trim("postcode")))
    # Names are normalised once for each spelling.
    a = norm(incoming.select("name", "postcode").distinct())
    b = norm(known.groupBy("name", "postcode").agg(F.min("id").alias("id")))
    held = b.where("_n is not null").groupBy(F.col("_n").alias("other"), F.col("_p").alias("_q")).agg(F.min("id").alias("_id"))
    named = held.groupBy("other").agg(F.min(F.when(F.col("_q").isNull(), F.col("_id"))).alias("_without"), F.min(F.when(F.col("_q").isNotNull(), F.col("_id"))).alias("_with"))
    asked = a.where("_n is not null").select("_n", "_p").distinct()
    scored = similar_texts(asked, named.withColumnRenamed("other", "_n"), "_n", search).withColumn("_s", similarity.name_similarity(F.col("_n"), F.col("other"))).where("_s > 0.55").select("_n", "other", "_s")
    met = asked.join(scored, "_n").join(named, "other").alias("m").join(held.alias("h"), (F.col("m.other") == F.col("h.other")) & F.col("_p").eqNullSafe(F.col("_q")), "left")
    same, else_ = F.struct(F.col("_id").alias("id"), F.lit(True).alias("_match")), F.struct(F.when(F.col("_p").isNull(), F.col("_with")).otherwise(F.col("_without")).alias("id"), F.lit(False).alias("_match"))
    each = met.select("_n", "_p", "_s", F.explode(F.array(same, else_)).alias("_c")).select("_n", "_p", "_s", "_c.id", "_c._match").where("id is not null")
    each = each.withColumn("score", F.when(F.col("_match") & (F.col("_s") > 0.6), F.least(F.col("_s") + 0.15, F.lit(1.0))).otherwise(F.col("_s"))).where("score > 0.7")
    highest = lambda df, *key: df.groupBy(*key).agg(F.max_by(F.struct("id", "score", "_match"), F.struct("score", "_match", -F.col("id"))).alias("_b"))
    found = highest(each, "_n", "_p").alias("f")
    spelled = a.alias("a").join(found, (F.col("a._n") == F.col("f._n")) & F.col("a._p").eqNullSafe(F.col("f._p"))).select("a.name", "a.postcode", "_b").alias("s")
    own = incoming.alias("i").join(spelled, (F.col("i.name") == F.col("s.name")) & F.col("i.postcode").eqNullSafe(F.col("s.postcode")))
    best = highest(own.select("i.ref", "_b.*"), "ref")  # a ref that comes with several names has the best of them
    return incoming.join(best, "ref", "left").select("ref", F.col("_b.id").alias("offender_id"), F.col("_b.score").alias("score"))


def register_decision(incoming: DataFrame, register: DataFrame, on: list[str], key: str, name: str, candidate: str, compatible: Column, sure: float = 0.90) -> DataFrame:
    """By number of active candidates, the register's rows that agree in `on`: none, auto (one, similar and compatible),
    review (up to three), skip (more).  compatible may use name, candidate and the columns of `on`.

    Names and candidates that stand under one `on` again and again meet once, with how many rows they are; a pair of
    spellings is compared once in all.
    """
    held = register.groupBy(*on, candidate).agg(F.count("*").alias("_c"))
    met = incoming.select(*on, name).distinct().join(held, on)
    pairs = met.select(name, candidate).where(F.col(name).isNotNull() & F.col(candidate).isNotNull()).distinct().withColumn("_s", similarity.jaro(F.col(name), F.col(candidate)))
    scored = met.join(pairs, [name, candidate], "left").groupBy(*on, name).agg(F.sum("_c").alias("_n"), F.max("_s").alias("_s"), F.max(compatible).alias("_ok")).alias("s")
    own = incoming.alias("i").join(scored, [F.col(f"i.{c}") == F.col(f"s.{c}") for c in on] + [F.col(f"i.{name}").eqNullSafe(F.col(f"s.{name}"))], "left")
    g = own.groupBy(F.col(f"i.{key}").alias(key)).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.max("_s").alias("score"), F.max("_ok").alias("_ok"))
    decision = F.when(F.col("n") == 0, "none").when((F.col("n") == 1) & (F.col("score") >= sure) & F.col("_ok"), "auto").when(F.col("n") <= 3, "review").otherwise("skip")
    return g.select(key, "n", F.round("score", 6).alias("score"), decision.alias("decision"))


def canonical(df: DataFrame, key: list[str], score: Column, id_: str = "id") -> DataFrame:
    """(id, canonical_id) of every row: the highest score of its key, of equals the least id.

    An aggregate and a join, so a key with a great many rows is neither sorted nor held by one task.
    """
    best = df.groupBy(*key).agg(F.max_by(id_, F.struct(score.alias("s"), (-F.col(id_)).alias("i"))).alias("canonical_id"))
    same = reduce(lambda a, b: a & b, [F.col(f"_d.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in key])
    return df.alias("_d").join(best.alias("_b"), same).select(F.col(f"_d.{id_}").alias(id_), "canonical_id")


def repoint(child: DataFrame, remap: DataFrame, foreign: str, id_: str = "id") -> DataFrame:
    """Foreign keys moved to the canonical rows; keys that the remap does not know stay."""
    m = remap.select(F.col(id_).alias("_k"), F.col("canonical_id").alias("_to"))
    return child.join(m, F.col(foreign) == F.col("_k"), "left").withColumn(foreign, F.coalesce("_to", foreign)).drop("_k", "_to")


def numbered(parent: DataFrame, key: str, items: Column) -> DataFrame:
    """Array elements as rows with their place, from 1."""
    return parent.select(key, F.posexplode(items).alias("_i", "item")).select(key, (F.col("_i") + 1).alias("sequence"), "item")


def rank_within(df: DataFrame, key: str, order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))
