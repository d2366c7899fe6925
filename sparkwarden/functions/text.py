"""Text functions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def company_name(c: Column) -> Column:
    """Comparable form of a company's name; null stays null."""
    c = F.lower(F.trim(c))
    return F.trim(_chain(c, ("&", " and "), (r"[.,:;!@#$%^*()]", ""), (r"\bltd\b", "limited"), (r"\s+", " ")))


def register_name(c: Column) -> Column:
    """The register's variant: & goes, and only a suffix is spelled out."""
    c = F.lower(F.trim(c))
    return F.trim(_chain(c, (r"[.,:;!@#$%^&*()]", ""), (r"\s+", " "), (r"\bltd$", "limited")))


def short_name(c: Column) -> Column:
    """Upper case with short company words."""
    return F.trim(_chain(F.upper(F.trim(c)), (r"\bLIMITED\b", "LTD"), (r"\bCOMPANY\b", "CO"), (r"\s+", " ")))


def postcode(c: Column) -> Column:
    return F.upper(_chain(F.trim(c), (r"\s+", " ")))


def find_postcode(c: Column) -> Column:
    """The first UK postcode in a text, without inner spaces; null if there is none."""
    found = F.regexp_extract(F.upper(c), r"([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})", 1)
    return F.when(found != "", F.regexp_replace(found, " ", ""))


#: Words that stay in lower case inside a title (fixed values).
SMALL_WORDS = ["at", "of", "and", "the", "in", "on", "for", "with", "to", "by", "under", "from", "etc"]
#: Abbreviations of legislation and what they stand for (fixed values).
ABBREVIATIONS = {
    "h&s": "Health and Safety",
    "cdm": "Construction (Design and Management)",
    "coshh": "Control of Substances Hazardous to Health",
    "puwer": "Provision and Use of Work Equipment Regulations",
    "dsear": "Dangerous Substances and Explosive Atmospheres",
    "loler": "Lifting Operations and Lifting Equipment",
    "comah": "Control of Major Accident Hazards",
}


def legislation_title(c: Column) -> Column:
    """Title case, word by word, without a leading article and without the year at the end; abbreviations are spelled out.

    A word that is looked up keeps the punctuation around it; small words stay small but at the beginning.
    """
    words = F.split(F.trim(F.lower(c)), r"\s+")
    words = F.when((F.get(words, F.lit(0)) == "the") & (F.size(words) > 1), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    dated = F.element_at(words, -1).rlike(r"^\(?[0-9]{4}\)?$") & (F.size(words) > 1)
    words = F.when(dated, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    known = {w: w for w in SMALL_WORDS} | {"etc": "etc."} | ABBREVIATIONS
    spelled = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])

    def cased(word: Column, i: Column) -> Column:
        bare = F.regexp_extract(word, r"[\p{L}0-9][\p{L}0-9&'’-]*", 0)
        lead = F.regexp_extract(word, r"^[^\p{L}0-9]*", 0)
        end = F.substr(word, F.length(lead) + F.length(bare) + 1)
        found = F.try_element_at(spelled, bare)
        end = F.when(bare == "etc", F.regexp_replace(end, r"^\.", "")).otherwise(end)
        capital = F.concat(F.upper(F.substr(bare, F.lit(1), F.lit(1))), F.substr(bare, F.lit(2)))
        own = F.when((i == 0) & bare.isin(SMALL_WORDS), capital).otherwise(F.coalesce(found, capital))
        return F.when(bare == "", word).otherwise(F.concat(lead, own, end))

    return F.rtrim(F.regexp_replace(F.array_join(F.transform(words, cased), " "), r"[\s,]+$", ""))


def legislation_type(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("code of practice") | t.contains("acop"), "acop").when(t.contains("regulation"), "regulation").when(t.contains("order"), "order").otherwise("act")


def type_code(c: Column) -> Column:
    return F.when(c.contains("Act"), "ukpga").when(c.contains("Regulation") | c.contains("Order"), "uksi")


def title_year(c: Column) -> Column:
    """The first free-standing year from 1900 to 2099; null if there is none."""
    return F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def legislation_url(c: Column) -> Column:
    """(type, year, number) of a legislation address; all null when it has another form."""
    p = r"^https?://www\.legislation\.gov\.uk/([a-z]+)/([0-9]{4})/([0-9]+)"
    kind = F.regexp_extract(c, p, 1)
    return F.when(kind != "", F.struct(kind.alias("type"), F.regexp_extract(c, p, 2).cast("int").alias("year"), F.regexp_extract(c, p, 3).alias("number")))


def build_legislation_url(kind: Column, year: Column, number: Column) -> Column:
    return F.concat(F.lit("https://www.legislation.gov.uk/"), F.concat_ws("/", kind, year.cast("string"), number))


def breaches(c: Column) -> Column:
    """The non-empty parts of a semicolon list, trimmed, in order."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def breach_type(c: Column) -> Column:
    return F.when(c.contains("Act"), "act").when(c.contains("Regulations"), "regulation").when(c.contains("Order"), "order")


def clean(c: Column) -> Column:
    """White space collapsed, HTML entities dropped."""
    return F.trim(_chain(c, (r"&[a-zA-Z]+;|&#[0-9]+;", " "), (r"\s+", " ")))


#: Company forms in the order they are looked for (fixed values).
BUSINESS_TYPES = [("LLC|llc", "LLC"), ("[Ii]nc$", "INC"), ("[ ][Cc]orp[. ]", "CORP"), ("PLC|[Pp]lc", "PLC"), ("[Ll]imited|LIMITED|Ltd|LTD|Lld", "LTD"), ("LLP|[Ll]lp", "LLP")]


def business_type(c: Column) -> Column:
    out = F.lit("SOLE")
    for pattern, kind in reversed(BUSINESS_TYPES):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def business_class(kind: Column) -> Column:
    """The enumeration a company form belongs to."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    return (
        F.when(k.isin("LTD", "LIMITED", "LLC", "INC", "CORP"), "limited_company").when(k == "PLC", "plc").when(k.isin("LLP", "PARTNERSHIP"), "partnership").when(k.isin("SOLE", ""), "individual").otherwise("other")
    )


#: Industry rules: pattern, industry, confidence (fixed values).
INDUSTRIES = [
    ("manufacturing", "Manufacturing", 0.95),
    ("production", "Manufacturing", 0.85),
    ("processing", "Manufacturing", 0.80),
    ("chemical", "Manufacturing", 0.90),
    ("engineering", "Manufacturing", 0.85),
    ("food.*processing", "Manufacturing", 0.90),
    ("construction", "Construction", 0.95),
    ("building", "Construction", 0.85),
    ("infrastructure", "Construction", 0.80),
    ("civil.*engineering", "Construction", 0.85),
    ("water.*treatment", "Extractive and utility supply industries", 0.90),
    ("water.*supply", "Extractive and utility supply industries", 0.90),
    ("mining", "Extractive and utility supply industries", 0.95),
    ("quarrying", "Extractive and utility supply industries", 0.95),
    ("utility", "Extractive and utility supply industries", 0.85),
    ("power.*generation", "Extractive and utility supply industries", 0.90),
    ("agriculture", "Agriculture hunting forestry and fishing", 0.95),
    ("farming", "Agriculture hunting forestry and fishing", 0.90),
    ("forestry", "Agriculture hunting forestry and fishing", 0.95),
    ("fishing", "Agriculture hunting forestry and fishing", 0.95),
    ("crop.*production", "Agriculture hunting forestry and fishing", 0.90),
    ("waste.*management", "Total service industries", 0.90),
    ("transport", "Total service industries", 0.80),
    ("logistics", "Total service industries", 0.80),
    ("retail", "Total service industries", 0.75),
    ("wholesale", "Total service industries", 0.75),
    ("distribution", "Total service industries", 0.75),
    ("services", "Total service industries", 0.70),
]


def industry(c: Column, rules: list[tuple[str, str, float]] = INDUSTRIES, least: float = 0.60, sure: float = 0.80) -> Column:
    """(industry, confidence, needs_review, alternatives): the most confident rule that fits, weighed by the text's length.

    Below least, or without a rule, the industry is null.  Alternatives are up to two other industries at 0.8 of theirs.
    """
    n = F.length(c)
    weight = F.when(n > 40, 1.1).when(n > 25, 1.05).when(n > 15, 1.0).otherwise(0.95)
    fits = [F.when(c.rlike(f"(?i){p}"), F.struct(F.least(F.lit(1.0), F.lit(s) * weight).alias("confidence"), F.lit(-i).alias("place"), F.lit(name).alias("industry"))) for i, (p, name, s) in enumerate(rules)]

    def judged(found: Column) -> Column:
        best = F.try_element_at(found, F.lit(1))
        ok = F.coalesce(best["confidence"] >= least, F.lit(False))
        other = F.slice(F.array_distinct(F.transform(F.filter(found, lambda x: x["industry"] != best["industry"]), lambda x: x["industry"])), 1, 2)
        return F.struct(F.when(ok, best["industry"]).alias("industry"), F.when(ok, best["confidence"]).alias("confidence"), (~ok | (best["confidence"] < sure)).alias("needs_review"), F.when(ok, other).alias("alternatives"))

    # A text is held against the rules once, however often the result's parts are used.
    return F.get(F.transform(F.array(F.sort_array(F.filter(F.array(*fits), lambda x: x.isNotNull()), asc=False)), judged), F.lit(0))


def severity(water: Column, land: Column, air: Column) -> Column:
    any_ = lambda v: F.array_contains(F.array(*[F.coalesce(x, F.lit("")) for x in (water, land, air)]), v)
    return F.when(any_("major"), "major").when(any_("minor"), "minor").otherwise("none")


def receptor(water: Column, land: Column, air: Column) -> Column:
    """The most severely affected of water, land, air, in this order; land by default."""
    out = F.lit("land")
    for level in ("minor", "major"):
        for c, name in ((air, "air"), (land, "land"), (water, "water")):
            out = F.when(c == level, name).otherwise(out)
    return out


def impacts(water: Column, land: Column, air: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *[F.nullif(x, F.lit("")) for x in (water, land, air)]), F.lit(""))


def record_id(prefix: str, date: Column, name: Column) -> Column:
    """prefix_yyyymmdd_ and eight hex digits of the name's letters and digits."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(date, "yyyyMMdd"), F.lit("_"), F.substr(F.md5(F.regexp_replace(F.lower(name), "[^a-z0-9]", "")), F.lit(1), F.lit(8)))


def short_hash(c: Column, n: int = 16) -> Column:
    return F.upper(F.substr(F.sha2(c, 256), F.lit(1), F.lit(n)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def company_number(c: Column) -> Column:
    t = F.upper(F.trim(F.regexp_replace(c, r"\(opens in new tab\)", "")))
    return F.when(t.rlike("^[0-9]{7}$"), F.lpad(t, 8, "0")).otherwise(F.nullif(t, F.lit("")))


def join_parts(*parts: Column, by: str = ", ") -> Column:
    return F.concat_ws(by, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


#: Ordinal words (fixed values).
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]


def ordinal(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), F.lower(F.trim(c))), F.lit(0)).cast("int")


def fine_severity(fine: Column) -> Column:
    f = F.coalesce(fine, F.lit(0))
    return F.when(f == 0, "None").when(f < 1000, "Low").when(f < 10000, "Medium").otherwise("High")


def legislation_reference(title: Column, year: Column, number: Column) -> Column:
    """Title, with year and number where they are known."""
    y = year.cast("string")
    return F.when(year.isNotNull() & number.isNotNull(), F.concat(title, F.lit(" "), y, F.lit(" No. "), number)).when(year.isNotNull(), F.concat(title, F.lit(" "), y)).when(number.isNotNull(), F.concat(title, F.lit(" No. "), number)).otherwise(title)


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment, tracking parameters and trailing slash."""
    base = F.regexp_replace(c, r"#.*$", "")
    base = F.regexp_replace(base, r"([?&])utm_[a-z]+=[^&]*", "$1")
    base = F.regexp_replace(base, r"[?&]+$", "")
    head = F.regexp_extract(base, r"^([A-Za-z]+://[^/?]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substr(base, F.length(head) + 1)), r"/$", "")


#: Parts of keys whose values must not be shown, and of keys that name a person (fixed values).
SENSITIVE, PERSONAL = ["password", "token", "secret", "api_key", "private"], ["email", "phone", "address", "name", "postcode"]


def redact(m: Column) -> Column:
    """Values of a string map behind sensitive or personal keys, replaced."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike("(?i)" + "|".join(SENSITIVE)), "[FILTERED]").when(k.rlike("(?i)" + "|".join(PERSONAL)), "[PII]").otherwise(v))


def drop_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def split_name(c: Column) -> Column:
    """type/year/number of a path-like name, as a struct; null parts where they are missing."""
    p = F.split(F.regexp_replace(c, r"^/+|/+$", ""), "[/_]")
    at = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    return F.struct(at(0).alias("type"), at(1).try_cast("int").alias("year"), at(2).alias("number"))


def resource_path(url: Column) -> Column:
    """What follows the host, without the leading slash."""
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/]+/(.*)$", 1)


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))


#: Titles of persons (fixed values).
PERSON_TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr"]


def offender_kind(c: Column) -> Column:
    """person or company: company words decide first, then titles of persons; a name of two or three capitalised words is a person."""
    company = c.rlike(r"(?i)\b(?:ltd|limited|plc|llp|inc|company|council|trust|group|services)\b")
    person = c.rlike(r"^(?:" + "|".join(PERSON_TITLES) + r")\b") | c.rlike(r"^[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}$")
    return F.when(company, "company").when(person, "person").otherwise("company")


#: Words that point to an industry group, in the order they are looked for (fixed values).
INDUSTRY_WORDS = [("farm", "agriculture"), ("build", "construction"), ("construct", "construction"), ("chem", "manufacturing"), ("machin", "manufacturing"), ("waste", "services"), ("water", "utilities")]


def industry_by_word(c: Column, other: str = "other") -> Column:
    out = F.lit(other)
    for word, name in reversed(INDUSTRY_WORDS):
        out = F.when(F.lower(c).contains(word), name).otherwise(out)
    return out


def distinct_name(name: Column, generic: list[str], key: Column) -> Column:
    """Generic names get their record's key as suffix, so that they do not merge."""
    return F.when(F.lower(F.trim(name)).isin([g.lower() for g in generic]), F.concat(name, F.lit(" ("), key, F.lit(")"))).otherwise(name)


def act_year(title: Column, guesses: dict[str, int]) -> Column:
    """The year in a title, else that of the first keyword it holds."""
    guess = F.lit(None).cast("int")
    for word, year in reversed(guesses.items()):
        guess = F.when(F.lower(title).contains(word), year).otherwise(guess)
    return F.coalesce(title_year(title), guess)


def notice_description(act: Column, section: Column, context: Column) -> Column:
    return F.concat(F.lit("Breach of "), act, F.when(F.trim(section) != "", F.concat(F.lit(", section "), section)).otherwise(""), F.when(F.trim(context) != "", F.concat(F.lit(" ("), context, F.lit(")"))).otherwise(""))
