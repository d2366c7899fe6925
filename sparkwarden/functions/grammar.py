"""Penalties and citations in running text, by a small grammar over tokens; all inside the JVM.

A text is cut once into tokens: amounts of money, numbers (with a letter and bracketed parts behind them), bracketed
phrases, words and punctuation.  What a token means follows from its neighbours: a number before a unit is a measure, an
amount belongs to the label beside it, a number behind the name of a kind of provision is a citation, and a law ends at the
word for a kind of law before a year.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
_TOKEN = r"£\s?[0-9][0-9,]*(?:\.[0-9]+)?|[0-9]+[A-Za-z]{0,2}(?:\([^()]*\))*|\([^()]*\)|[Ee]tc\.|\p{L}[\p{L}'’&-]*|[,;:.]"
#: Words that label an amount, units of time in months, words of custody and of unpaid work, kinds of provisions (first the
#: one that is preferred) and of laws (fixed values).
LABELS = {"fine": ["fine", "fined", "fines"], "costs": ["cost", "costs"], "surcharge": ["surcharge"]}
MONTHS = {"month": 1, "months": 1, "year": 12, "years": 12}
CUSTODY = ["imprisonment", "prison", "custody", "custodial", "jail"]
UNPAID = ["unpaid", "community"]
PROVISIONS = ["Section", "Regulation", "Article", "Rule"]
LAWS = ["act", "regulation", "regulations", "order"]
#: Between a label and its amount, between an amount and its label, before a law's name, and where such a name cannot go on.
_LINKS, _FILLERS, _LEADING, _STOPS = ["of", "was", "totalling", ":"], ["in", "of", "victim", "prosecution", "towards"], ["to", "of", "the", "and", ","], ["contrary", "under", "breach", "breached", ";", ":", "."]


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _starts_with_digit(c: Column) -> Column:
    return (c >= "0") & (c < ":")  # `:` comes right after `9`


class _Text:
    """Tokens of a text, and these in lower case; places count from 0 and are null outside."""

    def __init__(self, tokens: Column, low: Column):
        self.tokens, self.low = tokens, low

    def at(self, i: Column | int) -> Column:
        return F.get(self.tokens, i if isinstance(i, Column) else F.lit(i))

    def word(self, i: Column) -> Column:
        return F.get(self.low, i)

    def places(self, fits: Callable[[Column], Column]) -> Column:
        """The places where something holds, in order."""
        every = F.when(F.size(self.tokens) > 0, F.sequence(F.lit(0), F.size(self.tokens) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: F.coalesce(fits(i), F.lit(False)))

    def span(self, start: Column, end: Column) -> Column:
        """Tokens start to end (included), with a space between, and none before punctuation."""
        return F.regexp_replace(F.array_join(F.slice(self.tokens, start + 1, F.greatest(end - start + 1, F.lit(0))), " "), r" (?=[,;:.])", "")

    def is_number(self, i: Column) -> Column:
        return _starts_with_digit(self.at(i))

    def is_money(self, i: Column) -> Column:
        return self.at(i).startswith("£")


def _with_tokens(c: Column | _Text, make: Callable[[_Text], Column]) -> Column:
    """make() on the tokens of c, which are cut once; null stays null.  c may be tokens that are cut already (see together())."""
    if isinstance(c, _Text):
        return make(c)
    cut = lambda t: _let(F.transform(t, lambda x: F.lower(x)), lambda low: F.when(t.isNotNull(), make(_Text(t, low))))
    return _let(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), cut)


def together(c: Column, parses: dict[str, Callable[[Column], Column]]) -> Column:
    """A struct of what several functions of this module (but breach(), which keeps the text) find in one text, cut once."""
    each = lambda x: F.struct(*[f(x).alias(name) for name, f in parses.items()])
    return F.coalesce(_with_tokens(c, each), each(F.lit(None).cast("string")))


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def _where(found: Column, field: str, value: str) -> Column:
    return F.filter(found, lambda x: x[field] == value)


def _measures(t: _Text, units: list[str], role: Callable[[Column], Column]) -> Column:
    """Places of numbers that stand before one of the units and have a role."""
    return t.places(lambda i: t.word(i + 1).isin(units) & t.at(i).rlike("^[0-9]+$") & role(i))


def _near(t: _Text, i: Column, words: list[str], steps: list[int]) -> Column:
    out = F.lit(False)
    for k in steps:
        out = out | F.coalesce(t.word(i + k).isin(words), F.lit(False))
    return out


def sentence(c: Column) -> Column:
    """(fine, imprisonment_months, suspended_months, community_months, unpaid_hours) of a penalty text; each null if absent.

    A term is suspended where that word stands one or two tokens before it, part of a community order where those words
    stand around it, and of custody where a word of custody follows.
    """

    def make(t: _Text) -> Column:
        suspended = lambda i: _near(t, i, ["suspended"], [-1, -2])
        order = lambda i: _near(t, i, ["order"], [-1, -2, 3]) & _near(t, i, ["community"], [-2, -3, 2])
        served = lambda i: _near(t, i, CUSTODY, [2, 3])

        def months(role: Callable[[Column], Column]) -> Column:
            units = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
            return F.transform(_measures(t, list(MONTHS), role), lambda i: t.at(i).try_cast("int") * F.try_element_at(units, t.word(i + 1)))

        hours = _measures(t, ["hour", "hours"], lambda i: _near(t, i, UNPAID, [2, 3]))
        return F.struct(
            _amount(t.at(_first(t.places(t.is_money)))).alias("fine"),
            _first(months(served)).alias("imprisonment_months"),
            _first(months(suspended)).alias("suspended_months"),
            _first(months(order)).alias("community_months"),
            t.at(_first(hours)).try_cast("int").alias("unpaid_hours"),
        )

    return _with_tokens(c, make)


def _amount(token: Column) -> Column:
    return F.translate(token, "£, ", "").try_cast(MONEY)


def _label(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in LABELS.items():
        out = F.when(word.isin(words), name).otherwise(out)
    return out


def _amounts(t: _Text) -> Column:
    """(amount, label) of each amount of money: the label right before it (a link between them allowed), else the one behind it,
    else the last one since the amount before."""

    def behind(i: Column) -> Column:
        one, two, three = (t.word(i + k) for k in (1, 2, 3))
        return F.coalesce(_label(one), F.when(one.isin(_FILLERS), F.coalesce(_label(two), F.when(two.isin(_FILLERS), _label(three)))))

    words = [w for x in LABELS.values() for w in x]

    def since(i: Column) -> Column:
        seen = F.filter(F.slice(t.low, F.lit(1), i), lambda w: w.isin(words) | w.startswith("£"))
        return _label(F.try_element_at(seen, F.lit(-1)))

    def label(i: Column) -> Column:
        before = F.coalesce(_label(t.word(i - 1)), F.when(t.word(i - 1).isin(_LINKS), _label(t.word(i - 2))))
        return F.coalesce(before, behind(i), since(i))

    return F.transform(t.places(t.is_money), lambda i: F.struct(_amount(t.at(i)).alias("amount"), label(i).alias("label")))


def components(c: Column) -> Column:
    """(fine, costs, surcharge, custodial, community_hours, total) of a case text; total adds up what there is."""

    def make(t: _Text) -> Column:
        weeks = ["week", "weeks", "month", "months"]
        # A number, its unit, and in the words behind it custody or a suspension.
        end = lambda i: F.when(_near(t, i, CUSTODY + ["suspended"], [2]), i + 2).when((t.word(i + 2) == "in") & _near(t, i, CUSTODY, [3]), i + 3)
        terms = F.transform(_measures(t, weeks, lambda i: end(i).isNotNull()), lambda i: F.struct(i.alias("at"), end(i).alias("end")))
        served = _let(terms, lambda x: F.coalesce(_first(F.filter(x, lambda y: t.word(y["end"]) != "suspended")), _first(x)))
        hours = _measures(t, ["hour", "hours"], lambda i: _near(t, i, UNPAID, [2, 3]))

        def sums(found: Column) -> Column:
            money = {name: _first(_where(found, "label", name))["amount"] for name in LABELS}
            custodial = _let(served, lambda x: t.span(x["at"], x["end"]))
            return F.struct(*[x.alias(n) for n, x in money.items()], custodial.alias("custodial"), t.at(_first(hours)).try_cast("int").alias("community_hours"))

        return _let(_amounts(t), sums)

    def total(parts: Column) -> Column:
        money = [F.coalesce(parts[n], F.lit(0).cast(MONEY)) for n in LABELS]
        every = F.when(F.coalesce(*[parts[n] for n in LABELS]).isNotNull(), (money[0] + money[1] + money[2]).cast(MONEY))
        return F.struct(*[parts[n].alias(n) for n in [*LABELS, "custodial", "community_hours"]], every.alias("total"))

    return _let(_with_tokens(c, make), total)


def court(c: Column) -> Column:
    """The court's name: the capitalised words before `Crown Court` or `Magistrates Court`, with these; null without one."""

    def make(t: _Text) -> Column:
        def named(seat: Column) -> Column:
            plain = t.places(lambda i: (i < seat) & (~t.at(i).rlike(r"^\p{Lu}") | t.word(i).isin("at", "the", "in")))
            start = F.coalesce(F.try_element_at(plain, F.lit(-1)) + 1, F.lit(0))
            return _let(start, lambda k: F.when(k < seat, t.span(k, seat + 1)))

        return _let(_first(t.places(lambda i: (t.word(i + 1) == "court") & F.translate(t.word(i), "'’", "").isin("crown", "magistrates"))), named)

    return _with_tokens(c, make)


def defendant(c: Column) -> Column:
    """(name, age, place) from `Name, 45, of Place`; the age may be missing, and then all is null without ` of `."""

    def make(t: _Text) -> Column:
        def parts(comma: Column) -> Column:
            number = F.when(t.word(comma + 1) == "aged", comma + 2).otherwise(comma + 1)
            aged = t.at(number).rlike("^[0-9]{1,3}$") & (t.at(number + 1) == ",")

            def rest(of: Column) -> Column:
                stop = F.coalesce(_first(t.places(lambda i: (i > of) & t.at(i).isin(",", "."))), F.size(t.tokens))

                def made(end: Column) -> Column:
                    fits = (comma > 0) & (t.word(of) == "of") & (end > of + 1)
                    return F.struct(F.when(fits, t.span(F.lit(0), comma - 1)).alias("name"), F.when(fits & aged, t.at(number).try_cast("int")).alias("age"), F.when(fits, t.span(of + 1, end - 1)).alias("place"))

                return _let(stop, made)

            return _let(F.when(aged, number + 2).otherwise(comma + 1), rest)

        return _let(_first(t.places(lambda i: t.at(i) == ",")), parts)

    return _with_tokens(c, make)


# ---------------------------------------------------------------- citations


def _law_ends(t: _Text) -> Column:
    """Places of the years that end a law's name."""
    return t.places(lambda i: t.word(i - 1).isin(LAWS) & t.at(i).rlike("^(?:1[5-9]|20)[0-9]{2}$"))


def _provisions(t: _Text) -> Column:
    """(at, last, kind, text) of each citation: a kind of provision with its number, and further numbers joined to it."""
    names = [w for p in PROVISIONS for w in (p.lower(), f"{p.lower()}s")]
    start = t.places(lambda i: t.word(i).isin(names) & t.is_number(i + 1) & ~F.coalesce(t.at(i + 1).rlike("^(?:1[5-9]|20)[0-9]{2}$") & t.word(i).isin(LAWS), F.lit(False)))

    def one(i: Column) -> Column:
        kind = F.initcap(F.regexp_replace(t.word(i), "s$", ""))
        # Behind the number: pairs of `and` and a number, as long as they go on.
        rest = F.slice(t.tokens, i + 3, F.greatest(F.size(t.tokens) - i - 2, F.lit(0)))
        zero = F.struct(F.lit(True).alias("on"), F.lit(False).alias("joined"), F.array().cast("array<string>").alias("numbers"))

        def step(s: Column, w: Column) -> Column:
            number, joins = s["joined"] & _starts_with_digit(w), ~s["joined"] & (F.lower(w) == "and")
            on = F.struct((number | joins).alias("on"), joins.alias("joined"), F.when(number, F.concat(s["numbers"], F.array(w))).otherwise(s["numbers"]).alias("numbers"))
            return F.when(s["on"], on).otherwise(s)  # what follows the end costs nothing

        def made(more: Column) -> Column:
            numbers = F.concat(F.array(t.at(i + 1)), more)
            return F.struct(i.alias("at"), (i + 1 + 2 * F.size(more)).alias("last"), kind.alias("kind"), F.concat(kind, F.lit(" "), F.array_join(numbers, " and ")).alias("text"))

        more = F.when(t.word(i + 2) == "and", F.aggregate(rest, zero, step, lambda s: s["numbers"]))
        return _let(F.coalesce(more, F.array().cast("array<string>")), made)

    return F.transform(start, one)


def _laws(t: _Text, provisions: Column) -> Column:
    """(at, text, year) of each law: the words since the last citation, law or stop, without those that lead to a name."""

    def of(ends: Column) -> Column:
        stops = F.concat(F.array(F.lit(-1)), ends, F.transform(provisions, lambda p: p["last"]), t.places(lambda i: t.word(i).isin(_STOPS)))

        def every(stops: Column) -> Column:
            def one(end: Column) -> Column:
                named = F.sequence(F.array_max(F.filter(stops, lambda k: k < end - 1)) + 1, end - 1)
                first = F.coalesce(_first(F.filter(named, lambda k: ~t.word(k).isin(_LEADING))), end - 1)
                return F.struct(end.alias("at"), t.span(first, end).alias("text"), t.at(end).try_cast("int").alias("year"))

            return F.transform(ends, one)

        return _let(stops, every)

    return _let(_law_ends(t), of)


def citations(c: Column) -> Column:
    """Array of (section, law): provisions with the law that follows them, or else the last one before; each once, in order."""

    def make(t: _Text) -> Column:
        def paired(provisions: Column) -> Column:
            def with_laws(laws: Column) -> Column:
                def one(p: Column) -> Column:
                    after, before = F.filter(laws, lambda x: x["at"] > p["at"]), F.filter(laws, lambda x: x["at"] < p["at"])
                    return F.struct(p["text"].alias("section"), F.coalesce(_first(after), F.try_element_at(before, F.lit(-1)))["text"].alias("law"))

                return F.array_distinct(F.filter(F.transform(provisions, one), lambda x: x["law"].isNotNull()))

            return _let(_laws(t, provisions), with_laws)

        return _let(_provisions(t), paired)

    return F.coalesce(_with_tokens(c, make), F.array().cast("array<struct<section: string, law: string>>"))


def breach(c: Column) -> Column:
    """What a breach text says: its reference, part, act with year, and fine; each null where it is not stated.

    The part is the first provision of the kind that comes first in PROVISIONS.
    """

    def make(x: _Text) -> Column:
        def found(parts: Column) -> Column:
            part = F.coalesce(*[_first(_where(parts, "kind", k))["text"] for k in PROVISIONS])
            paid = _first(_where(_amounts(x), "label", "fine"))["amount"]

            def made(law: Column) -> Column:
                rest = F.when(x.at(law["at"] + 1) == ",", F.nullif(x.span(law["at"] + 2, F.size(x.tokens) - 1), F.lit("")))
                reference = F.when(law.isNotNull(), F.concat_ws(", ", law["text"], rest))
                return F.struct(reference.alias("reference"), part.alias("part"), law["text"].alias("act_name"), law["year"].alias("act_year"), paid.alias("fine"))

            return _let(_first(_laws(x, parts)), made)

        return _let(_provisions(x), found)

    names = ["reference", "part", "act_name", "act_year", "fine"]
    return _let(_with_tokens(c, make), lambda p: F.struct(F.trim(c).alias("description"), *[p[n].alias(n) for n in names]))


def parsed_once(df: DataFrame, parses: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """df with columns name -> parse(text) of (text column, parse), where each distinct wording is parsed once: for texts that
    stand again and again.  The distinct ones are gathered map-side and joined back; a null text has what parse makes of it."""
    texts = list(dict.fromkeys(c for c, _ in parses.values()))
    known = df.select(*[F.col(c).alias(f"_known_{c}") for c in texts]).distinct().withColumns({name: parse(F.col(f"_known_{c}")) for name, (c, parse) in parses.items()})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in texts])
    return df.join(known, same).select(*df.columns, *parses)


def describe(parts: Column) -> Column:
    """One line of what components() found; null where it found nothing."""

    def line(p: Column) -> Column:
        pounds = lambda name, label: F.concat(F.lit(f"{label}: £"), F.format_number(p[name], 2))
        return F.concat_ws("; ", pounds("fine", "Fine"), pounds("costs", "Costs"), pounds("surcharge", "Victim surcharge"), F.concat(F.lit("Custodial: "), p["custodial"]), F.concat(F.lit("Unpaid work: "), p["community_hours"].cast("string"), F.lit(" hours")))

    return _let(parts, lambda p: F.nullif(line(p), F.lit("")))
