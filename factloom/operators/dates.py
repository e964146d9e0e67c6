"""Dates, times, durations and measures in text, as spans of words, in column expressions alone.

Words are tagged first. Months, years and days that stand at most two words apart make one date as long as no kind comes twice; that rule is a regular
expression over the tags, written with their places, so it takes time in proportion to the text. What is said relative to today is
resolved by the first whole date of the text itself.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and units as they stand in text.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
RELATIVE = {"yesterday": -1, "today": 0, "tomorrow": 1}
DURATIONS = ("second", "minute", "hour", "day", "week", "month", "year")
MEASURES = {"kg": "kilogram", "kilogram": "kilogram", "g": "gram", "gram": "gram", "km": "kilometer", "kilometer": "kilometer", "m": "meter", "meter": "meter", "cm": "centimeter", "centimeter": "centimeter", "mile": "mile", "foot": "foot", "feet": "foot", "inch": "inch", "inches": "inch", "liter": "liter", "pound": "pound", "ton": "ton", "percent": "percent", "dollar": "dollar", "euro": "euro"}
TOKEN = r"[0-9]+(?:[/.:-][0-9]+)*(?:(?:st|nd|rd|th)\b)?|[A-Za-z]+"
#: Words that may stand between two parts of one date, and one more.
APART = 2


def _units() -> dict[str, str]:
    plural = {u: c for u, c in MEASURES.items() if len(u) > 2}
    return MEASURES | {f"{u}s": c for u, c in plural.items()} | {d: d for d in DURATIONS} | {f"{d}s": d for d in DURATIONS}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), key)


def _placed(words: Column) -> Column:
    """(w, i) of numbers and of the names above: few words are looked at closely."""
    names = {*MONTHS, *(m[:3] for m in MONTHS), *WEEKDAYS, *RELATIVE}
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike("^[0-9]") | F.lower(x["w"]).isin(*sorted(names)))


def _tagged(words: Column, placed: Column) -> Column:
    """(tag, at, value, amount, unit) of each placed word that means something."""

    def tag(x: Column) -> Column:
        w, i = x["w"], x["i"]
        low, after, third = F.lower(w), F.lower(F.get(words, i + 1)), F.lower(F.get(words, i + 2))
        number = w.rlike(r"^[0-9]+(\.[0-9]+)?$")
        unit = _lookup(_units(), F.coalesce(after, F.lit("")))
        month = _lookup({m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)}, low)
        western = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"
        day = F.regexp_extract(w, "^([0-9]{1,2})(st|nd|rd|th)?$", 1)
        whole = F.concat_ws("-", F.regexp_extract(w, western, 3), F.lpad(F.regexp_extract(w, western, 1), 2, "0"), F.lpad(F.regexp_extract(w, western, 2), 2, "0"))
        of = lambda t, value, amount=None, u=None: F.struct(F.lit(t).alias("tag"), i.alias("at"), value.cast("string").alias("value"), (F.lit(None) if amount is None else amount).cast("double").alias("amount"), (F.lit(None) if u is None else u).cast("string").alias("unit"))
        none = F.lit(None).cast("string")
        return (
            F.when(number & unit.isNotNull() & F.coalesce(third == "ago", F.lit(False)) & unit.isin("day", "week", "month", "year") & ~F.contains(w, F.lit(".")), of("ago", F.lit("3"), -w.try_cast("double"), unit))
            .when(number & unit.isNotNull() & unit.isin(*DURATIONS), of("duration", none, w.try_cast("double"), unit))
            .when(number & unit.isNotNull(), of("measure", none, w.try_cast("double"), unit))
            .when(F.try_to_date(F.when(w.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), w), "yyyy-MM-dd").isNotNull(), of("whole", w))
            .when(F.try_to_date(F.when(w.rlike(western), whole), "yyyy-MM-dd").isNotNull(), of("whole", whole))
            .when(w.rlike("^[0-9]{4}-[0-9]{4}$"), of("years", F.replace(w, F.lit("-"), F.lit("/"))))
            .when(w.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), of("time", F.rpad(F.when(F.substring(w, 2, 1) == ":", F.concat(F.lit("0"), w)).otherwise(w), 8, ":00")))
            .when(_lookup(RELATIVE, low).isNotNull(), of("ago", F.lit("1"), _lookup(RELATIVE, low), F.lit("day")))
            .when(low.isin(*WEEKDAYS), of("weekday", low))
            .when(month.isNotNull(), of("M", month))
            .when(w.rlike("^[0-9]{4}$"), of("Y", w))
            .when(day.try_cast("int").between(1, 31), of("D", day.try_cast("int")))
        )

    return F.filter(F.transform(placed, tag), lambda x: x.isNotNull())


def _dates(parts: Column) -> Column:
    """Spans of what the parts of dates make: (kind, at, n, value, amount, unit). A day alone is no date."""
    written = F.array_join(F.transform(parts, lambda x, i: F.concat(F.when((i > 0) & (x["at"] - F.get(parts, i - 1)["at"] > APART), "|").otherwise(""), x["tag"], x["at"].cast("string"), F.lit("="), x["value"], F.lit(";"))), "")
    orders = [o for n in (3, 2, 1) for o in permutations("MYD", n)]
    groups = F.regexp_extract_all(written, F.lit("|".join("".join(f"{t}[^;|]*;" for t in o) for o in orders)), F.lit(0))
    groups = F.filter(groups, lambda g: g.rlike("[MY]"))

    def span(g: Column) -> Column:
        part = lambda t, size, unknown: F.when(g.rlike(f"{t}[0-9]"), F.lpad(F.regexp_extract(g, f"{t}[0-9]+=([0-9]+);", 1), size, "0")).otherwise(unknown)
        first, last = F.regexp_extract(g, "^[MYD]([0-9]+)", 1).cast("int"), F.regexp_extract(g, "([0-9]+)=[0-9]+;$", 1).cast("int")
        value = F.concat(part("Y", 4, "XXXX"), F.lit("-"), part("M", 2, "XX"), F.lit("-"), part("D", 2, "XX"))
        return _span(F.lit("date"), first, last - first + 1, value)

    return F.transform(groups, span)


def _span(kind: Column, at: Column, n: Column, value: Column, amount: Column | None = None, unit: Column | None = None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c
    return F.struct(kind.alias("kind"), at.cast("int").alias("at"), n.cast("int").alias("n"), value.alias("value"), none(amount, "double").alias("amount"), none(unit, "string").alias("unit"))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, and a row a span: kind, at (its first word, from 0), n (words), value, amount, unit.

    date: value is year-month-day, X for what isn't said; time; weekday; years: from/to; duration and measure: amount and unit; relative: value
    is the day that amount units before or after the text's first whole date is, null if it has none. A null or empty text has no spans; words are runs of
    ASCII letters, or of digits with signs between.
    """
    keep = [c for c in docs.columns if c not in (text, "kind", "at", "n", "value", "amount", "unit", "__w", "__c", "__t", "__p", "__d", "__b")]
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    #: Each of these columns is read more than once by the next, so it is computed once a text; a filter on one would be pushed below and do it anew.
    tagged = docs.select(*keep, words.alias("__w")).withColumn("__c", _placed(F.col("__w")))
    tagged = tagged.select(*keep, _tagged(F.col("__w"), F.col("__c")).alias("__t"))
    tagged = tagged.withColumn("__p", F.filter("__t", lambda x: x["tag"].isin("M", "Y", "D"))).withColumn("__d", _dates(F.col("__p"))).drop("__p")
    wholes = F.concat(F.transform(F.filter("__t", lambda x: x["tag"] == "whole"), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))), F.transform("__d", lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))))
    tagged = tagged.withColumn("__b", F.array_min(F.filter(wholes, lambda x: ~F.contains(x["value"], F.lit("X")) & F.try_to_date(x["value"], "yyyy-MM-dd").isNotNull()))["value"].cast("date"))

    def single(x: Column) -> Column:
        months = (x["amount"] * F.when(x["unit"] == "year", 12).otherwise(1)).cast("int")
        days = (x["amount"] * F.when(x["unit"] == "week", 7).otherwise(1)).cast("int")
        day = F.when(x["unit"].isin("month", "year"), F.add_months("__b", months)).otherwise(F.date_add("__b", days)).cast("string")
        return (
            F.when(x["tag"] == "ago", _span(F.lit("relative"), x["at"], x["value"].cast("int"), day, x["amount"], x["unit"]))
            .when(x["tag"].isin("duration", "measure"), _span(x["tag"], x["at"], F.lit(2), x["value"], x["amount"], x["unit"]))
            .otherwise(_span(F.when(x["tag"] == "whole", "date").otherwise(x["tag"]), x["at"], F.lit(1), x["value"]))
        )

    singles = F.transform(F.filter("__t", lambda x: ~x["tag"].isin("M", "Y", "D")), single)
    return tagged.select(*keep, F.explode(F.concat(singles, "__d")).alias("s")).select(*keep, "s.*")
