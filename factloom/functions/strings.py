"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove_html(c: Column) -> Column:
    """Without tags."""
    return F.regexp_replace(c, "<[^>]+>", "")


def filter_html(c: Column) -> Column:
    """Without scripts, styles and tags; runs of white space become one space."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def normalise_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def remove_punctuation(c: Column) -> Column:
    """Contractions lose their apostrophe's end; other punctuation goes."""
    return F.regexp_replace(F.regexp_replace(c, "'(s|re|ve|ll|d|m|t)\\b", ""), r"[.,;:!?()\[\]\"'`]", "")


def split_camel_case(c: Column) -> Column:
    """A space before each capital that follows a small letter or a digit."""
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def normal_name(c: Column) -> Column:
    """For matching: camel case split, lower case, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(split_camel_case(c)), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Words of letters and digits, in lower case for ASCII."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_integer(c: Column) -> Column:
    return c.try_cast("int").isNotNull()


def has_non_ascii(c: Column) -> Column:
    return c.rlike("[^\\x00-\\x7F]")


def replace_non_ascii(c: Column, by: str = "x") -> Column:
    return F.regexp_replace(c, "[^\\x00-\\x7F]", by)


def to_identifier(c: Column) -> Column:
    """A term's name: words joined with a capital each, other characters dropped."""
    return F.regexp_replace(F.initcap(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), " ", "")


def to_prolog_name(c: Column) -> Column:
    """A Prolog atom: starts with a small letter, other characters become underlines."""
    c = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def escape_quotes(c: Column) -> Column:
    return F.regexp_replace(c, '(["\\\\])', "\\\\$1")


def quote_cell(c: Column) -> Column:
    """A cell of a written sheet: in quotes unless it is an integer."""
    return F.when(c.rlike("^[+-]?[0-9]+$"), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def substring_distance(a: Column, b: Column) -> Column:
    """1 for equal strings; where one holds the other, its place (from 0) and the difference of lengths; else null."""
    inside = lambda x, y: F.instr(x, y) - 1 + F.length(x) - F.length(y)
    return F.when(a == b, 1).when(F.contains(a, b), inside(a, b)).when(F.contains(b, a), inside(b, a)).cast("int")


def tail_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein's distance of what follows the first characters, -1 beyond `most`; null for an empty string."""
    rest = lambda c: c.substr(F.lit(2), F.length(c))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(rest(a), rest(b), most))


def lower_median(values: Column) -> Column:
    """Of an array of integers: the middle one, or the mean of the middle two without its fraction; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n == 0, None).when(n % 2 == 1, at((n - 1) / 2)).otherwise(((at(n / 2 - 1) + at(n / 2)) / 2).cast("long")).cast("long")


def filled(c: Column, char: str, length: int, before: bool) -> Column:
    """Filled with a character up to a length; longer strings stay, and null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    more = F.repeat(F.lit(char), F.greatest(F.lit(0), F.lit(length) - F.length(c)))
    return F.concat(more, c) if before else F.concat(c, more)


def balanced_paren(c: Column, at: int) -> Column:
    """The place (from 0) of the parenthesis that closes the one at place at; -1 if there is none, null for null."""
    steps = F.transform(F.split(F.substring(c, at + 2, 1 << 30), ""), lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0))
    seen = F.aggregate(
        steps,
        F.struct(F.lit(1).alias("open"), F.lit(at).alias("place")),
        lambda s, x: F.struct(F.when(s["open"] == 0, 0).otherwise(s["open"] + x).alias("open"), F.when(s["open"] == 0, s["place"]).otherwise(s["place"] + 1).alias("place")),
    )
    return F.when(c.isNull(), None).when(seen["open"] == 0, seen["place"]).otherwise(-1)


def relation_id(c: Column) -> Column:
    """A relation's name: the first character small."""
    return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def all_caps_id(c: Column) -> Column:
    """A term's name from words in capitals with underlines between: each word's first character stays, its others are
    made small."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.substring(w, 1, 1), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def is_vowel(c: Column) -> Column:
    return c.isin("a", "e", "i", "o", "u")


def verb_plural(c: Column) -> Column:
    """A verb's form with a plural ending, at its first word where underlines part several."""
    word = F.when(F.locate("_", c) > 1, F.substring_index(c, "_", 1)).otherwise(c)
    rest = c.substr(F.length(word) + 1, F.length(c))
    made = (
        F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|x|ch|sh|z)$") | (word == "go"), F.concat(word, F.lit("es")))
        .when(word == "be", "are")
        .otherwise(F.concat(word, F.lit("s")))
    )
    return F.concat(made, rest)


def pattern_value(pairs: list[tuple[str, str]], key: Column) -> Column:
    """The value of the first (pattern, value) whose pattern matches the whole key; empty if none does."""
    whole = lambda p: key.rlike(rf"\A(?:{p})\z")
    return F.coalesce(*(F.when(whole(p), F.lit(v)) for p, v in pairs), F.lit(""))


def retained(values: Column, pattern: str, remove: bool = False) -> Column:
    """The elements of an array that a pattern matches as a whole, or those that it doesn't."""
    hit = lambda x: x.rlike(rf"\A(?:{pattern})\z")
    return F.filter(values, (lambda x: ~hit(x)) if remove else hit)
