"""Look-ups by position: conjunctive filters over facts, projections, neighbours in the order of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.facts import ARGS, mentions, terms
from factloom.plans.closure import numbered


def _at(pos: int):
    return F.col("rel") if pos == 0 else F.col(f"a{pos}")


def ask(facts: DataFrame, *where: tuple[int, str]) -> DataFrame:
    """Facts with these terms at these positions (0: the relation): a bag, however many restrictions tie."""
    for pos, term in where:
        facts = facts.filter(_at(pos) == term)
    return facts


def terms_by(facts: DataFrame, target: int, *where: tuple[int, str]) -> DataFrame:
    """The distinct terms at a position of the facts that ask finds."""
    return ask(facts, *where).select(_at(target).alias("term")).filter("term IS NOT NULL").distinct()


def pattern(facts: DataFrame, *atom: str) -> DataFrame:
    """Bindings of a literal such as ("contains", "?O", "P1", "?S", "?N"): all its constants restrict, equal variables
    must agree."""
    names: dict[str, int] = {}
    for pos, a in enumerate(atom):
        if not a.startswith("?"):
            facts = facts.filter(_at(pos) == a)
        elif a in names:
            facts = facts.filter(_at(pos) == _at(names[a]))
        else:
            names[a] = pos
    return facts.select(*(_at(p).alias(v[1:]) for v, p in names.items()))


def both_terms(facts: DataFrame, one: str, two: str) -> DataFrame:
    """Facts that have the two terms at different positions, each once, with both positions."""
    hit = facts.filter(F.array_contains(F.array(*ARGS), one) & F.array_contains(F.array(*ARGS), two))
    pos = lambda t: F.array_position(F.array(*ARGS), t).cast("int")
    return hit.select("rel", *ARGS, pos(one).alias("p1"), pos(two).alias("p2")).filter("p1 <> p2")


def matching(facts: DataFrame, expression: str) -> DataFrame:
    """Terms that a regular expression matches as a whole."""
    return terms(facts).filter(F.col("term").rlike(f"^(?:{expression})$"))


def nearest(facts: DataFrame, term: str, k: int) -> DataFrame:
    """(side, place, term): the k terms before it, and the k from it on, in their order. place counts from it."""
    all_terms = terms(facts)
    below = all_terms.filter(F.col("term") < term).orderBy(F.desc("term")).limit(k)
    above = all_terms.filter(F.col("term") >= term).orderBy("term").limit(k)
    place = lambda df, side, order: df.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order)).alias("place"), "term")
    return place(below, "before", F.desc("term")).unionByName(place(above, "after", F.asc("term")))


def count_by_relation(facts: DataFrame) -> DataFrame:
    return facts.groupBy("rel").agg(F.count("*").alias("n"))


def statistics(facts: DataFrame) -> DataFrame:
    """One row: the numbers of distinct terms, relations and facts."""
    return facts.agg(F.count("*").alias("facts"), F.count_distinct("rel").alias("relations")).crossJoin(terms(facts).agg(F.count("*").alias("terms")))


def merge(facts: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts and those of more that are new, those of more that were there)."""
    key = ["rel", *ARGS]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    join = lambda how: more.alias("l").join(facts.select(*key).alias("r"), same, how)
    return facts.unionByName(join("left_anti").dropDuplicates(key)), join("left_semi")


def first_wins(facts: DataFrame, order: str) -> DataFrame:
    """One row for each different fact: the one that comes first by order."""
    w = Window.partitionBy("rel", *ARGS).orderBy(order)
    return facts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def semantic_network(facts: DataFrame) -> DataFrame:
    """(a, rel, b): the labelled edges of binary facts."""
    return facts.filter("a2 IS NOT NULL AND a3 IS NULL").select(F.col("a1").alias("a"), "rel", F.col("a2").alias("b")).distinct()


def source_dependencies(facts: DataFrame) -> DataFrame:
    """(user, definer, n): how many terms one source uses that another defines, by subclass, instance or subrelation."""
    defined = facts.filter(F.col("rel").isin("subclass", "instance", "subrelation")).select(F.col("a1").alias("term"), F.col("src").alias("definer")).distinct()
    used = mentions(facts).select("term", F.col("src").alias("user")).distinct()
    return used.join(defined, "term").filter("user <> definer").groupBy("user", "definer").agg(F.count("*").alias("n"))


def neighbour(facts: DataFrame, term: str, by: int) -> DataFrame:
    """(term): the one `by` places behind a term (before it, if negative) in the order of terms, or the last on the way.
    A term that isn't there stands for the one before it."""
    all_terms = terms(facts)
    here = all_terms.filter(F.col("term") <= term).orderBy(F.desc("term"))
    if by <= 0:
        return here.limit(1 - by).orderBy("term").limit(1)
    return here.limit(1).unionByName(all_terms.filter(F.col("term") > term).orderBy("term").limit(by)).orderBy(F.desc("term")).limit(1)


def common_terms(facts: DataFrame, one: str, two: str) -> DataFrame:
    """Terms that both sources have."""
    of = lambda src: terms(facts.filter(F.col("src") == src))
    return of(one).intersect(of(two))


def page(df: DataFrame, order: list[str], start: int, rows: int) -> DataFrame:
    """One page of a listing: rows from the start-th (from 0) in this order."""
    return df.orderBy(*order).offset(start).limit(rows)


def by_length(found: DataFrame) -> DataFrame:
    """(term, number): the longest first, then by name."""
    return numbered(found.select("term", (-F.length("term")).alias("__n")), "__n", "term").drop("__n")


def by_presentation(found: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name, number): in the order of the names (term, name) that are shown, whatever their case, then by term."""
    shown = found.join(names, "term", "left").select("term", F.coalesce("name", "term").alias("name"))
    return numbered(shown.withColumn("__n", F.lower("name")), "__n", "term").drop("__n")


def values_by_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): each key's different values, in their order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))


def without_source(facts: DataFrame, src: str) -> DataFrame:
    """Facts but those of one source, such as a user's assertions."""
    return facts.filter(~F.col("src").eqNullSafe(src))


def implied(facts: DataFrame, closed: DataFrame) -> DataFrame:
    """(rel, child, parent) of a closure that no fact states: what a cache file adds."""
    stated = facts.filter("a3 IS NULL").select("rel", F.col("a1").alias("child"), F.col("a2").alias("parent"))
    return closed.join(stated, ["rel", "child", "parent"], "left_anti")
