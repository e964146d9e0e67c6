"""Lint queries over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.formula import idle_variables
from factloom.operators.facts import mentions, terms
from factloom.operators.taxonomy import ancestors, edges, instances
from factloom.plans.closure import small


def without_relation(facts: DataFrame, rel: str, pos: int) -> DataFrame:
    """Terms that no fact of the relation has at a position."""
    return terms(facts).join(facts.filter(F.col("rel") == rel).select(F.col(f"a{pos}").alias("term")), "term", "left_anti")


def repeated_values(facts: DataFrame, rel: str) -> DataFrame:
    """(term, n): first arguments with more than one fact of a relation that should have one."""
    return facts.filter(F.col("rel") == rel).groupBy(F.col("a1").alias("term")).agg(F.count("*").alias("n")).filter("n > 1")


def not_below(facts: DataFrame, root: str) -> DataFrame:
    """Classes that aren't below the root, and aren't the root."""
    classes = edges(facts, "subclass").selectExpr("explode(array(child, parent)) AS term").distinct()
    below = ancestors(facts).filter(F.col("parent") == root).select(F.col("child").alias("term"))
    return classes.filter(F.col("term") != root).join(below, "term", "left_anti")


def below(facts: DataFrame, root: str) -> DataFrame:
    return ancestors(facts).filter(F.col("parent") == root).select(F.col("child").alias("term"))


def children_of_disjoint(facts: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(child, a, b): classes below two disjoint ones."""
    up = ancestors(facts)
    return up.select("child", F.col("parent").alias("a")).join(disjoint.filter("a < b"), "a").join(up.select("child", F.col("parent").alias("b")), ["child", "b"]).select("child", "a", "b")


def in_no_part(facts: DataFrame, whole: str, parts: DataFrame) -> DataFrame:
    """(inst): instances of a partitioned class that are in none of its parts (part)."""
    members = instances(facts)
    inside = members.join(small(parts), F.col("class") == F.col("part"), "left_semi").select("inst")
    return members.filter(F.col("class") == whole).select("inst").distinct().join(inside, "inst", "left_anti")


def unused_terms(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Terms that no rule (term) names."""
    return terms(facts).join(rules, "term", "left_anti")


def instance_of_instance(facts: DataFrame) -> DataFrame:
    """(inst, mid, top): instances of what is an instance itself."""
    e = edges(facts, "instance")
    return e.select(F.col("child").alias("inst"), F.col("parent").alias("mid")).join(e.select(F.col("child").alias("mid"), F.col("parent").alias("top")), "mid").select("inst", "mid", "top")


def term_usage(facts: DataFrame) -> DataFrame:
    """(term, n): facts that name it."""
    return mentions(facts).groupBy("term").agg(F.count("*").alias("n"))


def redundant(facts: DataFrame) -> DataFrame:
    """(child, parent): stated subclass facts that the others imply."""
    e = edges(facts, "subclass").distinct()
    up = ancestors(facts)
    via = e.select("child", F.col("parent").alias("mid")).join(up.select(F.col("child").alias("mid"), "parent"), "mid").filter("mid <> parent")
    return e.join(via, ["child", "parent"], "left_semi")


def quantified_in_vain(formulas: DataFrame) -> DataFrame:
    """formulas (text) and variables: those that name a variable in a quantifier and don't have it in its body."""
    return formulas.filter("text LIKE '%forall%' OR text LIKE '%exists%'").withColumn("variables", idle_variables("text")).filter("size(variables) > 0")
