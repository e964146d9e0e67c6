"""Classes, instances and relations: closures, inheritance, disjointness, signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import ARGS, arity
from factloom.plans.closure import Grown, closure, cut, frontier, reachable, small


def edges(facts: DataFrame, rel: str) -> DataFrame:
    return facts.filter(F.col("rel") == rel).select(F.col("a1").alias("child"), F.col("a2").alias("parent"))


def ancestors(facts: DataFrame, rel: str = "subclass") -> DataFrame:
    """(child, parent) over one step or more."""
    return closure(edges(facts, rel))


def instances(facts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(inst, class): direct and inherited membership, of these classes (class) or of all. The closure of classes is small beside
    the instances, and a shuffle join where it isn't."""
    direct = edges(facts, "instance").select(F.col("child").alias("inst"), F.col("parent").alias("class"))
    up = ancestors(facts).select(F.col("child").alias("class"), F.col("parent").alias("above"))
    if classes is not None:
        #: Each class with those asked for that it is or stands below; others' members fall away before they are shuffled.
        asked = classes.select(F.col("class").alias("above")).filter("above IS NOT NULL").distinct()
        to = cut(up.join(asked, "above", "left_semi").select("class", "above").unionByName(asked.select(F.col("above").alias("class"), "above")).distinct())
        return direct.join(small(to), "class").select("inst", F.col("above").alias("class")).distinct()
    direct = direct.distinct()
    return direct.unionByName(direct.join(up, "class").select("inst", F.col("above").alias("class"))).distinct()


def instances_per_class(facts: DataFrame) -> DataFrame:
    return instances(facts).groupBy("class").agg(F.count_distinct("inst").alias("n"))


def most_specific(members: DataFrame, up: DataFrame) -> DataFrame:
    """(inst, class) without the classes that stand above another class of the instance."""
    above = members.join(up.select(F.col("child").alias("class"), F.col("parent")), "class").select("inst", F.col("parent").alias("class"))
    return members.join(above, ["inst", "class"], "left_anti")


def disjoint_pairs(parts: DataFrame) -> DataFrame:
    """(a, b) both ways, of decompositions (whole, parts: array<string>)."""
    p = parts.select("whole", F.explode(F.array_distinct("parts")).alias("a"))
    return p.join(p.withColumnRenamed("a", "b"), "whole").filter("a <> b").select("a", "b").distinct()


def disjoint_violations(members: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(inst, a, b): instances of two disjoint classes."""
    return members.select("inst", F.col("class").alias("a")).join(disjoint.filter("a < b"), "a").join(members.select("inst", F.col("class").alias("b")), ["inst", "b"]).select("inst", "a", "b")


def related(facts: DataFrame, rel: str, inverse: dict[str, str] | None = None) -> DataFrame:
    """(a1, a2) of the relation and all below it, with inverse relations read backwards."""
    below = frontier(facts.sparkSession.createDataFrame([(rel,)], "term string"), edges(facts, "subrelation"))
    found = facts.join(small(below.withColumnRenamed("term", "rel")), "rel", "left_semi").select("a1", "a2")
    for of, by in (inverse or {}).items():
        swapped = below.filter(F.col("term") == of).select(F.lit(by).alias("rel"))
        found = found.unionByName(facts.join(swapped, "rel", "left_semi").select(F.col("a2").alias("a1"), F.col("a1").alias("a2")))
    return found.distinct()


def kinds_of_terms(facts: DataFrame) -> DataFrame:
    """(term, relation, class, instance): of each relation and each term of a subclass, subrelation or instance fact, what it is."""
    says = lambda rel, arg, kind: facts.filter(F.col("rel") == rel).select(F.col(arg).alias("term"), F.lit(kind).alias("kind"))
    stated = [facts.select(F.col("rel").alias("term"), F.lit("relation").alias("kind")), says("subrelation", "a1", "relation"), says("subrelation", "a2", "relation")]
    stated += [says("subclass", "a1", "class"), says("subclass", "a2", "class"), says("instance", "a2", "class"), says("instance", "a1", "instance")]
    flag = lambda kind: F.max(F.col("kind") == kind).alias(kind)
    return reduce(DataFrame.unionByName, stated).filter("term IS NOT NULL").groupBy("term").agg(flag("relation"), flag("class"), flag("instance"))


def neighbourhood(facts: DataFrame, term: str, rels: list[str], depth: int) -> DataFrame:
    """(term, depth) within so many steps of the relations, either way."""
    e = reduce(DataFrame.unionByName, [edges(facts, r) for r in rels])
    both = e.unionByName(e.select(F.col("parent").alias("child"), F.col("child").alias("parent"))).distinct()
    return reachable(both, facts.sparkSession.createDataFrame([(term,)], "term string"), depth)


def valence(facts: DataFrame) -> DataFrame:
    """(rel, n): the arity that most facts of a relation have, the smaller one where two tie."""
    counted = facts.groupBy("rel", arity().alias("n")).agg(F.count("*").alias("c"))
    return counted.groupBy("rel").agg(F.max_by(F.col("n"), F.struct("c", -F.col("n"))).alias("n"))


def arity_errors(facts: DataFrame, valences: DataFrame) -> DataFrame:
    """Facts whose number of arguments isn't their relation's."""
    return facts.join(small(valences), "rel").filter(arity() != F.col("n")).select("rel", *ARGS, "n")


def inherit_signatures(domains: DataFrame, subrelation: DataFrame) -> DataFrame:
    """(rel, pos, type): declared types, else the nearest declared ones above; the least type where several are as near.

    domains: (rel, pos, type); subrelation: (child, parent).
    """
    rels = domains.select("rel").union(subrelation.select("child")).distinct()
    up = rels.select(F.col("rel").alias("child"), F.col("rel").alias("at"), F.lit(0).alias("d"))
    seen, level = Grown(domains.sparkSession), 0
    open_ = seen.add(up)
    while not open_.isEmpty():
        level += 1
        step = open_.join(subrelation.select(F.col("child").alias("at"), "parent"), "at").select("child", F.col("parent").alias("at"), F.lit(level).alias("d")).distinct()
        open_ = seen.add(step.join(seen.all(), ["child", "at"], "left_anti"))
    found = seen.all().join(domains.withColumnRenamed("rel", "at"), "at")
    return found.groupBy(F.col("child").alias("rel"), "pos").agg(F.min(F.struct("d", "type")).alias("m")).select("rel", "pos", F.col("m.type").alias("type"))


def admissible(valences: DataFrame, signatures: DataFrame, n: int, required: DataFrame) -> DataFrame:
    """Relations of arity n whose signature has every required (pos, type): relational division."""
    of_arity = valences.filter(F.col("n") == n).select("rel")
    missing = of_arity.crossJoin(small(required)).join(signatures, ["rel", "pos", "type"], "left_anti")
    return of_arity.join(missing, "rel", "left_anti")


def instance_relations(transitive: DataFrame, signatures: DataFrame) -> DataFrame:
    """(rel): transitive relations (rel) with a signature (rel, pos, type) none of whose types is a class of classes (+)."""
    return transitive.join(signatures, "rel").groupBy("rel").agg(F.max(F.col("type").endswith("+")).alias("of_classes")).filter("NOT of_classes").select("rel")


def expand(facts: DataFrame, term: str, rel: str, up: bool = False) -> DataFrame:
    """(term): one step below a node of a tree (or above), by a relation and those below it."""
    got = related(facts, rel)
    return got.filter(F.col("a1") == term).select(F.col("a2").alias("term")) if up else got.filter(F.col("a2") == term).select(F.col("a1").alias("term"))


def nearest_mapped(edges_: DataFrame, mapped: DataFrame) -> DataFrame:
    """(child, term, steps): for each node of (child, parent) edges the mapping (child, term) of itself or of the nearest
    node above that has one; the least where several are as near."""
    nodes = edges_.select("child").union(edges_.select("parent")).union(mapped.select("child")).distinct()
    open_ = cut(nodes.select("child", F.col("child").alias("at"), F.lit(0).alias("steps")))
    found, seen, level = None, open_, 0
    while not open_.isEmpty():
        hit = cut(open_.join(mapped.withColumnRenamed("child", "at"), "at").groupBy("child").agg(F.min("term").alias("term")).withColumn("steps", F.lit(level)))
        found = hit if found is None else found.unionByName(hit)
        level += 1
        step = open_.join(hit.select("child"), "child", "left_anti").join(edges_.select(F.col("child").alias("at"), "parent"), "at").select("child", F.col("parent").alias("at")).distinct()
        open_ = cut(step.join(seen, ["child", "at"], "left_anti").withColumn("steps", F.lit(level)))
        seen = cut(seen.unionByName(open_))
    return found
