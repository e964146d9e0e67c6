"""Ground equality: classes of terms under equations and under equal arguments, and rewriting by representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import cut


def _flat(up: DataFrame) -> DataFrame:
    """(id, rep) whose representatives are their own: paths are halved until none is left."""
    while True:
        above = up.select(F.col("id").alias("rep"), F.col("rep").alias("top"))
        up = cut(up.join(above, "rep", "left").select("id", F.coalesce("top", "rep").alias("rep"), (F.col("top") < F.col("rep")).alias("moved")))
        moved = up.filter("moved").isEmpty()
        up = up.drop("moved")
        if moved:
            return up


def connected(links: DataFrame) -> DataFrame:
    """(id, rep): every id of the links (a, b) that isn't its own class's smallest, with that one.

    Each node hangs itself below its smallest neighbour, the trees are flattened, and links between trees are what the
    next round works on; a round at least halves the nodes that still have links.
    """
    edges, found = cut(links.filter("a <> b").select("a", "b").distinct()), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _flat(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("rep")))
        if found is None:
            found = up
        else:
            found = cut(found.join(up.select(F.col("id").alias("rep"), F.col("rep").alias("top")), "rep", "left").select("id", F.coalesce("top", "rep").alias("rep")))
        for side in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("rep")) if found is None else found.filter("id <> rep")


def classes(terms: DataFrame, equations: DataFrame) -> DataFrame:
    """(term, rep): the smallest term that each is equal to.

    terms: (term, fn, args: array<string>), a row a compound term, whose arguments are terms by name; equations: (a, b). Names
    without a row, and terms without arguments, are constants. Two terms with one fn are equal if their arguments are; that may make further ones equal, so
    rounds follow each other until none does. A term's own cycle (an argument that is equal to it) does no harm.
    """
    parts = cut(terms.filter("size(args) > 0").select("term", "fn", F.posexplode("args").alias("pos", "arg")))
    every = terms.select("term").union(parts.select("arg")).union(equations.select("a")).union(equations.select("b")).distinct()
    reps = cut(every.select("term", F.col("term").alias("rep")))
    links = equations.select("a", "b")
    while True:
        new = connected(links)
        if new.isEmpty():
            return reps
        reps = cut(reps.join(new.select(F.col("id").alias("rep"), F.col("rep").alias("top")), "rep", "left").select("term", F.coalesce("top", "rep").alias("rep")))
        of = reps.select(F.col("term").alias("arg"), F.col("rep").alias("r"))
        signed = parts.join(of, "arg").groupBy("term", "fn").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("key"))
        signed = cut(signed.join(reps, "term").select("fn", "key", "rep").distinct())
        least = signed.groupBy("fn", "key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
        links = signed.join(least, ["fn", "key"]).select("a", F.col("rep").alias("b"))


def rewritten(facts: DataFrame, reps: DataFrame, *columns: str) -> DataFrame:
    """facts with each of the columns' terms replaced by its representative; terms without one stay."""
    out = facts
    for c in columns:
        out = out.join(reps.filter("term <> rep").select(F.col("term").alias(c), "rep"), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
    return out.select(*facts.columns)
