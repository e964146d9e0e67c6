"""One hierarchy against another: where a mapping's two sides don't agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import Grown, cut


def disagreements(edges: DataFrame, mapping: DataFrame, up: DataFrame) -> DataFrame:
    """(child, parent, term, above, nearest, steps): edges (child, parent) of which no pair of mapped terms is equal or connected on the other side, whose
    closure is up (child, parent); the least term of each end; and the nearest ancestor of child whose term is the child's or above it, null if none is.

    mapping: (node, term), several terms a node allowed; edges with an end that isn't mapped say nothing. Ancestors are climbed for disagreeing children
    only, and no further than to the one that agrees.
    """
    m, over = mapping.select("node", "term").distinct(), cut(up.select(F.col("child").alias("term"), F.col("parent").alias("above")).distinct())
    e = edges.select("child", "parent").filter("child <> parent").distinct()
    both = cut(e.join(m.withColumnRenamed("node", "child"), "child").join(m.select(F.col("node").alias("parent"), F.col("term").alias("above")), "parent"))
    fine = both.filter("term = above").select("child", "parent").union(both.join(over, ["term", "above"], "left_semi").select("child", "parent")).distinct()
    bad = cut(both.join(fine, ["child", "parent"], "left_anti").groupBy("child", "parent").agg(F.min("term").alias("term"), F.min("above").alias("above")))
    of = cut(bad.select("child").distinct().join(m.withColumnRenamed("node", "child"), "child"))
    good = cut(of.select("child", F.col("term").alias("above")).union(of.join(over, "term").select("child", "above")).distinct())
    seen, hits, steps = Grown(edges.sparkSession), Grown(edges.sparkSession), 0
    open_ = seen.add(bad.select("child", F.col("child").alias("at")).distinct())
    hits.add(bad.select("child", F.col("child").alias("nearest"), F.lit(0).alias("steps")).limit(0))
    while not open_.isEmpty():
        steps += 1
        step = open_.join(e.select(F.col("child").alias("at"), "parent"), "at").select("child", F.col("parent").alias("at")).distinct()
        new = seen.add(step.join(seen.all(), ["child", "at"], "left_anti"))
        found = new.join(m.select(F.col("node").alias("at"), F.col("term").alias("above")), "at").join(good, ["child", "above"], "left_semi")
        hit = hits.add(found.groupBy("child").agg(F.min("at").alias("nearest")).withColumn("steps", F.lit(steps)))
        open_ = new.join(hit.select("child"), "child", "left_anti")
    return bad.join(hits.all(), "child", "left").select("child", "parent", "term", "above", "nearest", "steps")


def unmapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(node): nodes of a hierarchy without a term."""
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).filter("node IS NOT NULL").distinct()
    return nodes.join(mapping.filter("term IS NOT NULL"), "node", "left_anti")
