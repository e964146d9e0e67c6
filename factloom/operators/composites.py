"""Composites: what a whole consists of, in order, as rows or as nested text, and what contains a part.

edges: (whole, part, attribute: boolean, may be left out): parts stand in the order of their names without case, attributes before the others. A part on its own path, a
cycle, isn't entered again; a part of two wholes stands below both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import Grown, cut, numbered


def _edges(edges: DataFrame) -> DataFrame:
    attribute = F.col("attribute") if "attribute" in edges.columns else F.lit(False)
    key = F.concat(F.when(attribute, "0").otherwise("1"), F.lower("part"), F.lit("\0"), F.col("part"))
    return edges.filter("whole IS NOT NULL AND part IS NOT NULL").select("whole", "part", attribute.alias("attribute"), key.alias("key")).distinct()


def descent(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, keys, term, attribute, indent): every node below the roots (term), level by level; path has the
    names from the root on, keys what siblings are ordered by."""
    e, found = _edges(edges), Grown(edges.sparkSession)
    at = F.concat(F.lit("1"), F.lower("term"), F.lit("\0"), F.col("term"))
    level = found.add(roots.select(F.col("term").alias("root"), F.array("term").alias("path"), F.array(at).alias("keys"), "term", F.lit(False).alias("attribute"), F.lit(0).alias("indent")).distinct())
    while not level.isEmpty():
        below = level.drop("attribute").join(e.withColumnRenamed("whole", "term"), "term").filter("NOT array_contains(path, part)")
        level = found.add(below.select("root", F.array_append("path", F.col("part")).alias("path"), F.array_append("keys", F.col("key")).alias("keys"), F.col("part").alias("term"), "attribute", (F.col("indent") + 1).alias("indent")))
    return found.all()


def composite_rows(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, number, indent, term, attribute): each root's tree in the order in which it is shown, a row a node, numbered from 1.

    Numbers come from range partitions over all trees, less the root's first, so a tree may be of any size.
    """
    rows = numbered(descent(edges, roots).select("root", "keys", "indent", "term", "attribute"), "root", "keys")
    first = rows.filter("indent = 0").select("root", F.col("number").alias("first"))
    return rows.join(first, "root").select("root", (F.col("number") - F.col("first") + 1).cast("int").alias("number"), "indent", "term", "attribute")


def composite_trees(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, tree, nodes): each root's tree as nested brackets, "(whole part (whole part))", and its number of nodes, built from the
    deepest level up: a level's nodes are gathered below their wholes once they are whole themselves. A row holds its tree, so roots are what a
    reader takes at once, such as a customer's orders."""
    rows = cut(descent(edges, roots))
    deepest = rows.agg(F.max("indent")).first()[0]
    if deepest is None:
        return rows.select("root", F.col("term").alias("tree"), F.col("indent").cast("long").alias("nodes"))
    made = None
    for level in range(deepest, -1, -1):
        here = rows.filter(F.col("indent") == level).select("root", "path", "keys", "term")
        if made is not None:
            gathered = made.groupBy("root", F.slice("path", 1, level + 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("keys", -1).alias("key"), "tree", "nodes"))).alias("parts"))
            here = here.join(gathered, ["root", "path"], "left")
            inner = F.expr("array_join(transform(parts, p -> p.tree), ' ')")
            tree = F.when(F.col("parts").isNull(), F.col("term")).otherwise(F.concat(F.lit("("), "term", F.lit(" "), inner, F.lit(")")))
            nodes = F.expr("1L + coalesce(aggregate(parts, 0L, (n, p) -> n + p.nodes), 0L)")
        else:
            tree, nodes = F.col("term"), F.lit(1).cast("long")
        made = cut(here.withColumn("tree", tree).withColumn("nodes", nodes).select("root", "path", "keys", "tree", "nodes"))
    return made.select("root", "tree", "nodes")


def containing(edges: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """(term, whole, steps): all that contain each part, by inverted paths, with the fewest steps. With `passed` (term) only those wholes are
    looked through; others end the path."""
    up = edges.filter("whole IS NOT NULL AND part IS NOT NULL").select(F.col("part").alias("at"), F.col("whole").alias("next")).distinct()
    found, steps = Grown(edges.sparkSession), 1
    new = found.add(up.select(F.col("at").alias("term"), F.col("next").alias("whole"), F.lit(1).alias("steps")))
    through = up if passed is None else up.join(passed.select(F.col("term").alias("at")), "at", "left_semi")
    while not new.isEmpty():
        steps += 1
        step = new.join(through, F.col("whole") == F.col("at")).select("term", F.col("next").alias("whole")).distinct()
        new = found.add(step.join(found.all(), ["term", "whole"], "left_anti").withColumn("steps", F.lit(steps)))
    return found.all()

