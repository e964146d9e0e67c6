"""Axiom selection by symbols: an axiom is triggered by its rarest symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.closure import cut


def triggers(occurrences: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(axiom, symbol): symbols that are at most `tolerance` times as common as the axiom's rarest. occurrences:
    (axiom, symbol)."""
    o = occurrences.select("axiom", "symbol").distinct()
    degree = o.groupBy("symbol").agg(F.count("*").alias("degree"))
    least = F.min("degree").over(Window.partitionBy("axiom"))
    return o.join(degree, "symbol").withColumn("least", least).filter(F.col("degree") <= F.col("least") * tolerance).select("axiom", "symbol")


def select(occurrences: DataFrame, goal: DataFrame, tolerance: float = 1.0, depth: int | None = None) -> DataFrame:
    """(axiom, depth): axioms that the goal's symbols (symbol) trigger, and those that their symbols trigger in turn."""
    o = occurrences.select("axiom", "symbol").distinct()
    fired = cut(triggers(o, tolerance))
    symbols = cut(goal.select("symbol").distinct())
    chosen, new, level = None, symbols, 0
    while not new.isEmpty() and (depth is None or level < depth):
        level += 1
        axioms = fired.join(new, "symbol", "left_semi").select("axiom").distinct()
        if chosen is not None:
            axioms = axioms.join(chosen, "axiom", "left_anti")
        axioms = cut(axioms.withColumn("depth", F.lit(level)))
        chosen = axioms if chosen is None else chosen.unionByName(axioms)
        new = cut(o.join(axioms, "axiom", "left_semi").select("symbol").distinct().join(symbols, "symbol", "left_anti"))
        symbols = symbols.unionByName(new)
    return chosen if chosen is not None else o.select("axiom", F.lit(0).alias("depth")).limit(0)
