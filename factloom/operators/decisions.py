"""Decision tables, sheets, matching of names, one-dimensional clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.strings import normal_name, substring_distance, tail_levenshtein
from factloom.plans.closure import small


def recommendations(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, score): sums of weight times value over a row's cells (row, col, value); cells without a weight don't count."""
    return cells.join(F.broadcast(weights), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def buckets(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, bucket, score): the weights (feature, bucket, weight) of the features that an item has."""
    return items.join(F.broadcast(weights), "feature").groupBy("item", "bucket").agg(F.sum("weight").alias("score"))


def matrix(counts: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """Sparse counts as a table with the named columns; 0 where there is none."""
    return counts.groupBy(row).pivot(col, columns).agg(F.sum(value)).fillna(0, columns)


def sheet(facts: DataFrame, relations: list[str]) -> DataFrame:
    """(a1, one column a relation): second arguments joined by / in their order."""
    chosen = facts.filter(F.col("rel").isin(*relations))
    return chosen.groupBy("a1").pivot("rel", relations).agg(F.array_join(F.array_sort(F.collect_list("a2")), "/"))


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, x, y) that share a word of their normal names x and y, so that no cross join is needed for names that hold each other's
    words; left and right: one column, name. A pair counts where it meets by the first of its common words, so none comes twice."""

    def words(df: DataFrame, name: str, normal: str) -> DataFrame:
        own = df.select(F.col("name").alias(name)).distinct().withColumn(normal, normal_name(F.col(name)))
        own = own.withColumn(f"{normal}s", F.array_distinct(F.split(normal, " ")))
        return own.withColumn("w", F.explode(f"{normal}s"))

    met = small(words(left, "a", "x")).join(words(right, "b", "y"), "w")
    return met.filter("w = element_at(array_intersect(xs, ys), 1)").select("a", "b", "x", "y")


def match_names(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, by_substring, by_letters) of pairs (a, b and their normal names x, y) with either distance of the normal names at most `most`.
    Letters are compared only as far as `most` before a pair is known to stay."""
    x, y = F.col("x"), F.col("y")
    kept = pairs.filter((substring_distance(x, y) <= most) | (tail_levenshtein(x, y, most) >= 0))
    return kept.select("a", "b", substring_distance(x, y).alias("by_substring"), tail_levenshtein(x, y).alias("by_letters"))


def best_match(scored: DataFrame, score: str) -> DataFrame:
    """(a, b, score): for each a the b of least distance, the first by name of equals."""
    return scored.filter(F.col(score).isNotNull()).groupBy("a").agg(F.min(F.struct(F.col(score).alias("score"), "b")).alias("m")).select("a", "m.b", "m.score")


def quartiles(df: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, low, high): the medians, without their fraction, of the lower and the upper half of each group's integers
    (the middle element in neither; one element alone is both). Groups are sorted by their different values."""
    counted = df.select(group, value.cast("long").alias("v")).filter("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    counted = counted.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    middle = lambda first: ((at(first + F.floor((half - 1) / 2)) + at(first + F.floor(half / 2))) / 2).cast("long")
    return counted.groupBy(group).agg(middle(F.lit(0)).alias("low"), middle(F.col("n") - half).alias("high"))


def medians(df: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, median): the middle one of each group's integers, or the mean of the middle two without its fraction; null for a group without any.
    Groups are sorted by their different values, with counts."""
    counted = df.select(group, value.cast("long").alias("v")).groupBy(group, "v").agg(F.count("v").alias("c"))
    w = Window.partitionBy(group)
    counted = counted.withColumn("upto", F.sum("c").over(w.orderBy(F.asc_nulls_last("v")))).withColumn("n", F.sum("c").over(w))
    at = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("v").isNotNull(), F.col("v")))
    return counted.groupBy(group).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).cast("long").alias("median"))


def outside_quartiles(df: DataFrame, group: str, value: Column) -> DataFrame:
    """df and outside: whether a row's value lies outside its group's two medians; null for a null group or value."""
    found = quartiles(df, group, value).withColumnRenamed(group, "__g")
    return df.join(found, F.col(group) == F.col("__g"), "left").withColumn("outside", (value < F.col("low")) | (value > F.col("high"))).drop("__g", "low", "high")


def counted_k_means(x: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The cluster of each of the different sorted numbers x, which stand for as many elements as counts has.

    Lloyd's algorithm until no element changes its cluster; the first k numbers are the first means.
    """
    means, seen = x[:k].astype(float), set()
    while True:
        near = np.abs(x[:, None] - means).argmin(1)
        borders = tuple(np.searchsorted(near, np.arange(len(means))))  # clusters are intervals
        if borders in seen:
            return near
        seen.add(borders)
        means = np.array([np.average(x[near == i], weights=counts[near == i]) if (near == i).any() else m for i, m in enumerate(means)])


def k_means(values: list[float], k: int) -> list[list[float]]:
    """The clusters of all elements, sorted."""
    x, counts = np.unique(np.array(values, float), return_counts=True)
    near = counted_k_means(x, counts, k)
    return [np.repeat(x[near == i], counts[near == i]).tolist() for i in range(min(k, len(x)))]


def grouped_k_means(df: DataFrame, group: str, value: Column, k: int) -> DataFrame:
    """(group, cluster, n, mean) over all of each group's rows with a value; a task holds a group's different values and their counts."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        x, counts = frame["v"].to_numpy(), frame["c"].to_numpy()
        near = counted_k_means(x, counts, k)
        got = [(x[near == i], counts[near == i]) for i in range(min(k, len(x)))]
        return pd.DataFrame([(frame[group].iloc[0], i, int(c.sum()), float(np.average(v, weights=c)) if len(v) else None) for i, (v, c) in enumerate(got)], columns=[group, "cluster", "n", "mean"])

    kind = df.schema[group].dataType.simpleString()
    counted = df.select(group, value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("c"))
    return counted.groupBy(group).applyInPandas(run, f"{group} {kind}, cluster int, n long, mean double")
