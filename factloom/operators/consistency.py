"""Consistency in order: each fact of an individual's class is held against those accepted before it.

A fact is refused if an accepted earlier one puts the individual into a class that is disjoint, itself or by inheritance; it is
redundant if accepted earlier ones have or imply it; else it is accepted. That is what a loop over the facts would find, but individuals are worked
on side by side: equal facts are one first, and an individual's classes, which the schema bounds, are taken one by one in the order of their first places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import small


def _classes(up: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(class, above, against): each class that stands below others or is disjoint, with the sets of itself and all above it, and of what excludes one of these."""
    both = disjoint.select("a", "b").union(disjoint.select("b", "a")).filter("a IS NOT NULL AND b IS NOT NULL")
    step = up.select(F.col("child").alias("class"), F.col("parent").alias("above")).filter("class IS NOT NULL AND above IS NOT NULL")
    wide = step.union(step.select("class", "class")).union(both.select("a", "a")).distinct()
    return wide.join(both, F.col("above") == F.col("a"), "left").groupBy("class").agg(F.collect_set("above").alias("above"), F.collect_set("b").alias("against"))


def _accepted(first: DataFrame, classes: DataFrame) -> DataFrame:
    """(inst, class, since, implied) of the accepted ones of first (inst, class, place); implied: by classes that were accepted before."""
    own = first.join(small(classes), "class", "left").withColumn("above", F.coalesce("above", F.array("class"))).withColumn("against", F.coalesce("against", F.array().cast("array<string>")))
    placed = own.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("place", "class", "above", "against"))).alias("facts"))
    kind = first.schema["place"].dataType.simpleString()
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("above"), none.alias("against"), F.array().cast(f"array<struct<class:string,since:{kind},implied:boolean>>").alias("good"))

    def take(held, fact):
        one = F.struct(fact["class"].alias("class"), fact["place"].alias("since"), F.array_contains(held["above"], fact["class"]).alias("implied"))
        more = F.struct(F.array_union(held["above"], fact["above"]).alias("above"), F.array_union(held["against"], fact["against"]).alias("against"), F.concat(held["good"], F.array(one)).alias("good"))
        return F.when(F.arrays_overlap(held["against"], fact["above"]), held).otherwise(more)

    return placed.select("inst", F.explode(F.aggregate("facts", start, take, lambda held: held["good"])).alias("one")).select("inst", "one.*")


def verdicts(facts: DataFrame, up: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(place, inst, class, verdict): accepted, redundant or refused, for facts (place, inst, class) in the order of their places, then classes.

    up: (child, parent), the closure of subclass; disjoint: (a, b), either way. Facts without an individual or a class are left out. Of equal
    facts the first decides; later ones are redundant, or refused with it. An individual's classes are bounded by the schema, its facts aren't:
    they are aggregated first. A class that is disjoint with one of its own superclasses conflicts with nothing but others.
    """
    stated = facts.filter("inst IS NOT NULL AND class IS NOT NULL").select("place", "inst", "class")
    first = stated.groupBy("inst", "class").agg(F.min("place").alias("place"))
    known = _accepted(first, _classes(up, disjoint))
    verdict = F.when(F.col("implied").isNull(), "refused").when(F.col("implied") | (F.col("n") > 1), "redundant").otherwise("accepted")
    #: Equal facts at one place count as one behind the other.
    counted = stated.groupBy("place", "inst", "class").agg(F.count("*").alias("times")).join(known, ["inst", "class"], "left")
    rows = counted.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rows = rows.withColumn("n", F.when(F.col("place") > F.col("since"), 2).otherwise(F.col("n")))
    return rows.select("place", "inst", "class", verdict.alias("verdict"))


def judge(accepted: DataFrame, batch: DataFrame, up: DataFrame, disjoint: DataFrame) -> DataFrame:
    """verdicts of a batch (place, inst, class) behind facts (inst, class) accepted before: what foreachBatch of a stream of assertions calls. Only accepted facts of
    the batch's individuals are read again; batches one after the other give what one run over all would."""
    before = accepted.select("inst", "class").distinct().join(batch.select("inst").distinct(), "inst", "left_semi")
    low = batch.agg(F.min("place")).first()[0]
    if low is None:
        return batch.select("place", "inst", "class", F.lit("accepted").alias("verdict"))
    kind = batch.schema["place"].dataType
    both = before.select(F.lit(low - 1).cast(kind).alias("place"), "inst", "class").unionByName(batch.select("place", "inst", "class"))
    return verdicts(both, up, disjoint).filter(F.col("place") >= low)
