"""Types of relations' arguments, inferred from where terms occur, and their declarations for a higher-order prover.

Places are a relation's argument (rel, pos), a formula's variable, and a constant. What occurs at a place has the place's type, so places that
share a variable or a constant are one class (by connected components); a class takes the types that are known of any of its places. Where
these differ, it gets the most special type above all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.formula import LOGICAL
from factloom.plans.closure import cut
from factloom.plans.congruence import connected

#: What formulas have as a type, and what has no other.
FORMULA, TOP = "$o", "Entity"


def _place(rel: Column, pos: Column) -> Column:
    return F.concat(F.lit("p|"), rel, F.lit("|"), pos.cast("string"))


def occurrences(nodes: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((place, what) pairs of one type, (place, type) that the form alone tells), of formulas' trees (sources.kif.nodes, best with heads, else they are joined). functions: (rel),
    whose lists are terms; any other list is a formula."""
    if "over" not in nodes.columns:
        heads = nodes.filter("pos = 0 AND token IS NOT NULL AND parent IS NOT NULL").select("formula_id", F.col("parent").alias("node"), F.col("token").alias("own"))
        nodes = nodes.join(heads, ["formula_id", "node"], "left").join(heads.select("formula_id", F.col("node").alias("parent"), F.col("own").alias("over")), ["formula_id", "parent"], "left")
    used = nodes.filter("pos > 0 AND over IS NOT NULL").filter(~F.col("over").isin(*LOGICAL) & ~F.col("over").rlike("^[?@]"))
    known = functions.select(F.col("rel").alias("own")).distinct().withColumn("term", F.lit(True))
    used = used.select("formula_id", _place(F.col("over"), F.col("pos")).alias("place"), "token", "own").filter("token IS NULL OR NOT startswith(token, '@')").join(known, "own", "left")
    atom, number = F.col("token").isNotNull(), F.col("token").rlike("^[+-]?[0-9]")
    what = F.when(~atom, F.when(F.col("term"), _place(F.col("own"), F.lit(0)))).when(number, None).when(F.col("token").startswith("?"), F.concat(F.lit("v|"), "formula_id", F.lit("|"), "token")).otherwise(F.concat(F.lit("c|"), "token"))
    kind = F.when(~atom, F.when(F.col("term").isNull(), F.lit(FORMULA))).when(number, F.lit("Number"))
    used = cut(used.select("place", what.alias("what"), kind.alias("type")))
    return used.filter("what IS NOT NULL").select("place", "what"), used.filter("type IS NOT NULL").select("place", "type").distinct()


def common(types: DataFrame, up: DataFrame) -> DataFrame:
    """(class, type): of each class's types (class, type) the most special one that is equal to or above all of them, the first by name of
    several; a formula's type has none above it but itself, and without a common one it is TOP. up: (child, parent), the closure of subclass."""
    some = cut(types.distinct())
    over = some.select("class", "type", F.col("type").alias("above")).union(some.join(up.select(F.col("child").alias("type"), F.col("parent").alias("above")), "type").select("class", "type", "above")).distinct()
    shared = over.groupBy("class", "above").agg(F.count("*").alias("n")).join(some.groupBy("class").agg(F.count("*").alias("needs")), "class").filter("n = needs")
    depth = up.groupBy(F.col("child").alias("above")).agg(F.count_distinct("parent").alias("depth"))
    best = shared.join(depth, "above", "left").groupBy("class").agg(F.min_by("above", F.struct((-F.coalesce("depth", F.lit(0))).alias("d"), "above")).alias("type"))
    return some.select("class").distinct().join(best, "class", "left").select("class", F.coalesce("type", F.lit(TOP)).alias("type"))


def inferred(nodes: DataFrame, functions: DataFrame, signatures: DataFrame, members: DataFrame, up: DataFrame) -> DataFrame:
    """(rel, pos, type): of every argument that occurs or is declared (signatures: rel, pos, type; pos 0 is a function's value).

    members: (inst, type), direct classes of constants. A place of which nothing is known gets TOP. Formulas and facts may be of any number; a variable's places
    belong to its formula alone.
    """
    links, told = occurrences(nodes, functions)
    # what stands at several places ties each of them to the least one: few places are connected, however many terms and variables there are
    least = cut(links.groupBy("what").agg(F.min("place").alias("place"), F.collect_set("place").alias("places")))
    declared = signatures.select(_place(F.col("rel"), F.col("pos")).alias("place"), "type")
    constants = members.select(F.concat(F.lit("c|"), "inst").alias("what"), "type").join(least.select("what", "place"), "what").select("place", "type").distinct()
    tied = F.when(F.col("what").startswith("p|"), F.array_append("places", F.col("what"))).otherwise(F.col("places"))
    spread = least.select("place", F.explode(tied).alias("b")).distinct()
    reps = cut(connected(spread.select(F.col("place").alias("a"), "b")))
    places = least.select(F.explode("places").alias("place")).union(told.select("place")).union(declared.select("place")).distinct()
    rep = lambda df: df.join(reps.withColumnRenamed("id", "place"), "place", "left").withColumn("class", F.coalesce("rep", "place")).drop("rep")
    types = common(rep(told.union(declared).union(constants)).select("class", "type"), up)
    out = rep(places).join(types, "class", "left")
    return out.select(F.regexp_extract("place", r"^p\|(.*)\|[0-9]+$", 1).alias("rel"), F.regexp_extract("place", r"\|([0-9]+)$", 1).try_cast("int").alias("pos"), F.coalesce("type", F.lit(TOP)).alias("type"))


def declarations(types: DataFrame) -> DataFrame:
    """(value): a THF type declaration for each relation of (rel, pos, type): individuals are $i, formulas $o; a relation's value is $o, a
    function's that of pos 0. A name that isn't a plain word stands in quotes."""
    sort = F.when(F.col("type") == FORMULA, FORMULA).otherwise("$i")
    got = types.groupBy("rel").agg(F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", sort.alias("s"))))).alias("args"), F.max(F.when(F.col("pos") == 0, sort)).alias("value"))
    name = F.when(F.col("rel").rlike("^[a-z][A-Za-z0-9_]*$"), F.col("rel")).otherwise(F.concat(F.lit("'"), F.regexp_replace("rel", r"([\\'])", r"\\$1"), F.lit("'")))
    arrow = F.array_join(F.concat(F.transform("args", lambda a: a["s"]), F.array(F.coalesce("value", F.lit(FORMULA)))), " > ")
    return got.select(F.concat(F.lit("thf("), name, F.lit(",type,("), name, F.lit(": ("), arrow, F.lit("))).")).alias("value"))
