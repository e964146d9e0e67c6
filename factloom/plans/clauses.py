"""Clauses as tables of literals: subsumption, its graph, and deletion of what can't take part in a refutation.

literals: (clause, neg, pred, args: array<string>), one row a literal; arguments that start with "?" are variables. A
clause is a set of literals and fits one row; the number of clauses is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import Grown, cut, small

_IS_VARIABLE = "startswith(a, '?')"


def indexed(literals: DataFrame) -> DataFrame:
    """(clause, lits, n, vars): a row a clause. Literals with few variables come first."""
    lit = F.struct(F.size(F.expr(f"filter(args, a -> {_IS_VARIABLE})")).alias("v"), "neg", "pred", "args")
    rows = literals.groupBy("clause").agg(F.array_sort(F.collect_set(lit)).alias("lits"))
    variables = F.expr(f"array_distinct(filter(flatten(transform(lits, l -> l.args)), a -> {_IS_VARIABLE}))")
    return rows.select("clause", "lits", F.size("lits").alias("n"), variables.alias("vars"))


def _featured(clauses: DataFrame) -> DataFrame:
    """clauses with features: array<(kind, f)>, low, high. Features are hashes of each literal's sign, predicate and arity (each a kind of its own), and of each
    constant at its place (the place is the kind). low, high: a bit for each feature. Literals are hashed once, and a clause's features are made once."""
    constants = "transform(filter(transform(l.args, (a, i) -> struct(a, i)), x -> NOT startswith(x.a, '?')), x -> named_struct('kind', xxhash64(l.own, x.i), 'f', xxhash64(l.own, x.i, x.a)))"
    hashed = F.expr("transform(lits, l -> struct(l.args AS args, xxhash64(l.neg, l.pred, size(l.args)) AS own))").alias("hashed")
    features = F.expr(f"array_distinct(flatten(transform(hashed, l -> concat(array(named_struct('kind', l.own, 'f', l.own)), {constants}))))").alias("features")
    bits = lambda k: F.expr(f"aggregate(features, 0L, (s, x) -> s | shiftleft(1L, CAST(x.f >> {k} & 63 AS INT)))")
    return clauses.select("*", hashed).select(*clauses.columns, features).select("*", bits(0).alias("low"), bits(6).alias("high"))


def _features(clauses: DataFrame) -> DataFrame:
    """(clause, n, low, high, kind, f): a row a feature of a clause."""
    featured = clauses if "features" in clauses.columns else _featured(clauses)
    return featured.select("clause", "n", "low", "high", F.inline("features"))


#: Kinds of features up to which each clause chooses among its own in its row, by a list in the plan.
KINDS = 64


def candidates(clauses: DataFrame) -> DataFrame:
    """(general, special): pairs that the index can't rule out. What subsumes has its features in what it subsumes, and is no
    longer; so each clause only meets those that have one of its features, of the kind that tells clauses best apart."""
    spark = clauses.sparkSession
    if "features" not in clauses.columns:
        clauses = Grown(spark).add(_featured(clauses))
    posted = _features(clauses)
    kinds = Grown(spark).add(posted.groupBy("kind").agg((F.count("*") / F.approx_count_distinct("f")).alias("df")))
    few = sorted(kinds.limit(KINDS + 1).collect(), key=lambda r: (r.df, r.kind))
    own = F.col("clause").alias("general"), F.col("n").alias("gn"), F.col("low").alias("glow"), F.col("high").alias("ghigh")
    if 0 < len(few) <= KINDS:
        rank = F.create_map(*(F.lit(x) for i, r in enumerate(few) for x in (r.kind, i)))
        best = F.array_min(F.transform("features", lambda x: F.struct(rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["f"].alias("f"))))
        asked = clauses.select(*own, best.alias("best"))
    else:
        asked = posted.join(small(kinds), "kind").groupBy(*own).agg(F.min(F.struct("df", "kind", "f")).alias("best"))
    asked = Grown(spark).add(asked.select("general", "gn", "glow", "ghigh", F.col("best.kind").alias("kind"), F.col("best.f").alias("f")))
    asked_of = posted.join(small(asked.select("kind").distinct()), "kind", "left_semi")
    return asked.drop("kind").join(asked_of, "f").filter("general <> clause AND gn <= n AND glow & ~low = 0 AND ghigh & ~high = 0").select("general", F.col("clause").alias("special"))


def subsumptions(literals: DataFrame) -> DataFrame:
    """(general, special): a substitution makes general a subset of special, and general isn't longer. Variables of special are
    constants for it. Clauses that are equal up to names subsume each other; none is paired with itself.

    Bindings are rows: round k joins each pair's open bindings with the literals of special that have the sign and
    predicate of general's k-th literal, keeps what agrees, forgets variables that don't occur any more, and drops what is then equal.
    """
    spark = literals.sparkSession
    clauses = Grown(spark).add(_featured(indexed(literals)))
    last = "transform(vars, v -> array_max(transform(lits, (l, i) -> IF(array_contains(l.args, v), i, -1))))"
    pattern = F.expr("transform(l.args, a -> struct(IF(startswith(a, '?'), array_position(vars, a) - 1, NULL) AS var, a AS const))")
    pairs = Grown(spark).add(candidates(clauses))
    generals = clauses.select(F.col("clause").alias("general"), "n", "vars", "lits").join(small(pairs.select("general").distinct()), "general", "left_semi")
    generals = generals.select("general", "n", "vars", F.expr(last).alias("last"), F.posexplode("lits").alias("k", "l"))
    generals = Grown(spark).add(generals.select("general", "n", "k", "l.neg", "l.pred", F.size("l.args").alias("size"), pattern.alias("pattern"), "last", F.size("vars").alias("nv")))
    specials = clauses.select(F.col("clause").alias("special"), F.explode("lits").alias("l")).select("special", "l.neg", "l.pred", F.size("l.args").alias("size"), "l.args")
    agrees = """IF(size = 0, bound, aggregate(sequence(0, size - 1), bound, (b, i) -> CASE
        WHEN b IS NULL THEN NULL
        WHEN pattern[i].var IS NULL THEN IF(pattern[i].const = args[i], b, NULL)
        WHEN b[pattern[i].var] IS NULL THEN transform(b, (x, j) -> IF(j = pattern[i].var, args[i], x))
        WHEN b[pattern[i].var] = args[i] THEN b END))"""
    found = Grown(spark)
    nothing = F.expr("IF(nv = 0, CAST(array() AS ARRAY<STRING>), array_repeat(CAST(NULL AS STRING), nv))")
    open_, k = pairs, 0
    while not open_.isEmpty():
        asking = generals.filter(F.col("k") == k)
        step = open_.join(asking, "general").join(specials.join(small(asking.select("neg", "pred", "size").distinct()), ["neg", "pred", "size"], "left_semi"), ["special", "neg", "pred", "size"])
        step = step if k else step.withColumn("bound", nothing)
        step = step.withColumn("bound", F.expr(agrees)).filter("bound IS NOT NULL")
        step = step.withColumn("bound", F.expr("transform(bound, (x, j) -> IF(last[j] <= k, NULL, x))"))
        step = Grown(spark).add(step.select("general", "special", "bound", (F.col("n") == k + 1).alias("done")).distinct())
        found.add(step.filter("done").select("general", "special"))  # with no variable left to bind, a pair has one row
        open_, k = step.filter("NOT done").drop("done"), k + 1
    return found.all() if found.rounds else open_.select("general", "special")


def subsumption_graph(pairs: DataFrame) -> DataFrame:
    """(general, special): the subsumptions that don't follow from two others. Clauses that subsume each other are one node, named by the
    smallest."""
    spark = pairs.sparkSession
    first = F.col("general") < F.col("special")
    both = pairs.filter("general <> special").groupBy(F.least("general", "special").alias("lo"), F.greatest("general", "special").alias("hi")).agg(F.max(first).alias("down"), F.max(~first).alias("up"))
    both = Grown(spark).add(both)
    directed = F.explode(F.expr("filter(array(IF(down, struct(lo AS general, hi AS special), NULL), IF(up, struct(hi AS general, lo AS special), NULL)), x -> x IS NOT NULL)")).alias("x")
    name = both.filter("down AND up").select(F.explode(F.expr("array(struct(lo AS id, hi AS other), struct(hi AS id, lo AS other))")).alias("x")).groupBy("x.id").agg(F.min("x.other").alias("least"))
    name = Grown(spark).add(name.select("id", F.least("id", "least").alias("least")))
    if name.isEmpty():
        strict = both.select(F.when(F.col("down"), F.col("lo")).otherwise(F.col("hi")).alias("general"), F.when(F.col("down"), F.col("hi")).otherwise(F.col("lo")).alias("special"))
    else:
        named = both.select(directed).select("x.*")
        for side in ("general", "special"):
            named = named.join(small(name.withColumnRenamed("id", side)), side, "left").withColumn(side, F.coalesce("least", side)).drop("least")
        strict = Grown(spark).add(named.select("general", "special").filter("general <> special").distinct())
    by = strict.select(F.col("general").alias("mid"), "special").join(strict.select("general", F.col("special").alias("mid")), "mid").select("general", "special").distinct()
    return strict.join(by, ["general", "special"], "left_anti")


def without_pure(literals: DataFrame, protected: tuple[str, ...] = ("equal",)) -> DataFrame:
    """(clause, round): the clauses that go since a literal's predicate occurs with one sign only among those that are left, by round.

    Each round looks only at predicates whose counts the round before has changed, and reads the literals of those.
    """
    literals = Grown(literals.sparkSession).add(literals.select("clause", "pred", "neg"))  # read twice a round
    counts, gone = Grown(literals.sparkSession), Grown(literals.sparkSession)
    signs = [F.sum(F.when(F.col("neg"), 0).otherwise(1)).alias("pos"), F.sum(F.when(F.col("neg"), 1).otherwise(0)).alias("negs")]
    changed = counts.add(literals.groupBy("pred").agg(*signs))
    level = 0
    while True:
        level += 1
        now = counts.all().join(changed.select("pred"), "pred", "left_semi").groupBy("pred").agg(F.sum("pos").alias("pos"), F.sum("negs").alias("negs"))
        pure = now.filter("(pos = 0) <> (negs = 0)").filter(~F.col("pred").isin(*protected)).select("pred")
        hit = literals.join(pure, "pred", "left_semi").select("clause").distinct()
        if level > 1:
            hit = hit.join(gone.all(), "clause", "left_anti")
        new = gone.add(hit.withColumn("round", F.lit(level)))
        if new.isEmpty():
            return gone.all()
        changed = counts.add(literals.join(new, "clause", "left_semi").groupBy("pred").agg(*signs).select("pred", (-F.col("pos")).alias("pos"), (-F.col("negs")).alias("negs")))


def unused_definitions(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """(clause, round): definitions (clause, pred) of predicates that nothing else which is left uses (uses: clause, pred), by round. A definition's
    use of its own predicate doesn't count; of several definitions of one predicate, each counts as a use for the others."""
    own = definitions.select("clause", "pred").distinct()
    others = uses.select("clause", "pred").distinct().join(own, ["clause", "pred"], "left_anti")
    several = own.groupBy("pred").count().filter("count > 1")
    others = cut(others.unionByName(own.join(several, "pred", "left_semi").select(F.col("clause"), "pred")))
    counts, gone = Grown(uses.sparkSession), Grown(uses.sparkSession)
    counts.add(others.groupBy("pred").agg(F.count("*").alias("n")))
    unused = own.join(others, "pred", "left_anti").select("clause")
    level = 0
    while True:
        level += 1
        new = gone.add(unused.withColumn("round", F.lit(level)))
        if new.isEmpty():
            return gone.all()
        changed = counts.add(others.join(new, "clause", "left_semi").groupBy("pred").agg((-F.count("*")).alias("n")))
        free = counts.all().join(changed.select("pred"), "pred", "left_semi").groupBy("pred").agg(F.sum("n").alias("n")).filter("n = 0").select("pred")
        unused = own.join(free, "pred", "left_semi").select("clause").join(gone.all(), "clause", "left_anti")
