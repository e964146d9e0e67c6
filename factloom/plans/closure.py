"""Recursive plans over edge tables: semi-naive closure, reachability and bounded neighbourhoods.

Each round joins only the rows that the round before has added, drops known ones by an anti join, and is written once to
the folder in spark.checkpoint.dir, so that plans don't grow and a lost executor costs one round. Cycles end by
themselves; a term is its own ancestor only within a cycle.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = context.getConf().get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.select(*(F.col(c).alias(c) for c in df.columns)).checkpoint()  # new attributes, for later unions


#: Rows up to which a side is broadcast.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, which are counted; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Grown:
    """A table that grows by rounds. Each round's rows are written once, and read back with those before in one scan,
    so that what is written is as much as the rows, whatever the number of rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rounds, self.schema = spark, [], None
        self.path = f"{folder(spark)}/grown-{uuid.uuid4().hex}"
        _made.append((spark, self.path))

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round's rows; they as a table."""
        self.schema = self.schema or df.schema
        at = f"{self.path}/{len(self.rounds)}"
        df.write.parquet(at)
        self.rounds.append(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.rounds)


@atexit.register
def drop() -> None:
    """Remove the grown tables of this process."""
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with the cluster's own clean-up
            return


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df and number (int), from 1 in the order of these columns: range partitions, each counted, and the sum of the
    counts before it. No task holds more than its range, and the driver one count a partition."""
    placed = cut(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.p):
        before[r.p] = total
        total += r.n
    starts = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__p long, __start long")
    out = placed.withColumn("__p", part).join(F.broadcast(starts), "__p")  # one row a partition
    return out.withColumn("number", (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).select(*df.columns, "number")


def closure(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All (keys, child, parent) pairs joined by one edge or more; keys (such as the relation) keep closures apart."""
    cols = [*keys, "child", "parent"]
    known = Grown(edges.sparkSession)
    delta = known.add(edges.select(*cols).filter("child IS NOT NULL AND parent IS NOT NULL").distinct())
    step = known.all().select(*keys, F.col("child").alias("parent"), F.col("parent").alias("__next"))
    while not delta.isEmpty():
        reached = delta.join(step, [*keys, "parent"]).select(*keys, "child", F.col("__next").alias("parent")).distinct()
        delta = known.add(reached.join(known.all(), cols, "left_anti"))
    return known.all()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(term, depth): terms on a path from a seed (column term) along child -> parent, seeds at depth 0."""
    known = Grown(seeds.sparkSession)
    delta = known.add(seeds.select("term").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while not delta.isEmpty() and (depth is None or level < depth):
        level += 1
        found = delta.join(edges, F.col("term") == F.col("child")).select(F.col("parent").alias("term")).distinct()
        delta = known.add(found.join(known.all(), "term", "left_anti").withColumn("depth", F.lit(level)))
    return known.all()


def frontier(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All terms (column term) below the seeds along parent -> child, seeds included."""
    return reachable(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), seeds).select("term")


def connected_order(body: list[tuple], bound: set[str] | None = None) -> list[tuple]:
    """The body's atoms so that each shares a variable with those before it, where any does; else as they stand."""
    left, out, known = list(body), [], set(bound or ())
    while left:
        at = next((i for i, (_, *args) in enumerate(left) if not known or known & set(args) or not any(a.startswith("?") for a in args)), 0)
        out.append(left.pop(at))
        known |= {a for a in out[-1][1:] if a.startswith("?")}
    return out


def _atom(source: DataFrame, atom: tuple) -> DataFrame:
    """The bindings of one atom, a column a variable."""
    rel, *args = atom
    out = source.filter(F.col("rel") == rel)
    for k, a in enumerate(args):
        if not a.startswith("?"):
            out = out.filter(F.col(f"a{k + 1}") == a)
    if args[0] == args[1]:
        out = out.filter("a1 = a2")
    return out.select(*(F.col(f"a{k + 1}").alias(a) for k, a in enumerate(args) if a.startswith("?") and a not in args[:k]))


def consequences(rules: list[dict], known: DataFrame, delta: DataFrame, all_new: bool = False) -> DataFrame | None:
    """(rel, a1, a2) that the rules derive with at least one atom from delta. The new atom comes first, then those that
    share a variable, so that only rules whose bodies fall into parts without a common variable multiply. all_new: known
    is delta, so what holds for one atom holds for each, and only a rule's first one is taken."""
    made = None
    used = {atom[0] for rule in rules for atom in rule["body"]}
    changed = {r["rel"] for r in delta.filter(F.col("rel").isin(*used)).select("rel").distinct().collect()}  # relations of the program, not rows
    for rule in rules:
        for new in range(1 if all_new else len(rule["body"])):
            if rule["body"][new][0] not in changed:
                continue
            rest = connected_order([b for i, b in enumerate(rule["body"]) if i != new], {a for a in rule["body"][new][1:] if a.startswith("?")})
            row = _atom(delta, rule["body"][new])
            for atom in rest:
                got = _atom(known, atom)
                both = [c for c in row.columns if c in got.columns]
                row = row.join(got, both) if both else row.join(got)
            rel, x, y = rule["head"]
            term = lambda a: F.col(f"`{a}`") if a.startswith("?") else F.lit(a)
            out = row.select(F.lit(rel).alias("rel"), term(x).alias("a1"), term(y).alias("a2"))
            made = out if made is None else made.unionByName(out)
    return made


def evaluate(facts: DataFrame, rules: list[dict], spark: SparkSession | None = None) -> DataFrame:
    """Least model of Horn rules over binary facts (rel, a1, a2), bottom up, semi-naive.

    A rule is {"head": (rel, x, y), "body": [(rel, x, y), ...]}; an argument that starts with "?" is a variable, any
    other a constant. In each round one body atom ranges over the new facts, the others over all.
    """
    known = Grown(facts.sparkSession)
    delta = known.add(facts.select("rel", "a1", "a2").distinct())
    while not delta.isEmpty() and (made := consequences(rules, known.all(), delta, len(known.rounds) == 1)) is not None:
        delta = known.add(made.distinct().join(known.all(), ["rel", "a1", "a2"], "left_anti"))
    return known.all()


def simplest_first_proof(steps: DataFrame, goal: int) -> DataFrame:
    """The steps (step, premises: array<int>) that the goal rests on, renumbered from 1 in their order."""
    edges = steps.select(F.col("step").alias("child"), F.explode("premises").alias("parent"))
    seeds = steps.filter(F.col("step") == goal).select(F.col("step").alias("term"))
    used = reachable(edges, seeds).select(F.col("term").alias("step"))
    return numbered(steps.join(used, "step", "left_semi"), "step")
