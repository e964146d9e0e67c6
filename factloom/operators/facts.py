"""Facts: one row a ground atom, rel and up to four arguments, with the source that holds it.

`warehouse` reads the star schema as such facts. It is a union of projections with literal relations, so a filter on
rel folds all other branches away and reaches the Parquet scans of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARGS = ("a1", "a2", "a3", "a4")


def _fact(df: DataFrame, rel: str, src: str, *args: Column) -> DataFrame:
    cells = [a.cast("string") for a in args] + [F.lit(None).cast("string")] * (4 - len(args))
    return df.select(F.lit(rel).alias("rel"), *(c.alias(n) for c, n in zip(cells, ARGS, strict=True)), F.lit(src).alias("src"))


def _key(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, lit = F.col, F.lit
    region, nation = t("region"), t("nation")
    named = nation.join(region, c("n_regionkey") == c("r_regionkey"))
    homes = nation.select("n_nationkey", "n_name")
    people = t("customer").join(F.broadcast(homes), c("c_nationkey") == c("n_nationkey"))
    suppliers = t("supplier").join(F.broadcast(homes), c("s_nationkey") == c("n_nationkey"))
    one = spark.range(1)
    parts = [
        _fact(one, "subclass", "top", lit("Region"), lit("Entity")),
        _fact(one, "subclass", "top", lit("PartType"), lit("Entity")),
        _fact(one, "subrelation", "top", lit("soldBy"), lit("involves")),
        _fact(one, "subrelation", "top", lit("orderedBy"), lit("involves")),
        _fact(region, "subclass", "region", c("r_name"), lit("Region")),
        _fact(named, "subclass", "nation", c("n_name"), c("r_name")),
        _fact(people, "instance", "customer", _key("C", "c_custkey"), c("n_name")),
        _fact(suppliers, "instance", "supplier", _key("S", "s_suppkey"), c("n_name")),
        _fact(t("part").select("p_type").distinct(), "subclass", "part", c("p_type"), lit("PartType")),
        _fact(t("part"), "instance", "part", _key("P", "p_partkey"), c("p_type")),
        _fact(t("part"), "brand", "part", _key("P", "p_partkey"), c("p_brand")),
        _fact(t("orders"), "orderedBy", "orders", _key("O", "o_orderkey"), _key("C", "o_custkey")),
        _fact(t("lineitem"), "contains", "lineitem", _key("O", "l_orderkey"), _key("P", "l_partkey"), _key("S", "l_suppkey"), c("l_linenumber")),
        _fact(t("lineitem"), "soldBy", "lineitem", _key("P", "l_partkey"), _key("S", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: DuckDB SQL for the same facts.
SQL = """facts AS (
SELECT 'subclass' AS rel, 'Region' AS a1, 'Entity' AS a2, NULL::VARCHAR AS a3, NULL::VARCHAR AS a4, 'top' AS src
UNION ALL SELECT 'subclass', 'PartType', 'Entity', NULL, NULL, 'top'
UNION ALL SELECT 'subrelation', 'soldBy', 'involves', NULL, NULL, 'top'
UNION ALL SELECT 'subrelation', 'orderedBy', 'involves', NULL, NULL, 'top'
UNION ALL SELECT 'subclass', r_name, 'Region', NULL, NULL, 'region' FROM region
UNION ALL SELECT 'subclass', n_name, r_name, NULL, NULL, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'instance', 'C' || c_custkey, n_name, NULL, NULL, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'instance', 'S' || s_suppkey, n_name, NULL, NULL, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'subclass', p_type, 'PartType', NULL, NULL, 'part' FROM part
UNION ALL SELECT 'instance', 'P' || p_partkey, p_type, NULL, NULL, 'part' FROM part
UNION ALL SELECT 'brand', 'P' || p_partkey, p_brand, NULL, NULL, 'part' FROM part
UNION ALL SELECT 'orderedBy', 'O' || o_orderkey, 'C' || o_custkey, NULL, NULL, 'orders' FROM orders
UNION ALL SELECT 'contains', 'O' || l_orderkey, 'P' || l_partkey, 'S' || l_suppkey, l_linenumber::VARCHAR, 'lineitem' FROM lineitem
UNION ALL SELECT 'soldBy', 'P' || l_partkey, 'S' || l_suppkey, NULL, NULL, 'lineitem' FROM lineitem)"""


def arity() -> Column:
    return sum((F.col(a).isNotNull().cast("int") for a in ARGS), F.lit(0))


def mentions(facts: DataFrame) -> DataFrame:
    """(term, pos, rel, src, a1..a4): a row for each argument; numbers aren't terms."""
    at = F.posexplode(F.array(*ARGS)).alias("p", "term")
    return facts.select("rel", "src", *ARGS, at).select("term", (F.col("p") + 1).alias("pos"), "rel", "src", *ARGS).filter("term IS NOT NULL AND NOT term RLIKE '^[+-]?[0-9]'")


def terms(facts: DataFrame) -> DataFrame:
    """The distinct terms: arguments and relations."""
    return mentions(facts).select("term").union(facts.select("rel")).distinct()
