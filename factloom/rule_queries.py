"""Queries over rules, clauses, ground equations, composites and phrases, with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import argument_types, composites, consistency, dates, hierarchies, phrases, taxonomy
from factloom.operators import predicate_variables as pv
from factloom.operators.facts import warehouse
from factloom.plans import clauses, closure, congruence, magic
from factloom.queries import ORACLE, QUERIES, _t, query
from factloom.sources import kif, owl

__all__ = ["ORACLE", "QUERIES"]


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- clauses -------------------------------------------------------------------------------------------------------


def _rules(spark, d) -> DataFrame:
    """Literals of a ground rule an order, a rule a customer on completed orders, a rule a nation on urgent orders, and one on all."""

    def rule(df: DataFrame, clause, *literals) -> DataFrame:
        """A clause a row; its literals (neg, pred, *args) come from one reading of the table."""
        as_column = lambda a: F.lit(a) if isinstance(a, str) else a
        made = [F.struct(F.lit(neg).alias("neg"), F.lit(pred).alias("pred"), F.array(*map(as_column, args)).alias("args")) for neg, pred, *args in literals]
        return df.select(as_column(clause).alias("clause"), F.inline(F.array(*made)))

    people = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = _t(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    o, c, n = _key("O", "o_orderkey"), _key("C", "c_custkey"), F.col("n_name")
    return _all([
        rule(orders, o, (True, "orderedBy", o, c), (True, "status", o, F.col("o_orderstatus")), (True, "priority", o, F.col("o_orderpriority")), (True, "from", c, n), (False, "handled", o)),
        rule(people, c, (True, "orderedBy", "?O", c), (True, "status", "?O", "F")),
        rule(_t(spark, d, "nation"), n, (True, "orderedBy", "?O", "?C"), (True, "from", "?C", n), (True, "priority", "?O", "1-URGENT")),
        rule(spark.range(1), "any", (True, "orderedBy", "?A", "?B")),
    ])


_RULE_PAIRS = """ids AS (SELECT 'O' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name FROM nation),
pairs AS (SELECT 'any' AS general, id AS special FROM ids UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
UNION ALL SELECT n_name, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT')"""


@query(f"WITH {_RULE_PAIRS} SELECT general, special FROM pairs", facts=False)
def subsumed_rules(spark, d):
    return clauses.subsumptions(_rules(spark, d))


@query(f"WITH {_RULE_PAIRS} SELECT general, special FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs x JOIN pairs y ON x.special = y.general WHERE x.general = p.general AND y.special = p.special)", facts=False)
def subsumption_graph(spark, d):
    return clauses.subsumption_graph(clauses.subsumptions(_rules(spark, d)))


def _chains(spark, d) -> DataFrame:
    """(clause, pred, neg): suppliers follow from nations, parts from suppliers, brands from parts, and goals from some brands."""

    def implies(df: DataFrame, name: str, body, head) -> DataFrame:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        sides = [F.struct(as_column(x).alias("pred"), F.lit(neg).alias("neg")) for x, neg in ((body, True), (head, False)) if x is not None]
        return df.select(F.concat(F.lit(name), *(F.col(c).cast("string") if i == 0 else F.concat(F.lit("_"), F.col(c).cast("string")) for i, c in enumerate(df.columns[:2]))).alias("clause"), F.explode(F.array(*sides)).alias("s")).select("clause", "s.*")

    sold = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    one = spark.range(1).select(F.col("id").alias("x"))
    return _all([
        implies(sold, "l", _key("s", "l_suppkey"), _key("p", "l_partkey")), implies(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s", _key("n", "s_nationkey"), _key("s", "s_suppkey")),
        implies(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c", _key("n", "c_nationkey"), _key("c", "c_custkey")), implies(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n", _key("r", "n_regionkey"), _key("n", "n_nationkey")),
        implies(_t(spark, d, "region").filter("r_regionkey > 0").select("r_regionkey", "r_regionkey"), "r", "world", _key("r", "r_regionkey")), implies(one, "world", None, "world"),
        implies(_t(spark, d, "part").select("p_partkey", "p_brand"), "p", _key("p", "p_partkey"), F.col("p_brand")), implies(_t(spark, d, "part").filter("p_brand LIKE '%1_'").select("p_brand", "p_brand").distinct(), "b", F.col("p_brand"), "goal"), implies(one, "goal", "goal", None),
    ])


_ROUNDS = 12
_CHAINS = """l0 AS MATERIALIZED (
SELECT 'l' || l_partkey || '_' || l_suppkey AS clause, unnest(['s' || l_suppkey, 'p' || l_partkey]) AS pred, unnest([true, false]) AS neg FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 's' || s_suppkey || '_' || s_nationkey, unnest(['n' || s_nationkey, 's' || s_suppkey]), unnest([true, false]) FROM supplier
UNION ALL SELECT 'c' || c_custkey || '_' || c_nationkey, unnest(['n' || c_nationkey, 'c' || c_custkey]), unnest([true, false]) FROM customer
UNION ALL SELECT 'n' || n_nationkey || '_' || n_regionkey, unnest(['r' || n_regionkey, 'n' || n_nationkey]), unnest([true, false]) FROM nation
UNION ALL SELECT 'r' || r_regionkey || '_' || r_regionkey, unnest(['world', 'r' || r_regionkey]), unnest([true, false]) FROM region WHERE r_regionkey > 0
UNION ALL SELECT 'world0', 'world', false
UNION ALL SELECT 'p' || p_partkey || '_' || p_brand, unnest(['p' || p_partkey, p_brand]), unnest([true, false]) FROM part
UNION ALL SELECT 'b' || p_brand || '_' || p_brand, unnest([p_brand, 'goal']), unnest([true, false]) FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1_')
UNION ALL SELECT 'goal0', 'goal', true)""" + "".join(
    f""",
g{k} AS MATERIALIZED (SELECT DISTINCT clause FROM l{k - 1} WHERE pred IN (SELECT pred FROM l{k - 1} GROUP BY pred HAVING bool_and(neg) OR bool_and(NOT neg))),
l{k} AS MATERIALIZED (SELECT * FROM l{k - 1} WHERE clause NOT IN (SELECT clause FROM g{k}))"""
    for k in range(1, _ROUNDS + 1)
)


@query(f"WITH {_CHAINS} " + " UNION ALL ".join(f"SELECT clause, {k}::INT AS round FROM g{k}" for k in range(1, _ROUNDS + 1)), facts=False)
def pure_clauses(spark, d):
    """The SQL unrolls more rounds than there are."""
    return clauses.without_pure(_chains(spark, d))


@query("""WITH RECURSIVE defs AS (SELECT 'd' || p_partkey AS clause, 'P' || p_partkey AS pred, p_size, p_partkey FROM part),
uses AS (SELECT 'd' || p_partkey AS clause, 'P' || (p_partkey // 2) AS pred FROM part WHERE p_partkey > 0 UNION SELECT 'q' || l_orderkey, 'P' || l_partkey FROM lineitem WHERE l_quantity > 49.5),
needed AS (SELECT pred FROM uses WHERE clause LIKE 'q%' UNION SELECT u.pred FROM needed n JOIN defs ON defs.pred = n.pred JOIN uses u ON u.clause = defs.clause),
up AS (SELECT clause, pred AS at_, 0 AS h FROM defs WHERE pred NOT IN (SELECT pred FROM needed) UNION ALL SELECT up.clause, 'P' || c.k, h + 1 FROM up JOIN (SELECT p_partkey AS k FROM part) c ON c.k > 0 AND 'P' || (c.k // 2) = up.at_)
SELECT clause, max(h + 1)::INT AS round FROM up GROUP BY clause""", facts=False)
def unused_definitions(spark, d):
    """Part k is defined by part k / 2, and lines of large quantity use their part. A definition goes in the round that its longest chain of users ends."""
    part = _t(spark, d, "part")
    definitions = part.select(_key("d", "p_partkey").alias("clause"), _key("P", "p_partkey").alias("pred"))
    by = part.filter("p_partkey > 0").select(_key("d", "p_partkey").alias("clause"), F.concat(F.lit("P"), F.expr("(p_partkey div 2)").cast("string")).alias("pred"))
    goals = _t(spark, d, "lineitem").filter("l_quantity > 49.5").select(_key("q", "l_orderkey").alias("clause"), _key("P", "l_partkey").alias("pred"))
    return clauses.unused_definitions(by.unionByName(goals), definitions)


# --- equations -----------------------------------------------------------------------------------------------------


def _nested(spark, d) -> tuple[DataFrame, DataFrame]:
    """Terms home(x), in(home(x)) and tag(in(home(x))) of customers and suppliers, and equations: homes are nations, in(nation) is its region, and
    every tenth supplier is the customer of the same number."""
    who = _all([_t(spark, d, t).select(_key(k.upper(), f"{k}_{t[:4]}key" if t == "supplier" else f"{k}_custkey").alias("x"), F.col(f"{k}_nationkey").alias("k")) for k, t in (("c", "customer"), ("s", "supplier"))])
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    home = lambda x: F.concat(F.lit("home("), x, F.lit(")"))
    apply = lambda df, fn, arg: df.select(F.concat(F.lit(f"{fn}("), arg, F.lit(")")).alias("term"), F.lit(fn).alias("fn"), F.array(arg).alias("args"))
    x, inside = F.col("x"), F.concat(F.lit("in("), home(F.col("x")), F.lit(")"))
    terms = _all([apply(who, "home", x), apply(who, "in", home(x)), apply(who, "tag", inside), apply(nation, "in", F.col("n_name")), apply(_t(spark, d, "region"), "tag", F.col("r_name"))])
    alias = _t(spark, d, "supplier").filter("s_suppkey % 10 = 0").join(_t(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    equations = _all([
        who.join(nation, F.col("k") == F.col("n_nationkey")).select(home(x).alias("a"), F.col("n_name").alias("b")),
        nation.select(F.concat(F.lit("in("), "n_name", F.lit(")")).alias("a"), F.col("r_name").alias("b")), alias.select(_key("S", "s_suppkey").alias("a"), _key("C", "c_custkey").alias("b")),
    ])
    return terms, equations


_CONGRUENT = """WITH RECURSIVE who AS (SELECT 'C' || c_custkey AS x, c_nationkey AS k, CASE WHEN c_custkey % 10 = 0 THEN c_custkey END AS alias FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey END FROM supplier),
nl AS (SELECT DISTINCT a.k AS x, b.k AS y FROM who a JOIN who b USING (alias)), nr AS (SELECT n_nationkey AS n, n_nationkey AS m FROM nation UNION SELECT nr.n, nl.y FROM nr JOIN nl ON nl.x = nr.m), nc AS (SELECT n, min(m) AS class FROM nr GROUP BY n),
rl AS (SELECT DISTINCT a.n_regionkey AS x, b.n_regionkey AS y FROM nation a JOIN nc p ON p.n = a.n_nationkey JOIN nc q USING (class) JOIN nation b ON b.n_nationkey = q.n),
rr AS (SELECT r_regionkey AS n, r_regionkey AS m FROM region UNION SELECT rr.n, rl.y FROM rr JOIN rl ON rl.x = rr.m), rc AS (SELECT n, min(m) AS class FROM rr GROUP BY n),
places AS (SELECT n_nationkey AS k, nc.class AS nclass, rc.class AS rclass FROM nation JOIN nc ON nc.n = n_nationkey JOIN rc ON rc.n = n_regionkey),
named AS (SELECT x AS term, coalesce('alias' || CASE WHEN count(*) OVER (PARTITION BY alias) > 1 THEN alias END, x) AS class FROM who
UNION ALL SELECT 'home(' || x || ')', 'n' || nclass FROM who JOIN places USING (k) UNION ALL SELECT n_name, 'n' || nclass FROM nation JOIN places ON k = n_nationkey
UNION ALL SELECT 'in(home(' || x || '))', 'r' || rclass FROM who JOIN places USING (k) UNION ALL SELECT 'in(' || n_name || ')', 'r' || rclass FROM nation JOIN places ON k = n_nationkey UNION ALL SELECT r_name, 'r' || rc.class FROM region JOIN rc ON rc.n = r_regionkey
UNION ALL SELECT 'tag(in(home(' || x || ')))', 't' || rclass FROM who JOIN places USING (k) UNION ALL SELECT 'tag(' || r_name || ')', 't' || rc.class FROM region JOIN rc ON rc.n = r_regionkey),
reps AS (SELECT term, min(term) OVER (PARTITION BY class) AS rep FROM named)"""


@query(_CONGRUENT + " SELECT term, rep FROM reps", facts=False)
def congruent_terms(spark, d):
    return congruence.classes(*_nested(spark, d))


@query(_CONGRUENT + " SELECT c_custkey, r.rep AS home, t.rep AS tag FROM customer JOIN reps r ON r.term = 'home(C' || c_custkey || ')' JOIN reps t ON t.term = 'tag(in(home(C' || c_custkey || ')))'", facts=False)
def normal_forms(spark, d):
    home = F.concat(F.lit("home(C"), F.col("c_custkey").cast("string"), F.lit(")"))
    stated = _t(spark, d, "customer").select("c_custkey", home.alias("home"), F.concat(F.lit("tag(in("), home, F.lit("))")).alias("tag"))
    return congruence.rewritten(stated, congruence.classes(*_nested(spark, d)), "home", "tag")


# --- goals ---------------------------------------------------------------------------------------------------------

_GOAL_RULES = [
    {"head": ("under", "?x", "?y"), "body": [("instance", "?x", "?y")]},
    {"head": ("under", "?x", "?y"), "body": [("subclass", "?x", "?y")]},
    {"head": ("under", "?x", "?z"), "body": [("under", "?x", "?y"), ("subclass", "?y", "?z")]},
    {"head": ("reaches", "?o", "?c"), "body": [("orderedBy", "?o", "?p"), ("under", "?p", "?c")]},
    {"head": ("reaches", "?o", "?c"), "body": [("soldBy", "?o", "?s"), ("under", "?s", "?c")]},
]


@query("""up AS (SELECT a1, a2 FROM facts WHERE rel IN ('instance', 'subclass') AND a1 IN (SELECT a2 FROM facts WHERE rel IN ('orderedBy', 'soldBy') AND a1 IN ('O7', 'P7')) UNION SELECT up.a1, f.a2 FROM up JOIN facts f ON f.rel = 'subclass' AND f.a1 = up.a2)
SELECT DISTINCT f.a1 AS "from", up.a2 AS "to" FROM facts f JOIN up ON up.a1 = f.a2 WHERE f.rel IN ('orderedBy', 'soldBy') AND f.a1 IN ('O7', 'P7')""", recursive=True)
def goal_answers(spark, d):
    """What order 7, and part 7, reach by rules, each asked as a goal."""
    facts = warehouse(spark, d).filter("rel IN ('instance', 'subclass', 'orderedBy', 'soldBy')")
    return _all([magic.answers(facts, _GOAL_RULES, ("reaches", x, "?c"))[0] for x in ("O7", "P7")]).select(F.col("a1").alias("from"), F.col("a2").alias("to"))


@query("""up AS (SELECT a1, a2 FROM facts WHERE rel = 'subclass' AND a2 = 'ASIA' UNION SELECT f.a1, up.a2 FROM up JOIN facts f ON f.rel IN ('instance', 'subclass') AND f.a2 = up.a1),
members AS (SELECT a1 FROM up UNION SELECT a1 FROM facts WHERE rel = 'instance' AND a2 = 'ASIA') SELECT DISTINCT f.a1 AS "from" FROM facts f JOIN members m ON m.a1 = f.a2 WHERE f.rel IN ('orderedBy', 'soldBy')""", recursive=True)
def goal_sources(spark, d):
    """What reaches ASIA: the goal's second argument is bound."""
    facts = warehouse(spark, d).filter("rel IN ('instance', 'subclass', 'orderedBy', 'soldBy')")
    return magic.answers(facts, _GOAL_RULES, ("reaches", "?x", "ASIA"))[0].select(F.col("a1").alias("from"))


# --- composites ----------------------------------------------------------------------------------------------------


def _parts_of_world(spark, d) -> DataFrame:
    nation = _t(spark, d, "nation")
    return _all([
        nation.join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("whole"), F.col("n_name").alias("part"), F.lit(False).alias("attribute")),
        _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("whole"), _key("C", "c_custkey").alias("part"), F.lit(False).alias("attribute")),
        _t(spark, d, "customer").select(_key("C", "c_custkey").alias("whole"), F.col("c_mktsegment").alias("part"), F.lit(True).alias("attribute")),
        _t(spark, d, "orders").select(_key("C", "o_custkey").alias("whole"), _key("O", "o_orderkey").alias("part"), F.lit(False).alias("attribute")),
    ])


@query("""WITH n AS (SELECT r_name AS root, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT root, n_name, 'C' || c_custkey AS c, c_mktsegment, c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey),
t AS (SELECT r_name AS root, 0 AS indent, r_name AS term, false AS attribute, [''] AS k FROM region UNION ALL SELECT root, 1, n_name, false, ['1' || lower(n_name)] FROM n UNION ALL SELECT root, 2, c, false, ['1' || lower(n_name), '1' || lower(c)] FROM c
UNION ALL SELECT root, 3, c_mktsegment, true, ['1' || lower(n_name), '1' || lower(c), '0' || lower(c_mktsegment)] FROM c UNION ALL SELECT root, 3, 'O' || o_orderkey, false, ['1' || lower(n_name), '1' || lower(c), '1o' || o_orderkey] FROM c JOIN orders ON o_custkey = c_custkey)
SELECT root, (row_number() OVER (PARTITION BY root ORDER BY k))::INT AS number, indent::INT AS indent, term, attribute FROM t""", facts=False)
def composite_rows(spark, d):
    return composites.composite_rows(_parts_of_world(spark, d), _t(spark, d, "region").select(F.col("r_name").alias("term")))


@query("""WITH o AS (SELECT o_custkey, string_agg('O' || o_orderkey, ' ' ORDER BY 'o' || o_orderkey) AS t, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT 'C' || c_custkey AS root, '(C' || c_custkey || ' ' || c_mktsegment || coalesce(' ' || t, '') || ')' AS tree, (2 + coalesce(n, 0))::BIGINT AS nodes FROM customer LEFT JOIN o ON o_custkey = c_custkey""", facts=False)
def composite_trees(spark, d):
    return composites.composite_trees(_parts_of_world(spark, d), _t(spark, d, "customer").select(_key("C", "c_custkey").alias("term")))


@query("""WITH e AS (SELECT n_name AS part, r_name AS whole FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'C' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_mktsegment, 'C' || c_custkey FROM customer UNION SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders),
x AS (SELECT part AS term, whole, 1 AS steps FROM e UNION SELECT a.part, b.whole, 2 FROM e a JOIN e b ON b.part = a.whole UNION SELECT a.part, c.whole, 3 FROM e a JOIN e b ON b.part = a.whole JOIN e c ON c.part = b.whole)
SELECT term, whole, min(steps)::INT AS steps FROM x GROUP BY term, whole""", facts=False)
def containing_composites(spark, d):
    return composites.containing(_parts_of_world(spark, d))


# --- phrases -------------------------------------------------------------------------------------------------------


def _phrases(spark, d) -> DataFrame:
    """The first three and the first five words of each item."""
    ws = _t(spark, d, "benchmark").select(F.transform(phrases.words(F.col("text")), F.lower).alias("w"))
    return ws.select(F.explode(F.array(F.slice("w", 1, 3), F.slice("w", 1, 5))).alias("phrase"))


_GROUPED = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS w FROM documents), b AS (SELECT [lower(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')] AS w FROM benchmark),
ph AS (SELECT DISTINCT w[1:n] AS p FROM b, (VALUES (3), (5)) v(n) WHERE len(w) > 0), heads AS (SELECT DISTINCT p[1] AS h FROM ph),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT doc_id, w, i FROM s JOIN heads ON lower(w[i]) = h),
m AS (SELECT doc_id, i, max(len(p)) AS n FROM h JOIN ph ON lower(w[i]) = p[1] AND [lower(x) FOR x IN w[i:i + len(p) - 1]] = p GROUP BY ALL),
nx AS (SELECT a.doc_id, a.i, any_value(a.n) AS n, min(b.i) AS nxt FROM m a LEFT JOIN m b ON b.doc_id = a.doc_id AND b.i >= a.i + a.n GROUP BY ALL),
pick AS (SELECT doc_id, i, n, nxt FROM nx WHERE (doc_id, i) IN (SELECT doc_id, min(i) FROM nx GROUP BY doc_id) UNION ALL SELECT nx.doc_id, nx.i, nx.n, nx.nxt FROM pick JOIN nx ON nx.doc_id = pick.doc_id AND nx.i = pick.nxt),
words AS (SELECT s.doc_id, s.i, s.w[s.i] AS x, p.i AS at_ FROM s LEFT JOIN pick p ON p.doc_id = s.doc_id AND s.i >= p.i AND s.i < p.i + p.n),
units AS (SELECT doc_id, coalesce(at_, i) AS i, string_agg(CASE WHEN at_ < i THEN upper(x[1]) || x[2:] ELSE x END, '' ORDER BY i) AS x FROM words GROUP BY doc_id, coalesce(at_, i)),
g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM units GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM pick p WHERE p.doc_id = d.doc_id)::INT AS phrases, coalesce(t, '') AS grouped FROM documents d LEFT JOIN g USING (doc_id)"""


@query(_GROUPED, facts=False)
def grouped_phrases(spark, d):
    return phrases.grouped(_t(spark, d, "documents").select("doc_id", "text"), _phrases(spark, d)).select("doc_id", "phrases", "grouped")


@query("""WITH w AS (SELECT p_partkey AS sent_id, string_split(p_name, ' ') AS w FROM part) SELECT sent_id, unnest([w[2] || '-2', w[1] || '-1']) AS word, list_aggregate(w[1:2], 'string_agg', '') || '-1' AS merged FROM w WHERE len(w) > 1""", facts=False)
def noun_groups(spark, d):
    """A part's first word modifies its second."""
    w = F.split("p_name", " ")
    nn = _t(spark, d, "part").filter(F.size(w) > 1).select(F.col("p_partkey").alias("sent_id"), F.lit("nn").alias("pred"), F.concat(w[1], F.lit("-2")).alias("arg1"), F.concat(w[0], F.lit("-1")).alias("arg2"))
    return phrases.noun_groups(nn)


# --- predicate variables -------------------------------------------------------------------------------------------


def _schemata(spark, d) -> tuple[DataFrame, ...]:
    """Formulas whose heads are variables, one a customer and one a supplier, and one a region without; a relation a part, of two or three arguments, an
    instance of its brand and of its type."""
    customer, supplier = _t(spark, d, "customer"), _t(spark, d, "supplier")
    brand = F.concat(F.lit("Brand#"), (F.col("c_custkey") % 30 + 1).cast("string"))
    asked = customer.select(_key("c", "c_custkey").alias("formula_id"), F.concat(F.lit("(=> (and (instance ?REL "), brand, F.lit(") (instance ?REL ECONOMY)) (exists (?X) (and (?REL C"), F.col("c_custkey").cast("string"), F.lit(" ?X) (known (kind ?REL) ?X))))")).alias("text"))
    described = supplier.select(_key("s", "s_suppkey").alias("formula_id"), F.concat(F.lit("(=> (describes ?REL S"), F.col("s_suppkey").cast("string"), F.lit(") (not (?REL S"), F.col("s_suppkey").cast("string"), F.lit(" (at ?X) ?Y)))")).alias("text"))
    plain = _t(spark, d, "region").select(F.col("r_name").alias("formula_id"), F.concat(F.lit("(subclass "), "r_name", F.lit(" Region)")).alias("text"))
    formulas = asked.unionByName(described).unionByName(plain).repartition("formula_id")
    part = _t(spark, d, "part").withColumn("rel", _key("made", "p_partkey"))
    relations = part.select("rel", (2 + F.col("p_size") % 2).cast("int").alias("arity"))
    members = part.select("rel", F.col("p_brand").alias("type")).union(part.select("rel", "p_type"))
    signatures = spark.createDataFrame([("describes", 1, "PROMO")], "rel string, pos int, type string")
    nodes = kif.nodes(formulas.select("formula_id", "text", F.lit(None).cast("string").alias("error")))
    return formulas, nodes, relations, members, signatures


@query("""SELECT 'c' || c_custkey AS formula_id, '(=> (and (instance made' || p_partkey || ' ' || p_brand || ') (instance made' || p_partkey || ' ECONOMY)) (exists (?X) (and (made' || p_partkey || ' C' || c_custkey || ' ?X) (known (kind made' || p_partkey || ') ?X))))' AS text
FROM customer JOIN part ON p_brand = 'Brand#' || (c_custkey % 30 + 1) AND p_type = 'ECONOMY' AND p_size % 2 = 0
UNION ALL SELECT 's' || s_suppkey, '(=> (describes made' || p_partkey || ' S' || s_suppkey || ') (not (made' || p_partkey || ' S' || s_suppkey || ' (at ?X) ?Y)))' FROM supplier, part WHERE p_type = 'PROMO' AND p_size % 2 = 1
UNION ALL SELECT r_name, '(subclass ' || r_name || ' Region)' FROM region""", facts=False)
def instantiated_formulas(spark, d):
    return pv.instantiated(*_schemata(spark, d))


@query("SELECT 'c' || c_custkey AS formula_id, '?REL' AS var FROM customer WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#' || (c_custkey % 30 + 1) AND p_type = 'ECONOMY' AND p_size % 2 = 0) UNION ALL SELECT 's' || s_suppkey, '?REL' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type = 'PROMO' AND p_size % 2 = 1)", facts=False)
def rejected_formulas(spark, d):
    _, nodes, relations, members, signatures = _schemata(spark, d)
    heads, types = pv.requirements(nodes, signatures)
    return pv.without_fit(heads, types, relations, members)


# --- consistency ---------------------------------------------------------------------------------------------------

#: Regions that exclude each other here: neighbours in the order of their names.
_EXCLUDED = [("AFRICA", "AMERICA"), ("AMERICA", "ASIA"), ("ASIA", "EUROPE"), ("EUROPE", "MIDDLE EAST")]


@query(f"""WITH RECURSIVE s AS (SELECT l_orderkey * 10 + l_linenumber AS place, 'P' || l_partkey AS inst, n_name AS class, r_name AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
x AS (SELECT * FROM (VALUES {', '.join(map(str, _EXCLUDED))}) v(a, b)), bad AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
f AS (SELECT inst, class, any_value(r) AS r, min(place) AS place FROM s GROUP BY inst, class), o AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY place, class) AS i FROM f),
b AS (SELECT a, list(b) AS bs FROM bad GROUP BY a),
walk AS (SELECT inst, class, i, true AS ok, [r] AS held FROM o WHERE i = 1 UNION ALL SELECT o.inst, o.class, o.i, NOT list_has_any(held, coalesce(bs, [])), CASE WHEN list_has_any(held, coalesce(bs, [])) THEN held ELSE list_append(held, r) END FROM walk w JOIN o ON o.inst = w.inst AND o.i = w.i + 1 LEFT JOIN b ON b.a = o.r)
SELECT s.place, s.inst, s.class, CASE WHEN NOT ok THEN 'refused' WHEN row_number() OVER (PARTITION BY s.inst, s.class ORDER BY s.place) > 1 THEN 'redundant' ELSE 'accepted' END AS verdict FROM s JOIN walk w ON w.inst = s.inst AND w.class = s.class""", facts=False)
def order_of_assertions(spark, d):
    """Parts come to be instances of their sellers' nations, line by line."""
    c = F.col
    sold = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")).join(_t(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
    facts = sold.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("place"), _key("P", "l_partkey").alias("inst"), c("n_name").alias("class"))
    return consistency.verdicts(facts, taxonomy.ancestors(warehouse(spark, d)), spark.createDataFrame(_EXCLUDED, "a string, b string"))


# --- one hierarchy against another ---------------------------------------------------------------------------------


def _lexical(spark, d) -> tuple[DataFrame, DataFrame]:
    """Edges and a mapping of a lexicon: customers below nations, nations below regions that are off by the seventh of their number, these below the world."""
    key = lambda letter, col: F.concat(F.lit(letter), F.expr(col).cast("string"))
    nation, region, customer = _t(spark, d, "nation"), _t(spark, d, "region"), _t(spark, d, "customer")
    edges = _all([
        customer.select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent")), nation.select(key("n", "n_nationkey").alias("child"), key("r", "(n_regionkey + n_nationkey div 7) % 5").alias("parent")),
        region.select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")),
    ])
    mapping = _all([
        customer.filter("c_custkey % 9 > 0").select(key("c", "c_custkey").alias("node"), F.when(F.col("c_custkey") % 10 == 3, F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + 5) % 25).cast("string"))).otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("term")),
        nation.select(key("n", "n_nationkey").alias("node"), F.col("n_name").alias("term")), region.select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("term")), spark.createDataFrame([("world", "Region")], "node string, term string"),
    ])
    return edges, mapping


@query("""up AS (SELECT a1 AS child, a2 AS parent FROM facts WHERE rel = 'subclass' UNION SELECT up.child, f.a2 FROM up JOIN facts f ON f.rel = 'subclass' AND f.a1 = up.parent),
e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || (n_regionkey + n_nationkey // 7) % 5 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
m AS (SELECT 'c' || c_custkey AS node, 'NATION_' || CASE WHEN c_custkey % 10 = 3 THEN (c_nationkey + 5) % 25 ELSE c_nationkey END AS term FROM customer WHERE c_custkey % 9 > 0 UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'world', 'Region'),
bad AS (SELECT e.child, e.parent, x.term, y.term AS above FROM e JOIN m x ON x.node = e.child JOIN m y ON y.node = e.parent WHERE x.term <> y.term AND NOT EXISTS (SELECT 1 FROM up WHERE up.child = x.term AND up.parent = y.term)),
climb AS (SELECT child, parent AS at_, 1 AS steps FROM e WHERE child IN (SELECT child FROM bad) UNION SELECT c.child, e.parent, steps + 1 FROM climb c JOIN e ON e.child = c.at_),
fit AS (SELECT c.child, c.at_, c.steps FROM climb c JOIN m x ON x.node = c.child JOIN m y ON y.node = c.at_ WHERE x.term = y.term OR EXISTS (SELECT 1 FROM up WHERE up.child = x.term AND up.parent = y.term))
SELECT bad.*, n.nearest, n.steps FROM bad LEFT JOIN (SELECT child, arg_min(at_, (steps, at_)) AS nearest, min(steps)::INT AS steps FROM fit GROUP BY child) n USING (child)""", recursive=True)
def hierarchy_disagreements(spark, d):
    return hierarchies.disagreements(*_lexical(spark, d), taxonomy.ancestors(warehouse(spark, d)))


@query("SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 9 = 0", facts=False)
def unmapped_nodes(spark, d):
    return hierarchies.unmapped(*_lexical(spark, d))


# --- OWL -----------------------------------------------------------------------------------------------------------


def _ontology(spark, d) -> DataFrame:
    """Subclass and instance facts, properties with their signatures, documentation, disjoint regions, and a restriction for each pair of a type and a brand."""
    facts = warehouse(spark, d).filter("rel IN ('subclass', 'instance')").select("rel", "a1", "a2")
    row = lambda df, rel, a1, a2: df.select(F.lit(rel).alias("rel"), a1.alias("a1"), a2.alias("a2"))
    node = F.concat(F.lit("_:"), F.sha2(F.concat_ws("\0", F.lit("brand"), F.lit("someValuesFrom"), F.col("p_brand")), 256).substr(1, 16))
    pairs = _t(spark, d, "part").select("p_type", "p_brand", node.alias("node")).distinct()
    regions = _t(spark, d, "region")
    stated = spark.createDataFrame([("instance", "brand", "BinaryRelation"), ("domain1", "brand", "PartType"), ("domain2", "brand", "Mark"), ("subrelation", "brand", "mark"), ("instance", "above", "TransitiveRelation"), ("documentation", "Region", 'Where <nations> & "customers" are')], "rel string, a1 string, a2 string")
    restricted = [row(pairs, "subclass", F.col("p_type"), F.col("node")), row(pairs, "onProperty", F.col("node"), F.lit("brand")), row(pairs, "someValuesFrom", F.col("node"), F.col("p_brand"))]
    return _all([facts, stated, *restricted, row(regions.filter("r_regionkey > 0"), "disjoint", F.col("r_name"), F.lit("AFRICA"))]).distinct()


@query("""r AS (SELECT DISTINCT p_type, p_brand, '_:' || sha256('brand' || chr(0) || 'someValuesFrom' || chr(0) || p_brand)[1:16] AS node FROM part)
SELECT DISTINCT rel, a1, a2 FROM facts WHERE rel IN ('subclass', 'instance') UNION SELECT 'subclass', p_type, node FROM r UNION SELECT 'onProperty', node, 'brand' FROM r UNION SELECT 'someValuesFrom', node, p_brand FROM r UNION SELECT 'disjoint', r_name, 'AFRICA' FROM region WHERE r_regionkey > 0
UNION SELECT * FROM (VALUES ('instance', 'brand', 'BinaryRelation'), ('domain1', 'brand', 'PartType'), ('domain2', 'brand', 'Mark'), ('subrelation', 'brand', 'mark'), ('instance', 'above', 'TransitiveRelation'), ('documentation', 'Region', 'Where <nations> & "customers" are')) v(rel, a1, a2)""")
def owl_round_trip(spark, d):
    """Written, read, written and read again."""
    facts = _ontology(spark, d)
    for _ in range(2):
        path = f"{closure.folder(spark)}/owl-{uuid.uuid4().hex}"
        owl.write(facts, path)
        facts = owl.read(spark, path)
    return facts


# --- dates and measures --------------------------------------------------------------------------------------------


@query()
def dates_in_text(spark, d):
    """Of all documents and pages."""
    docs, pages = _t(spark, d, "documents"), _t(spark, d, "pages")
    return dates.spans(docs.select(_key("d", "doc_id").alias("id"), "text").unionByName(pages.select(_key("p", "page_id").alias("id"), F.col("html").alias("text"))))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS t, o_orderkey % 28 + 2 AS k FROM orders)
SELECT o_orderkey, kind, at_::INT AS at, n::INT AS n, value, amount, unit FROM (
SELECT o_orderkey, 'date' AS kind, 3 AS at_, 3 AS n, strftime(t, '%Y-%m-%d') AS value, NULL::DOUBLE AS amount, NULL AS unit FROM o UNION ALL SELECT o_orderkey, 'time', 7, 1, '09:30:00', NULL, NULL FROM o
UNION ALL SELECT o_orderkey, 'duration', 10, 2, NULL, k, 'day' FROM o UNION ALL SELECT o_orderkey, 'measure', 13, 2, NULL, 2.5 + k, 'kilogram' FROM o UNION ALL SELECT o_orderkey, 'date', 18, 2, strftime(t, 'XXXX-%m-%d'), NULL, NULL FROM o
UNION ALL SELECT o_orderkey, 'weekday', 20, 1, lower(dayname(t)), NULL, NULL FROM o UNION ALL SELECT o_orderkey, 'relative', 22, 3, strftime((t - to_weeks(k::INT))::DATE, '%Y-%m-%d'), -k, 'week' FROM o UNION ALL SELECT o_orderkey, 'relative', 26, 1, strftime((t + 1)::DATE, '%Y-%m-%d'), 1, 'day' FROM o
UNION ALL SELECT o_orderkey, 'years', 28, 1, '1990/' || year(t), NULL, NULL FROM o UNION ALL SELECT o_orderkey, 'date', 29, 1, strftime(t, '%Y-%m-%d'), NULL, NULL FROM o)""", facts=False)
def dates_of_orders(spark, d):
    t, k = F.col("o_orderdate"), (F.col("o_orderkey") % 28 + 2)
    on = lambda pattern: F.date_format(t, pattern)
    words = F.concat(F.lit("It was ordered "), on("d"), F.lit(" "), on("MMMM"), F.lit(", "), on("yyyy"), F.lit(" at 9:30, due in "), k.cast("string"), F.lit(" days: weighs "), (k + 2.5).cast("string"), F.lit(" kg. It was seen "), on("MMM"), F.lit(" "), on("d"), F.lit(" "), on("EEEE"), F.lit(" or "), k.cast("string"), F.lit(" weeks ago and tomorrow for 1990-"), on("yyyy"), F.lit(" "), on("M/d/yyyy"))
    return dates.spans(_t(spark, d, "orders").select("o_orderkey", words.alias("text")))


# --- types of arguments --------------------------------------------------------------------------------------------


def _typed(spark, d) -> DataFrame:
    """A rule an order, in the words of its customer's nation: who orders believes to have paid. Orders are instances of their status, and a status is an order's."""
    c = F.col
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), c("o_custkey") == c("c_custkey")).withColumn("key", c("o_orderkey").cast("string")).withColumn("at", c("c_nationkey").cast("string"))
    lit = F.lit
    text = F.concat(lit("(=> (orderedIn"), "at", lit(" O"), "key", lit(" ?C) (believes"), "at", lit(" ?C (not (paid"), "at", lit(" ?C (priceOf O"), "key", lit(") "), F.round("o_totalprice").cast("long").cast("string"), lit("))))"))
    formulas = o.select(c("key").alias("formula_id"), text.alias("text"), lit(None).cast("string").alias("error"))
    signatures = _t(spark, d, "nation").select(F.concat(lit("orderedIn"), c("n_nationkey").cast("string")).alias("rel"), lit(2).alias("pos"), lit("Customer").alias("type"))
    members = o.select(F.concat(lit("O"), "key").alias("inst"), F.concat(lit("Status"), "o_orderstatus").alias("type"))
    status = o.select(F.concat(lit("Status"), "o_orderstatus").alias("child")).distinct()
    up = status.select("child", lit("Order").alias("parent")).union(status.select("child", lit("Entity"))).union(spark.createDataFrame([("Order", "Entity"), ("Customer", "Entity")], "child string, parent string"))
    return argument_types.inferred(kif.nodes(formulas, heads=True), spark.createDataFrame([("priceOf",)], "rel string"), signatures, members, up)


_TYPES = """WITH o AS (SELECT c_nationkey AS k, count(DISTINCT o_orderstatus) AS n, any_value('Status' || o_orderstatus) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT count(DISTINCT o_orderstatus) AS n, any_value('Status' || o_orderstatus) AS s FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT 'orderedIn' || n_nationkey AS rel, 2 AS pos, 'Customer' AS type FROM nation
UNION ALL SELECT 'orderedIn' || k, 1, CASE WHEN a.n > 1 THEN 'Order' ELSE a.s END FROM o, a UNION ALL SELECT 'believes' || k, 1, 'Customer' FROM o UNION ALL SELECT 'believes' || k, 2, '$o' FROM o
UNION ALL SELECT 'paid' || k, 1, 'Customer' FROM o UNION ALL SELECT 'paid' || k, 2, 'Entity' FROM o UNION ALL SELECT 'paid' || k, 3, 'Number' FROM o UNION ALL SELECT 'priceOf', 1, CASE WHEN n > 1 THEN 'Order' ELSE s END FROM a)"""


@query(_TYPES + " SELECT rel, pos::INT AS pos, type FROM t", facts=False)
def inferred_types(spark, d):
    """priceOf takes orders of all nations, so their types are one class."""
    return _typed(spark, d)


@query(_TYPES + " SELECT 'thf(' || rel || ',type,(' || rel || ': (' || string_agg(CASE WHEN type = '$o' THEN '$o' ELSE '$i' END, ' > ' ORDER BY pos) || ' > $o))).' AS value FROM t GROUP BY rel", facts=False)
def type_declarations(spark, d):
    return argument_types.declarations(_typed(spark, d).filter("pos > 0"))
