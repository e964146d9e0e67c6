"""One query an operator, over the driver's tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import formula as fo
from factloom.functions import strings as st
from factloom.functions.distance import jaro_winkler_distance
from factloom.operators import decisions, diagnostics, index, relevance, taxonomy, text
from factloom.operators.facts import SQL as FACTS
from factloom.operators.facts import terms, warehouse
from factloom.plans import closure, rewrite
from factloom.sources import exports, kif, lexicon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STOP = ("the", "of", "and", "de", "la", "der", "die", "en", "to", "a", "in")
#: A lexicon (word, strength, sign) and senses for the text queries.
LEXICON = [("idiot", "strong", "negative"), ("trash", "strong", "negative"), ("stupid", "weak", "negative"), ("clown", "weak", "negative"), ("and", "weak", "positive"), ("est", "strong", "positive"), ("der", "weak", "neutral")]
CONCEPTS = [("the", "Article"), ("der", "Article"), ("idiot", "Insult"), ("clown", "Insult"), ("est", "Being")]
SENSES = [("the", "the_1", 1, "of", 3), ("the", "the_1", 1, "and", 1), ("the", "the_2", 2, "to", 4), ("la", "la_1", 1, "de", 2), ("la", "la_2", 2, "que", 2)]
_LEXICON_SQL = "lexicon AS (SELECT * FROM (VALUES ('idiot', -5), ('trash', -5), ('stupid', -1), ('clown', -1), ('and', 1), ('est', 5), ('der', 0)) v(word, polarity))"
_TOKENS = "words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)"
_UP = "sub AS (SELECT DISTINCT a1 AS child, a2 AS parent FROM facts WHERE rel = 'subclass'), up AS (SELECT child, parent FROM sub UNION SELECT up.child, sub.parent FROM up JOIN sub ON up.parent = sub.child)"
_INST = "direct AS (SELECT DISTINCT a1 AS inst, a2 AS class FROM facts WHERE rel = 'instance'), members AS (SELECT * FROM direct UNION SELECT inst, parent FROM direct JOIN up ON class = child)"
_MENTIONS = "mentions AS (SELECT term, pos, rel, src FROM (SELECT rel, src, unnest([a1, a2, a3, a4]) AS term, unnest([1, 2, 3, 4]) AS pos FROM facts) WHERE term IS NOT NULL AND NOT regexp_matches(term, '^[+-]?[0-9]'))"
_TERMS = _MENTIONS + ", terms AS (SELECT term FROM mentions UNION SELECT rel FROM facts)"


def query(sql: str | None = None, facts: bool = True, recursive: bool = False):
    """Register a query by its function's name; sql goes behind the facts' CTE."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = (f"WITH {'RECURSIVE ' * recursive}{FACTS}" + ("" if sql.lstrip().startswith("SELECT") else ", ") + sql) if facts else sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, strength string, sign string").select("word", text.polarity(F.col("strength"), F.col("sign")).alias("polarity"))


# --- look-ups ------------------------------------------------------------------------------------------------------


@query("SELECT rel, a1, a2, src FROM facts WHERE a2 = 'NATION_3'")
def ask_argument(spark, d):
    return index.ask(warehouse(spark, d), (2, "NATION_3")).select("rel", "a1", "a2", "src")


@query("SELECT a1, a2, a3, a4 FROM facts WHERE rel = 'contains' AND a3 = 'S7'")
def ask_two_arguments(spark, d):
    return index.ask(warehouse(spark, d), (0, "contains"), (3, "S7")).select("a1", "a2", "a3", "a4")


@query("SELECT a1, a2 FROM facts WHERE rel = 'contains' AND a3 = 'S7' AND a4 = '1'")
def ask_three_arguments(spark, d):
    return index.ask(warehouse(spark, d), (0, "contains"), (3, "S7"), (4, "1")).select("a1", "a2")


@query("SELECT DISTINCT a2 AS term FROM facts WHERE rel = 'contains' AND a3 = 'S7'")
def terms_by_restriction(spark, d):
    return index.terms_by(warehouse(spark, d), 2, (0, "contains"), (3, "S7"))


@query("SELECT a1 AS \"O\", a2 AS \"P\", a4 AS \"N\" FROM facts WHERE rel = 'contains' AND a3 = 'S9'")
def literal_pattern(spark, d):
    return index.pattern(warehouse(spark, d), "contains", "?O", "?P", "S9", "?N")


@query("SELECT rel, a1, a2, a3, a4, list_position([a1, a2, a3, a4], 'P1')::INT AS p1, list_position([a1, a2, a3, a4], 'S2')::INT AS p2 FROM facts WHERE list_contains([a1, a2, a3, a4], 'P1') AND list_contains([a1, a2, a3, a4], 'S2')")
def term_intersection(spark, d):
    return index.both_terms(warehouse(spark, d), "P1", "S2")


@query(_TERMS + " SELECT term FROM terms WHERE regexp_full_match(term, 'N.*_1[0-9]?|[A-Z]+')")
def terms_matching(spark, d):
    return index.matching(warehouse(spark, d), "N.*_1[0-9]?|[A-Z]+")


@query(_TERMS + """, b AS (SELECT term FROM terms WHERE term < 'NATION_2' ORDER BY term DESC LIMIT 5), a AS (SELECT term FROM terms WHERE term >= 'NATION_2' ORDER BY term LIMIT 5)
SELECT 'before' AS side, (row_number() OVER (ORDER BY term DESC))::INT AS place, term FROM b UNION ALL SELECT 'after', (row_number() OVER (ORDER BY term))::INT, term FROM a""")
def nearest_terms(spark, d):
    return index.nearest(warehouse(spark, d), "NATION_2", 5)


@query("SELECT rel, count(*) AS n FROM facts GROUP BY rel")
def facts_per_relation(spark, d):
    return index.count_by_relation(warehouse(spark, d))


@query(_TERMS + " SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(DISTINCT rel) FROM facts) AS relations, (SELECT count(*) FROM terms) AS terms")
def statistics(spark, d):
    return index.statistics(warehouse(spark, d))


@query("SELECT rel, a1, a2 FROM (SELECT *, row_number() OVER (PARTITION BY rel, a1, a2, a3, a4 ORDER BY src) AS n FROM facts WHERE rel = 'soldBy') WHERE n = 1")
def first_fact_wins(spark, d):
    return index.first_wins(warehouse(spark, d).filter("rel = 'soldBy'"), "src").select("rel", "a1", "a2")


@query("SELECT a1, a2 FROM facts f WHERE rel = 'instance' AND src = 'supplier' AND EXISTS (SELECT 1 FROM facts g WHERE g.rel = 'soldBy' AND g.a2 = f.a1)")
def merge_present(spark, d):
    facts = warehouse(spark, d)
    more = facts.filter("rel = 'instance' AND src = 'supplier'").join(facts.filter("rel = 'soldBy'").select(F.col("a2").alias("a1")).distinct(), "a1", "left_semi").select(*facts.columns)
    return index.merge(facts.filter("rel = 'instance'"), more)[1].select("a1", "a2")


@query("SELECT count(*) AS n, count(DISTINCT a1) AS whole FROM (SELECT DISTINCT a1, rel, a2 FROM facts WHERE a2 IS NOT NULL AND a3 IS NULL)")
def semantic_network(spark, d):
    return index.semantic_network(warehouse(spark, d)).agg(F.count("*").alias("n"), F.count_distinct("a").alias("whole"))


@query(_MENTIONS + """, defined AS (SELECT DISTINCT a1 AS term, src AS definer FROM facts WHERE rel IN ('subclass', 'instance', 'subrelation')), used AS (SELECT DISTINCT term, src AS user FROM mentions)
SELECT used.user, definer, count(*) AS n FROM used JOIN defined USING (term) WHERE used.user <> definer GROUP BY ALL""")
def source_dependencies(spark, d):
    return index.source_dependencies(warehouse(spark, d))


# --- classes and relations -----------------------------------------------------------------------------------------


@query(_UP + ", " + _INST + " SELECT class, count(DISTINCT inst) AS n FROM members GROUP BY class", recursive=True)
def instances_per_class(spark, d):
    return taxonomy.instances_per_class(warehouse(spark, d))


@query(_UP + " SELECT child, parent FROM up", recursive=True)
def ancestors(spark, d):
    return taxonomy.ancestors(warehouse(spark, d))


@query(_UP + " SELECT parent AS term, count(*) AS descendants FROM up GROUP BY parent", recursive=True)
def descendants(spark, d):
    return taxonomy.ancestors(warehouse(spark, d)).groupBy(F.col("parent").alias("term")).agg(F.count("*").alias("descendants"))


@query(_UP + ", " + _INST + " SELECT inst, class FROM members m WHERE NOT EXISTS (SELECT 1 FROM members o JOIN up ON o.class = up.child WHERE o.inst = m.inst AND up.parent = m.class)", recursive=True)
def most_specific_classes(spark, d):
    facts = warehouse(spark, d)
    return taxonomy.most_specific(taxonomy.instances(facts), taxonomy.ancestors(facts))


def _regions(spark, d) -> DataFrame:
    return _t(spark, d, "region").agg(F.collect_list("r_name").alias("parts")).select(F.lit("Region").alias("whole"), "parts")


_DISJOINT = "disjoint AS (SELECT x.r_name AS a, y.r_name AS b FROM region x JOIN region y ON x.r_name <> y.r_name)"


@query(_DISJOINT + " SELECT a, b FROM disjoint")
def disjoint_classes(spark, d):
    return taxonomy.disjoint_pairs(_regions(spark, d))


@query(_UP + ", direct AS (SELECT a1 AS inst, a2 AS class FROM facts WHERE rel = 'instance' UNION SELECT 'P' || l_partkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), members AS (SELECT * FROM direct UNION SELECT inst, parent FROM direct JOIN up ON class = child), "
+ _DISJOINT + " SELECT x.inst, x.class AS a, y.class AS b FROM members x JOIN members y USING (inst) JOIN disjoint ON a = x.class AND b = y.class WHERE a < b", recursive=True)
def disjointness_violations(spark, d):
    """Parts belong to their suppliers' nations here, so to several regions."""
    facts = warehouse(spark, d)
    sold = facts.filter("rel = 'soldBy'").select("a1", F.col("a2").alias("s"))
    home = facts.filter("rel = 'instance' AND src = 'supplier'").select(F.col("a1").alias("s"), "a2")
    more = sold.join(home, "s").select(F.lit("instance").alias("rel"), "a1", "a2", *(F.lit(None).cast("string").alias(c) for c in ("a3", "a4")), F.lit("made").alias("src"))
    disjoint = taxonomy.disjoint_pairs(_regions(spark, d))
    return taxonomy.disjoint_violations(taxonomy.instances(facts.unionByName(more), disjoint.select(F.col("a").alias("class"))), disjoint)


@query("SELECT count(*) AS n, count(DISTINCT a1) AS subjects FROM (SELECT DISTINCT a1, a2 FROM facts WHERE rel IN ('involves', 'soldBy', 'orderedBy') UNION SELECT a2, a1 FROM facts WHERE rel = 'sells')")
def by_subrelations(spark, d):
    return taxonomy.related(warehouse(spark, d), "involves", {"soldBy": "sells"}).agg(F.count("*").alias("n"), F.count_distinct("a1").alias("subjects"))


@query("""reach AS (SELECT 'C1' AS term, 0 AS depth UNION SELECT a2, depth + 1 FROM reach JOIN facts ON a1 = term WHERE rel IN ('instance', 'subclass'))
SELECT term, min(depth)::INT AS depth FROM reach GROUP BY term""", recursive=True)
def transitive_reach(spark, d):
    facts = warehouse(spark, d).filter("rel IN ('instance', 'subclass')")
    return closure.reachable(facts.select(F.col("a1").alias("child"), F.col("a2").alias("parent")), spark.createDataFrame([("C1",)], "term string"))


@query("""e AS (SELECT a1 AS x, a2 AS y FROM facts WHERE rel IN ('subclass', 'instance') UNION SELECT a2, a1 FROM facts WHERE rel IN ('subclass', 'instance')),
reach AS (SELECT 'Region' AS term, 0 AS depth UNION SELECT y, depth + 1 FROM reach JOIN e ON x = term WHERE depth < 3) SELECT term, min(depth)::INT AS depth FROM reach GROUP BY term""", recursive=True)
def bounded_neighbourhood(spark, d):
    return taxonomy.neighbourhood(warehouse(spark, d), "Region", ["subclass", "instance"], 3)


@query("below AS (SELECT 'Entity' AS term UNION SELECT a1 FROM facts JOIN below ON a2 = term WHERE rel = 'subclass') SELECT term FROM below", recursive=True)
def class_set(spark, d):
    return closure.frontier(spark.createDataFrame([("Entity",)], "term string"), taxonomy.edges(warehouse(spark, d), "subclass"))


@query("""says AS (SELECT rel AS term, 'relation' AS kind FROM facts UNION SELECT unnest([a1, a2]), 'relation' FROM facts WHERE rel = 'subrelation' UNION SELECT unnest([a1, a2]), 'class' FROM facts WHERE rel = 'subclass'
UNION SELECT a2, 'class' FROM facts WHERE rel = 'instance' UNION SELECT a1, 'instance' FROM facts WHERE rel = 'instance')
SELECT term, bool_or(kind = 'relation') AS relation, bool_or(kind = 'class') AS "class", bool_or(kind = 'instance') AS instance FROM says GROUP BY term""")
def kinds_of_terms(spark, d):
    return taxonomy.kinds_of_terms(warehouse(spark, d))


_VALENCE = "val AS (SELECT rel, arg_max(n, c * 100 - n)::INT AS n FROM (SELECT rel, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT AS n, count(*) AS c FROM facts GROUP BY ALL) GROUP BY rel)"


@query(_VALENCE + " SELECT rel, n FROM val")
def valences(spark, d):
    return taxonomy.valence(warehouse(spark, d))


#: Valences as a schema declares them; the line number that `contains` has besides is an error in every such fact.
_DECLARED = [("contains", 3), ("soldBy", 2), ("orderedBy", 2), ("instance", 2), ("subclass", 2)]


@query(f"""SELECT rel, a1, a2, a3, a4, n FROM facts JOIN (VALUES {', '.join(map(str, _DECLARED))}) v(rel, n) USING (rel)
WHERE (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT <> n""")
def arity_errors(spark, d):
    return taxonomy.arity_errors(warehouse(spark, d), spark.createDataFrame(_DECLARED, "rel string, n int"))


_DOMAINS = [("involves", 1, "Entity"), ("involves", 2, "Entity"), ("soldBy", 1, "PartType")]


@query(f"""dom AS (SELECT * FROM (VALUES {', '.join(map(str, _DOMAINS))}) v(rel, pos, type)), up AS (SELECT rel AS child, rel AS above, 0 AS d FROM (SELECT rel FROM dom UNION SELECT a1 FROM facts WHERE rel = 'subrelation') UNION SELECT up.child, a2, d + 1 FROM up JOIN facts ON rel = 'subrelation' AND a1 = up.above)
SELECT child AS rel, pos, arg_min(type, (d, type)) AS type FROM up JOIN dom ON dom.rel = up.above GROUP BY child, pos""", recursive=True)
def inherited_signatures(spark, d):
    return taxonomy.inherit_signatures(spark.createDataFrame(_DOMAINS, "rel string, pos int, type string"), taxonomy.edges(warehouse(spark, d), "subrelation"))


@query(_VALENCE + " SELECT rel FROM val WHERE n = 2 AND rel IN ('soldBy')")
def admissible_relations(spark, d):
    signatures = inherited_signatures(spark, d)
    required = spark.createDataFrame([(1, "PartType"), (2, "Entity")], "pos int, type string")
    return taxonomy.admissible(taxonomy.valence(warehouse(spark, d)), signatures, 2, required)


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT x.a1 AS p, y.a2 AS q FROM facts x JOIN facts y ON x.a2 = y.a1 WHERE x.rel = 'soldBy' AND y.rel = 'instance')""")
def horn_rules(spark, d):
    facts = warehouse(spark, d).filter("rel IN ('soldBy', 'instance') AND src IN ('lineitem', 'supplier')").select("rel", "a1", "a2")
    rule = {"head": ("availableIn", "?p", "?n"), "body": [("soldBy", "?p", "?s"), ("instance", "?s", "?n")]}
    return closure.evaluate(facts, [rule]).filter("rel = 'availableIn'").agg(F.count("*").alias("n"))


@query("""anc AS (SELECT a1, a2 FROM facts WHERE rel = 'subclass' UNION SELECT anc.a1, f.a2 FROM anc JOIN facts f ON f.rel = 'subclass' AND f.a1 = anc.a2) SELECT a1, a2 FROM anc""", recursive=True)
def transitive_rule(spark, d):
    rules = [{"head": ("below", "?x", "?y"), "body": [("subclass", "?x", "?y")]}, {"head": ("below", "?x", "?z"), "body": [("below", "?x", "?y"), ("subclass", "?y", "?z")]}]
    return closure.evaluate(warehouse(spark, d).filter("rel = 'subclass'"), rules).filter("rel = 'below'").select("a1", "a2")


# --- lint ----------------------------------------------------------------------------------------------------------


@query(_TERMS + " SELECT term FROM terms WHERE term NOT IN (SELECT a1 FROM facts WHERE rel = 'brand')")
def terms_without_relation(spark, d):
    return diagnostics.without_relation(warehouse(spark, d), "brand", 1)


@query("SELECT a1 AS term, count(*) AS n FROM facts WHERE rel = 'soldBy' GROUP BY a1 HAVING count(*) > 1")
def terms_with_repeats(spark, d):
    return diagnostics.repeated_values(warehouse(spark, d), "soldBy")


@query(_UP + " SELECT DISTINCT term FROM (SELECT child AS term FROM sub UNION SELECT parent FROM sub) WHERE term <> 'Region' AND term NOT IN (SELECT child FROM up WHERE parent = 'Region')", recursive=True)
def classes_not_below(spark, d):
    return diagnostics.not_below(warehouse(spark, d), "Region")


@query(_UP + " SELECT child AS term FROM up WHERE parent = 'Region'", recursive=True)
def classes_below(spark, d):
    return diagnostics.below(warehouse(spark, d), "Region")


@query(_UP + ", d AS (SELECT 'Region' AS a, least(r_name, 'x') AS b FROM region) SELECT x.child, x.parent AS b, y.parent AS a FROM up x JOIN up y USING (child) JOIN d ON d.b = x.parent AND d.a = y.parent", recursive=True)
def children_of_disjoint_parents(spark, d):
    pairs = _t(spark, d, "region").select(F.lit("Region").alias("b"), F.col("r_name").alias("a"))
    got = diagnostics.children_of_disjoint(warehouse(spark, d), pairs.filter("a < b"))
    return got.select("child", F.col("a").alias("b"), F.col("b").alias("a"))


@query(_UP + ", " + _INST + " SELECT DISTINCT inst FROM members m WHERE class = 'Region' AND NOT EXISTS (SELECT 1 FROM members o WHERE o.inst = m.inst AND o.class IN (SELECT n_name FROM nation WHERE n_nationkey < 20))", recursive=True)
def members_in_no_part(spark, d):
    return diagnostics.in_no_part(warehouse(spark, d), "Region", _t(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_name").alias("part")))


@query(_TERMS + " SELECT term FROM terms WHERE term NOT IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_quantity > 10)")
def terms_without_rules(spark, d):
    named = _t(spark, d, "lineitem").filter("l_quantity > 10").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term")).distinct()
    return diagnostics.unused_terms(warehouse(spark, d), named)


@query("i AS (SELECT a1, a2 FROM facts WHERE rel = 'instance' UNION ALL SELECT a1, a2 FROM facts WHERE rel = 'orderedBy') SELECT x.a1 AS inst, x.a2 AS mid, y.a2 AS top FROM i x JOIN i y ON x.a2 = y.a1")
def instances_of_instances(spark, d):
    """Orders count as instances of their customers here."""
    facts = warehouse(spark, d)
    return diagnostics.instance_of_instance(facts.withColumn("rel", F.when(F.col("rel") == "orderedBy", "instance").otherwise(F.col("rel"))))


@query(_MENTIONS + " SELECT term, count(*) AS n FROM mentions GROUP BY term")
def term_usage(spark, d):
    return diagnostics.term_usage(warehouse(spark, d))


@query(_UP + ", more AS (SELECT * FROM sub UNION SELECT n_name, 'Region' FROM nation WHERE n_nationkey < 5) SELECT DISTINCT m.child, m.parent FROM more m JOIN more v ON v.child = m.child AND v.parent <> m.parent JOIN up ON up.child = v.parent AND up.parent = m.parent", recursive=True)
def redundant_facts(spark, d):
    facts = warehouse(spark, d).filter("rel = 'subclass'")
    more = _t(spark, d, "nation").filter("n_nationkey < 5").select(F.lit("subclass").alias("rel"), F.col("n_name").alias("a1"), F.lit("Region").alias("a2"), *(F.lit(None).cast("string").alias(c) for c in ("a3", "a4")), F.lit("user").alias("src"))
    return diagnostics.redundant(facts.unionByName(more))


# --- text ----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages", facts=False)
def html_removed(spark, d):
    return _t(spark, d, "pages").select("page_id", st.remove_html(F.col("html")).alias("text"))


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS name FROM part", facts=False)
def normal_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", st.normal_name(F.col("p_name")).alias("name"))


@query(f"WITH {_TOKENS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM words GROUP BY term", facts=False)
def term_statistics(spark, d):
    tf = text.term_counts(_t(spark, d, "documents"), "doc_id")
    return tf.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


_STOPPED = f"WITH {_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN {STOP} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc_id, term, tf * log10((SELECT count(*) FROM documents) / df) AS w FROM tf JOIN df USING (term))"


def _weights(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents")
    return text.weights(text.term_counts(docs, "doc_id", stop=STOP), "doc_id", docs.count())


@query(_STOPPED + " SELECT doc_id, round(sqrt(sum(w * w)), 4) AS norm FROM w GROUP BY doc_id", facts=False)
def document_norms(spark, d):
    return text.norms(_weights(spark, d), "doc_id").select("doc_id", F.round("norm", 4).alias("norm"))


@query(_STOPPED + " SELECT doc_id, term, place FROM (SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term))::INT AS place FROM w) WHERE place <= 3", facts=False)
def top_terms(spark, d):
    w = _weights(spark, d).withColumn("w", F.round("w", 6))
    return text.top(w, "doc_id", [F.desc("w"), F.asc("term")], 3).select("doc_id", "term", "place")


@query(_STOPPED + f""", q AS (SELECT item_id, term, tf * log10((SELECT count(*) FROM documents) / df) AS qw FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE term NOT IN {STOP} GROUP BY ALL) JOIN df USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM q GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(w * qw) / any_value(dn * qn), 6) AS score FROM w JOIN q USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) WHERE dn > 0 AND qn > 0 GROUP BY ALL)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 3""", facts=False)
def best_documents(spark, d):
    docs = _t(spark, d, "documents")
    n = docs.count()
    counts = text.term_counts(docs, "doc_id", stop=STOP)
    df = text.frequencies(counts)
    q = closure.cut(text.weights(text.term_counts(_t(spark, d, "benchmark"), "item_id", stop=STOP), "item_id", n, df))
    asked = counts.join(closure.small(q.select("term").distinct()), "term", "left_semi")
    s = text.cosines(text.weights(counts, "doc_id", n, df), "doc_id", q, "item_id", text.weights(asked, "doc_id", n, df)).withColumn("score", F.round("score", 6))
    return text.top(s, "item_id", [F.desc("score"), F.asc("doc_id")], 3).select("item_id", "doc_id", "score")


@query(f"WITH {_TOKENS}, {_LEXICON_SQL} SELECT doc_id, coalesce(score, 0)::BIGINT AS score FROM documents LEFT JOIN (SELECT doc_id, sum(polarity) AS score FROM words JOIN lexicon ON term = word GROUP BY doc_id) USING (doc_id)", facts=False)
def document_sentiment(spark, d):
    return text.sentiment(_t(spark, d, "documents"), "doc_id", _lexicon(spark)).select("doc_id", F.col("score").cast("long").alias("score"))


@query(f"""WITH {_LEXICON_SQL}, concepts AS (SELECT * FROM (VALUES ('the', 'Article'), ('der', 'Article'), ('idiot', 'Insult'), ('clown', 'Insult'), ('est', 'Being')) v(word, concept)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
words AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM lines WHERE trim(t) <> ''),
score AS (SELECT doc_id, i, sum(polarity) AS score FROM words JOIN lexicon ON term = word GROUP BY ALL), named AS (SELECT DISTINCT doc_id, i, concept FROM words JOIN concepts ON term = word)
SELECT concept, sum(coalesce(score, 0))::BIGINT AS score, count(*) AS sentences FROM named LEFT JOIN score USING (doc_id, i) GROUP BY concept""", facts=False)
def concept_sentiment(spark, d):
    return text.concept_sentiment(_t(spark, d, "documents"), "doc_id", _lexicon(spark), spark.createDataFrame(CONCEPTS, "word string, concept string"))


@query("SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, round(sum(value), 4) AS value FROM events GROUP BY ALL", facts=False)
def values_by_period(spark, d):
    return _t(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").alias("week")).agg(F.round(F.sum("value"), 4).alias("value"))


@query(f"""WITH {_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), senses AS (SELECT * FROM (VALUES ('the', 'the_1', 1, 'of', 3), ('the', 'the_1', 1, 'and', 1), ('the', 'the_2', 2, 'to', 4), ('la', 'la_1', 1, 'de', 2), ('la', 'la_2', 2, 'que', 2)) v(word, sense, o, companion, n)),
s AS (SELECT x.doc_id, word, sense, o, sum(n)::BIGINT AS total FROM tf x JOIN senses ON x.term = word JOIN tf y ON y.doc_id = x.doc_id AND y.term = companion GROUP BY ALL)
SELECT doc_id, word, sense, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY total DESC, o) AS place FROM s) WHERE place = 1 AND total > 3""", facts=False)
def word_senses(spark, d):
    words = text.term_counts(_t(spark, d, "documents"), "doc_id").withColumnRenamed("term", "word")
    senses = spark.createDataFrame(SENSES, "word string, sense string, sense_order int, companion string, n long")
    return text.best_sense(words, "doc_id", F.broadcast(senses), 3)


@query("SELECT user_id, floor(avg(dist))::BIGINT AS mean FROM (SELECT user_id, levenshtein(event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dist FROM events) WHERE dist > 0 GROUP BY user_id", facts=False)
def search_coherence(spark, d):
    return text.coherence(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT p_partkey, lpad(p_brand, greatest(12, length(p_brand))::INT, '.') AS before, rpad(p_type, greatest(9, length(p_type))::INT, '*') AS after, to_base64(p_name::BLOB) AS coded, replace(url_encode(p_name), '%20', '+') AS url, p_name AS plain FROM part", facts=False)
def filled_and_coded(spark, d):
    coded = F.base64(F.col("p_name").cast("binary"))
    return _t(spark, d, "part").select("p_partkey", st.filled(F.col("p_brand"), ".", 12, True).alias("before"), st.filled(F.col("p_type"), "*", 9, False).alias("after"), coded.alias("coded"), F.url_encode("p_name").alias("url"), F.url_decode(F.url_encode("p_name")).alias("plain"))


@query("""WITH t AS (SELECT o_orderkey, '(order (by (c ' || o_custkey || ')) ' || repeat('(', (o_orderkey % 3)::INT) || o_orderstatus || repeat(')', (o_orderkey % 4)::INT) AS text, o_orderstatus FROM orders)
SELECT o_orderkey, (strpos(text, '))'))::INT AS inner_end, (CASE WHEN o_orderkey % 4 > o_orderkey % 3 THEN strpos(text, o_orderstatus || ')') + o_orderkey % 3 ELSE -1 END)::INT AS outer_end FROM t""", facts=False)
def balanced_parens(spark, d):
    key = F.col("o_orderkey").cast("int")
    text_ = F.concat(F.lit("(order (by (c "), F.col("o_custkey").cast("string"), F.lit(")) "), F.repeat(F.lit("("), key % 3), F.col("o_orderstatus"), F.repeat(F.lit(")"), key % 4))
    return _t(spark, d, "orders").select("o_orderkey", st.balanced_paren(text_, 7).alias("inner_end"), st.balanced_paren(text_, 0).alias("outer_end"))


# --- matching, tables and decisions --------------------------------------------------------------------------------


def _names(spark, d) -> DataFrame:
    left = _t(spark, d, "nation").select(F.col("n_name").alias("name"))
    right = _t(spark, d, "customer").select(F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"), F.lit("Of"), F.col("c_custkey").cast("string")).alias("name"))
    return decisions.name_pairs(left, right)


_NORMAL = "trim(regexp_replace(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_PAIRS = f"""WITH p AS (SELECT n_name AS a, 'Nation_' || c_nationkey || 'Of' || c_custkey AS b FROM nation, customer), q AS (SELECT a, b, {_NORMAL.format('a')} AS x, {_NORMAL.format('b')} AS y FROM p),
r AS (SELECT a, b, x, y FROM q WHERE list_has_any(string_split(x, ' '), string_split(y, ' '))),
s AS (SELECT a, b, (CASE WHEN x = y THEN 1 WHEN contains(x, y) THEN instr(x, y) - 1 + length(x) - length(y) WHEN contains(y, x) THEN instr(y, x) - 1 + length(y) - length(x) END)::INT AS by_substring, levenshtein(x[2:], y[2:])::INT AS by_letters FROM r)"""


@query(_PAIRS + " SELECT * FROM s WHERE by_substring <= 6 OR by_letters <= 6", facts=False)
def matched_names(spark, d):
    return decisions.match_names(_names(spark, d), 6)


@query(_PAIRS + " SELECT a, arg_min(b, (by_letters, b)) AS b, min(by_letters)::INT AS score FROM s WHERE by_letters <= 6 OR by_substring <= 6 GROUP BY a", facts=False)
def best_matches(spark, d):
    return decisions.best_match(decisions.match_names(_names(spark, d), 6), "by_letters")


@query()
def jaro_winkler_names(spark, d):
    pairs = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return pairs.select("p_partkey", jaro_winkler_distance(F.col("p_name"), F.col("p_brand")).alias("distance"))


@query("SELECT 'P' || p_partkey AS row, round(3 * p_size + 0.01 * p_retailprice, 4) AS score FROM part", facts=False)
def recommendations(spark, d):
    part = _t(spark, d, "part")
    cells = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("row"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"), F.lit("none"), F.lit(1.0))).alias("col", "value"))
    got = decisions.recommendations(cells, spark.createDataFrame([("size", 3.0), ("price", 0.01)], "col string, weight double"))
    return got.select("row", F.round("score", 4).alias("score"))


@query("""WITH v AS (SELECT p_type, list(p_size ORDER BY p_size) AS s, count(*) AS n FROM part GROUP BY p_type)
SELECT p_type, (CASE WHEN n % 2 = 1 THEN s[(n + 1) // 2] ELSE trunc((s[n // 2] + s[n // 2 + 1]) / 2) END)::BIGINT AS median FROM v""", facts=False)
def lower_medians(spark, d):
    return decisions.medians(_t(spark, d, "part"), "p_type", F.col("p_size"))


@query("""WITH v AS (SELECT p_brand, list(p_size ORDER BY p_size) AS s, count(*)::INT AS n, max(p_partkey) AS k FROM part GROUP BY p_brand), h AS (SELECT *, n // 2 AS h, s[1:greatest(n // 2, 1)] AS lo, s[greatest(n - n // 2 + 1, 1):] AS hi FROM v),
m AS (SELECT p_brand, n, s, (CASE WHEN h % 2 = 1 THEN lo[(h + 1) // 2] ELSE trunc((lo[h // 2] + lo[h // 2 + 1]) / 2) END)::BIGINT AS q1, (CASE WHEN h % 2 = 1 THEN hi[(h + 1) // 2] ELSE trunc((hi[h // 2] + hi[h // 2 + 1]) / 2) END)::BIGINT AS q3 FROM h)
SELECT p_partkey, (CASE WHEN n = 1 THEN s[1] <> p_size ELSE p_size < q1 OR p_size > q3 END) AS outside FROM part JOIN m USING (p_brand)""", facts=False)
def quartile_outliers(spark, d):
    return decisions.outside_quartiles(_t(spark, d, "part"), "p_brand", F.col("p_size")).select("p_partkey", "outside")


@query("SELECT l_suppkey AS item, CASE WHEN l_returnflag = 'R' THEN 'risk' ELSE 'trade' END AS bucket, sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 2 END)::BIGINT AS score FROM lineitem GROUP BY ALL", facts=False)
def weighted_buckets(spark, d):
    items = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("feature"))
    w = spark.createDataFrame([("R", "risk", 3), ("A", "trade", 1), ("N", "trade", 2)], "feature string, bucket string, weight long")
    return decisions.buckets(items, w)


@query("SELECT l_suppkey AS item, count(*) FILTER (l_returnflag = 'A')::BIGINT AS \"A\", count(*) FILTER (l_returnflag = 'N')::BIGINT AS \"N\", count(*) FILTER (l_returnflag = 'R')::BIGINT AS \"R\" FROM lineitem GROUP BY l_suppkey", facts=False)
def sparse_matrix(spark, d):
    counts = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("item"), "l_returnflag").agg(F.count("*").alias("n"))
    return decisions.matrix(counts, "item", "l_returnflag", "n", ["A", "N", "R"])


@query("SELECT a1, string_agg(a2, '/' ORDER BY a2) FILTER (rel = 'brand') AS brand, string_agg(a2, '/' ORDER BY a2) FILTER (rel = 'instance') AS instance FROM facts WHERE rel IN ('brand', 'instance') AND src = 'part' GROUP BY a1")
def fact_sheet(spark, d):
    return decisions.sheet(warehouse(spark, d).filter("src = 'part'"), ["brand", "instance"])


@query()
def one_dimensional_clusters(spark, d):
    return decisions.grouped_k_means(_t(spark, d, "part"), "p_type", F.col("p_size"), 3)


# --- axiom selection -----------------------------------------------------------------------------------------------


def _occurrences(spark, d) -> DataFrame:
    part = _t(spark, d, "part")
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("axiom"), F.explode(F.array("p_brand", "p_type", F.concat(F.lit("size"), F.col("p_size").cast("string")))).alias("symbol"))


_OCC = "WITH RECURSIVE occ AS (SELECT DISTINCT 'P' || p_partkey AS axiom, unnest([p_brand, p_type, 'size' || p_size]) AS symbol FROM part), deg AS (SELECT symbol, count(*) AS degree FROM occ GROUP BY symbol), fired AS (SELECT axiom, symbol FROM (SELECT axiom, symbol, degree, min(degree) OVER (PARTITION BY axiom) AS least FROM occ JOIN deg USING (symbol)) WHERE degree = least)"


@query(_OCC + " SELECT axiom, symbol FROM fired", facts=False)
def axiom_triggers(spark, d):
    return relevance.triggers(_occurrences(spark, d))


@query(_OCC + """, s1 AS (SELECT 'size7' AS symbol), a1 AS (SELECT DISTINCT axiom FROM fired WHERE symbol IN (SELECT symbol FROM s1)), s2 AS (SELECT DISTINCT symbol FROM occ WHERE axiom IN (SELECT axiom FROM a1)),
a2 AS (SELECT DISTINCT axiom FROM fired WHERE symbol IN (SELECT symbol FROM s2)) SELECT axiom, (CASE WHEN axiom IN (SELECT axiom FROM a1) THEN 1 ELSE 2 END)::INT AS depth FROM (SELECT axiom FROM a1 UNION SELECT axiom FROM a2)""", facts=False)
def selected_axioms(spark, d):
    return relevance.select(_occurrences(spark, d), spark.createDataFrame([("size7",)], "symbol string"), depth=2)


# --- files and formulas --------------------------------------------------------------------------------------------


def _file(spark, d) -> DataFrame:
    """All facts and one rule as knowledge files of about FILE_FACTS facts each, several of them a source."""
    facts = warehouse(spark, d)
    of = F.concat("src", F.lit("/"), F.pmod(F.xxhash64("rel", "a1", "a2", "a3", "a4"), F.lit(facts.count() // FILE_FACTS + 1)).cast("string"))
    files = facts.groupBy(of.alias("src")).agg(F.array_join(F.array_sort(F.collect_list(kif.fact_text(facts))), "\n").alias("text"))
    return files.unionByName(spark.createDataFrame([("rules/0", "; a rule\n(=> (instance ?X ?C) (member ?X ?C))")], "src string, text string"))


FILE_FACTS = 10_000


@query("""SELECT src, rel AS head, 'fact' AS kind, count(*) AS n, sum((a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT)::BIGINT AS args FROM facts GROUP BY src, rel UNION ALL SELECT 'rules', '=>', 'rule', 1, 2""")
def parsed_files(spark, d):
    source = F.split_part("src", F.lit("/"), F.lit(1)).alias("src")
    return kif.read(_file(spark, d)).groupBy(source, "head", "kind").agg(F.count("*").alias("n"), F.sum(F.size("args")).alias("args"))


@query("""x AS (SELECT 0 AS argnum, rel AS term FROM facts UNION ALL SELECT unnest([1, 2, 3, 4]), unnest([a1, a2, a3, a4]) FROM facts)
SELECT 'arg' AS kind, argnum::INT AS argnum, term, count(*) AS n FROM x WHERE term IS NOT NULL AND NOT regexp_matches(term, '^[+-]?[0-9]| ') GROUP BY ALL UNION ALL SELECT 'ant', NULL, 'instance', 1 UNION ALL SELECT 'cons', NULL, 'member', 1""")
def inverted_index(spark, d):
    return kif.index(kif.read(_file(spark, d))).groupBy("kind", "argnum", "term").agg(F.count("*").alias("n"))


@query("SELECT 0 AS depth, true AS list, count(*) AS n FROM facts UNION ALL SELECT 1, false, sum(1 + (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT)::BIGINT FROM facts")
def formula_nodes(spark, d):
    got = kif.nodes(kif.read(_file(spark, d)).filter("kind = 'fact'"))
    return got.groupBy("depth", F.col("token").isNull().alias("list")).agg(F.count("*").alias("n"))


_RULES = [
    "(=> (and (instance ?X Region) (part ?Y ?X)) (or (located ?Y ?X) (not (member ?Y ?X))))",
    "(<=> (sibling ?A ?B) (sibling ?B ?A))",
    "(forall (?X) (=> (instance ?X Nation) (exists (?Y) (and (instance ?Y Region) (part ?X ?Y)))))",
    "(subclass Nation Region)",
    "(unbalanced (formula",
]


@query()
def clausal_form(spark, d):
    rules = spark.createDataFrame(list(enumerate(_RULES)), "id int, text string")
    return rules.select("id", F.posexplode(fo.clausify(F.col("text"))).alias("clause", "c")).select("id", "clause", "c.neg", "c.pos")


@query("SELECT * FROM (VALUES (0, true, false, false, false), (1, true, false, false, false), (2, false, false, false, false), (3, false, true, true, true), (4, NULL, NULL, NULL, NULL)) v(id, rule, horn, \"ground\", simple)", facts=False)
def formula_kinds(spark, d):
    rules = spark.createDataFrame(list(enumerate(_RULES)), "id int, text string")
    # a rule whose quantifiers bind its parts isn't ground: its variables occur
    got = rules.select("id", fo.classify(F.col("text")).alias("k")).select("id", "k.rule", "k.horn", "k.ground", "k.simple")
    return got


_WRITTEN = "CASE WHEN contains({0}, ' ') THEN '\"' || {0} || '\"' ELSE {0} END"


@query("SELECT DISTINCT '(' || concat_ws(' ', " + ", ".join(_WRITTEN.format(c) for c in ("rel", "a1", "a2", "a3", "a4")) + ") || ')' AS value FROM facts")
def fact_file(spark, d):
    facts = warehouse(spark, d)
    return facts.select(kif.fact_text(facts).alias("value")).distinct()


_TPTP_TERM = "CASE WHEN contains({0}, ' ') THEN chr(39) || {0} || chr(39) WHEN regexp_full_match({0}, '[0-9]+') THEN {0} WHEN regexp_full_match(replace({0}, '-', '_'), '[A-Za-z0-9_]*') THEN 's__' || replace({0}, '-', '_') ELSE chr(39) || 's__' || replace({0}, '-', '_') || chr(39) END"


@query("t AS (SELECT src, 's__' || rel || '(' || concat_ws(',', " + ", ".join(_TPTP_TERM.format(c) for c in ("a1", "a2", "a3", "a4")) + ") || ')' AS t FROM facts) SELECT 'fof(kb_' || row_number() OVER (ORDER BY place, t) || ',axiom,(' || t || ')).' AS value FROM (SELECT t, min(src) AS place FROM t GROUP BY t)")
def tptp_axioms(spark, d):
    return exports.tptp_facts(warehouse(spark, d))


@query("SELECT rel || '(' || concat_ws(',', " + ", ".join(f"lower({c}[1]) || regexp_replace({c}[2:], '[^A-Za-z0-9_]', '_', 'g')" for c in ("a1", "a2", "a3", "a4")) + ") || ').' AS value FROM facts")
def prolog_facts(spark, d):
    return exports.prolog_facts(warehouse(spark, d))


@query("SELECT p_partkey || ',\"' || p_name || '\",' || p_size || ',' AS value FROM part", facts=False)
def sheet_lines(spark, d):
    return _t(spark, d, "part").select(exports.csv_line(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string"), trailing=True).alias("value"))


@query("SELECT DISTINCT '  \"' || a1 || '\" -> \"' || a2 || '\" [ label = \"' || rel || '\" ];' AS value FROM facts WHERE rel = 'subclass'")
def graph_lines(spark, d):
    return exports.dot_edges(index.semantic_network(warehouse(spark, d).filter("rel = 'subclass'")))


@query("SELECT rel, a1, a2 FROM facts WHERE rel = 'subclass'")
def rdf_round_trip(spark, d):
    return exports.rdf_facts(exports.rdf_classes(warehouse(spark, d)))


@query("SELECT rel, a1, a2, a1 || ' is an instance of ' || a2 AS text FROM facts WHERE rel = 'instance' AND src = 'supplier' UNION ALL SELECT rel, a1, a2, a1 || ' is a kind of ' || a2 FROM facts WHERE rel = 'subclass'")
def paraphrases(spark, d):
    templates = spark.createDataFrame([("instance", "%1 is %n{not} an instance of %2"), ("subclass", "%1 is %n{not} a kind of %2")], "rel string, template string")
    return exports.paraphrase(warehouse(spark, d).filter("rel = 'subclass' OR src = 'supplier'"), templates)


@query("SELECT o_orderkey AS sent_id, '(agent Buying-' || o_orderkey || ' C' || o_custkey || ')' AS formula FROM orders", facts=False)
def rewritten_literals(spark, d):
    o = _t(spark, d, "orders")
    lits = o.select(F.col("o_orderkey").alias("sent_id"), F.explode(F.array(F.struct(F.lit(1).alias("lit_id"), F.lit("nsubj").alias("pred"), F.concat(F.lit("buys-"), F.col("o_orderkey").cast("string")).alias("arg1"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("arg2")), F.struct(F.lit(2).alias("lit_id"), F.lit("verb").alias("pred"), F.concat(F.lit("buys-"), F.col("o_orderkey").cast("string")).alias("arg1"), F.concat(F.lit("Buying-"), F.col("o_orderkey").cast("string")).alias("arg2")))).alias("l")).select("sent_id", "l.*")
    return rewrite.rewrite(lits, "nsubj(?V,?S), verb(?V,?E) ==> {(agent ?E ?S)}.\n")


@query()
def proof_steps(spark, d):
    steps = _t(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("step"), F.when(F.col("o_orderkey") > 2, F.array((F.col("o_orderkey") / 2).cast("int"), (F.col("o_orderkey") / 3).cast("int"))).otherwise(F.array().cast("array<int>")).alias("premises"))
    return closure.simplest_first_proof(steps, 100).select("step", "number")


# --- order, sets and listings --------------------------------------------------------------------------------------


@query(_TERMS + " SELECT term FROM (SELECT term FROM terms WHERE term <= 'NATION_2' ORDER BY term DESC LIMIT 8) ORDER BY term LIMIT 1")
def term_before(spark, d):
    return index.neighbour(warehouse(spark, d), "NATION_2", -7)


@query(_TERMS + " SELECT max(term) AS term FROM terms")
def term_after_clamped(spark, d):
    return index.neighbour(warehouse(spark, d), "subclass", 1000)


@query(_TERMS + " SELECT term FROM (SELECT term FROM terms WHERE term > 'NATION_2' ORDER BY term LIMIT 9) ORDER BY term DESC LIMIT 1")
def term_after(spark, d):
    return index.neighbour(warehouse(spark, d), "NATION_2", 9)


@query(_MENTIONS + " SELECT term FROM (SELECT term FROM mentions WHERE src = 'customer' UNION SELECT rel FROM facts WHERE src = 'customer') INTERSECT SELECT term FROM (SELECT term FROM mentions WHERE src = 'supplier' UNION SELECT rel FROM facts WHERE src = 'supplier')")
def common_terms(spark, d):
    return index.common_terms(warehouse(spark, d), "customer", "supplier")


@query("SELECT rel, a1, a2 FROM facts WHERE rel = 'brand' ORDER BY a2, a1 LIMIT 25 OFFSET 50")
def listing_page(spark, d):
    return index.page(warehouse(spark, d).filter("rel = 'brand'").select("rel", "a1", "a2"), ["a2", "a1"], 50, 25)


@query(_TERMS + " SELECT term, (row_number() OVER (ORDER BY length(term) DESC, term))::INT AS number FROM terms")
def terms_by_length(spark, d):
    return index.by_length(terms(warehouse(spark, d)))


@query("SELECT 'P' || p_partkey AS term, p_name AS name, (row_number() OVER (ORDER BY lower(p_name), 'P' || p_partkey))::INT AS number FROM part", facts=False)
def terms_by_shown_name(spark, d):
    part = _t(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("term"), F.col("p_name").alias("name"))
    return index.by_presentation(part.select("term"), part)


@query("SELECT rel, a1, list_sort(list(DISTINCT a2)) AS \"values\" FROM facts WHERE a3 IS NULL GROUP BY rel, a1")
def values_by_key(spark, d):
    return index.values_by_key(warehouse(spark, d).filter("a3 IS NULL"), ["rel", "a1"], "a2")


@query("SELECT rel, a1, a2, a3, a4, src FROM facts WHERE src <> 'customer'")
def without_assertions(spark, d):
    return index.without_source(warehouse(spark, d), "customer")


@query(_UP + " SELECT 'subclass' AS rel, child, parent FROM up EXCEPT SELECT 'subclass', child, parent FROM sub", recursive=True)
def cached_facts(spark, d):
    facts = warehouse(spark, d)
    return index.implied(facts, taxonomy.ancestors(facts).select(F.lit("subclass").alias("rel"), "child", "parent"))


# --- more of classes -----------------------------------------------------------------------------------------------


@query("""sig AS (SELECT DISTINCT rel, pos, CASE WHEN rel = 'subclass' THEN 'Class+' ELSE 'Entity' END AS type FROM (SELECT rel, unnest([1, 2]) AS pos FROM facts)) SELECT rel FROM sig GROUP BY rel HAVING NOT bool_or(suffix(type, '+'))""")
def instance_relations(spark, d):
    facts = warehouse(spark, d)
    sig = facts.select("rel", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).distinct().withColumn("type", F.when(F.col("rel") == "subclass", "Class+").otherwise("Entity"))
    return taxonomy.instance_relations(facts.select("rel").distinct(), sig)


@query("SELECT DISTINCT a1 AS term FROM facts WHERE rel IN ('involves', 'soldBy', 'orderedBy') AND a2 = 'S3'")
def expanded_node(spark, d):
    return taxonomy.expand(warehouse(spark, d), "S3", "involves")


@query("""m AS (SELECT r_name AS child, 'map_' || r_name AS term FROM region UNION ALL SELECT n_name, 'map_' || n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'Entity', 'top'),
e AS (SELECT a1 AS child, a2 AS parent FROM facts WHERE rel IN ('subclass', 'instance')),
r AS (SELECT child, child AS at_, 0 AS steps FROM (SELECT child FROM e UNION SELECT parent FROM e) UNION SELECT r.child, e.parent, steps + 1 FROM r JOIN e ON e.child = at_ WHERE at_ NOT IN (SELECT child FROM m))
SELECT r.child, arg_min(m.term, (steps, m.term)) AS term, min(steps)::INT AS steps FROM r JOIN m ON m.child = at_ GROUP BY r.child""", recursive=True)
def nearest_mappings(spark, d):
    facts = warehouse(spark, d)
    to = lambda df, c: df.select(F.col(c).alias("child"), F.concat(F.lit("map_"), c).alias("term"))
    mapped = to(_t(spark, d, "region"), "r_name").unionByName(to(_t(spark, d, "nation").filter("n_nationkey % 2 = 0"), "n_name")).unionByName(spark.createDataFrame([("Entity", "top")], "child string, term string"))
    return taxonomy.nearest_mapped(taxonomy.edges(facts, "subclass").unionByName(taxonomy.edges(facts, "instance")), mapped)


# --- more of strings and words -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, lower(p[1]) || p[2:] AS relation, list_aggregate([w[1] || lower(w[2:]) FOR w IN string_split(x, '_')], 'string_agg', '') AS term, CASE WHEN p LIKE '5%' THEN 'low' WHEN p LIKE '%U%' THEN 'urgent' ELSE '' END AS level,
[w FOR w IN string_split(p, '-') IF regexp_full_match(w, '[0-9]+')] AS kept, [w FOR w IN string_split(p, '-') IF NOT regexp_full_match(w, '[0-9]+')] AS others
FROM (SELECT o_orderkey, o_orderpriority AS p, replace(replace(o_orderpriority, '-', '_'), ' ', '_') AS x FROM orders)""", facts=False)
def identifiers(spark, d):
    p = F.col("o_orderpriority")
    parts = F.split(p, "-")
    return _t(spark, d, "orders").select("o_orderkey", st.relation_id(p).alias("relation"), st.all_caps_id(F.regexp_replace(p, "[- ]", "_")).alias("term"), st.pattern_value([("5.*", "low"), (".*U.*", "urgent")], p).alias("level"), st.retained(parts, "[0-9]+").alias("kept"), st.retained(parts, "[0-9]+", True).alias("others"))


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents"


@query(f"""SELECT word, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' WHEN regexp_matches(word, '(s|x|ch|sh|z)$') OR word = 'go' THEN word || 'es' WHEN word = 'be' THEN 'are' ELSE word || 's' END AS plural, word[1] IN ('a', 'e', 'i', 'o', 'u') AS vowel FROM ({_WORDS})""", facts=False)
def verb_plurals(spark, d):
    words = text.term_counts(_t(spark, d, "documents"), "doc_id").select(F.col("term").alias("word")).distinct()
    return words.select("word", st.verb_plural(F.col("word")).alias("plural"), st.is_vowel(F.substring("word", 1, 1)).alias("vowel"))


@query(f"""WITH w AS ({_WORDS}), known AS (SELECT word AS root FROM w WHERE length(word) % 2 = 0), e AS (SELECT * FROM (VALUES ('was', 'be'), ('went', 'go'), ('are', 'be')) v(word, root)),
r AS (SELECT * FROM (VALUES ('s', '', 0), ('es', '', 1), ('ies', 'y', 2), ('ed', '', 3), ('ed', 'e', 4), ('ing', 'e', 5), ('ing', '', 6), ('', '', 7)) v(ending, form, i)),
t AS (SELECT word, left(word, length(word) - length(ending)) || form AS root, i FROM w JOIN r ON suffix(word, ending)), b AS (SELECT word, arg_min(root, i) AS root FROM t JOIN known USING (root) GROUP BY word)
SELECT w.word, coalesce(e.root, b.root) AS root FROM w LEFT JOIN e USING (word) LEFT JOIN b USING (word)""", facts=False)
def verb_roots(spark, d):
    words = text.term_counts(_t(spark, d, "documents"), "doc_id").select(F.col("term").alias("word")).distinct()
    exceptions = spark.createDataFrame([("was", "be"), ("went", "go"), ("are", "be")], "form string, root string")
    return lexicon.verb_root(words, exceptions, words.filter("length(word) % 2 = 0"))


@query(f"""WITH {_TOKENS}, concepts AS (SELECT * FROM (VALUES ('the', 'Article'), ('der', 'Article'), ('idiot', 'Insult'), ('clown', 'Insult'), ('est', 'Being')) v(word, concept)), n AS (SELECT concept, count(*) AS n FROM words JOIN concepts ON term = word WHERE concept <> 'Being' GROUP BY concept)
SELECT concept, n, (row_number() OVER (ORDER BY n DESC, concept))::INT AS place FROM n""", facts=False)
def top_concepts(spark, d):
    return text.concept_histogram(text.term_counts(_t(spark, d, "documents"), "doc_id"), spark.createDataFrame(CONCEPTS, "word string, concept string"), ["Being"], 5)


_KINDS_OF_SENSES = [("the", "the_n", 1, 1, "of", 3), ("the", "the_n", 1, 1, "and", 1), ("the", "the_v", 2, 1, "to", 4), ("la", "la_n", 1, 1, "de", 2), ("la", "la_v", 2, 1, "que", 4)]


@query(f"""WITH {_TOKENS}, t AS (SELECT DISTINCT doc_id, term FROM words), senses AS (SELECT * FROM (VALUES {', '.join(map(str, _KINDS_OF_SENSES))}) v(word, sense, kind, o, companion, n)),
s AS (SELECT x.doc_id, word, sense, kind, sum(n)::BIGINT AS total FROM t x JOIN senses ON x.term = word JOIN t y ON y.doc_id = x.doc_id AND y.term = companion GROUP BY ALL)
SELECT doc_id, word, sense, kind::INT AS kind, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY total DESC, kind DESC) AS place FROM s) WHERE place = 1 AND total > 3""", facts=False)
def senses_across_kinds(spark, d):
    words = text.term_counts(_t(spark, d, "documents"), "doc_id").withColumnRenamed("term", "word")
    senses = spark.createDataFrame(_KINDS_OF_SENSES, "word string, sense string, kind int, sense_order int, companion string, n long")
    return text.best_across_kinds(words, "doc_id", F.broadcast(senses), 3)


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events", facts=False)
def json_members(spark, d):
    return lexicon.json_pairs(_t(spark, d, "events"), "event_id", "props")


# --- more of files and formulas ------------------------------------------------------------------------------------


@query("SELECT unnest(['(hasName C' || c_custkey || ' \"' || c_name || '\")', '(inSegment C' || c_custkey || ' \"' || c_mktsegment || '\")']) AS value FROM customer", facts=False)
def cell_statements(spark, d):
    return exports.statements(_t(spark, d, "customer").withColumn("key", F.concat(F.lit("C"), F.col("c_custkey").cast("string"))), "key", {"c_name": "hasName", "c_mktsegment": "inSegment"})


@query("""w AS (SELECT rel, max((a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT) AS n FROM facts GROUP BY rel)
SELECT 'create table ' || rel || ' (' || list_aggregate(['a' || i || ' varchar /* Entity */' FOR i IN range(1, n + 1)], 'string_agg', ', ') || ');' AS value FROM w""")
def table_definitions(spark, d):
    signature = taxonomy.valence(warehouse(spark, d)).select("rel", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pos"), F.lit("Entity").alias("type"))
    return exports.table_definitions(signature)


@query("SELECT DISTINCT rel, a1, a2 FROM facts WHERE rel IN ('instance', 'subclass', 'brand')")
def tptp_round_trip(spark, d):
    facts = warehouse(spark, d).filter("rel IN ('instance', 'subclass', 'brand')")
    return exports.tptp_atoms(exports.tptp_facts(facts)).select("rel", F.col("args")[0].alias("a1"), F.col("args")[1].alias("a2"))


def _order_rules(spark, d) -> DataFrame:
    """(id, text): a rule an order, quantified in vain for every third."""
    key = F.col("o_orderkey").cast("string")
    vain = F.when(F.col("o_orderkey") % 3 == 0, "?W").otherwise("?X")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("(exists ("), vain, F.lit(") (orderedBy O"), key, F.lit(" ?X))")).alias("text"))


@query("SELECT o_orderkey AS id, ['?W'] AS variables FROM orders WHERE o_orderkey % 3 = 0", facts=False)
def quantified_in_vain(spark, d):
    return diagnostics.quantified_in_vain(_order_rules(spark, d)).select("id", "variables")


@query("SELECT o_orderkey AS id, '(exists (' || CASE WHEN o_orderkey % 3 = 0 THEN '?W' ELSE '?X' END || ') (orderedBy Some ?X))' AS text FROM orders", facts=False)
def replaced_terms(spark, d):
    return _order_rules(spark, d).select("id", fo.replaced(F.col("text"), "O[0-9]+", "Some").alias("text"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN [['?A', 'O' || o_orderkey], ['?B', 'C' || o_custkey]] END AS bound FROM orders", facts=False)
def unifiers(spark, d):
    o, c = F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    left = F.when(F.col("o_orderkey") % 2 == 0, "(orderedBy ?A (by ?B))").otherwise("(orderedBy ?A (by ?A))")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fo.unifier(left, F.concat(F.lit("(orderedBy "), o, F.lit(" (by "), c, F.lit("))"))).alias("bound"))


@query("""SELECT o_orderkey AS id, unnest(['(forall (?Y) (=> (instance ?Y Person) (=> (orderedBy O' || o_orderkey || ' ?Y) (list_3 a b ?Y))))', '(forall (?Y) (=> (instance ?Y Person) (=> (soldBy O' || o_orderkey || ' ?Y) (list_3 a b ?Y))))']) AS text FROM orders""", facts=False)
def preprocessed_rules(spark, d):
    #: Keys alone are dealt out, to a set number of tasks: they are small and their rules' work isn't, which neither row groups nor merged partitions would follow.
    keys = _t(spark, d, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rules = keys.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("(=> (?REL O"), F.col("o_orderkey").cast("string"), F.lit(" ?Y) (list a b ?Y))")).alias("text"))
    signature = {("orderedBy", 2): "Person", ("soldBy", 2): "Person", ("contains", 2): "Part"}
    made = fo.preprocess(F.col("text"), {"orderedBy": 2, "soldBy": 2, "contains": 4}, signature, {}, frozenset({"list"}))
    return rules.select("id", F.explode(made).alias("text"))
