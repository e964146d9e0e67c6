"""Operators on micro-fixtures: cycles, ties, nulls, empty inputs."""

from pyspark.sql import functions as F

from factloom.operators import decisions, index, relevance, taxonomy, text
from factloom.plans import closure
from factloom.sources import lexicon
from factloom.streaming import append_assertions, with_overlay

FACT = "rel string, a1 string, a2 string, a3 string, a4 string, src string"


def _facts(spark, *rows):
    return spark.createDataFrame([(r[0], *(list(r[1:]) + [None] * 4)[:4], "t") for r in rows], FACT)


def test_closure_of_a_cycle_with_a_tail(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("s", "s"), (None, "a")], "child string, parent string")
    got = {tuple(r) for r in closure.closure(e).collect()}
    ring = {(x, y) for x in "abc" for y in "abc"}
    assert got == ring | {("t", x) for x in "abc"} | {("s", "s")}
    assert closure.closure(e.limit(0)).count() == 0


def test_instances_and_most_specific(spark):
    f = _facts(spark, ("subclass", "Dog", "Animal"), ("subclass", "Animal", "Entity"), ("instance", "Rex", "Dog"), ("instance", "Rex", "Unknown"))
    m = taxonomy.instances(f)
    assert {tuple(r) for r in m.collect()} == {("Rex", c) for c in ("Dog", "Animal", "Entity", "Unknown")}
    assert {r["class"] for r in taxonomy.most_specific(m, taxonomy.ancestors(f)).collect()} == {"Dog", "Unknown"}


def test_instances_of_classes_asked_for(spark):
    f = _facts(spark, ("subclass", "Dog", "Animal"), ("subclass", "Animal", "Entity"), ("instance", "Rex", "Dog"), ("instance", "Rex", "Animal"), ("instance", "Rex", "Unknown"), ("instance", "Tom", "Plant"))
    asked = spark.createDataFrame([("Animal",), ("Plant",), (None,), ("Dog",), ("Dog",)], "class string")
    assert sorted(map(tuple, taxonomy.instances(f, asked).collect())) == [("Rex", "Animal"), ("Rex", "Dog"), ("Tom", "Plant")]
    assert taxonomy.instances(f, asked.limit(0)).count() == 0


def test_first_round_derives_once(spark):
    """Where all facts are new, a rule of two atoms isn't joined for each of them."""
    facts = spark.createDataFrame([("p", "a", "b"), ("q", "b", "c"), ("q", "b", "d")], "rel string, a1 string, a2 string")
    rule = {"head": ("r", "?x", "?z"), "body": [("p", "?x", "?y"), ("q", "?y", "?z")]}
    assert sorted(map(tuple, closure.consequences([rule], facts, facts, True).collect())) == [("r", "a", "c"), ("r", "a", "d")]
    assert closure.evaluate(facts, [rule]).filter("rel = 'r'").count() == 2


def test_golden_rules(spark):
    facts = spark.createDataFrame([("subclass", "A", "B"), ("subclass", "B", "C"), ("subclass", "C", "A"), ("near", "x", "y"), ("near", "y", "z")], "rel string, a1 string, a2 string")
    rule = lambda rel: {"head": (rel, "?x", "?z"), "body": [(rel, "?x", "?y"), (rel, "?y", "?z")]}
    got = {tuple(r) for r in closure.evaluate(facts, [rule("subclass"), rule("near")]).collect()}
    assert ("subclass", "A", "A") in got and ("near", "x", "z") in got and len(got) == 12


def test_merge_keeps_what_was_there(spark):
    old = _facts(spark, ("p", "a"), ("p", "b", "c"))
    all_, same = index.merge(old, _facts(spark, ("p", "a"), ("p", "d"), ("p", "d")))
    assert all_.count() == 3 and [r.a1 for r in same.collect()] == ["a"]


def test_pattern_with_a_repeated_variable(spark):
    got = index.pattern(_facts(spark, ("p", "a", "a"), ("p", "a", "b")), "p", "?X", "?X").collect()
    assert [r.X for r in got] == ["a"]


def test_signatures_come_from_the_nearest(spark):
    domains = spark.createDataFrame([("top", 1, "Entity"), ("top", 2, "Entity"), ("mid", 1, "Animal")], "rel string, pos int, type string")
    sub = spark.createDataFrame([("mid", "top"), ("low", "mid")], "child string, parent string")
    got = {(r.rel, r.pos): r.type for r in taxonomy.inherit_signatures(domains, sub).collect()}
    assert got["low", 1] == "Animal" and got["low", 2] == "Entity" and got["mid", 2] == "Entity"


def test_axiom_selection(spark):
    o = spark.createDataFrame([("1", "rare"), ("1", "common"), ("2", "common"), ("2", "other"), ("3", "common"), ("3", "far")], "axiom string, symbol string")
    got = {r.axiom: r.depth for r in relevance.select(o, spark.createDataFrame([("rare",)], "symbol string")).collect()}
    assert got == {"1": 1}
    got = {r.axiom for r in relevance.select(o, spark.createDataFrame([("rare",)], "symbol string"), tolerance=3.0).collect()}
    assert got == {"1", "2", "3"}


def test_lexicon_lines(spark):
    line = "02084071 05 n 02 dog 0 domestic_dog 0 001 @ 02083346 n 0000 | a canine &%Canine="
    got = lexicon.synsets(spark.createDataFrame([(line,), ("  1 licence",)], "value string"))
    r = got.collect()
    assert len(r) == 1 and r[0].words == ["dog", "domestic_dog"] and (r[0].term, r[0].mapping) == ("Canine", "=")
    assert [tuple(x) for x in lexicon.hypernyms(got).collect()] == [("02084071", "02083346")]
    words = spark.createDataFrame([("dogs",), ("mice",), ("buses",), ("zzz",)], "word string")
    known = spark.createDataFrame([("dog",), ("bus",)], "word string")
    roots = lexicon.noun_root(words, spark.createDataFrame([("mice", "mouse")], "form string, root string"), known)
    assert {r.word: r.root for r in roots.collect()} == {"dogs": "dog", "mice": "mouse", "buses": "bus", "zzz": None}
    pairs = lexicon.companions(spark.createDataFrame([("bank_1 river_4 money_2 Term: x_9",)], "value string")).collect()
    assert {(r.companion, r.n) for r in pairs} == {("river", 4), ("money", 2)}


def test_assertions_as_a_stream(spark, tmp_path):
    _facts(spark, ("p", "a"), ("p", "new")).write.parquet(f"{tmp_path}/in")
    q = append_assertions(spark.readStream.schema(FACT).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at")
    q.awaitTermination(60)
    base = _facts(spark, ("p", "a"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert with_overlay(base.fillna(""), spark.read.parquet(f"{tmp_path}/out").fillna("")).count() == 2


def test_clusters_count_every_row(spark):
    rows = [("a", v) for v in [1.0] * 50 + [2.0, 9.0, 10.0, 10.0, None]] + [("b", 5.0), ("c", None)]
    got = decisions.grouped_k_means(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v"), 2).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 51, 52 / 51), ("a", 1, 3, 29 / 3), ("b", 0, 1, 5.0)]
    # no element is nearer to the other mean
    values = [float(i) for i in range(3000)]
    first, second = decisions.k_means(values, 2)
    border = (sum(first) / len(first) + sum(second) / len(second)) / 2
    assert first[-1] <= border <= second[0]
    # the clusters of three rows stand by every element's distance, repeats included
    many = [v for i in range(60) for v in [float(i)] * (1 + 40 * (i % 7 == 0))]
    parts = decisions.k_means(many, 3)
    means = [sum(p) / len(p) for p in parts]
    assert sorted(v for p in parts for v in p) == many and all(min(range(3), key=lambda j: abs(v - means[j])) == i for i, p in enumerate(parts) for v in p)


def test_weights_of_rare_and_common_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"all w{i % 3} only{i}") for i in range(12)] + [(0, "all again"), (99, None)], "id int, text string")
    whole = {tuple(r) for r in text.weights(text.term_counts(docs, "id"), "id", 12).collect()}
    monkeypatch.setattr(text, "small", lambda df: df)
    monkeypatch.setattr(text, "COMMON", 2)
    made = text.weights(text.term_counts(docs, "id"), "id", 12)
    assert {tuple(r) for r in made.collect()} == whole and made.count() == len(whole) == 37
    assert {(r["tf"], r["df"]) for r in made.filter("id = 0 AND term = 'all'").collect()} == {(2, 12)}


def test_pairs_of_names_come_once(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    pairs = decisions.name_pairs(names("Big Red Dog", "Big Red Dog", "cat"), names("redBig", "Dog big red", "Cow", None))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [("Big Red Dog", "Dog big red"), ("Big Red Dog", "redBig")]
    assert plan.index("Join") < plan.index("Aggregate")  # names are made distinct, not their pairs
    got = decisions.match_names(decisions.name_pairs(names("red dogs"), names("red dog", "red elephants")), 2).collect()
    assert [tuple(r) for r in got] == [("red dogs", "red dog", 1, 1)]
