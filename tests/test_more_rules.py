"""Predicate variables, consistency in order, hierarchies and OWL against brute force."""

import itertools
import random

from factloom.functions import formula as fo
from factloom.operators import argument_types, consistency, hierarchies
from factloom.operators import predicate_variables as pv
from factloom.sources import kif, owl


def test_predicate_variables(spark):
    formulas = [
        ("a", "(=> (instance ?R Sym) (<=> (?R ?X ?Y) (?R ?Y ?X)))"), ("b", "(forall (?R ?X) (=> (and (instance ?R Sym) (instance ?R Trans)) (holds ?R ?X)))"),
        ("c", "(=> (sub ?R ?S) (=> (?R ?X @ROW) (?S ?X @ROW)))"), ("d", "(?R a)"), ("e", "(?R a (?R b))"), ("f", "(p a b)"), ("g", "(=> (instance ?R None) (?R a b))"), ("h", "(and (?R a b) (?Q (f a) b c) (instance ?R Trans) (instance ?R Sym))"),
    ]
    arity = {"p": 2, "q": 2, "r$1": 2, "s": 1, "t": 3}
    members = {("p", "Sym"), ("q", "Sym"), ("q", "Trans"), ("r$1", "Trans"), ("t", "Rel"), ("p", "Rel"), ("q", "Rel"), ("s", "Rel")}
    signatures = [("sub", 1, "Rel"), ("sub", 2, "Sym")]
    table = spark.createDataFrame([(i, t, None) for i, t in formulas], "formula_id string, text string, error string")
    args = (spark.createDataFrame(list(arity.items()), "rel string, arity int"), spark.createDataFrame(sorted(members), "rel string, type string"), spark.createDataFrame(signatures, "rel string, pos int, type string"))
    got = {tuple(r) for r in pv.instantiated(table, kif.nodes(table), *args).collect()}

    want = set()
    for i, text in formulas:
        f, heads, needs = fo.parse(text), {}, {}

        def visit(x, heads=heads, needs=needs):
            if isinstance(x, str) or not x:
                return
            if fo.is_variable(x[0]):
                heads.setdefault(x[0], set()).add(None if any(str(y).startswith("@") for y in x) else len(x) - 1)
            if x[0] == "instance":
                needs.setdefault(x[1], set()).add(x[2])
            for r, pos, kind in signatures:
                if x[0] == r and len(x) > pos and isinstance(x[pos], str):
                    needs.setdefault(x[pos], set()).add(kind)
            for k, y in enumerate(x):
                if not (k == 1 and x[0] in ("forall", "exists")):
                    visit(y)

        visit(f)
        choices = []
        for v in sorted(heads):
            sizes = heads[v] - {None}
            choices.append([r for r in arity if (sizes <= {arity[r]} if sizes else needs.get(v)) and all((r, t) in members for t in needs.get(v, ()))])
        want |= {(i, fo.show(fo.substitute(f, dict(zip(sorted(heads), c, strict=True))))) for c in itertools.product(*choices)}
    assert got == want and {i for i, _ in want} == set("abcdfh")
    heads, types = pv.requirements(kif.nodes(table), args[2])
    assert {tuple(r) for r in pv.rejected(heads, pv.candidates(heads, types, *args[:2])).collect()} == {("e", "?R"), ("g", "?R")}


def _sequential(facts, above, disjoint):
    held, out = {}, []
    bad = lambda x, y: any((a, b) in disjoint or (b, a) in disjoint for a in above[x] | {x} for b in above[y] | {y})
    for place, inst, cls in sorted(facts):
        have = held.setdefault(inst, [])
        if any(bad(c, cls) for c in have if c != cls):
            out.append((place, inst, cls, "refused"))
        elif any(c == cls or cls in above[c] for c in have):
            out.append((place, inst, cls, "redundant"))
        else:
            out.append((place, inst, cls, "accepted"))
            have.append(cls)
    return sorted(out)


def test_consistency(spark):
    rng = random.Random(4)
    classes = [f"c{i}" for i in range(12)]
    above = {}
    for i, c in enumerate(classes):
        p = [classes[rng.randrange(i)]] if i and rng.random() < 0.7 else []
        above[c] = {x for q in p for x in above[q] | {q}}
    #: Disjoint classes of which neither stands above the other.
    pairs = [(a, b) for a, b in itertools.combinations(classes, 2) if a not in above[b] and b not in above[a]]
    disjoint = set(rng.sample(pairs, 10))
    disjoint = {(a, b) for a, b in disjoint if not any(a in above[x] | {x} and b in above[x] | {x} for x in classes)}
    facts = [(rng.randrange(200), f"i{rng.randrange(25)}", rng.choice(classes)) for _ in range(260)]
    up = spark.createDataFrame([(c, p) for c in classes for p in above[c]], "child string, parent string")
    apart = spark.createDataFrame(sorted(disjoint), "a string, b string")
    table = spark.createDataFrame([*facts, (5, None, "c1"), (5, "i1", None)], "place int, inst string, class string")
    want = _sequential(facts, above, disjoint)
    assert sorted(map(tuple, consistency.verdicts(table, up, apart).collect())) == want
    assert {v for *_, v in want} == {"accepted", "redundant", "refused"} and len(disjoint) > 4

    accepted, got = spark.createDataFrame([], "inst string, class string"), []
    for low in (0, 70, 140):
        batch = spark.createDataFrame([f for f in facts if low <= f[0] < low + 70], "place int, inst string, class string")
        rows = consistency.judge(accepted, batch, up, apart).collect()
        got += map(tuple, rows)
        new = [(r["inst"], r["class"]) for r in rows if r["verdict"] == "accepted"]
        accepted = spark.createDataFrame([*map(tuple, accepted.collect()), *new], "inst string, class string")
    assert sorted(got) == want
    assert consistency.judge(accepted, table.limit(0), up, apart).collect() == []


def test_consistency_without_rounds(spark):
    """Each class excludes the one before it, so a class is decided only after all before it; the jobs don't grow with their number."""
    n = 24
    facts = spark.createDataFrame([(i, "x", f"c{i:02d}") for i in range(n)] + [(n, "x", "c00"), (n + 1, "x", "c01")], "place int, inst string, class string")
    apart = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(n - 1)], "a string, b string")
    spark.sparkContext.setJobGroup("chain", "")
    try:
        got = consistency.verdicts(facts, spark.createDataFrame([], "child string, parent string"), apart).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r[::3] for r in map(tuple, got)) == [(i, "refused" if i % 2 else "accepted") for i in range(n)] + [(n, "redundant"), (n + 1, "refused")]
    assert 0 < len(jobs) < n


def test_hierarchies(spark):
    rng = random.Random(8)
    for _ in range(2):
        nodes, terms = [f"n{i:02d}" for i in range(30)], [f"t{i:02d}" for i in range(12)]
        edges = {(n, nodes[rng.randrange(i)]) for i, n in enumerate(nodes) if i for _ in range(rng.randint(1, 2))}
        upper = {(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i}
        up = set(upper)
        while new := {(a, d) for a, b in up for c, d in upper if b == c} - up:
            up |= new
        mapping = {(n, rng.choice(terms)) for n in nodes if rng.random() < 0.8 for _ in range(rng.randint(1, 2))}
        of = lambda n, mapping=mapping: {t for m, t in mapping if m == n}
        ok = lambda a, b, up=up, of=of: any(x == y or (x, y) in up for x in of(a) for y in of(b))
        want = set()
        for a, b in edges:
            if of(a) and of(b) and not ok(a, b):
                level, seen, steps, hit = {a}, {a}, 0, None
                while level and not hit:
                    level = {p for c, p in edges if c in level} - seen
                    seen |= level
                    steps += 1
                    hit = min((x for x in level if ok(a, x)), default=None)
                want.add((a, b, min(of(a)), min(of(b)), hit, steps if hit else None))
        frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
        got = hierarchies.disagreements(frame(edges, "child string, parent string"), frame(mapping, "node string, term string"), frame(up, "child string, parent string"))
        assert {tuple(r) for r in got.collect()} == want and want


def test_owl_reads_other_shapes(spark, tmp_path):
    text = """<?xml version="1.0"?><rdf:RDF>
<owl:Class rdf:ID="Wine"><rdfs:subClassOf rdf:resource="http://x.example/food#Drink"/><rdfs:subClassOf><owl:Class rdf:about="#Fluid"/></rdfs:subClassOf>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#hasMaker"/><owl:cardinality rdf:datatype="&xsd;int">1</owl:cardinality></owl:Restriction></rdfs:subClassOf>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#hasMaker"/><owl:allValuesFrom rdf:resource="#Winery"/></owl:Restriction></rdfs:subClassOf><rdfs:comment>a &lt;b&gt;</rdfs:comment></owl:Class>
<owl:Class rdf:nodeID="A7"><owl:disjointWith rdf:resource="#Wine"/></owl:Class>
<owl:FunctionalProperty rdf:about="#hasMaker"><rdfs:domain rdf:resource="#Wine"/><rdfs:range rdf:nodeID="A7"/></owl:FunctionalProperty><owl:DatatypeProperty rdf:ID="year"/>
<rdf:Description rdf:about="#Merlot"><rdf:type rdf:resource="#Wine"/><rdf:type rdf:resource="#Red"/></rdf:Description>
</rdf:RDF>"""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "wine.owl").write_text(text.replace("&xsd;", "xsd:"))
    got = {tuple(r) for r in owl.read(spark, f"{tmp_path}/in").collect()}
    blank = {a: {(r, y) for r, x, y in got if x == a} for _, _, a in got if a.startswith("_:") and a != "_:A7"}
    assert sorted(map(sorted, blank.values())) == [[("allValuesFrom", "Winery"), ("onProperty", "hasMaker")], [("cardinality", "1"), ("onProperty", "hasMaker")]]
    rest = {f for f in got if not f[1].startswith("_:") and f[2] not in blank}
    assert rest == {("subclass", "Wine", "Drink"), ("subclass", "Wine", "Fluid"), ("documentation", "Wine", "a <b>"), ("instance", "hasMaker", "SingleValuedRelation"), ("domain1", "hasMaker", "Wine"),
                    ("domain2", "hasMaker", "_:A7"), ("instance", "year", "BinaryRelation"), ("instance", "Merlot", "Wine"), ("instance", "Merlot", "Red")}
    assert ("disjoint", "_:A7", "Wine") in got and {("subclass", "Wine", b) for b in blank} <= got


def test_argument_types(spark):
    texts = ["(=> (likes ?X ?Y) (knows ?X ?Y))", "(likes Rex ?Z)", "(thinks Ann (likes Ann Rex))", "(knows Ann (fatherOf ?B))", "(age ?A 7)", "(thinks ?X (and (p ?X) q))", "(forall (?W) (odd ?W (says ?W)))", "(odd Rex Rex)"]
    table = spark.createDataFrame([(f"f{i}", t, None) for i, t in enumerate(texts)], "formula_id string, text string, error string")
    up = [("Dog", "Animal"), ("Dog", "Entity"), ("Human", "Animal"), ("Human", "Entity"), ("Animal", "Entity"), ("Man", "Human"), ("Man", "Animal"), ("Man", "Entity")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    args = (frame([("fatherOf",)], "rel string"), frame([("fatherOf", 0, "Man"), ("fatherOf", 1, "Human")], "rel string, pos int, type string"), frame([("Rex", "Dog"), ("Ann", "Human")], "inst string, type string"), frame(up, "child string, parent string"))
    got = {(r["rel"], r["pos"]): r["type"] for r in argument_types.inferred(kif.nodes(table), *args).collect()}
    #: Rex and Ann like, so what likes is an animal; knows shares both places, and what is known may be a man as well. Rex stands where a formula does.
    assert got == {("likes", 1): "Entity", ("likes", 2): "Entity", ("knows", 1): "Entity", ("knows", 2): "Entity", ("thinks", 1): "Entity", ("thinks", 2): "$o", ("fatherOf", 0): "Entity", ("fatherOf", 1): "Human", ("age", 1): "Entity",
                   ("age", 2): "Number", ("p", 1): "Entity", ("odd", 1): "Entity", ("odd", 2): "Entity", ("says", 1): "Entity"}
    without = {(r["rel"], r["pos"]): r["type"] for r in argument_types.inferred(kif.nodes(table.filter("formula_id <> 'f7' AND formula_id <> 'f6'")), *args).collect()}
    assert {k: without[k] for k in [("likes", 1), ("likes", 2), ("knows", 1), ("knows", 2), ("thinks", 1), ("thinks", 2), ("fatherOf", 0), ("fatherOf", 1), ("age", 1)]} == {
        ("likes", 1): "Animal", ("likes", 2): "Animal", ("knows", 1): "Animal", ("knows", 2): "Animal", ("thinks", 1): "Animal", ("thinks", 2): "$o", ("fatherOf", 0): "Animal", ("fatherOf", 1): "Human", ("age", 1): "Entity"}
    lines = {r["value"] for r in argument_types.declarations(frame([("likes", 1, "Dog"), ("likes", 2, "$o"), ("f o", 0, "Dog"), ("f o", 1, "Dog"), ("k", 0, "$o")], "rel string, pos int, type string")).collect()}
    assert lines == {"thf(likes,type,(likes: ($i > $o > $o))).", "thf('f o',type,('f o': ($i > $i))).", "thf(k,type,(k: ($o)))."}


def test_demands_meet_relations_once(spark):
    table = spark.createDataFrame([(f"f{i}", f"(=> (instance ?R {'T' if i % 2 else 'U'}) (?R a{i} ?X))") for i in range(60)], "formula_id string, text string").selectExpr("*", "CAST(NULL AS STRING) AS error")
    relations = spark.createDataFrame([(f"r{i}", 2) for i in range(40)], "rel string, arity int")
    members = relations.selectExpr("rel", "'T' AS type")
    signatures = spark.createDataFrame([], "rel string, pos int, type string")
    heads, types = pv.requirements(kif.nodes(table), signatures)
    asked, kinds = pv.needs(heads, types)
    assert asked.count() == 60 and kinds.count() == 2  # and not one a formula
    assert pv.fitting(kinds, relations, members).count() == 40
    assert {r["formula_id"] for r in pv.without_fit(heads, types, relations, members).collect()} == {f"f{i}" for i in range(0, 60, 2)}
    most, pv.small = pv.small, lambda df: df  # the join by blocks
    size, pv.BLOCK = pv.BLOCK, 7
    try:
        got = [tuple(r) for r in pv.instantiated(table, kif.nodes(table), relations, members, signatures).collect()]
    finally:
        pv.small, pv.BLOCK = most, size
    assert sorted(got) == sorted((f"f{i}", f"(=> (instance r{j} T) (r{j} a{i} ?X))") for i in range(1, 60, 2) for j in range(40))


def test_types_connect_places_only(spark, monkeypatch):
    texts = [f"(=> (in O{i} ?C) (paid ?C (priceOf O{i})))" for i in range(50)]
    table = spark.createDataFrame([(f"f{i}", t, None) for i, t in enumerate(texts)], "formula_id string, text string, error string")
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    args = (frame([("priceOf",)], "rel string"), frame([("in", 2, "Customer")], "rel string, pos int, type string"), frame([("O7", "Order")], "inst string, type string"), frame([("Order", "Entity")], "child string, parent string"))
    seen, whole = [], argument_types.connected
    monkeypatch.setattr(argument_types, "connected", lambda links: (seen.append(links.count()), whole(links))[1])
    want = {("in", 1): "Order", ("in", 2): "Customer", ("paid", 1): "Customer", ("paid", 2): "Entity", ("priceOf", 1): "Order"}
    for heads in (False, True):
        assert {(r["rel"], r["pos"]): r["type"] for r in argument_types.inferred(kif.nodes(table, heads), *args).collect()} == want
    assert max(seen) < 10  # whatever the number of formulas


def test_pure_clauses_make_their_literals_once(spark):
    from factloom.plans import clauses

    rows = [(f"c{i}", f"p{i}", True) for i in range(5)] + [(f"c{i}", f"p{i + 1}", False) for i in range(5)]
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    table = spark.createDataFrame(rows, "clause string, pred string, neg boolean").mapInArrow(run, "clause string, pred string, neg boolean")
    assert {r["clause"] for r in clauses.without_pure(table).collect()} == {f"c{i}" for i in range(5)}
    assert made.value == len(rows)


def _own_joins(df):
    plan = df._jdf.queryExecution().toString()
    return [x for x in ("Join", "BroadcastExchange", "CartesianProduct") if x in plan]


def test_nodes_are_no_side_of_a_join(spark):
    """Spark takes what is parsed from texts for as small as their columns, and would broadcast it."""
    texts = ["(=> (forall (?X ?Y) (?P ?X (f ?Y @R))) (exists (?Q) (and (instance ?P T) (?P a b) (likes ?P ?Q) (?Q))))", "((?Z a) b)", "(instance ?Z ?T)", "(forall ?V (?V a))"]
    table = spark.createDataFrame([(f"f{i}", t, None) for i, t in enumerate(texts)], "formula_id string, text string, error string")
    signatures = spark.createDataFrame([("likes", 1, "L"), ("likes", 2, "M"), ("f", 1, "N")], "rel string, pos int, type string")
    assert not _own_joins(pv._lists(kif.nodes(table)))
    heads, types = pv.requirements(kif.nodes(table), signatures)
    assert {tuple(r) for r in heads.collect()} == {("f0", "?P", 2), ("f0", "?Q", 0), ("f1", "?Z", 1), ("f3", "?V", 1)}
    assert {tuple(r) for r in types.collect()} == {("f0", "?P", "T"), ("f0", "?P", "L"), ("f0", "?Q", "M")}
    for df in (*pv.needs(heads, types), heads, types):
        assert not _own_joins(df)


def test_a_demand_that_many_fit_is_dealt_out_by_both_sides(spark, monkeypatch):
    monkeypatch.setattr(pv, "small", lambda df: df)  # the join by blocks
    monkeypatch.setattr(pv, "BLOCK", 7)
    asked = spark.range(30).selectExpr("concat('f', id) AS formula_id", "concat('t', id) AS text", "'n' AS need")
    fit = spark.range(210).selectExpr("'n' AS need", "concat('r', id) AS rel")
    met = pv._met(asked, fit)
    assert met.select("formula_id", "rel").distinct().count() == met.count() == 30 * 210
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().toString()
    assert max(r["count"] for r in met.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()) < 500  # of 6300; 7 of asked with all that fits them: 1470
