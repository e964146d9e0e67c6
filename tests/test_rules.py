"""Clauses, congruence, goals, composites and phrases against brute force on small random inputs."""

import itertools
import random

import pytest

from factloom import rule_queries
from factloom.operators import composites, phrases
from factloom.plans import clauses, closure, congruence, magic

LITERALS = "clause string, neg boolean, pred string, args array<string>"


def _random_clauses(rng, n):
    out = []
    for i in range(n):
        lits = {(rng.random() < 0.4, p, tuple(rng.choice(["?X", "?Y", "?Z", "a", "b"]) for _ in range(k))) for p, k in rng.choices([("p", 2), ("q", 1), ("r", 3), ("s", 0)], k=rng.randint(1, 4))}
        out.append((f"c{i}", lits))
    return out


def _subsumes(c, d):
    if len(c) > len(d):
        return False

    def go(rest, bound):
        if not rest:
            return True
        neg, pred, args = rest[0]
        for n2, p2, a2 in d:
            if (n2, p2, len(a2)) != (neg, pred, len(args)):
                continue
            new, ok = dict(bound), True
            for x, y in zip(args, a2, strict=True):
                ok = ok and (new.setdefault(x, y) == y if x.startswith("?") else x == y)
            if ok and go(rest[1:], new):
                return True
        return False

    return go(list(c), {})


def _reduced(pairs):
    """Edges between classes of clauses that subsume each other, less those that follow."""
    name = {}
    for x in {x for p in pairs for x in p}:
        name[x] = min([x, *(y for y in {b for _, b in pairs} if (x, y) in pairs and (y, x) in pairs)])
    strict = {(name[a], name[b]) for a, b in pairs if name[a] != name[b]}
    return {(a, b) for a, b in strict if not any((a, m) in strict and (m, b) in strict for m in {x for _, x in strict})}


def test_subsumption(spark):
    made = _random_clauses(random.Random(3), 60)
    rows = [(c, *lit[:2], list(lit[2])) for c, lits in made for lit in lits]
    pairs = clauses.subsumptions(spark.createDataFrame([*rows, rows[0]], LITERALS))
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    got = {tuple(r) for r in pairs.collect()}
    want = {(a, b) for (a, c), (b, d) in itertools.permutations(made, 2) if _subsumes(c, d)}
    assert got == want and len(want) > 100
    assert {tuple(r) for r in clauses.subsumption_graph(pairs).collect()} == _reduced(want)
    plan = clauses.candidates(clauses.indexed(spark.createDataFrame(rows, LITERALS)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert clauses.subsumptions(spark.createDataFrame([], LITERALS)).collect() == []


def test_candidates_lose_no_pair_and_move_bits_for_features(spark):
    made = _random_clauses(random.Random(4), 50)
    indexed = clauses.indexed(spark.createDataFrame([(c, *lit[:2], list(lit[2])) for c, lits in made for lit in lits], LITERALS))
    rows = clauses._features(indexed)
    assert [t for _, t in rows.dtypes] == ["string", "int", "bigint", "bigint", "bigint", "bigint"]
    for r in rows.collect():
        assert r.low >> (r.f & 63) & 1 and r.high >> (r.f >> 6 & 63) & 1
    want = {(a, b) for (a, c), (b, d) in itertools.permutations(made, 2) if _subsumes(c, d)}
    assert want and want <= {tuple(r) for r in clauses.candidates(indexed).collect()}


def test_pure_clauses(spark):
    rng = random.Random(5)
    for size in (30,):
        made = {f"c{i}": [(rng.random() < 0.5, f"p{rng.randrange(size // 2)}") for _ in range(rng.randint(1, 3))] for i in range(size)} | {"e": [(False, "equal")]}
        left, want, level = dict(made), {}, 0
        while True:
            level += 1
            signs = {}
            for lits in left.values():
                for neg, p in lits:
                    signs.setdefault(p, set()).add(neg)
            gone = [c for c, lits in left.items() if any(len(signs[p]) == 1 and p != "equal" for _, p in lits)]
            if not gone:
                break
            want |= {c: level for c in gone}
            left = {c: x for c, x in left.items() if c not in gone}
        got = clauses.without_pure(spark.createDataFrame([(c, neg, p) for c, lits in made.items() for neg, p in lits], "clause string, neg boolean, pred string"))
        assert {r["clause"]: r["round"] for r in got.collect()} == want and len(want) > 2


def test_unused_definitions(spark):
    uses = [("d1", "p2"), ("d2", "p3"), ("d3", "p3"), ("d4", "p5"), ("d5", "p4"), ("q", "p6"), ("d6", "p7"), ("d8b", "p9")]
    definitions = [("d1", "p1"), ("d2", "p2"), ("d3", "p3"), ("d4", "p4"), ("d5", "p5"), ("d6", "p6"), ("d7", "p7"), ("d8a", "p8"), ("d8b", "p8"), ("d9", "p9")]
    got = clauses.unused_definitions(spark.createDataFrame(uses, "clause string, pred string"), spark.createDataFrame(definitions, "clause string, pred string"))
    #: p3 uses itself, p4 and p5 each other; p8 has two definitions.
    assert {tuple(r) for r in got.collect()} == {("d1", 1), ("d2", 2), ("d3", 3)}


def test_congruence(spark):
    for seed in (7,):
        rng = random.Random(seed)
        consts = [f"k{i}" for i in range(8)]
        names = list(consts)
        terms = []
        for i in range(40):
            fn, args = rng.choice("fg"), [rng.choice(names) for _ in range(rng.randint(1, 2))]
            terms.append((f"t{i:02d}", fn, args))
            names.append(f"t{i:02d}")
        equations = [tuple(rng.sample(names, 2)) for _ in range(6)]
        up = {n: n for n in names}

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        todo = list(equations)
        while todo:
            for a, b in todo:
                x, y = sorted((top(a), top(b)))
                up[y] = x
            seen, todo = {}, []
            for t, fn, args in terms:
                key = (fn, tuple(map(top, args)))
                if top(seen.setdefault(key, t)) != top(t):
                    todo.append((seen[key], t))
        got = congruence.classes(spark.createDataFrame(terms, "term string, fn string, args array<string>"), spark.createDataFrame(equations, "a string, b string"))
        assert {r["term"]: r["rep"] for r in got.collect()} == {n: top(n) for n in {t for t, *_ in terms} | {a for *_, args in terms for a in args} | {x for e in equations for x in e}}


def test_connected(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)] + [("x", "y"), ("y", "y")]
    random.Random(1).shuffle(chain)
    got = {tuple(r) for r in congruence.connected(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {(f"{i:03d}", "000") for i in range(1, 71)} | {("y", "x")}


FACTS = "rel string, a1 string, a2 string"
RULES = [
    {"head": ("path", "?x", "?y"), "body": [("edge", "?x", "?y")]},
    {"head": ("path", "?x", "?z"), "body": [("path", "?x", "?y"), ("edge", "?y", "?z")]},
    {"head": ("same", "?x", "?y"), "body": [("up", "?x", "?u"), ("same", "?u", "?v"), ("up", "?y", "?v")]},
    {"head": ("same", "?x", "?y"), "body": [("flat", "?x", "?y")]},
    {"head": ("loop", "?x", "?x"), "body": [("path", "?x", "?x")]},
]


@pytest.fixture(scope="module")
def facts(spark):
    """Facts, and all that the rules derive from them."""
    rng = random.Random(2)
    rows = {("edge", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(16)} | {("up", f"m{i}", f"m{i // 2}") for i in range(2, 12)} | {("flat", "m1", "m1"), ("path", "n1", "extra")}
    table = spark.createDataFrame(sorted(rows), FACTS)
    model = closure.evaluate(table, RULES).collect()
    return table, rows, model


@pytest.mark.parametrize("goal", [("path", "?x", "n5"), ("path", "n1", "n5"), ("same", "m3", "?y"), ("loop", "?x", "?y"), ("path", "?x", "?x")])
def test_goals(facts, goal):
    table, rows, model = facts
    got, derived = magic.answers(table, RULES, goal)
    want = {(r.a1, r.a2) for r in model if r.rel == goal[0]}
    for k, a in enumerate(goal[1:]):
        want = {w for w in want if a.startswith("?") or w[k] == a}
    if goal[1] == goal[2]:
        want = {w for w in want if w[0] == w[1]}
    assert {tuple(r) for r in got.collect()} == want and want
    if not goal[1].startswith("?") and goal[0] == "same":
        assert derived.count() < len(model) - len(rows)


def test_goal_derives_fewer_facts(spark):
    """A hundred chains, of which the goal's is one."""
    facts = [("edge", f"c{c}n{i}", f"c{c}n{i + 1}") for c in range(100) for i in range(5)]
    table = spark.createDataFrame(facts, FACTS)
    got, derived = magic.answers(table, RULES, ("path", "c7n1", "?y"))
    assert {r.a2 for r in got.collect()} == {f"c7n{i}" for i in range(2, 6)}
    assert closure.evaluate(table, RULES).filter("rel = 'path'").count() == 1500 and derived.count() < 20


def test_unbound_heads_get_a_domain(spark):
    rules = magic.bound_domains([{"head": ("near", "?x", "?y"), "body": [("edge", "?x", "?x")]}, RULES[0]], "thing")
    assert [len(r["body"]) for r in rules] == [2, 1]
    facts = spark.createDataFrame([("edge", "a", "a"), ("edge", "a", "b"), ("thing", "k", "k"), ("thing", "l", "l")], FACTS)
    assert {tuple(r) for r in closure.evaluate(facts, rules).filter("rel = 'near'").select("a1", "a2").collect()} == {("a", "k"), ("a", "l")}


def test_closure_writes_each_pair_once(spark):
    import os
    import urllib.parse

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "child int, parent int")
    got = closure.closure(edges)
    files = [urllib.parse.unquote(f).removeprefix("file://") for f in got.inputFiles()]
    assert got.count() == 78 and len({os.path.dirname(f) for f in files}) == 13  # a folder a round, the last empty
    assert sum(spark.read.parquet(*{os.path.dirname(f)}).count() for f in {os.path.dirname(f): f for f in files}.values()) == 78


def test_composites(spark):
    edges = [("a", "C", False), ("a", "b", False), ("b", "d", False), ("b", "X", True), ("d", "a", False), ("C", "d", False), ("e", "e", False), ("a", None, False), ("a", "b", False)]
    table = spark.createDataFrame(edges, "whole string, part string, attribute boolean")
    children = {}
    for w, p, at in {e for e in edges if e[1]}:
        children.setdefault(w, []).append((not at, p.lower(), p, at))

    def walk(t, path, attribute):
        yield t, len(path), attribute
        for *_, p, at in sorted(children.get(t, [])):
            if p not in (*path, t):
                yield from walk(p, (*path, t), at)

    def text(t, path=()):
        inner = [text(p, (*path, t)) for *_, p, at in sorted(children.get(t, [])) if p not in (*path, t)]
        return f"({t} {' '.join(inner)})" if inner else t

    roots = spark.createDataFrame([("a",), ("b",), ("e",), ("lone",)], "term string")
    got = sorted(map(tuple, composites.composite_rows(table, roots).collect()))
    assert got == sorted((r, i, indent, t, at) for r in ("a", "b", "e", "lone") for i, (t, indent, at) in enumerate(walk(r, (), False), 1))
    assert {(r["root"], r["tree"], r["nodes"]) for r in composites.composite_trees(table, roots).collect()} == {(r, text(r), len(list(walk(r, (), False)))) for r in ("a", "b", "e", "lone")}
    assert composites.composite_trees(table, roots.limit(0)).collect() == []
    up = {(r["term"], r["whole"]): r["steps"] for r in composites.containing(table).collect()}
    assert up["X", "b"] == 1 and up["X", "a"] == 2 and up["X", "d"] == 3 and up["a", "a"] == 3 and up["e", "e"] == 1
    only = {(r["term"], r["whole"]) for r in composites.containing(table, spark.createDataFrame([("b",)], "term string")).collect()}
    assert ("X", "a") in only and ("X", "d") not in only


@pytest.mark.parametrize("most", [1000, 0])
def test_phrases(spark, most):
    rng = random.Random(6)
    listed = [[rng.choice("abc") for _ in range(rng.randint(1, 5))] for _ in range(12)] + [["kick", "the", "bucket"], ["kick", "the"], []]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "b", "c", "A", "x"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["They Kick the BUCKET now", "kick the", None, "", "a " * 3000, "They Kick the BUCKET now"]
    have = {tuple(p) for p in listed if p}

    def want(t):
        import re

        ws, out, at, n = re.findall("[A-Za-z0-9]+", t or ""), [], 0, 0
        while at < len(ws):
            k = max((k for k in range(1, 6) if tuple(w.lower() for w in ws[at : at + k]) in have and at + k <= len(ws)), default=0)
            out.append(ws[at] + "".join(w[0].upper() + w[1:] for w in ws[at + 1 : at + k]))
            n, at = n + (k > 0), at + max(k, 1)
        return n, " ".join(out)

    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, body string, phrases string")
    got = phrases.grouped(docs, spark.createDataFrame([(p,) for p in listed], "phrase array<string>"), "body", most).collect()
    assert {r["id"]: (r["phrases"], r["grouped"]) for r in got} == {i: want(t) for i, t in enumerate(texts)} and len(got) == len(texts)


def test_noun_groups(spark):
    rows = [(1, "nn", "factory-3", "car-2"), (1, "nn", "factory-3", "old-1"), (1, "det", "factory-3", "the-0"), (2, "nn", "x-2", "y-11"), (3, "nn", "bad", "y-1")]
    got = phrases.noun_groups(spark.createDataFrame(rows, "sent_id int, pred string, arg1 string, arg2 string"))
    assert {tuple(r) for r in got.collect()} == {(1, w, "oldcarfactory-1") for w in ("factory-3", "car-2", "old-1")} | {(2, "x-2", "xy-2"), (2, "y-11", "xy-2")}


def test_features_are_made_once_and_both_ways_to_choose_lose_no_pair(spark, monkeypatch):
    made = _random_clauses(random.Random(6), 40)
    table = spark.createDataFrame([(c, *lit[:2], list(lit[2])) for c, lits in made for lit in lits], LITERALS)
    want = {(a, b) for (a, c), (b, d) in itertools.permutations(made, 2) if _subsumes(c, d)}
    for kinds in (64, 1):  # in the row, by a join
        monkeypatch.setattr(clauses, "KINDS", kinds)
        pairs = clauses.candidates(clauses.indexed(table))
        assert "array_distinct" not in pairs._jdf.queryExecution().toString()  # features are read, not made anew
        assert want <= {tuple(r) for r in pairs.collect()}
        assert {tuple(r) for r in clauses.subsumptions(table).collect()} == want


def test_orders_are_read_once_for_their_rules(spark):
    plan = rule_queries._rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1


def test_subsumption_graph_writes_its_pairs_as_a_table(spark):
    rng = random.Random(7)
    above = {(a, b) for a, b in itertools.permutations(range(9), 2) if b % (a + 1) == 0 or rng.random() < 0.1}
    while more := {(a, d) for a, b in above for c, d in above if b == c and a != d} - above:
        above |= more
    alone = {(a, b) for a, b in itertools.permutations(range(1, 30), 2) if b % a == 0}
    for links in (above, alone):  # with clauses that subsume each other, and without
        rows = [(f"k{a:02}", f"k{b:02}") for a, b in links]
        got = clauses.subsumption_graph(spark.createDataFrame([*rows, rows[0], rows[-1]], "general string, special string"))
        assert sorted(map(tuple, got.collect())) == sorted(_reduced(set(rows)))
        assert "ExistingRDD" not in got._jdf.queryExecution().toString()
