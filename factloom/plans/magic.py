"""Goal-directed evaluation of Horn rules: the goal's bindings are passed sideways into the rules (magic sets).

Rules and facts are those of closure.evaluate. For a goal such as ("below", "C1", "?y") each derived relation gets one version for each
pattern of bound and free arguments that the goal leads to, and a relation of the bindings that are asked for;
a rule then only joins facts that some asked binding reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import connected_order, evaluate


def _is_variable(a: str) -> bool:
    return a.startswith("?")


def _pattern(args: tuple[str, str], bound: set[str]) -> str:
    return "".join("b" if not _is_variable(a) or a in bound else "f" for a in args)


def _asked(rel: str, pattern: str, args: tuple[str, str]) -> tuple[str, str, str] | None:
    """The atom of asked bindings: one bound argument stands twice; none for a pattern without any."""
    if pattern == "ff":
        return None
    x, y = (a for a, p in zip((*args, *args), pattern * 2, strict=True) if p == "b") if pattern != "bb" else args
    return f"asked {pattern} {rel}", x, y


def rewritten(rules: list[dict], goal: tuple[str, str, str]) -> tuple[list[dict], str, tuple[str, str, str] | None]:
    """(rules, the goal's relation, the first asked fact). Body atoms are taken so that each shares a bound variable where it
    can, and pass their bindings on to the next."""
    derived = {r["head"][0] for r in rules}
    first = _pattern(goal[1:], set())
    out, todo, seen = [], [(goal[0], first)], {(goal[0], first)}
    while todo:
        rel, pattern = todo.pop()
        for rule in (r for r in rules if r["head"][0] == rel):
            head = rule["head"]
            bound = {a for a, p in zip(head[1:], pattern, strict=True) if p == "b" and _is_variable(a)}
            asked = _asked(rel, pattern, head[1:])
            body = [asked] if asked else []
            for atom in connected_order(rule["body"], bound):
                if atom[0] in derived:
                    inner = _pattern(atom[1:], bound)
                    if (want := _asked(atom[0], inner, atom[1:])) and want not in body:
                        if body:
                            out.append({"head": want, "body": list(body)})
                        else:  # nothing is bound yet but constants
                            out.append({"head": want, "body": [("true", "t", "t")]})
                    if (atom[0], inner) not in seen:
                        seen.add((atom[0], inner))
                        todo.append((atom[0], inner))
                    atom = (f"{inner} {atom[0]}", *atom[1:])
                body.append(atom)
                bound |= {a for a in atom[1:] if _is_variable(a)}
            out.append({"head": (f"{pattern} {rel}", *head[1:]), "body": body})
    #: Facts of a derived relation count as well.
    for rel, pattern in seen:
        asked = _asked(rel, pattern, ("?x", "?y"))
        out.append({"head": (f"{pattern} {rel}", "?x", "?y"), "body": [*([asked] if asked else []), (rel, "?x", "?y")]})
    return out, f"{first} {goal[0]}", _asked(goal[0], first, goal[1:])


def bound_domains(rules: list[dict], domain: str) -> list[dict]:
    """Rules whose heads have variables that no body atom binds get an atom of the domain for each of those, and only those."""
    out = []
    for r in rules:
        have = {a for _, *args in r["body"] for a in args}
        free = [a for a in dict.fromkeys(r["head"][1:]) if _is_variable(a) and a not in have]
        out.append({"head": r["head"], "body": [*r["body"], *((domain, a, a) for a in free)]})
    return out


def answers(facts: DataFrame, rules: list[dict], goal: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """((a1, a2) of the goal's answers, all facts that were derived for them)."""
    program, rel, asked = rewritten(rules, goal)
    used = sorted({b[0] for r in program for b in r["body"]})
    base = facts.select("rel", "a1", "a2").filter(F.col("rel").isin(*used))
    more = [("true", "t", "t"), *([asked] if asked else [])]
    model = evaluate(base.unionByName(facts.sparkSession.createDataFrame(more, "rel string, a1 string, a2 string")), program)
    got = model.filter(F.col("rel") == rel)
    for k, a in enumerate(goal[1:]):
        if not _is_variable(a):
            got = got.filter(F.col(f"a{k + 1}") == a)
    if goal[1] == goal[2] and _is_variable(goal[1]):
        got = got.filter("a1 = a2")
    return got.select("a1", "a2"), model.filter("rel LIKE 'asked %' OR rel LIKE 'b_ %' OR rel LIKE 'f_ %'")
