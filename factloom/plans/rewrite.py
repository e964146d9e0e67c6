"""Rewriting of dependency literals by ordered rules.

A rule is "lhs ==> rhs." (matched literals are consumed, but those with a leading +), "lhs ?=> rhs." (they stay), or
"/- clause." (always added). Literals are pred(arg1,arg2); arguments that start with ? are variables; a literal with a
leading - must be absent. A right side in braces is a formula for the output, else literals that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PASSES = 10
_LITERAL = re.compile(r"\s*([+-]?)\s*([\w:]+)\(\s*([^,()\s]+)\s*,\s*([^,()\s]+)\s*\)\s*,?")


def literals(text: str) -> list[tuple[str, str, str, str]]:
    """(sign, pred, arg1, arg2)"""
    out, at = [], 0
    while m := _LITERAL.match(text, at):
        out.append(m.groups())
        at = m.end()
    if text[at:].strip():
        raise ValueError(f"not a literal: {text[at:].strip()}")
    return out


def rules(text: str) -> list[dict]:
    out = []
    for part in re.split(r"\.\s*(?:\n|$)", re.sub(r";[^\n]*", "", text)):
        part = part.strip()
        if not part:
            continue
        if part.startswith("/-"):
            out.append({"op": "/-", "lhs": [], "rhs": part[2:].strip()})
            continue
        m = re.match(r"(?s)(.*?)\s*(==>|\?=>)\s*(.*)", part)
        if not m:
            raise ValueError(f"not a rule: {part}")
        out.append({"op": m[2], "lhs": literals(m[1]), "rhs": m[3].strip()})
    return out


def _matches(lhs: list, facts: list[tuple], bound: dict, used: tuple = ()) -> Iterator[tuple[dict, tuple]]:
    """All bindings of the left side, with the facts that its literals match; absent ones are tried last."""
    if not lhs:
        yield bound, used
        return
    lhs = sorted(lhs, key=lambda x: x[0] == "-")
    (sign, pred, *args), rest = lhs[0], lhs[1:]

    def bind(fact: tuple) -> dict | None:
        if fact[0] != pred:
            return None
        new = dict(bound)
        for a, v in zip(args, fact[1:], strict=True):
            if a.startswith("?"):
                if new.setdefault(a, v) != v:
                    return None
            elif a != v:
                return None
        return new

    if sign == "-":
        if all(bind(f) is None for f in facts):
            yield from _matches(rest, facts, bound, used)
        return
    for f in facts:
        if f not in used and (new := bind(f)) is not None:
            yield from _matches(rest, facts, new, (*used, f if sign != "+" else ("+", *f)))


def interpret(facts: list[tuple[str, str, str]], program: list[dict]) -> tuple[list[tuple], list[str]]:
    """(literals that are left, formulas) after at most PASSES passes, rules in their order, first match first."""
    facts, out = list(dict.fromkeys(facts)), []
    for _ in range(PASSES):
        before = (list(facts), list(out))
        for rule in program:
            fill = lambda s, b: re.sub(r"\?\w+", lambda m: b.get(m[0], m[0]), s)
            for bound, used in list(_matches(rule["lhs"], facts, {})):
                consumed = [f for f in used if f[0] != "+"]
                if any(f not in facts for f in consumed):
                    continue  # an earlier match has taken it
                if rule["op"] == "==>":
                    facts = [f for f in facts if f not in consumed]
                made = fill(rule["rhs"], bound)
                if made.startswith("{"):
                    if (made := made.strip("{} ")) not in out:
                        out.append(made)
                elif made != "!":
                    facts += [x[1:] for x in literals(made) if x[1:] not in facts]
        if (facts, out) == before:
            break
    return facts, out


def rewrite(sentences: DataFrame, program: str) -> DataFrame:
    """(sent_id, formula) for literals (sent_id, lit_id, pred, arg1, arg2); a sentence's literals fit in a task."""
    parsed = rules(program)
    kind = sentences.schema["sent_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            ids, out = [], []
            for sent, *fact in zip(*(batch.column(c).to_pylist() for c in ("sent_id", "pred", "arg1", "arg2")), strict=True):
                if held and sent != key:
                    got = interpret(held, parsed)[1]
                    ids += [key] * len(got)
                    out += got
                    held = []
                key = sent
                held.append(tuple(fact))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("sent_id").type), pa.array(out, pa.string())], ["sent_id", "formula"])
            kept = batch.schema.field("sent_id").type
        if held:
            got = interpret(held, parsed)[1]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), kept), pa.array(got, pa.string())], ["sent_id", "formula"])

    dealt = sentences.repartition("sent_id").sortWithinPartitions("sent_id", "lit_id").select("sent_id", "pred", "arg1", "arg2")
    return dealt.mapInArrow(run, f"sent_id {kind}, formula string")
