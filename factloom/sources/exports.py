"""Facts and formulas as text in other notations. All are columns or one-column DataFrames, for write.text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from factloom.functions import formula as fo
from factloom.functions.strings import quote_cell, to_prolog_name
from factloom.operators.facts import ARGS
from factloom.plans.closure import numbered, small
from factloom.sources.kif import fact_text

#: Terms of facts that are written without Python: names, and values in words.
_NAME, _VALUE = r"[A-Za-z0-9_][A-Za-z0-9_#-]*", r"[A-Za-z0-9_#,.-]+(?: [A-Za-z0-9_#,.-]*)+"
_RELATION = r"^(?!(?:and|or|not|forall|exists|equal)\z)[A-Za-z][A-Za-z0-9_-]*\z"

_TPTP = {"and": " & ", "or": " | ", "=>": " => ", "<=>": " <=> "}


def tptp_term(x) -> str:
    if isinstance(x, list):
        return f"{tptp_term(x[0])}({','.join(tptp_term(y) for y in x[1:])})"
    if fo.is_variable(x):
        return "V__" + x[1:].replace("-", "_")
    if x[:1] == '"':
        return _quoted(re.sub(r"\\(.)", r"\1", x[1:-1]))
    if x.lstrip("+-").replace(".", "", 1).isdigit():
        return x
    name = "s__" + x.replace("-", "_")
    return name if re.fullmatch("[A-Za-z0-9_]+", name) else _quoted(name)


def _quoted(x: str) -> str:
    """A name that isn't a plain word stands in single quotes, which are escaped within, as is the mark that escapes."""
    return "'" + re.sub(r"([\\'])", r"\\\1", x) + "'"


def tptp_formula(f) -> str:
    """A first-order formula in TPTP's FOF notation, without the closing quantifier of free variables."""
    if isinstance(f, str):
        return tptp_term(f)
    if f[0] == "not":
        return f"~({tptp_formula(f[1])})"
    if f[0] in ("forall", "exists"):
        return f"({'!' if f[0] == 'forall' else '?'} [{','.join(map(tptp_term, f[1]))}] : {tptp_formula(f[2])})"
    if f[0] in _TPTP:
        return "(" + _TPTP[f[0]].join(map(tptp_formula, f[1:])) + ")"
    if f[0] == "equal":
        return f"({tptp_term(f[1])} = {tptp_term(f[2])})"
    return tptp_term(f)


@pandas_udf(StringType())
def to_tptp(texts: pd.Series) -> pd.Series:
    """The formula with its free variables quantified; null for higher-order or unbalanced ones."""
    return fo._each(lambda f: None if fo.is_higher_order(f) else tptp_formula(fo.close(f)), texts)


def prolog_rule(f) -> str | None:
    """A Horn formula as a Prolog clause, else None."""
    if not fo.is_horn(f):
        return None
    name = lambda x: x[0].lower() + x[1:].replace("-", "_") if not fo.is_variable(x) else x[1:].capitalize()
    atom = lambda x: name(x) if isinstance(x, str) else f"{name(x[0])}({','.join(map(atom, x[1:]))})"
    if not fo.is_rule(f):
        return atom(f) + "."
    body = f[1][1:] if f[1][0] == "and" else [f[1]]
    return f"{atom(f[2])} :- {', '.join(map(atom, body))}."


def tptp_file(parsed: DataFrame, skip: tuple[str, ...] = ("documentation", "format", "termFormat")) -> DataFrame:
    """(value): numbered axioms of formulas (text, head, src, start_line), each different one once, in their order."""
    return _axioms(parsed.filter(~F.coalesce("head", F.lit("")).isin(*skip)).select(to_tptp("text").alias("t"), F.struct("src", "start_line").alias("at")))


def tptp_facts(facts: DataFrame, skip: tuple[str, ...] = ("documentation", "format", "termFormat")) -> DataFrame:
    """tptp_file of facts' texts, each at line 1 of its src. Facts of names and values are columns already, and are
    written without being parsed anew; the others are parsed."""
    given = facts.filter(~F.coalesce("rel", F.lit("")).isin(*skip))
    easy = F.col("rel").rlike(_RELATION) & F.coalesce(*ARGS).isNotNull()
    for a in ARGS:
        easy &= F.col(a).isNull() | F.col(a).rlike(rf"^(?:{_NAME}|{_VALUE})\z")
    easy = F.coalesce(easy, F.lit(False))
    at = F.struct("src", F.lit(1).alias("start_line")).alias("at")
    plain = given.filter(easy).select(_atom_to_tptp("rel", *ARGS).alias("t"), at)
    return _axioms(plain.unionByName(given.filter(~easy).select(to_tptp(fact_text(facts)).alias("t"), at)))


def _atom_to_tptp(rel: str, *args: str) -> Column:
    name = lambda x: F.concat(F.lit("s__"), F.translate(x, "-", "_"))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))

    def term(a: str) -> Column:
        x = F.col(a)
        return F.when(x.contains(" "), quoted(x)).when(x.rlike(r"^[0-9]+\z"), x).when(x.contains("#"), quoted(name(x))).otherwise(name(x))

    return F.concat(name(F.col(rel)), F.lit("("), F.concat_ws(",", *map(term, args)), F.lit(")"))


def _axioms(made: DataFrame) -> DataFrame:
    made = made.filter("t IS NOT NULL").groupBy("t").agg(F.min("at").alias("at"))
    return numbered(made, "at", "t").select(F.concat(F.lit("fof(kb_"), F.col("number").cast("string"), F.lit(",axiom,("), "t", F.lit(")).")).alias("value"))


def prolog_facts(facts: DataFrame) -> DataFrame:
    args = F.concat_ws(",", *(to_prolog_name(F.col(a)) for a in ARGS))
    return facts.select(F.concat(to_prolog_name(F.col("rel")), F.lit("("), args, F.lit(").")).alias("value"))


def csv_line(*cells: Column, trailing: bool = False) -> Column:
    """Cells in quotes unless they are integers; trailing: with a comma at the end."""
    line = F.concat_ws(",", *(quote_cell(F.coalesce(c, F.lit(""))) for c in cells))
    return F.concat(line, F.lit(",")) if trailing else line


def dot_edges(edges: DataFrame) -> DataFrame:
    """(value): edges (a, rel, b) as lines of a DOT graph."""
    return edges.select(F.format_string('  "%s" -> "%s" [ label = "%s" ];', "a", "b", "rel").alias("value"))


def rdf_classes(facts: DataFrame) -> DataFrame:
    """(value): subclass facts as RDF/XML."""
    return facts.filter("rel = 'subclass'").select(F.concat(F.lit('<owl:Class rdf:ID="'), "a1", F.lit('"><rdfs:subClassOf rdf:resource="#'), "a2", F.lit('"/></owl:Class>')).alias("value"))


def rdf_facts(lines: DataFrame) -> DataFrame:
    """(rel, a1, a2) from such lines (value)."""
    take = lambda k: F.regexp_extract("value", '<owl:Class rdf:(?:ID|about)="#?([^"]+)">.*?<rdfs:subClassOf rdf:resource="#?([^"]+)"', k)
    return lines.select(F.lit("subclass").alias("rel"), take(1).alias("a1"), take(2).alias("a2")).filter("a1 <> ''")


def paraphrase(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """(rel, a1, a2, text): facts by their relation's template (rel, template), where %1, %2 stand for arguments and
    %n{...} for a negation's words, which a fact hasn't."""
    text = F.regexp_replace("template", r"%n\{[^}]*\}", "")
    for i, a in enumerate(ARGS, 1):
        text = F.replace(text, F.lit(f"%{i}"), F.coalesce(a, F.lit("")))
    return facts.join(small(templates), "rel").select("rel", "a1", "a2", F.trim(F.regexp_replace(text, " +", " ")).alias("text"))


def statements(rows: DataFrame, key: str, relations: dict[str, str]) -> DataFrame:
    """(value): a fact for each cell of a table that isn't null, (relation key "cell"), by columns' relations."""
    cell = lambda c, rel: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"({rel} "), F.col(key), F.lit(' "'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('")')))
    return rows.select(F.explode(F.array_compact(F.array(*(cell(c, r) for c, r in relations.items())))).alias("value"))


def table_definitions(domains: DataFrame) -> DataFrame:
    """(value): a table's definition for each relation of (rel, pos, type), a column an argument, in their order."""
    columns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: F.concat(F.lit("a"), x["pos"].cast("string"), F.lit(" varchar /* "), x["type"], F.lit(" */"))), ", ")
    return domains.groupBy("rel").agg(columns.alias("c")).select(F.concat(F.lit("create table "), "rel", F.lit(" ("), "c", F.lit(");")).alias("value"))


def tptp_atoms(lines: DataFrame) -> DataFrame:
    """(name, rel, args) of the ground atoms among annotated TPTP formulas (value): names lose their prefix, quoted ones
    their quotes and what is escaped in them its mark."""
    quoted = r"'(?:[^'\\]|\\.)*'"
    atom = rf"^fof\((\w+),\w+,\(({quoted}|\w+)\(((?:{quoted}|[^'()])*)\)\)\)\.$"
    plain = lambda c: F.regexp_replace(F.when(c.startswith("'"), F.regexp_replace(c.substr(F.lit(2), F.length(c) - 2), r"\\(.)", "$1")).otherwise(c), "^s__", "")
    take = lambda k: F.regexp_extract("value", atom, k)
    args = F.transform(F.regexp_extract_all(take(3), F.lit(rf"{quoted}|[^,']+"), F.lit(0)), plain)
    return lines.filter(take(1) != "").select(take(1).alias("name"), plain(take(2)).alias("rel"), args.alias("args"))
