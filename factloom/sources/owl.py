"""OWL in RDF/XML: facts to elements and back, restrictions and nested classes included.

facts: (rel, a1, a2). Classes have subclass, disjoint and documentation facts; a restriction is a blank node, a term that starts with "_:", with
onProperty and a filler's fact; properties have instance, domain1, domain2 and subrelation facts; instances of other classes are descriptions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of properties and the classes that stand for them, and what restricts a property.
PROPERTIES = {"owl:ObjectProperty": "BinaryRelation", "owl:TransitiveProperty": "TransitiveRelation", "owl:SymmetricProperty": "SymmetricRelation", "owl:FunctionalProperty": "SingleValuedRelation"}
FILLERS = ("someValuesFrom", "allValuesFrom", "hasValue", "minCardinality", "maxCardinality", "cardinality")
_NUMBERS = ("minCardinality", "maxCardinality", "cardinality")
HEAD = '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
FOOT = "</rdf:RDF>"


def escaped(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def _about(tag: Column | str, term: str, inner: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("<"), tag, F.lit(' rdf:about="#'), escaped(F.col(term)), F.lit('">'), inner, F.lit("</"), tag, F.lit(">"))


def _resource(tag: str, term: str) -> Column:
    return F.concat(F.lit(f'<{tag} rdf:resource="#'), escaped(F.col(term)), F.lit('"/>'))


def elements(facts: DataFrame) -> DataFrame:
    """(value): an element an axiom; an element may stand for a term many times, so no term's axioms have to meet in one row."""
    of = lambda rel: facts.filter(F.col("rel") == rel).select("a1", "a2")
    blank = F.col("a2").startswith("_:")
    sub = of("subclass").filter(~F.col("a1").startswith("_:"))
    fillers = facts.filter(F.col("rel").isin(*FILLERS)).select(F.col("a1").alias("node"), F.col("rel").alias("kind"), F.col("a2").alias("filler"))
    held = fillers.join(of("onProperty").select(F.col("a1").alias("node"), F.col("a2").alias("property")), "node")
    value = F.when(F.col("kind").isin(*_NUMBERS), F.concat(F.lit("<owl:"), "kind", F.lit(">"), escaped(F.col("filler")), F.lit("</owl:"), "kind", F.lit(">"))).otherwise(F.concat(F.lit("<owl:"), "kind", F.lit(' rdf:resource="#'), escaped(F.col("filler")), F.lit('"/>')))
    restriction = F.concat(F.lit("<rdfs:subClassOf><owl:Restriction>"), _resource("owl:onProperty", "property"), value, F.lit("</owl:Restriction></rdfs:subClassOf>"))
    kinds = F.create_map(*(F.lit(x) for tag, c in PROPERTIES.items() for x in (c, tag)))
    props = of("instance").withColumn("tag", kinds[F.col("a2")])
    text = lambda tag: F.concat(F.lit(f"<{tag}>"), escaped(F.col("a2")), F.lit(f"</{tag}>"))
    out = [
        sub.filter(~blank).select(_about("owl:Class", "a1", _resource("rdfs:subClassOf", "a2"))),
        sub.filter(blank).join(held, F.col("a2") == F.col("node")).select(_about("owl:Class", "a1", restriction)),
        of("disjoint").select(_about("owl:Class", "a1", _resource("owl:disjointWith", "a2"))),
        of("documentation").select(_about("owl:Class", "a1", text("rdfs:comment"))),
        props.filter("tag IS NOT NULL").select(_about(F.col("tag"), "a1", F.lit(""))),
        *(of(rel).select(_about("owl:ObjectProperty", "a1", _resource(tag, "a2"))) for rel, tag in (("domain1", "rdfs:domain"), ("domain2", "rdfs:range"), ("subrelation", "rdfs:subPropertyOf"))),
        props.filter("tag IS NULL").select(_about("rdf:Description", "a1", _resource("rdf:type", "a2"))),
    ]
    all_ = out[0].toDF("value")
    for o in out[1:]:
        all_ = all_.unionByName(o.toDF("value"))
    return all_


def write(facts: DataFrame, path: str) -> None:
    """Every part file is an RDF document of its own."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [HEAD]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": [FOOT]})

    elements(facts).mapInArrow(framed, "value string").write.text(path)


_LINK = "struct<`_rdf:resource`:string,`_rdf:nodeID`:string>"
_RESTRICTION = f"struct<`_rdf:nodeID`:string,`owl:onProperty`:{_LINK}," + ",".join(f"`owl:{k}`:" + ("string" if k in _NUMBERS else _LINK) for k in FILLERS) + ">"
_SUB = f"array<struct<`_rdf:resource`:string,`owl:Restriction`:{_RESTRICTION},`owl:Class`:struct<`_rdf:about`:string,`_rdf:ID`:string>>>"
_ROW = "`_rdf:about` string, `_rdf:ID` string, `_rdf:nodeID` string, `rdfs:subClassOf` " + _SUB + f", `owl:disjointWith` array<{_LINK}>, `rdfs:comment` array<string>, `rdfs:domain` array<{_LINK}>, `rdfs:range` array<{_LINK}>, `rdfs:subPropertyOf` array<{_LINK}>, `rdf:type` array<{_LINK}>"


def _name(c: Column) -> Column:
    """What stands behind the # of a reference, or all of it."""
    return F.regexp_replace(c, "^[^#]*#", "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(rel, a1, a2) of the RDF/XML files at path, each fact once. A restriction is named by its property, kind and filler, so that it has one name wherever and whenever
    it is read. Elements without a name of their own are blank nodes by their nodeID; other vocabularies are left out."""
    fact = lambda rel, a1, a2: F.struct((F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), a1.alias("a1"), a2.alias("a2"))
    link = lambda x: F.coalesce(_name(x["_rdf:resource"]), F.concat(F.lit("_:"), x["_rdf:nodeID"]))
    term = F.col("t")

    def each(column: str, rel: str, value) -> Column:
        return F.transform(F.col(f"`{column}`"), lambda x: fact(rel, term, value(x)))

    def superclass(x: Column) -> Column:
        return F.coalesce(_name(x["_rdf:resource"]), _name(x["owl:Class"]["_rdf:about"]), _name(x["owl:Class"]["_rdf:ID"]))

    def restriction(x: Column) -> Column:
        r, got = x["owl:Restriction"], []
        for k in FILLERS:
            prop, value = link(r["owl:onProperty"]), r[f"owl:{k}"] if k in _NUMBERS else link(r[f"owl:{k}"])
            node = F.when(prop.isNotNull() & value.isNotNull(), F.concat(F.lit("_:"), F.sha2(F.concat_ws("\0", prop, F.lit(k), value), 256).substr(1, 16)))
            got += [fact("subclass", term, node), fact("onProperty", node, prop), fact(k, node, value)]
        return F.array(*got)

    out = None
    for tag in ["owl:Class", *PROPERTIES, "owl:DatatypeProperty", "rdf:Description"]:
        rows = spark.read.format("xml").option("rowTag", tag).schema(_ROW).load(path)
        named = F.coalesce(_name(F.col("`_rdf:about`")), _name(F.col("`_rdf:ID`")), F.concat(F.lit("_:"), F.col("`_rdf:nodeID`")))
        found = [each("rdfs:subClassOf", "subclass", superclass), F.flatten(F.transform(F.col("`rdfs:subClassOf`"), restriction)), each("owl:disjointWith", "disjoint", link), each("rdfs:comment", "documentation", lambda x: x)]
        if tag in PROPERTIES or tag == "owl:DatatypeProperty":
            found += [F.array(fact("instance", term, F.lit(PROPERTIES.get(tag, "BinaryRelation"))))]
            found += [each(c, rel, link) for c, rel in (("rdfs:domain", "domain1"), ("rdfs:range", "domain2"), ("rdfs:subPropertyOf", "subrelation"))]
        elif tag == "rdf:Description":
            found.append(each("rdf:type", "instance", link))
        got = rows.withColumn("t", named).filter("t IS NOT NULL").select(F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f")).select("f.*")
        out = got if out is None else out.unionByName(got)
    return out.filter("a1 IS NOT NULL AND a2 IS NOT NULL").distinct()
