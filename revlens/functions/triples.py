"""Triples: their equality, their text form and their prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

W3, BASE = "http://www.w3.org/", "http://www.wikidata.org/"
#: Prefix: namespace, of the published list for RDF dumps.
PREFIXES = {
    **{k: W3 + v for k, v in dict(rdf="1999/02/22-rdf-syntax-ns#", xsd="2001/XMLSchema#", rdfs="2000/01/rdf-schema#", owl="2002/07/owl#", skos="2004/02/skos/core#", prov="ns/prov#", ontolex="ns/lemon/ontolex#").items()},
    **{k: BASE + v + "/" for k, v in dict(wd="entity", wds="entity/statement", wdref="reference", wdv="value", wdata="wiki/Special:EntityData", p="prop").items()},
    **{k: f"{BASE}prop/{v}/" for k, v in dict(wdt="direct", wdtn="direct-normalized", wdno="novalue", ps="statement", psv="statement/value", psn="statement/value-normalized").items()},
    **{k: f"{BASE}prop/{v}/" for k, v in dict(pq="qualifier", pqv="qualifier/value", pqn="qualifier/value-normalized", pr="reference", prv="reference/value", prn="reference/value-normalized").items()},
    **dict(wikibase="http://wikiba.se/ontology#", schema="http://schema.org/", geo="http://www.opengis.net/ont/geosparql#", cc="http://creativecommons.org/ns#", dct="http://purl.org/dc/terms/", bd="http://www.bigdata.com/rdf#", hint="http://www.bigdata.com/queryHints#"),
}


def object_key(object_: Column) -> Column:
    """What objects are compared by: labels of blank nodes are made up anew in each revision, so that all blank nodes are alike."""
    return F.when(object_.startswith("_:"), F.lit("_:")).otherwise(object_)


def key(triple: Column) -> Column:
    return F.struct(triple["subject"].alias("subject"), triple["predicate"].alias("predicate"), object_key(triple["object_"]).alias("object_key"))


def prefix_iri(c: Column) -> Column:
    """An IRI in angle brackets with its longest namespace replaced; anything else as it is."""
    names = sorted(PREFIXES.items(), key=lambda x: -len(x[1]))
    short = F.create_map(*[F.lit(x) for k, v in names for x in (v, k + ":")])
    pattern = f"(?s)^<({'|'.join(re.escape(v) for _, v in names)})(.*)>$"
    space = F.regexp_extract(c, pattern, 1)
    return F.when(space != "", F.concat(F.element_at(short, space), F.regexp_extract(c, pattern, 2))).otherwise(c)


def parse_ntriples(c: Column) -> Column:
    """array<struct<subject, predicate, object_>> of N-Triples text; blanks in an object stay."""
    lines = F.filter(F.split(c, " \\.\\n"), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.split(x, " ", 3))
    return F.transform(parts, lambda x: F.struct(prefix_iri(x[0]).alias("subject"), prefix_iri(x[1]).alias("predicate"), prefix_iri(x[2]).alias("object_")))


def to_ntriple(triple: Column) -> Column:
    return F.concat_ws(" ", triple["subject"], triple["predicate"], triple["object_"], F.lit("."))


def distinct_triples(triples: Column) -> Column:
    """The triples as map<key, object>, of equal ones the first."""
    entries = F.transform(triples, lambda t: F.struct(key(t).alias("key"), t["object_"].alias("value")))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.filter(entries, lambda e: e["key"] == k)[0]["value"].alias("value"))))
