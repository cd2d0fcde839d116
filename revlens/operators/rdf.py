"""Entity documents as triples, by the published RDF mapping: types, terms, statements in full and truthy, site links, redirects.

A statement is a node with its rank, value, qualifiers and references; a value of several parts is a node, too, named by
the hash of what it says. Rows that can't be converted have null in triples, and leave the state of their page as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = "map<string, struct<language: string, value: string>>"
TERMS = "map<string, array<struct<language: string, value: string>>>"
SNAK = "struct<snaktype: string, property: string, datatype: string, datavalue: struct<type: string, value: string>>"
CLAIM = f"struct<id: string, rank: string, mainsnak: {SNAK}, qualifiers: map<string, array<{SNAK}>>, references: array<struct<hash: string, snaks: map<string, array<{SNAK}>>>>>"
ENTITY = f"id string, type string, datatype string, redirect string, labels {TERM}, descriptions {TERM}, aliases {TERMS}, claims map<string, array<{CLAIM}>>, sitelinks map<string, struct<site: string, title: string>>"
TRIPLES = "array<struct<subject: string, predicate: string, object_: string>>"
XSD = "^^<http://www.w3.org/2001/XMLSchema#"
EARTH, ONE = "http://www.wikidata.org/entity/Q2", "1"
#: What a property means in each role: name of the link, prefix.
ROLES = [("directClaim", "wdt"), ("claim", "p"), ("statementProperty", "ps"), ("statementValue", "psv"), ("qualifier", "pq"), ("qualifierValue", "pqv"), ("reference", "pr"), ("referenceValue", "prv"), ("novalue", "wdno")]
#: Classes of the vocabulary, which are declared on request.
CLASSES = ["Item", "Property", "Statement", "Reference", "BestRank", "TimeValue", "QuantityValue", "GlobecoordinateValue"]


def _triple(s: Column, p: Column | str, o: Column) -> Column:
    return F.struct(s.alias("subject"), (F.lit(p) if isinstance(p, str) else p).alias("predicate"), o.alias("object_"))


def _literal(value: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return F.concat(F.lit('"'), value, F.lit('"'))


def _text(term: Column) -> Column:
    return F.concat(_literal(term["value"]), F.lit("@"), term["language"])


def _many(arrays: Column) -> Column:
    return F.coalesce(arrays, F.lit(None).cast(TRIPLES), F.array().cast(TRIPLES))


def _typed(value: Column, kind: str) -> Column:
    return F.concat(_literal(value), F.lit(XSD + kind + ">"))


def _iri(value: Column) -> Column:
    """An address in angle brackets; those of entities with their prefix."""
    entity = "http://www.wikidata.org/entity/"
    return F.when(value.startswith(entity), F.concat(F.lit("wd:"), F.substring(value, len(entity) + 1, 1 << 20))).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def _get(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, "$." + path)


def _time(raw: Column) -> Column:
    """A time without sign "+"; months and days that aren't known are the first."""
    return F.replace(F.ltrim(_get(raw, "time"), F.lit("+")), F.lit("-00"), F.lit("-01"))


def _value(snak: Column) -> Column:
    """The object that says a value in one term; null for kinds that are not known."""
    kind, raw = snak["datavalue"]["type"], snak["datavalue"]["value"]
    item = F.coalesce(_get(raw, "id"), F.concat(F.when(_get(raw, "entity-type") == "property", "P").otherwise("Q"), _get(raw, "numeric-id")))
    point = F.concat(F.lit("Point("), _get(raw, "longitude"), F.lit(" "), _get(raw, "latitude"), F.lit(")"))
    globe = F.coalesce(_get(raw, "globe"), F.lit(EARTH))
    text = F.when(snak["datatype"] == "url", F.concat(F.lit("<"), raw, F.lit(">"))).when(snak["datatype"] == "commonsMedia", F.concat(F.lit("<http://commons.wikimedia.org/wiki/File:"), F.replace(raw, F.lit(" "), F.lit("_")), F.lit(">")))
    return (
        F.when(kind == "string", F.coalesce(text, _literal(raw)))
        .when(kind == "wikibase-entityid", F.concat(F.lit("wd:"), item))
        .when(kind == "monolingualtext", F.concat(_literal(_get(raw, "text")), F.lit("@"), _get(raw, "language")))
        .when(kind == "quantity", _typed(_get(raw, "amount"), "decimal"))
        .when(kind == "time", _typed(_time(raw), "dateTime"))
        .when(kind == "globecoordinate", F.concat(_literal(F.when(globe == EARTH, point).otherwise(F.concat(F.lit("<"), globe, F.lit("> "), point))), F.lit("^^<http://www.opengis.net/ont/geosparql#wktLiteral>")))
    )


def _node(snak: Column) -> Column:
    """The node of a value of several parts; null for others."""
    kind = snak["datavalue"]["type"]
    return F.when(kind.isin("time", "quantity", "globecoordinate"), F.concat(F.lit("wdv:"), F.md5(F.concat_ws("|", kind, snak["datavalue"]["value"]))))


def _parts(node: Column, snak: Column) -> Column:
    """What a value's node says; parts that the value doesn't have are left out."""
    kind, raw = snak["datavalue"]["type"], snak["datavalue"]["value"]
    unit = _get(raw, "unit")
    own = [
        ("time", "TimeValue", [("timeValue", _typed(_time(raw), "dateTime")), ("timePrecision", _typed(_get(raw, "precision"), "integer")), ("timeTimezone", _typed(_get(raw, "timezone"), "integer")), ("timeCalendarModel", _iri(_get(raw, "calendarmodel")))]),
        ("quantity", "QuantityValue", [("quantityAmount", _typed(_get(raw, "amount"), "decimal")), ("quantityUpperBound", _typed(_get(raw, "upperBound"), "decimal")), ("quantityLowerBound", _typed(_get(raw, "lowerBound"), "decimal")), ("quantityUnit", F.when(unit == ONE, F.lit("wd:Q199")).otherwise(_iri(unit)))]),
        ("globecoordinate", "GlobecoordinateValue", [("geoLatitude", _typed(_get(raw, "latitude"), "double")), ("geoLongitude", _typed(_get(raw, "longitude"), "double")), ("geoPrecision", _typed(_get(raw, "precision"), "double")), ("geoGlobe", _iri(F.coalesce(_get(raw, "globe"), F.lit(EARTH))))]),
    ]
    out = None
    for name, of, parts in own:
        rows = F.array(_triple(node, "rdf:type", F.lit("wikibase:" + of)), *[_triple(node, "wikibase:" + p, o) for p, o in parts])
        out = F.when(kind == name, rows) if out is None else out.when(kind == name, rows)
    return F.filter(_many(out), lambda t: t["object_"].isNotNull())


def _snak(s: Column, snak: Column, simple: str, full: str | None, blank: Column) -> Column:
    """Triples of a value of s: in one term and, if full is given, as a node with what it says; an unknown one is a blank node; none is a type."""
    p, node = snak["property"], _node(snak)
    said = F.array(_triple(s, F.concat(F.lit(simple + ":"), p), _value(snak)))
    if full is not None:
        said = F.concat(said, F.when(node.isNotNull(), F.concat(F.array(_triple(s, F.concat(F.lit(full + ":"), p), node)), _parts(node, snak))).otherwise(F.array().cast(TRIPLES)))
    out = (
        F.when(snak["snaktype"] == "value", said)
        .when(snak["snaktype"] == "somevalue", F.array(_triple(s, F.concat(F.lit(simple + ":"), p), F.concat(F.lit("_:"), F.md5(blank)))))
        .when(snak["snaktype"] == "novalue", F.array(_triple(s, "rdf:type", F.concat(F.lit("wdno:"), p))))
    )
    return F.filter(_many(out), lambda t: t["object_"].isNotNull())


def _snaks(s: Column, by_property: Column, simple: str, full: str) -> Column:
    snaks = F.flatten(F.map_values(by_property))
    return _many(F.flatten(F.transform(snaks, lambda x, i: _snak(s, x, simple, full, F.concat_ws("|", s, F.lit(simple), x["property"], i.cast("string"))))))


def _claims(s: Column, claims: Column) -> Column:
    """Statements, each a node; the best of each property (preferred ones, or normal ones where none is preferred) also as a plain triple."""

    def statement(c: Column, best: Column) -> Column:
        name = F.coalesce(c["id"], F.md5(F.concat_ws("|", s, c["mainsnak"]["property"], c["mainsnak"]["datavalue"]["value"])))
        node, p = F.concat(F.lit("wds:"), F.replace(name, F.lit("$"), F.lit("-"))), c["mainsnak"]["property"]
        rank = F.concat(F.lit("wikibase:"), F.initcap(F.coalesce(c["rank"], F.lit("normal"))), F.lit("Rank"))
        head = F.array(_triple(s, F.concat(F.lit("p:"), p), node), _triple(node, "rdf:type", F.lit("wikibase:Statement")), _triple(node, "wikibase:rank", rank))
        is_best = F.coalesce(c["rank"], F.lit("normal")) == best
        none = F.array().cast(TRIPLES)
        truthy = F.when(is_best, F.concat(F.array(_triple(node, "rdf:type", F.lit("wikibase:BestRank"))), _snak(s, c["mainsnak"], "wdt", None, node))).otherwise(none)

        def reference(r: Column) -> Column:
            of = F.concat(F.lit("wdref:"), F.coalesce(r["hash"], F.md5(F.to_json(r["snaks"]))))
            return F.concat(F.array(_triple(node, "prov:wasDerivedFrom", of), _triple(of, "rdf:type", F.lit("wikibase:Reference"))), _snaks(of, r["snaks"], "pr", "prv"))

        return F.concat(truthy, head, _snak(node, c["mainsnak"], "ps", "psv", node), _snaks(node, c["qualifiers"], "pq", "pqv"), _many(F.flatten(F.transform(c["references"], reference))))

    def of(entry: Column) -> Column:
        best = F.when(F.exists(entry["value"], lambda c: c["rank"] == "preferred"), F.lit("preferred")).otherwise(F.lit("normal"))
        return F.flatten(F.transform(entry["value"], lambda c: statement(c, best)))

    return F.flatten(F.transform(F.map_entries(claims), of))


def to_triples(text: Column, model: Column, entity_id: Column, sites: Column | None = None, document: Column | None = None, schema: bool = False) -> Column:
    """Of a document's JSON: its triples in order; null if it can't be converted.

    sites: a map from a site's key to its pages' address ("$1" for the title); links to other sites are left out.
    document: the text parsed by ENTITY, where it is a column already. schema: also declare the vocabulary's classes.
    """
    e = F.from_json(text, ENTITY) if document is None else document
    s = F.concat(F.lit("wd:"), e["id"])

    def terms(field: str, predicate: str) -> Column:
        return _many(F.transform(F.map_values(e[field]), lambda t: _triple(s, predicate, _text(t))))

    aliases = _many(F.flatten(F.transform(F.map_values(e["aliases"]), lambda a: F.transform(a, lambda t: _triple(s, "skos:altLabel", _text(t))))))
    none = F.array().cast(TRIPLES)
    links = none
    if sites is not None:
        known = F.filter(F.map_values(e["sitelinks"]), lambda x: F.element_at(sites, x["site"]).isNotNull())
        url = lambda x: F.concat(F.lit("<"), F.replace(F.element_at(sites, x["site"]), F.lit("$1"), F.url_encode(F.replace(x["title"], F.lit(" "), F.lit("_")))), F.lit(">"))
        links = _many(F.transform(known, lambda x: _triple(url(x), "schema:about", s)))
    datatype = F.concat_ws("", F.transform(F.split(e["datatype"], "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))))
    own = F.when(model == "wikibase-item", F.array(_triple(s, "rdf:type", F.lit("wikibase:Item")))).when(
        model == "wikibase-property", F.array(_triple(s, "rdf:type", F.lit("wikibase:Property")), _triple(s, "wikibase:propertyType", F.concat(F.lit("wikibase:"), datatype)))
    )
    roles = F.array(*[_triple(s, "wikibase:" + name, F.concat(F.lit(prefix + ":"), e["id"])) for name, prefix in ROLES])
    classes = F.array(*[_triple(F.lit("wikibase:" + c), "rdf:type", F.lit("owl:Class")) for c in CLASSES]) if schema else none
    body = F.concat(classes, own, terms("labels", "rdfs:label"), terms("descriptions", "schema:description"), aliases, _many(_claims(s, e["claims"])), F.when(model == "wikibase-item", links).otherwise(roles))
    to = F.get_json_object(text, "$.redirect")
    redirect = F.array(_triple(F.concat(F.lit("wd:"), F.coalesce(F.get_json_object(text, "$.entity"), entity_id)), "owl:sameAs", F.concat(F.lit("wd:"), to)))
    return F.when(F.contains(text, F.lit('"redirect":')), F.when(to.isNotNull(), redirect)).when(e["id"].isNotNull() & model.isin("wikibase-item", "wikibase-property"), body).cast(TRIPLES)


def convert(raw: DataFrame, sites: Column | None = None, schema: bool = False) -> DataFrame:
    """Raw revisions with triples instead of text; a text is parsed once.

    Rows are first spread evenly over spark.sql.shuffle.partitions tasks: a row group or an archive, which may hold millions
    of texts, is one task's otherwise, and to convert a text takes much longer than to shuffle it. Filters on triples (also
    those that an explode implies) are kept from being pushed below the conversion, which would then be done twice.
    """
    spread = raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = spread.withColumn("_document", F.from_json("text", ENTITY))
    triples = to_triples(F.col("text"), F.col("wikibase_model"), F.col("entity_id"), sites, F.col("_document"), schema)
    return parsed.withColumn("triples", F.when(F.spark_partition_id() >= 0, triples)).drop("text", "_document")
