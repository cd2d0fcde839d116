"""Documents against the triples that the published mapping gives them."""

import json

from revlens.operators import rdf

X = "^^<http://www.w3.org/2001/XMLSchema#"
DAY = {"time": "+2013-05-00T00:00:00Z", "timezone": 0, "precision": 10, "calendarmodel": "http://www.wikidata.org/entity/Q1985727"}


def snak(p, kind=None, value=None, snaktype="value", datatype=None):
    return {"snaktype": snaktype, "property": p, **({"datatype": datatype} if datatype else {}), **({"datavalue": {"type": kind, "value": value}} if kind else {})}


def claim(name, main, rank="normal", **more):
    return {"id": name, "rank": rank, "mainsnak": main, **more}


def triples(spark, text, model="wikibase-item", **more):
    raw = spark.createDataFrame([("Q1", model, text if text is None or isinstance(text, str) else json.dumps(text))], "entity_id string, wikibase_model string, text string")
    found = rdf.convert(raw, **more).first()["triples"]
    return None if found is None else [tuple(t) for t in found]


def test_item(spark):
    claims = {
        "P1": [claim("Q1$a", snak("P1", "wikibase-entityid", {"id": "Q5"})), claim("Q1$b", snak("P1", "string", "x\ny"), "preferred")],
        "P2": [claim("Q1$c", snak("P2", "time", DAY), qualifiers={"P3": [snak("P3", "quantity", {"amount": "+5", "unit": "1"}), snak("P3", snaktype="somevalue")]}, references=[{"hash": "ff", "snaks": {"P4": [snak("P4", "string", "http://a.example/", datatype="url")]}}])],
        "P5": [claim("Q1$d", snak("P5", snaktype="somevalue")), claim("Q1$e", snak("P5", snaktype="somevalue")), claim("Q1$f", snak("P5", snaktype="novalue"))],
        "P6": [claim("Q1$g", snak("P6", "globecoordinate", {"latitude": 1.5, "longitude": 2.5, "precision": 0.1, "globe": "http://www.wikidata.org/entity/Q2"}), "deprecated")],
    }
    got = triples(spark, {"type": "item", "id": "Q1", "labels": {"en": {"language": "en", "value": 'a "b"'}}, "claims": claims})
    assert got[:2] == [("wd:Q1", "rdf:type", "wikibase:Item"), ("wd:Q1", "rdfs:label", '"a \\"b\\""@en')]
    have = set(got)
    assert {o for s, p, o in got if p == "wdt:P1"} == {'"x\\ny"'} and ("wds:Q1-a", "ps:P1", "wd:Q5") in have and ("wds:Q1-a", "wikibase:rank", "wikibase:NormalRank") in have
    assert ("wds:Q1-b", "rdf:type", "wikibase:BestRank") in have and ("wds:Q1-a", "rdf:type", "wikibase:BestRank") not in have
    assert ("wd:Q1", "wdt:P2", f'"2013-05-01T00:00:00Z"{X}dateTime>') in have
    node = next(o for s, p, o in got if p == "psv:P2")
    assert {(p, o) for s, p, o in got if s == node} == {("rdf:type", "wikibase:TimeValue"), ("wikibase:timeValue", f'"2013-05-01T00:00:00Z"{X}dateTime>'), ("wikibase:timePrecision", f'"10"{X}integer>'), ("wikibase:timeTimezone", f'"0"{X}integer>'), ("wikibase:timeCalendarModel", "wd:Q1985727")}
    amount = next(o for s, p, o in got if p == "pqv:P3")
    assert {(p, o) for s, p, o in got if s == amount} == {("rdf:type", "wikibase:QuantityValue"), ("wikibase:quantityAmount", f'"+5"{X}decimal>'), ("wikibase:quantityUnit", "wd:Q199")}
    assert sum(p == "pq:P3" for _, p, _ in got) == 2 and ("wds:Q1-c", "prov:wasDerivedFrom", "wdref:ff") in have and ("wdref:ff", "pr:P4", "<http://a.example/>") in have
    assert len({o for s, p, o in got if p == "wdt:P5"}) == 2 and ("wd:Q1", "rdf:type", "wdno:P5") in have and ("wds:Q1-f", "rdf:type", "wdno:P5") in have
    assert ("wds:Q1-g", "ps:P6", '"Point(2.5 1.5)"^^<http://www.opengis.net/ont/geosparql#wktLiteral>') in have and not [t for t in got if t[1] == "wdt:P6"]
    assert len(got) == len(have)


def test_property(spark):
    got = triples(spark, {"type": "property", "id": "P9", "datatype": "commonsMedia"}, "wikibase-property")
    assert got[:2] == [("wd:P9", "rdf:type", "wikibase:Property"), ("wd:P9", "wikibase:propertyType", "wikibase:CommonsMedia")]
    assert got[2:] == [("wd:P9", "wikibase:" + n, f"{x}:P9") for n, x in rdf.ROLES]
    assert ("wd:P8", "wikibase:propertyType", "wikibase:ExternalId") in triples(spark, {"id": "P8", "datatype": "external-id"}, "wikibase-property")


def test_what_is_not_converted(spark):
    assert triples(spark, None) is None and triples(spark, "{") is None and triples(spark, {"id": "L1"}, "wikibase-lexeme") is None
    assert triples(spark, {"entity": "Q1", "redirect": "Q2"}) == [("wd:Q1", "owl:sameAs", "wd:Q2")]


def test_schema_on_request(spark):
    got = triples(spark, {"type": "item", "id": "Q1"}, schema=True)
    assert ("wikibase:Statement", "rdf:type", "owl:Class") in got and len(got) == 1 + len(rdf.CLASSES)


def test_site_links(spark):
    from pyspark.sql import functions as F

    got = triples(spark, {"id": "Q1", "sitelinks": {"a": {"site": "a", "title": "B c"}, "z": {"site": "z", "title": "Z"}}}, sites=F.create_map(F.lit("a"), F.lit("https://a.example/$1")))
    assert got[1:] == [("<https://a.example/B_c>", "schema:about", "wd:Q1")]


def test_rows_of_one_file_are_converted_by_all_tasks(spark):
    from pyspark.sql import functions as F

    raw = spark.range(100).coalesce(1).select(F.concat(F.lit("Q"), "id").alias("entity_id"), F.lit("wikibase-item").alias("wikibase_model"), F.concat(F.lit('{"type":"item","id":"Q'), "id", F.lit('"}')).alias("text"))
    got = rdf.convert(raw).groupBy(F.spark_partition_id()).agg(F.count("triples").alias("n")).collect()
    assert len(got) == 4 and {r["n"] for r in got} == {25}


def test_filters_do_not_convert_again(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([("Q1", "wikibase-item", '{"type":"item","id":"Q1"}')], "entity_id string, wikibase_model string, text string")
    plan = rdf.convert(raw).where("triples IS NOT NULL").select(F.inline("triples"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("owl:sameAs") == 1
