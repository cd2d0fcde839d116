from datetime import datetime

import pytest

from revlens.operators import delta
from revlens.plans.dataset import Engine
from revlens.sources import dumps, files, jsonlines

XML = """<mediawiki><siteinfo><sitename>Own</sitename><dbname>own</dbname><base>b</base><generator>g</generator><case>first</case>
<namespaces><namespace key="0" case="first" /><namespace key="1" case="first">Talk</namespace></namespaces></siteinfo>
  <page>
    <title>Q1 &amp; co</title><ns>0</ns><id>7</id><redirect title="Q2" />
    <revision><id>10</id><timestamp>2013-01-01T00:00:00Z</timestamp><contributor><username>Ann</username><id>3</id></contributor><minor /><comment>first &lt;edit&gt;</comment>
      <model>wikibase-item</model><format>application/json</format><text bytes="0" /><sha1 /></revision>
    <revision><id>12</id><parentid>10</parentid><timestamp>2012-12-31T23:59:58Z</timestamp><contributor deleted="deleted" /><comment deleted="deleted" />
      <model>wikibase-item</model><format>application/json</format><text bytes="9">{&quot;id&quot;:&quot;Q1&quot;,&quot;labels&quot;:{&quot;en&quot;:{&quot;language&quot;:&quot;en&quot;,&quot;value&quot;:&quot;x&quot;}}}</text><sha1>abc</sha1></revision>
    <revision><id>13</id><parentid>12</parentid><timestamp>2013-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor>
      <model>wikibase-item</model><format>application/json</format><text>{&quot;entity&quot;:&quot;Q1&quot;,&quot;redirect&quot;:&quot;Q2&quot;}</text><sha1>d</sha1></revision>
  </page>
</mediawiki>
"""


@pytest.fixture
def dump(tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    return str(tmp_path / "d.xml")


def test_xml(spark, dump):
    rows = {r["revision_id"]: r for r in dumps.read_dump(spark, dump).collect()}
    a, b, c = rows[10], rows[12], rows[13]
    assert (a["entity_id"], a["page_id"], a["redirect"], a["contributor"], a["contributor_id"], a["is_minor"], a["comment"], a["text"], a["sha1"]) == ("Q1 & co", 7, "Q2", "Ann", 3, True, "first <edit>", None, None)
    assert (b["parent_revision_id"], b["contributor"], b["comment"], b["sha1"], b["timestamp"] < a["timestamp"]) == (10, None, None, "abc", True)
    assert (c["contributor"], c["contributor_id"]) == ("1.2.3.4", None)


def test_site(spark, dump):
    site = dumps.read_site(spark, dump).first()
    assert site["site_name"] == "Own" and site["namespaces"] == {0: "", 1: "Talk"}


def test_build_and_load(spark, dump, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    built = engine.build(dump, "v1")
    assert [r["revision_id"] for r in built.in_order(page_id=7).collect()] == [12, 13]  # 10 has no text, so it isn't converted
    loaded = engine.load("v1")
    assert [r["page_id"] for r in loaded.page_ids().collect()] == [7]
    last = delta.replay(delta.log_of(loaded.revisions(page_id=7))).collect()
    assert [(r["predicate"], r["object_"]) for r in last] == [("owl:sameAs", "wd:Q2")]
    assert loaded.revisions(min_timestamp=datetime(2013, 1, 1)).count() == 1


def test_json_round_trip(spark, dump, tmp_path):
    built = Engine(spark, str(tmp_path / "w")).build(dump, "v1").revisions(page_id=7)
    jsonlines.write_deltas(built, str(tmp_path / "j"))
    back = jsonlines.read_deltas(spark, str(tmp_path / "j"))
    assert sorted(map(repr, back.select("revision_id", "timestamp", "triple_additions").collect())) == sorted(map(repr, built.select("revision_id", "timestamp", "triple_additions").collect()))


def test_digests(spark, dump, tmp_path):
    found = files.digests(spark, dump).first()
    with pytest.raises(Exception):
        files.verified(tmp_path / "d.xml", "0" * 40)
    assert files.verified(tmp_path / "d.xml", found["sha1"])
