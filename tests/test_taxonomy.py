"""U1/W1 definitions, F4/F5 locale text, S9 service record, A11 counts."""

import json

from linkloom.operators.taxonomy import service_record, taxonomy_definitions, universe_counts


def inputs(spark):
    cats = spark.createDataFrame([("section", 1, "US"), ("section", 2, "opinion"), ("section", 3, "travel"),
                                  ("subsection", 1, "politics"), ("subsection", 2, "US"), ("subsection", 3, "--")],
                                 "family string, ord long, name string")
    authors = spark.createDataFrame([(1, "Wanda Oko", 3), (2, "Ilse Marr", 3), (3, "Travel", 9), (4, "  ", 5)],
                                    "id long, name string, total_articles long")
    return cats, authors


def test_definitions_first_registration_wins(spark):
    cats, authors = inputs(spark)
    d = taxonomy_definitions(cats, authors, publisher="The Paper").orderBy("position").collect()
    assert [(r.position, r.identifier, r.family) for r in d] == [
        (1, "us", "section"), (2, "opinion", "section"), (3, "travel", "section"), (4, "politics", "subsection"),
        (5, "ilse-marr", "author"), (6, "wanda-oko", "author")]
    assert d[0].locale_name == "US Section"
    assert d[0].description == "Articles in the US section of The Paper"
    assert d[3].locale_name == "Politics Subsection"
    assert d[4].locale_name == "Ilse Marr" and d[4].description == "Articles authored by Ilse Marr for The Paper"
    assert {r.severity for r in d} == {"inform"} and {r.default_setting for r in d} == {"warn"}


def test_service_record(spark):
    cats, authors = inputs(spark)
    rec = service_record(taxonomy_definitions(cats, authors), "2024-01-01T00:00:00.000Z").first()
    doc = json.loads(rec.record)
    assert doc["$type"] == "app.bsky.labeler.service"
    assert doc["policies"]["labelValues"] == ["us", "opinion", "travel", "politics", "ilse-marr", "wanda-oko"]
    first = doc["policies"]["labelValueDefinitions"][0]
    assert first == {"identifier": "us", "severity": "inform", "blurs": "none", "defaultSetting": "warn",
                     "locales": [{"lang": "en", "name": "US Section",
                                  "description": "Articles in the US section of Example News"}]}
    assert doc["subjectTypes"] == ["record"] and doc["subjectCollections"] == ["app.bsky.feed.post"]
    assert rec.n_definitions == 6


def test_universe_counts(spark):
    cats, authors = inputs(spark)
    got = {r.family: r.n for r in universe_counts(cats, authors).collect()}
    assert got == {"section": 3, "subsection": 3, "author": 4}
