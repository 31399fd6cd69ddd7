"""Payloads of any shape: what is usable becomes rows, what is not is counted."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import payloads


def snak(value, kind="value"):
    return {"snaktype": kind, "datavalue": {"value": value}}


def entity(name, **claims):
    return json.dumps({"labels": {"en": {"value": name}}, "claims": {"P31": [{"rank": "normal", "mainsnak": snak({"id": "Q5"})}], "P106": [{"rank": "normal", "mainsnak": snak({"id": "Q70"})}]} | claims})


def frame(spark, texts):
    return spark.createDataFrame([(f"Q{i}", t) for i, t in enumerate(texts)], "entity_id string, payload string")


def test_values_ranks_and_labels(spark):
    good = [{"rank": "normal", "mainsnak": snak({"id": "Q1"})}, {"rank": "preferred", "mainsnak": snak({"numeric-id": 2})}, {"rank": "preferred", "mainsnak": snak({"id": "Q2"})}, {"rank": "deprecated", "mainsnak": snak({"id": "Q3"})}]
    unusable = [{"rank": "preferred", "mainsnak": snak({"id": 7})}, {"rank": "preferred", "mainsnak": snak({"id": "Q9"}, "somevalue")}, {"rank": "normal", "mainsnak": snak({"id": "Q4"})}, {"rank": "normal", "mainsnak": snak({"numeric-id": "5"})}, "text", None, 3]
    df = payloads.parse(frame(spark, [json.dumps({"labels": {"fr": {"value": " Été "}, "de": {"value": ""}, "en": {"value": " "}}, "claims": {"P1": good, "P2": unusable, "P3": {"not": "a list"}}}), "[1]", '{"claims": 7, "labels": []}', "{broken", None]))
    got = df.select("entity_id", "is_json", payloads.label("payload").alias("name"), *[payloads.truthy("payload", p).alias(p) for p in ("P1", "P2", "P3", "P4")]).orderBy("entity_id").collect()
    assert (got[0]["name"], got[0]["P1"], got[0]["P2"], got[0]["P3"], got[0]["P4"]) == ("Été", ["Q2"], ["Q4"], [], [])
    assert [r["is_json"] for r in got] == [True, True, True, False, True] and all(r["name"] is None and r["P1"] == [] for r in got[1:])
    dated = [{"rank": "normal", "mainsnak": snak({"time": "+1815-12-10T00:00:00Z", "precision": 10})}, {"rank": "normal", "mainsnak": snak({"time": 5, "precision": 10})}]
    df = payloads.parse(frame(spark, [json.dumps({"claims": {"P569": dated}})]))
    assert df.select(payloads.truthy("payload", "P569", payloads.date_of)).first()[0] == ["1815-12"]


def test_broken_claims_are_counted(spark):
    claims = {"P1": ["text", None, 3, [1], {"mainsnak": snak({"id": "Q1"})}, {"rank": "best", "mainsnak": snak({"id": "Q1"})}, {"rank": "normal"}, {"rank": "normal", "mainsnak": {"snaktype": "novalue"}}, {"rank": "normal", "mainsnak": snak({"id": ""})}, {"rank": "normal", "mainsnak": snak("plain")}, {"rank": "deprecated", "mainsnak": snak({"id": "Q1"})}], "P2": "x", "P3": []}
    texts = [json.dumps({"claims": claims}), "{", "5", None, "null", json.dumps({"claims": [1]})]
    got = {r["problem"]: r["n"] for r in payloads.problems(frame(spark, texts)).collect()}
    assert got == {"claim_not_an_object": 4, "unknown_rank": 2, "no_value": 2, "no_target": 2, "claims_not_a_list": 1, "payload_not_json": 1, "payload_not_an_object": 2, "payload_missing": 1}
    assert payloads.claims(frame(spark, texts)).where("problem IS NULL").count() == 1
    assert payloads.problems(frame(spark, texts).where("false")).count() == 0


def test_rows_of_eligible_humans(spark):
    award = lambda *ids: [{"rank": "normal", "mainsnak": snak({"id": x})} for x in ids]
    texts = [entity("A", P166=award("Q1", "Q2", "Q1")), entity("B", P166=award("Q1")), entity("C", P166=award("Q1", "Q3")), entity(" ", P166=award("Q1", "Q2")), entity("E", P166=award("Q1", "Q2"), P106=[]), entity("F", P166=award("Q1", "Q2"), P31=award("Q6"))]
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two"), ("Q3", None), ("Q70", "writer")], "value_id string, label string")
    rows = payloads.fact_rows(frame(spark, texts).withColumn("slot", F.lit("clash")), labels, {"award": "P166"})
    assert sorted((r["entity_id"], r["slot"], r["value_id"], r["value_text"], r["source_ref"]) for r in rows.collect()) == [("Q0", "award", "Q1", "one", "wikidata:Q0:P166:Q1"), ("Q0", "award", "Q2", "two", "wikidata:Q0:P166:Q2"), ("Q0", "occupation", "Q70", "writer", "wikidata:Q0:P106:Q70")]
