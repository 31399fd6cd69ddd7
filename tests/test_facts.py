"""Filters that become part of the query: recorded answers of a local endpoint, and the plans."""

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import variable_date
from palimpsest.sources import facts, paged

E = "http://www.wikidata.org/entity/"
RANK = "http://wikiba.se/ontology#"
#: (subject, class, label, relation, value, rank): dates as (time, precision), else (id, label).
GRAPH = [
    ("Q1", "Q5", "Ada", "P569", ("+1815-12-10T00:00:00Z", 11), "PreferredRank"),
    ("Q1", "Q5", "Ada", "P569", ("+1816-00-00T00:00:00Z", 9), "NormalRank"),
    ("Q2", "Q5", "Bob", "P569", ("-0044-03-15T00:00:00Z", 14), "NormalRank"),
    ("Q2", "Q5", "Bob", "P569", ("+1900-01-01T00:00:00Z", 10), "DeprecatedRank"),
    ("Q3", "Q5", "Cid", "P569", ("bad", 9), "NormalRank"),
    ("Q4", "Q6256", "Land", "P36", ("Q9", "Town"), "NormalRank"),
    ("Q4", "Q6256", "Land", "P36", ("Q8", "Old Town"), "PreferredRank"),
    ("Q1", "Q5", "Ada", "P106", ("Q70", "writer"), "NormalRank"),
    ("Q1", "Q5", "Ada", "P166", ("Q71", "prize"), "NormalRank"),
    ("Q2", "Q5", "Bob", "P166", ("Q71", "prize"), "NormalRank"),
    ("Q5", "Q43229", "Club", "P166", ("Q71", "prize"), "NormalRank"),
]


def answers(query):
    """What the endpoint recorded for the conditions that the query holds."""
    relation = re.search(r"\?subject p:(P\d+) \?statement", query)[1]
    ids, kind, also = re.search(r"VALUES \?subject \{ (.*?) \}", query), re.search(r"wdt:P31 wd:(Q\d+)", query), re.search(r"wdt:(P\d+) \?also", query)
    ranks = re.search(r"\?rank IN \((.*?)\)", query)
    out = []
    for s, c, label, r, value, rank in GRAPH:
        best = rank == "PreferredRank" or rank == "NormalRank" and not any(x[0] == s and x[3] == r and x[5] == "PreferredRank" for x in GRAPH)
        if r != relation or kind and c != kind[1] or ids and f"wd:{s}" not in ids[1].split() or also and not any(x[0] == s and x[3] == also[1] for x in GRAPH):
            continue
        if ranks and f"wikibase:{rank}" not in ranks[1].split(", ") or "NOT EXISTS" in query and not best:
            continue
        held = {"time": value[0], "precision": str(value[1])} if isinstance(value[1], int) else {"object": E + value[0], "objectLabel": value[1]}
        out.append({k: {"value": v} for k, v in ({"subject": E + s, "subjectLabel": label, "rank": RANK + rank} | held).items()})
    limit, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups())
    return out[offset : offset + limit]


@pytest.fixture(scope="module")
def endpoint(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = urllib.parse.unquote(self.path.split("query=", 1)[1])
            asked.append(query)
            body = json.dumps({"results": {"bindings": answers(query)}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(facts.FactSource)
    yield spark.read.format("facts").option("url", f"http://127.0.0.1:{server.server_port}/?query={{query}}").option("page_size", 2), asked
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_dates_without_outranked_or_deprecated(endpoint):
    source, asked = endpoint
    asked.clear()
    df = source.load().where("relation_id IN ('P569', 'P570') AND class_id = 'Q5' AND best_rank")
    assert sorted((r["subject_id"], r["object_text"], r["rank"], r["object_id"]) for r in df.collect()) == [("Q1", "1815-12-10", "preferred", None), ("Q2", "-0044-03-15", "normal", None)]
    assert all("wdt:P31 wd:Q5" in q and "NOT EXISTS" in q and "?rank != wikibase:DeprecatedRank" in q for q in asked)
    assert {re.search(r"p:(P\d+)", q)[1] for q in asked} == {"P569", "P570"} and sum("OFFSET 2" in q for q in asked) == 1
    held = plan_of(df)
    assert re.search(r"PushedFilters: \[.*relation_id.*class_id", held) or "Filter" not in held.split("== Physical Plan ==")[1].split("(1)")[0]


def test_ranks_and_ids_are_asked_for(endpoint):
    source, asked = endpoint
    asked.clear()
    df = source.load().where("relation_id = 'P569' AND rank <> 'deprecated' AND subject_id IN ('Q1', 'Q2', 'Q3')")
    assert sorted((r["subject_id"], r["object_text"]) for r in df.collect()) == [("Q1", "1815-12-10"), ("Q1", "1816"), ("Q2", "-0044-03-15")]
    assert all("VALUES ?subject { wd:Q1 wd:Q2 wd:Q3 }" in q and "?rank IN (wikibase:PreferredRank, wikibase:NormalRank)" in q for q in asked)
    assert source.load().where("relation_id = 'P569' AND rank = 'deprecated'").first()["object_text"] == "1900-01"
    # What cannot be asked for is left to Spark; what contradicts itself is not asked at all.
    assert [r["object_text"] for r in source.load().where("relation_id = 'P36' AND object_text LIKE '%Old%'").collect()] == ["Old Town"]
    asked.clear()
    assert source.load().where("relation_id = 'P36' AND rank = 'normal' AND rank <> 'normal'").count() == 0 and source.load().where("relation_id = 'P36' AND relation_id = 'P38'").count() == 0 and not asked
    many = facts.FactReader({"url": ""})
    assert list(many.pushFilters([facts.EqualTo(("relation_id",), "P19"), facts.In(("subject_id",), tuple(f"Q{i}" for i in range(120)))])) == [] and len(many.partitions()) == 3
    with pytest.raises(Exception, match="name the relations"):
        source.load().collect()
    with pytest.raises(ValueError, match="no id"):
        facts.statements_query("P19", class_id="Q5 . } #")


def test_entities_relations_and_slots(endpoint):
    source, asked = endpoint
    df = source.load()
    asked.clear()
    assert [r[0] for r in facts.eligible(df, ["P166"]).collect()] == ["Q1"]
    assert all("wdt:P31 wd:Q5" in q and "wdt:P106 ?also" in q and "p:P166 ?statement" in q for q in asked)
    got = facts.relation_rows(df, ["P36"], "Q6256").collect()
    assert [(r["subject_text"], r["object_id"], r["object_text"], r["source_ref"]) for r in got] == [("Land", "Q8", "Old Town", "wikidata:Q4:P36:Q8")]
    got = facts.slot_rows(df, "P166", "award", ["Q1", "Q2", "Q5"]).collect()
    assert sorted((r["entity_id"], r["entity_name"], r["is_human"], r["slot"], r["value_id"], r["value_text"]) for r in got) == [("Q1", "Ada", True, "award", "Q71", "prize"), ("Q2", "Bob", True, "award", "Q71", "prize")]


def test_queries_of_the_paged_source():
    assert "wdt:P106 ?also" in (q := paged.entity_query("Q5", "P166", "P106")) and "wdt:P166 ?value" in q and "DISTINCT" in q
    assert "psv:P569" in (q := paged.relation_query("P569", "Q5", True)) and "NOT EXISTS" in q and "DeprecatedRank" in q
    assert "?subjectLabel" in (q := paged.slot_query("P166", ["Q2", "Q1"])) and "wdt:P31 wd:Q5" in q


def test_dates_of_any_era_and_precision(spark):
    rows = [("+1815-12-10T00:00:00Z", 11, "1815-12-10"), ("-0044-03-15T00:00:00Z", 14, "-0044-03-15"), ("-0044-03-15T00:00:00Z", 10, "-0044-03"), ("-0044-00-00T00:00:00Z", 9, "-0044"), ("+1900-00-00T00:00:00Z", 8, None), ("short", 11, None), (None, 11, None)]
    df = spark.createDataFrame(rows, "time string, precision int, want string")
    assert df.where(~variable_date(F.col("time"), F.col("precision")).eqNullSafe(F.col("want"))).count() == 0
    assert [facts.date_text(t, p) for t, p, _ in rows] == [w for *_, w in rows]
