"""Paged remote scans as a Spark data source.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", "https://host/search?q={query}&limit={limit}&offset={offset}") \\
        .option("queries", json.dumps([search_query("P19", "Q5")])).option("rows", "query.search").option("next", "continue.sroffset").load()

One partition asks for the pages of one query, one after the other: where the next page begins is
known from the last one. It ends at an empty page, at one with fewer rows than asked for, or after
`pages`. Queries run side by side, and a lost executor repeats only its own. `ids` (comma-separated)
with `{ids}` in the url asks for batches of distinct ids in order instead, a partition each. Rows
come as JSON text; the functions below give them their columns.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.text import variable_date
from palimpsest.sources.facts import HUMAN, statements_query

#: Rows of a search page, and ids of a lookup, at most. Fixed values.
MOST_A_PAGE = MOST_IDS = 50


def search_query(relation_id: str, subject_class: str) -> str:
    """Entities of a class that hold a relation."""
    return f"haswbstatement:P31={subject_class} haswbstatement:{relation_id}"


def entity_query(subject_class: str, relation_id: str | None = None, also_relation_id: str | None = None) -> str:
    """Ids of the entities of a class that hold a relation, and another one too, by page."""
    held = "".join(f" ?entity wdt:{r} ?{name} ." for name, r in (("also", also_relation_id), ("value", relation_id)) if r)
    return f"SELECT DISTINCT ?entity WHERE {{ ?entity wdt:P31 wd:{subject_class} .{held} }} ORDER BY ?entity LIMIT {{limit}} OFFSET {{offset}}"


def relation_query(relation_id: str, subject_class: str, dates: bool = False) -> str:
    """Subjects of a class with the best-ranked values of a relation and both labels, or its dates with their precision, by page."""
    return statements_query(relation_id, class_id=subject_class, dates=dates, best_rank=True)


def slot_query(relation_id: str, entity_ids: list[str], subject_class: str = HUMAN) -> str:
    """The best-ranked values of a relation for listed entities of a class, with both labels, by page."""
    return statements_query(relation_id, class_id=subject_class, subject_ids=entity_ids, best_rank=True)


def get_json(url: str, *, tries: int = 6, timeout: float = 60.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    """429 waits as told, 15 s at least; 5xx and lost or late answers wait min(2^n, 8) s; other errors stop at once."""
    for n in range(tries):
        try:
            with opener(url, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if n + 1 == tries or error.code != 429 and error.code < 500:
                raise
            wait = min(2.0**n, 8.0)
            if error.code == 429:
                told = str(error.headers.get("Retry-After", "")) if error.headers else ""
                try:
                    wait = max(15.0, float(told))
                except ValueError:
                    wait = 15.0
        except OSError:  # a timeout, or no connection
            if n + 1 == tries:
                raise
            wait = min(2.0**n, 8.0)
        sleep(wait)
    raise ValueError("tries must be positive")


def inner(held: object, path: str) -> object:
    for part in filter(None, path.split(".")):
        held = held.get(part) if isinstance(held, dict) else None
    return held


def rows_of(answer: dict, path: str) -> list:
    """The rows of an answer: a list, or the values of a mapping. Anything else is an error; nothing at all is an empty page."""
    held = inner(answer, path)
    if held is None:
        return []
    if isinstance(held, dict):
        return list(held.values())
    if not isinstance(held, list):
        raise ValueError(f"{path} is neither a list nor a mapping")
    return held


class Query(InputPartition):
    def __init__(self, text: str) -> None:
        self.text = text


class Batch(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        self.ids = ids


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.size = min(int(options.get("page_size", MOST_A_PAGE)), int(options.get("most_a_page", MOST_A_PAGE)))
        self.pages, self.pause = int(options.get("pages", 1)), float(options.get("pause", 0))
        if self.size <= 0 or self.pages <= 0:
            raise ValueError("page_size and pages must be positive")

    def partitions(self) -> list[InputPartition]:
        ids = sorted({x for x in self.options.get("ids", "").split(",") if x})
        if ids:
            n = min(self.size, MOST_IDS)
            return [Batch(ids[i : i + n]) for i in range(0, len(ids), n)]
        return [Query(x) for x in json.loads(self.options.get("queries", '[""]'))]

    def ask(self, url: str) -> dict:
        return get_json(url, timeout=float(self.options.get("timeout", 60)))

    def read(self, partition: Query | Batch) -> Iterator[tuple]:
        o, quote = self.options, urllib.parse.quote
        if isinstance(partition, Batch):
            url = o["url"].replace("{ids}", quote("|".join(partition.ids)))
            held = inner(self.ask(url), o.get("rows", ""))
            for own in partition.ids if isinstance(held, dict) else ():
                # What is not there is left out.
                if isinstance(held.get(own), dict) and "missing" not in held[own]:
                    yield (own, json.dumps(held[own], sort_keys=True))
            return
        offset = 0
        for page in range(self.pages):
            text = partition.text.replace("{limit}", str(self.size)).replace("{offset}", str(offset))
            answer = self.ask(o["url"].replace("{query}", quote(text)).replace("{limit}", str(self.size)).replace("{offset}", str(offset)))
            rows = rows_of(answer, o.get("rows", ""))
            for row in rows:
                yield (partition.text, json.dumps(row, sort_keys=True))
            if len(rows) < self.size:
                return
            told = inner(answer, o["next"]) if "next" in o else None
            offset = told if isinstance(told, int) else offset + self.size
            if page + 1 < self.pages:
                time.sleep(self.pause)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def entity_ids(pages: DataFrame, path: str = "$.title") -> DataFrame:
    """The distinct entity ids (Q and digits, behind any url) of rows, in order."""
    held = F.regexp_extract(F.get_json_object("row", path), r"(?:^|/)(Q\d+)$", 1).alias("entity_id")
    return pages.select(held).where("entity_id <> ''").distinct().orderBy("entity_id")


def _value(name: str):
    return F.trim(F.get_json_object("row", f"$.{name}.value"))


def _id(name: str):
    return F.nullif(F.regexp_extract(_value(name), r"/(Q\d+)$", 1), F.lit(""))


def relation_rows(pages: DataFrame, relation_id: str, dates: bool = False, labelled: bool = True) -> DataFrame:
    """Bindings as rows: subject, relation, object, texts and source_ref. Incomplete ones are dropped, and of
    equal (subject, object, text) one stays. A date has no object id; its text is as precise as the date. labelled: whether
    a row without its subject's label is incomplete."""
    text = variable_date(_value("time"), _value("precision").cast("int")) if dates else _value("objectLabel")
    out = pages.select(_id("subject").alias("subject_id"), _value("subjectLabel").alias("subject_text"), F.lit(relation_id).alias("relation_id"), (F.lit(None).cast("string") if dates else _id("object")).alias("object_id"), text.alias("object_text"))
    whole = out.where("subject_id IS NOT NULL AND object_text <> ''" + ("" if dates else " AND object_id IS NOT NULL"))
    if labelled:
        whole = whole.where("subject_text <> ''")
    whole = whole.groupBy("subject_id", "relation_id", "object_id", "object_text").agg(F.min("subject_text").alias("subject_text"))
    return whole.withColumn("source_ref", F.concat_ws(":", F.lit("wikidata"), "subject_id", "relation_id", F.coalesce("object_id", "object_text")))
