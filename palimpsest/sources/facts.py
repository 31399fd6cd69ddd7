"""Statements of a knowledge graph as a table whose filters become part of the query.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FactSource)
    facts = spark.read.format("facts").option("url", "https://host/sparql?format=json&query={query}").load()
    facts.where("relation_id = 'P569' AND class_id = 'Q5' AND best_rank")

Relations must be named (= or IN): the graph is never read whole. Pushed down: relation_id and subject_id
by = and IN, class_id and also_relation_id by =, rank by =, <> and IN, best_rank. Each relation is a
partition that asks page after page, or, where subjects are named, one for each batch of them. A
predicate that cannot be put into the query is left to Spark.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not

from palimpsest.fixed import RELATIONS

SCHEMA = "subject_id string, subject_text string, relation_id string, object_id string, object_text string, rank string, best_rank boolean, class_id string, also_relation_id string, source_ref string"
#: Ranks and the terms that stand for them; ids of a lookup at most; the relation of an occupation.
RANKS = {"preferred": "wikibase:PreferredRank", "normal": "wikibase:NormalRank", "deprecated": "wikibase:DeprecatedRank"}
MOST_IDS = 50
OCCUPATION = "P106"
HUMAN = "Q5"


def statements_query(
    relation_id: str, *, class_id: str | None = None, also_relation_id: str | None = None, subject_ids: Sequence[str] = (), dates: bool = False, ranks: Sequence[str] | None = None, best_rank: bool = False, language: str = "en"
) -> str:
    """Statements of a relation with labels and rank, by page: `{limit}` and `{offset}` stay to be filled in.

    ranks: those that may come. best_rank: no deprecated one, and a normal one only where the subject has no preferred one.
    """
    for name in (relation_id, class_id, also_relation_id, *subject_ids):
        if name is not None and not re.fullmatch(r"[PQ]\d+", name):
            raise ValueError(f"{name!r} is no id")
    where = [f"VALUES ?subject {{ {' '.join(f'wd:{x}' for x in sorted(set(subject_ids)))} }}"] if subject_ids else []
    if class_id:
        where.append(f"?subject wdt:P31 wd:{class_id} .")
    if also_relation_id:
        where.append(f"?subject wdt:{also_relation_id} ?also .")
    where.append(f"?subject p:{relation_id} ?statement . ?statement wikibase:rank ?rank .")
    if dates:
        held = "?time ?precision"
        where.append(f"?statement psv:{relation_id} ?node . ?node wikibase:timeValue ?time ; wikibase:timePrecision ?precision .")
    else:
        held = "?object ?objectLabel"
        where.append(f"?statement ps:{relation_id} ?object . ?object rdfs:label ?objectLabel . FILTER(LANG(?objectLabel) = '{language}')")
    where.append(f"?subject rdfs:label ?subjectLabel . FILTER(LANG(?subjectLabel) = '{language}')")
    if ranks is not None:
        where.append(f"FILTER(?rank IN ({', '.join(RANKS[r] for r in RANKS if r in ranks)}))")
    if best_rank:
        where.append(f"FILTER(?rank != {RANKS['deprecated']})")
        where.append(f"FILTER(?rank = {RANKS['preferred']} || NOT EXISTS {{ ?subject p:{relation_id} ?other . ?other wikibase:rank {RANKS['preferred']} . }})")
    return f"SELECT DISTINCT ?subject ?subjectLabel {held} ?rank WHERE {{ {' '.join(where)} }} ORDER BY ?subject {held.split()[0]} LIMIT {{limit}} OFFSET {{offset}}"


def date_text(moment: str | None, precision: object) -> str | None:
    """X11 for one value: as many of year, month and day as the precision covers, with the sign of a year before the common era."""
    if not moment or len(moment) < 11 or not str(precision or "").isdigit() or int(str(precision)) < 9:
        return None
    sign = "-" if moment[0] == "-" else ""
    return sign + moment.lstrip("+-")[: {9: 4, 10: 7}.get(int(str(precision)), 10)]


class Asked(InputPartition):
    def __init__(self, relation_id: str, subject_ids: tuple[str, ...]) -> None:
        self.relation_id, self.subject_ids = relation_id, subject_ids


class FactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.relations: tuple[str, ...] | None = None
        self.subjects: tuple[str, ...] | None = None
        self.ranks: tuple[str, ...] | None = None
        self.class_id: str | None = None
        self.also: str | None = None
        self.best = False
        self.size, self.pages = int(options.get("page_size", 500)), int(options.get("pages", 1_000_000))
        if self.size <= 0 or self.pages <= 0:
            raise ValueError("page_size and pages must be positive")

    @staticmethod
    def _both(held: tuple | None, more: Iterable) -> tuple:
        """Conditions on one column hold together."""
        return tuple(sorted(set(more) if held is None else set(held) & set(more)))

    def _take(self, f: Filter) -> bool:
        """Whether the condition is part of the query now."""
        match f:
            case EqualTo(("relation_id",), x):
                self.relations = self._both(self.relations, [x])
            case In(("relation_id",), xs):
                self.relations = self._both(self.relations, xs)
            case EqualTo(("subject_id",), x):
                self.subjects = self._both(self.subjects, [x])
            case In(("subject_id",), xs):
                self.subjects = self._both(self.subjects, xs)
            case EqualTo(("class_id",), x) if self.class_id in (None, x):
                self.class_id = x
            case EqualTo(("also_relation_id",), x) if self.also in (None, x):
                self.also = x
            case EqualTo(("rank",), x):
                self.ranks = self._both(self.ranks, [x])
            case In(("rank",), xs):
                self.ranks = self._both(self.ranks, xs)
            case Not(EqualTo(("rank",), x)):
                self.ranks = self._both(self.ranks, [r for r in RANKS if r != x])
            case Not(In(("rank",), xs)):
                self.ranks = self._both(self.ranks, [r for r in RANKS if r not in xs])
            case EqualTo(("best_rank",), True):
                self.best = True
            case IsNotNull((name,)):
                # What an equality of the same column asks for is never null; these columns never are.
                return name in ("relation_id", "subject_id", "subject_text", "object_text", "rank", "best_rank", "source_ref")
            case _:
                return False
        return True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from [f for f in filters if not self._take(f)]

    def partitions(self) -> list[InputPartition]:
        if self.relations is None:
            raise ValueError("name the relations to read, by relation_id = or IN, with spark.sql.python.filterPushdown.enabled")
        relations = [r for r in self.relations if r is not None and re.fullmatch(r"P\d+", r)]
        if self.subjects is None:
            return [Asked(r, ()) for r in relations]
        ids = [s for s in self.subjects if s is not None and re.fullmatch(r"Q\d+", s)]
        return [Asked(r, tuple(ids[i : i + MOST_IDS])) for r in relations for i in range(0, len(ids), MOST_IDS)]

    def query(self, part: Asked) -> str:
        dates = RELATIONS.get(part.relation_id, ("", ""))[1] == "date"
        return statements_query(part.relation_id, class_id=self.class_id, also_relation_id=self.also, subject_ids=part.subject_ids, dates=dates, ranks=self.ranks, best_rank=self.best, language=self.options.get("language", "en"))

    def read(self, part: Asked | None) -> Iterator[tuple]:
        from palimpsest.sources.paged import get_json, rows_of

        if part is None or self.ranks == ():  # nothing was asked for, or nothing can be
            return
        text = self.query(part)
        for page in range(self.pages):
            asked = text.replace("{limit}", str(self.size)).replace("{offset}", str(page * self.size))
            rows = rows_of(get_json(self.options["url"].replace("{query}", urllib.parse.quote(asked)), timeout=float(self.options.get("timeout", 60))), "results.bindings")
            for row in rows:
                if (held := self._row(part.relation_id, row)) is not None:
                    yield held
            if len(rows) < self.size:
                return
            time.sleep(float(self.options.get("pause", 0)))

    def _row(self, relation_id: str, row: dict) -> tuple | None:
        """A binding as a row; None where it is incomplete."""
        value = lambda name: ((row.get(name) or {}).get("value") or "").strip()
        entity = lambda name: (re.search(r"(?:^|/)(Q\d+)$", value(name)) or [None, None])[1]
        subject, subject_text = entity("subject"), value("subjectLabel")
        object_id = entity("object")
        text = date_text(value("time"), value("precision")) if "time" in row else value("objectLabel")
        if not subject or not subject_text or not text or ("time" not in row and not object_id):
            return None
        rank = next((name for name, term in RANKS.items() if value("rank").endswith(term.split(":")[1])), None)
        return (subject, subject_text, relation_id, object_id, text, rank, True if self.best else None, self.class_id, self.also, f"wikidata:{subject}:{relation_id}:{object_id or text}")


class FactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "facts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FactReader:
        return FactReader(dict(self.options))


def eligible(facts: DataFrame, relation_ids: Sequence[str]) -> DataFrame:
    """Ids of humans with an occupation who hold one of the relations, asked of the source in that form."""
    asked = (F.col("class_id") == HUMAN) & (F.col("also_relation_id") == OCCUPATION) & F.col("relation_id").isin(*relation_ids) & F.col("best_rank")
    return facts.where(asked).select(F.col("subject_id").alias("entity_id")).distinct()


def relation_rows(facts: DataFrame, relation_ids: Sequence[str], class_id: str) -> DataFrame:
    """Subjects of a class with their best-ranked values of the relations; of equal ones one stays."""
    held = facts.where(F.col("relation_id").isin(*relation_ids) & (F.col("class_id") == class_id) & F.col("best_rank"))
    return held.groupBy("subject_id", "relation_id", "object_id", "object_text").agg(F.min("subject_text").alias("subject_text"), F.min("source_ref").alias("source_ref"))


def slot_rows(facts: DataFrame, relation_id: str, slot: str, entity_ids: Sequence[str]) -> DataFrame:
    """entity_id, entity_name, is_human, slot, value_id, value_text, source_ref of named humans."""
    held = facts.where((F.col("relation_id") == relation_id) & (F.col("class_id") == HUMAN) & F.col("subject_id").isin(*entity_ids) & F.col("best_rank"))
    renamed = held.select(F.col("subject_id").alias("entity_id"), F.col("subject_text").alias("entity_name"), F.lit(True).alias("is_human"), F.lit(slot).alias("slot"), F.col("object_id").alias("value_id"), F.col("object_text").alias("value_text"), "source_ref")
    return renamed.groupBy("entity_id", "slot", "value_id").agg(F.min("entity_name").alias("entity_name"), F.first("is_human").alias("is_human"), F.min("value_text").alias("value_text"), F.min("source_ref").alias("source_ref"))
