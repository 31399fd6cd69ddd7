"""URL filter rules as a sort-merge range join.

A host with its labels reversed turns "this host and its subdomains" into one interval of keys:
`org.example.` holds every `org.example.<more>.`. A sweep over sorted keys keeps a stack of the
rule hosts whose intervals are open, outermost first; each carries its path prefixes. Every task
merges its own sorted run of hosts with the sorted rules, so the urls are never shuffled and a
hot host costs one lookup per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import lowered


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules held by one pass over the urls: they are sent to every task, so their size is bounded.
RULES_A_PASS = 50_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; null or no `://`: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return lowered(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or end; null or no `://`: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Node:
    """A rule host: its key and, by path prefix, the verdict; prefix lengths longest first."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host, self.paths = key, host, {}

    def add(self, rule: Rule) -> None:
        # Two rules for the same host and path: block wins.
        if self.paths.get(rule.path) != "block":
            self.paths[rule.path] = rule.verdict
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.paths:
                return len(self.host) + n, len(self.host), self.host + path[:n], self.paths[path[:n]]
        return None


def tree_of(rules: Iterable[Rule]) -> list[Node]:
    nodes: dict[str, Node] = {}
    for rule in rules:
        key = host_key(rule.host)
        nodes.setdefault(key, Node(key, rule.host)).add(rule)
    return [nodes[k] for k in sorted(nodes)]


def sweep(hosts: list[str], nodes: list[Node]) -> dict[str, tuple[Node, ...]]:
    """For each host, the rule hosts that hold it: one merge of both sorted lists with a stack."""
    out: dict[str, tuple[Node, ...]] = {}
    stack: list[Node] = []
    at = 0
    for key, host in sorted((host_key(h), h) for h in set(hosts)):
        while at < len(nodes) and nodes[at].key <= key:
            while stack and not nodes[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(nodes[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        out[host] = tuple(stack)
    return out


def longest_fit(rules: list[Rule]):
    """UDF (host, path) -> the longest rule that fits, with its verdict; one sweep a batch."""

    @F.pandas_udf("all int, of_host int, rule string, verdict string")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        nodes = tree_of(rules)
        for host, path in batches:
            held = sweep(host.tolist(), nodes)
            rows = [max((b for n in held[h] if (b := n.best(p))), key=lambda b: b[:2], default=(None,) * 4) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(rows, columns=["all", "of_host", "rule", "verdict"]).astype({"all": "Int32", "of_host": "Int32"})

    return found


def judge(pages: DataFrame, rules: Iterable[Rule], *, url_col: str = "url", default: str = "allow", rules_a_pass: int = RULES_A_PASS) -> DataFrame:
    """pages with host, path, rule (the longest that fits; else null) and verdict (else `default`).

    A rule fits its host and all subdomains if the path starts with the rule's. Of two of equal
    length the one with the longer host wins, of two that agree in both block. Null urls and such
    without `://` have an empty host and path, which no rule with a host fits. Columns of pages
    with these names are replaced; repeated rows are judged each. More rules than `rules_a_pass`
    are judged in blocks, and the longest of all blocks wins.
    """
    rules = sorted(set(rules), key=lambda r: (host_key(r.host), r.path))
    kept = pages.drop("host", "path", "rule", "verdict")
    url = F.col(url_col)
    out = kept.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    out = out.withColumn("_best", F.lit(None).cast("struct<all:int,of_host:int,rule:string,verdict:string>"))
    for a in range(0, len(rules), rules_a_pass):
        block = rules[a : a + rules_a_pass]

        out = out.withColumn("_new", longest_fit(block)(F.col("host"), F.col("path")))
        better = F.col("_best.all").isNull() | (F.struct("_new.all", "_new.of_host") > F.struct("_best.all", "_best.of_host"))
        out = out.withColumn("_best", F.when(F.col("_new.all").isNotNull() & better, F.col("_new")).otherwise(F.col("_best"))).drop("_new")
    return out.select(*kept.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
