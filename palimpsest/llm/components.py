"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, passing


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """links (a, b) -> a written table (node, component_id): the smallest node that can be reached, for nodes with a link.

    Alternating stars: every node hands its larger neighbours to its least one, then its smaller
    neighbours. Each round is written to the shared folder; nothing but a checksum goes to the
    driver. Nulls, loops and repeated links are passed over. The number of rounds grows with the
    logarithm of the longest path; beyond `rounds` it is an error, never a partial result.
    """
    with passing(links.sparkSession):
        return cut(_settled(links, rounds), lasting=True)


def _settled(links: DataFrame, rounds: int) -> DataFrame:
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    seen = _sum(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
