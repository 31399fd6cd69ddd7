"""Mixing sources to target weights by subset-sum budget fitting.

Per source: documents are counted by exact length; whole copies of the source go in first, a
proportional share of each length next, and a bounded-knapsack dynamic program over the counts
left fills what remains of the budget to the word. Which documents of a length are taken is a
seeded choice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import cut, meet, n_words

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; none above most * its size, the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


#: Words that the dynamic program may fill at most: bounds its memory and time.
WIDEST = 1 << 22


def fill(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Of each length at most `free`, with the largest sum up to budget: the bounded knapsack by dynamic programming.

    Binary splitting of the counts keeps the steps few. For every sum the step that first made it
    is kept; the step before it was made by earlier ones, so the way back needs no more.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    reach = np.zeros(budget + 1, dtype=bool)
    by = np.zeros(budget + 1, dtype=np.int32)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable")[::-1]:
        size = int(lengths[i])
        if size <= 0 or size > budget:
            continue
        left, part = min(int(free[i]), budget // size), 1
        while left > 0 and not reach[budget]:
            part = min(part, left)
            new = np.flatnonzero(reach[: budget + 1 - part * size] & ~reach[part * size :]) + part * size
            reach[new] = True
            by[new] = len(steps)
            steps.append((int(i), part))
            left -= part
            part *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part = steps[by[at]]
        take[i] += part
        at -= part * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, widest: int = WIDEST) -> np.ndarray:
    """How many of each length (at most counts) so that the sum comes closest to budget from below.

    The proportional share of every length is taken first; then lengths in order of their largest
    fractional share, one each, until the rest is small; the dynamic program fills the rest. If it
    cannot fill it to the word, ever more of the shares is given back to it, in the end all: the
    sum is then the best there is. Only a rest of over `widest` words (in units of the common
    divisor of the lengths) is not widened; the best sum that was found counts.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts
    unit = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-(share - take), kind="stable"):
        # Enough stays for the dynamic program to choose from: a few of the longest.
        if rest - lengths[i] < 2 * int(lengths.max()):
            continue
        if take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    while rest < 0:  # rounding of the shares
        i = int(np.argmax(np.where(take > 0, lengths, 0)))
        take[i] -= 1
        rest += int(lengths[i])
    best, short = take, rest
    while True:
        now = take + fill(lengths, counts - take, rest)
        left = budget - int((now * lengths).sum())
        if left < short:
            best, short = now, left
        held = budget - rest
        if not short or not held or rest > widest:
            return best
        wish = min(held, 4 * max(rest, int(lengths.max())))
        take = np.floor(take * (1 - wish / held)).astype(np.int64)
        rest = budget - int((take * lengths).sum())


def _size(size: Column | None, text_col: str) -> Column:
    """Words of the text, or the size given: null and negative ones are 0."""
    return n_words(F.col(text_col)) if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slice_rows: int = 1 << 18) -> DataFrame:
    """Every row of docs with size, source_size, target, copies (0..ceil(most)) and taken = copies * size.

    Sources in order of code points, null last and a source of its own, weigh `weights`, repeating;
    together they are to give as many words as there are. Null and empty texts have size 0 and
    copies 0 unless whole copies of the source are taken. An empty table gives an empty table.
    Equal rows are told apart by nothing: a choice among them may fall on any, but how many are
    taken is fixed. Columns of docs with the names above are replaced.

    Sent to the driver: one row per source. A plan is made per source from one row per distinct
    length. Documents are ranked within (source, length, slice of a hash); there are so many
    slices that the most frequent length has about `slice_rows` documents in each. A null or
    negative size counts as 0.
    """
    spark = docs.sparkSession
    names = ("size", "source_size", "target", "copies", "taken")
    kept = docs.drop(*names)
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    sized = cut(kept.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), _size(size, text_col).alias("_size"), hashed.alias("_hash")))
    largest = sized.groupBy("_source", "_size").count().agg(F.max("count")).first()[0] or 0
    sized = sized.withColumn("_slice", F.pmod("_hash", F.lit(max(64, -(-largest // slice_rows)))).cast("int"))
    grain = cut(sized.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_n")))
    totals = sorted(((r[0], int(r[1] or 0)) for r in grain.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n"))).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goals = targets([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    dims = spark.createDataFrame([(s, n, t) for (s, n), t in zip(totals, goals, strict=True)], "_source string, source_size long, target double")

    def plan(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("_size")
        whole_size, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
        whole = int(target // whole_size) if whole_size else 0
        extra = fit(hist["_size"].to_numpy(), hist["_n"].to_numpy(), round(target) - whole * whole_size)
        return hist.assign(_whole=whole, _extra=extra)[["_source", "_size", "_whole", "_extra", "source_size", "target"]]

    hist = meet(grain.groupBy("_source", "_size").agg(F.sum("_n").alias("_n")), dims, ["_source"])
    plans = hist.groupBy("_source").applyInPandas(plan, "_source string, _size long, _whole int, _extra long, source_size long, target double")
    # Slices come one after the other: those before take their documents first.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = meet(grain.withColumn("_before", before), plans, ["_source", "_size"]).select(
        "_source", "_size", "_slice", "_whole", (F.col("_extra") - F.col("_before")).alias("_here"), "source_size", "target"
    )
    ranked = sized.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_size", "_slice").orderBy("_hash", "_id")))
    copies = F.col("_whole") + (F.col("_rank") <= F.col("_here")).cast("int")
    return meet(ranked, cells, ["_source", "_size", "_slice"]).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken")
    )


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as mix() says, with the columns of docs.

    Rows are matched by (id, source, place among rows that agree in both), so repeated ids keep
    their own rows.
    """
    held = docs.columns
    plan = mix(docs, id_col=id_col, source_col=source_col, **options).where("copies > 0")
    plan = plan.groupBy(id_col, source_col, "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    text_col = options.get("text_col", "text")
    text = F.col(text_col)
    rows = docs.withColumn("_size", _size(options.get("size"), text_col))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(id_col, source_col, "_size").orderBy(F.xxhash64(text))))
    met = meet(rows, plan.withColumnRenamed("size", "_size"), [id_col, source_col, "_size"])
    met = met.withColumn("_times", F.get("_copies", F.col("_at") - 1)).where("_times > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*held)
