"""Hard negatives by a full sort of each anchor's integer scores, in blocks of rows.

Anchors, a stated part of the rows, go to all tasks in passes of bounded size. A task reads its rows in
blocks, sorts each anchor's scores of a block by score and id, and keeps the first few that the
anchor can use; what tasks keep meets by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import cut, passing, small_batches

#: Bytes of the anchors of a pass; numbers of a block of rows, and rows of it at most; fewest and most rows of a task.
ANCHOR_BYTES, BLOCK_NUMBERS, BLOCK_ROWS, TASK_ROWS = 32 << 20, 1 << 21, 1 << 14, (4096, 1 << 18)
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LIMIT = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b; beyond 64 bits they stand at the limits."""
    top = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(a.shape[1], 1)
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], dtype=object).reshape(b.shape).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


class Anchors:
    """The anchors of a pass by length of vector: ids, labels, whole vectors; and for each its positives, best first."""

    def __init__(self, rows: pd.DataFrame, scale: int) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, g in rows.groupby(rows["_vec"].map(len)):
            self.of[int(n)] = (g["_id"].to_numpy(np.int64), g["_label"].to_numpy(object), whole(np.stack(g["_vec"].to_numpy()), scale))
        self.positives: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blocks(batches: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and whole vectors of one length, a block at a time."""
    held: dict[int, list[pd.DataFrame]] = {}

    def block(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = pd.concat(parts)
        return g["_id"].to_numpy(np.int64), g["_label"].to_numpy(object), whole(np.stack(g["_vec"].to_numpy()), scale)

    for batch in batches:
        for n, g in batch.groupby(batch["_vec"].map(len)):
            held.setdefault(n, []).append(g)
            if sum(map(len, held[n])) >= min(BLOCK_ROWS, max(1, BLOCK_NUMBERS // max(n, 1))):
                yield block(held.pop(n))
    for parts in held.values():
        yield block(parts)


def by_anchor(anchors: Anchors, batches: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple]:
    """For each block and anchor: its id, and ids and scores of the block's rows of its label and of other labels."""
    for ids, labels, vectors in blocks(batches, scale):
        of_ids, of_labels, of_vectors = anchors.of.get(vectors.shape[1], ((), (), vectors[:0]))
        for start in range(0, len(of_ids), 64):
            found = scores(of_vectors[start : start + 64], vectors)
            for i, own in enumerate(found, start):
                same = labels == of_labels[i]
                yield of_ids[i], ids, own, same


def sorted_by_score(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -own))
    return ids[order], own[order]


def read(ids: np.ndarray, own: np.ndarray, positive: int, lower: int, upper: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of sorted scores within lower to upper percent of the positive's."""
    most, least = upper * positive // 100, -(-lower * positive // 100)
    start = np.searchsorted(-own, -most, side="left")
    stop = np.searchsorted(-own[start : start + k], -least, side="right") if most >= least else 0
    return ids[start : start + stop], own[start : start + stop]


def hard_negatives(rows: DataFrame, *, anchor: Column | None = None, k: int = 10, n_positives: int = 5, lower: int = 30, upper: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its first n_positives rows of its label, the first k rows of
    other labels with lower * positive score <= 100 * score <= upper * positive score.

    Components become floor(scale * x); scores are their exact inner products, higher first, ties by
    smaller id. anchor: which rows are anchors (default: ids divisible by 100). Rows with a null id,
    label or vector or with a null or non-finite component take no part. Rows that share an id are
    one: the least by label and vector. Vectors of different length are not compared. Anchors without
    positives, and positives without negatives, have no rows; an empty table gives none. Ids are
    whole numbers; labels are compared as they are. Other columns are not read.

    Sent to every task: the anchors of a pass, ANCHOR_BYTES or so, with n_positives ids and scores each.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    anchor = F.col("_id") % 100 == 0 if anchor is None else anchor
    with passing(spark):
        one = rows.where(fine).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.struct(F.col(label_col).alias("_label"), v.alias("_vec"))).alias("_row"))
        held = cut(one.select("_id", "_row._label", "_row._vec"))
        n, n_anchors, longest = held.agg(F.count("*"), F.count_if(anchor), F.max(F.size("_vec"))).first()
        n_passes = max(1, -(-n_anchors * 8 * (longest or 1) // ANCHOR_BYTES))
        wanted = max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS[1]))
        spread = small_batches(held).coalesce(max(1, min(wanted, -(-n // TASK_ROWS[0]))))
        out = None
        for at in range(n_passes):
            chosen = held.where(anchor & (F.pmod(F.xxhash64("_id"), F.lit(n_passes)) == at)).toPandas()
            found = cut(_one_pass(spread, Anchors(chosen, scale), k, n_positives, lower, upper, scale), lasting=True)
            out = found if out is None else out.union(found)
    return out


def _one_pass(rows: DataFrame, anchors: Anchors, k: int, n_positives: int, lower: int, upper: int, scale: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    first = sc.broadcast(anchors)

    def positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for key, ids, own, same in by_anchor(first.value, batches, scale):
            near = same & (ids != key)
            best[key] = tuple(x[:n_positives] for x in sorted_by_score(*(np.concatenate(x) for x in zip(best.get(key, _NONE), (ids[near], own[near]), strict=True))))
        yield from tables((key, ids, own) for key, (ids, own) in best.items())

    order = lambda key, score: Window.partitionBy(*key).orderBy(F.col(score).desc(), score.replace("score", "id"))
    def tables(kept: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """(keys..., ids, scores), a few thousand at a time, as rows."""
        while part := list(islice(kept, 4096)):
            keys = {f"_{i}": np.repeat(x, [len(p[-1]) for p in part]) for i, x in enumerate(zip(*(p[:-2] for p in part), strict=True))}
            yield pd.DataFrame(keys | {"_ids": np.concatenate([p[-2] for p in part]), "_scores": np.concatenate([p[-1] for p in part])})

    near = rows.mapInPandas(positives, "_0 long, _ids long, _scores long").toDF("anchor_id", "positive_id", "positive_score")
    near = near.withColumn("_at", F.row_number().over(order(["anchor_id"], "positive_score"))).where(F.col("_at") <= n_positives).toPandas().sort_values(["anchor_id", "_at"])
    anchors.positives = {int(key): (g["positive_id"].to_numpy(), g["positive_score"].to_numpy()) for key, g in near.groupby("anchor_id")}
    second = sc.broadcast(anchors)

    def negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for key, ids, own, same in by_anchor(second.value, batches, scale):
            other, others = sorted_by_score(ids[~same], own[~same])
            for p, s in zip(*second.value.positives.get(key, ((), ())), strict=True):
                here = read(other, others, int(s), lower, upper, k)
                if len(here[0]):
                    pair = (int(key), int(p), int(s))
                    best[pair] = tuple(x[:k] for x in sorted_by_score(*(np.concatenate(x) for x in zip(best.get(pair, _NONE), here, strict=True))))
        yield from tables((*pair, ids, own) for pair, (ids, own) in best.items())

    far = rows.mapInPandas(negatives, "_0 long, _1 long, _2 long, _ids long, _scores long").toDF("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    ranked = far.withColumn("rank", F.row_number().over(order(["anchor_id", "positive_id"], "negative_score")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
