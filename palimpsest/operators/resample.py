"""Bootstrap and seeded samples."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import digests, twister
from palimpsest.operators.metrics import COUNTED, from_sums, sums
from palimpsest.sources.shared import workspace

NAMES = ("base_acc", "gcf", "gap", "sensitivity_at_base_correct", "invariance_at_base_correct", "underreaction_at_base_correct", "overreaction_at_base_correct", "tie_rate", "order_disagreement")
#: Ranges of the id within which rows are numbered, at most: so many bounds go into the plan.
RANGES = 512
#: Pairs of draws that one row of a plan stands for before it is unfolded.
BLOCK = 2048
#: Families that are sent to every task: some 100 bytes each, so 50 MB at most. More are joined by shuffles.
BROADCAST_ROWS = 500_000


def ordinals(families: DataFrame, by: list[str], order: str = "family_id") -> DataFrame:
    """ordinal 0.. in order of the id within each slice.

    Rows are numbered within ranges of the id, and shifted by the sizes of the ranges before. The
    bounds are taken once and are part of the plan from then on, so every run of it agrees. Sent to
    the driver: RANGES bounds at most. Ids that are equal are numbered in no certain order.
    """
    parts = min(RANGES, int(families.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = families.select(order).repartitionByRange(parts, order)
    least = dealt.groupBy(F.spark_partition_id().alias("_part")).agg(F.min(order).alias("_least"))
    bounds = sorted(r["_least"] for r in least.collect() if r["_least"] is not None)
    kind = families.schema[order].dataType
    held = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    cell = F.coalesce(F.size(F.filter(held, lambda b: b <= F.col(order))), F.lit(-1))
    placed = families.withColumn("_cell", cell)
    sizes = placed.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order)) - 1
    return placed.withColumn("_place", place).join(shift, [*by, "_cell"]).withColumn("ordinal", F.col("_before") + F.col("_place")).drop("_cell", "_place", "_before")


def hash_draw(rep: Column | str, pair: Column | str) -> Column:
    """Two numbers of 60 bits: those of draws 2 * pair and 2 * pair + 1 of a replicate, from md5(rep:pair)."""
    digits = F.md5(F.concat_ws(":", rep, pair).cast("binary"))
    return F.transform(F.array(F.substring(digits, 1, 15), F.substring(digits, 17, 15)), lambda x: F.conv(x, 16, 10).cast("long"))


def hash_draws(families: DataFrame, by: list[str], reps: int) -> DataFrame:
    """The draws of every replicate: (slice, rep, ordinal, times = 1), as many as the slice has families.

    Blocks of draws are dealt over the cluster first and unfolded there.
    """
    n = families.groupBy(*by).agg(F.count("*").alias("n"))
    pairs = F.floor((F.col("n") + 1) / 2)
    blocks = n.where("n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((pairs - 1) / BLOCK))))
    blocks = blocks.repartition(*by, "rep", "block")
    first = F.col("block") * BLOCK
    pair = blocks.withColumn("pair", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), pairs - 1))))
    drawn = pair.select(*by, "n", "rep", "pair", F.posexplode(hash_draw("rep", "pair")).alias("side", "bits")).where(F.col("pair") * 2 + F.col("side") < F.col("n"))
    return drawn.select(*by, "rep", (F.col("bits") % F.col("n")).alias("ordinal"), F.lit(1).alias("times"))


#: Words of the generator's stream that one task reads, at least and at most, and at a time.
WORDS_A_BLOCK, WORDS_AT_ONCE = (1 << 18, 1 << 25), 1 << 20


def _blocks(spark: SparkSession, first: int, last: int) -> DataFrame:
    # One block a task: a block is some tenths of a second of work.
    return spark.range(first, last, numPartitions=last - first).toDF("block")


def _exact_blocks(spark: SparkSession, n: int, reps: int, seed: int, words: int | None) -> tuple[int, Callable[[int], Iterator[tuple[int, np.ndarray]]]]:
    """How many blocks the generator's stream has for reps times n draws, and the draws of a block: (place of the first, values) in turn."""
    if n.bit_length() > 32:
        raise ValueError("the standard library's draws are for up to 2^32 rows: use hash_draws")
    wanted, key, share = n * reps, twister.seeded(seed), n / (1 << n.bit_length())
    if words is None:
        words = min(WORDS_A_BLOCK[1], max(WORDS_A_BLOCK[0], math.ceil(wanted / share / (4 * spark.sparkContext.defaultParallelism))))

    def parts(block: int) -> Iterator[np.ndarray]:
        there = twister.source(twister.jumped(key, block * words))
        for done in range(0, words, WORDS_AT_ONCE):
            yield twister.accepted(there, n, min(WORDS_AT_ONCE, words - done))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"block": batch["block"], "draws": [sum(map(len, parts(int(b)))) for b in batch["block"]]})

    # The share of words that count is known; the last blocks may be needed or not, and more where luck was against it.
    ends: list[int] = []
    while not ends or ends[-1] < wanted:
        more = max(1, math.ceil((wanted - (ends[-1] if ends else 0)) / share / words))
        for r in sorted(_blocks(spark, len(ends), len(ends) + more).mapInPandas(counted, "block long, draws long").collect()):
            ends.append((ends[-1] if ends else 0) + r["draws"])

    def drawn(block: int) -> Iterator[tuple[int, np.ndarray]]:
        at = ends[block - 1] if block else 0
        for values in parts(block):
            values = values[: max(0, wanted - at)]
            if not len(values):
                break
            yield at, values
            at += len(values)

    return len(ends), drawn


def exact_draws(families: DataFrame, reps: int, seed: int, words: int | None = None) -> DataFrame:
    """The draws of the standard library's generator: (rep, ordinal, times). They depend on seed, n and reps only.

    The stream is parted into blocks of `words` (by default so that all cores have some), which tasks enter by a jump. They first count how
    many draws their block holds; a running sum tells which draws of which replicate stand where, and
    tasks then make those. The driver holds a number per block. A replicate and ordinal may stand
    in several rows, one per block or part of it.
    """
    spark, n = families.sparkSession, families.count()
    schema = "rep int, ordinal long, times long"
    if not n or reps <= 0:
        return spark.createDataFrame([], schema)
    n_blocks, drawn = _exact_blocks(spark, n, reps, seed, words)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["block"].tolist():
                for at, values in drawn(block):
                    # Draws of a replicate follow each other.
                    codes, times = np.unique((at + np.arange(len(values))) // n * n + values, return_counts=True)
                    yield pd.DataFrame({"rep": (codes // n).astype(np.int32), "ordinal": codes % n, "times": times})

    return _blocks(spark, 0, n_blocks).mapInPandas(rows, schema)


def bootstrap(families: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """Long (slice, metric, point_estimate, ci_lower, ci_upper); bounds by index, nulls left out.

    Each replicate is a weighed sum over distinct families, never a copy of the rows. Up to
    BROADCAST_ROWS families are sent to the draws, which then sum where they are made. For draws that
    are made by hash, `hash_bootstrap` gives the same without a row per draw.
    """
    numbered = ordinals(families, by)
    if families.count() <= BROADCAST_ROWS:
        numbered = F.broadcast(numbered)
    return _intervals(families, sums(draws.join(numbered, [*by, "ordinal"]), [*by, "rep"], F.col("times")), by)


def _intervals(families: DataFrame, resampled: DataFrame, by: list[str]) -> DataFrame:
    """Point estimates, and bounds from the sums of every replicate."""
    reps = from_sums(resampled)
    long = lambda df, value: df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(value)) for m in NAMES])).alias("x")).select(*by, "x.*")
    values = long(reps, "value").groupBy(*by, "metric").agg(F.sort_array(F.collect_list("value")).alias("v"))
    k = F.size("v")
    low = F.greatest(F.lit(0), F.floor(k * F.lit(0.025)).cast("int") - 1)
    high = F.least(k - 1, F.floor(k * F.lit(0.975)).cast("int"))
    bounds = values.select(*by, "metric", F.when(k > 0, F.get("v", low)).alias("ci_lower"), F.when(k > 0, F.get("v", high)).alias("ci_upper"))
    return long(from_sums(sums(families, by)), "point_estimate").join(bounds, [*by, "metric"])


#: Families whose kinds are one row of a plan, and such rows of a slice that one task holds: 64 MB for kinds of two bytes.
CHUNK, HELD = 1 << 20, 32
#: Parts into which the replicates are dealt: each gets a copy of all kinds.
REP_BLOCKS = 100


def _coded(families: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """Families as numbers of their kind, in order of the id: (families, slices, kinds, chunks, type of the numbers).

    Families of one kind agree in all columns that sums need, so there are some hundred kinds however
    many families; kinds and slices are numbered in one task each. A chunk is the kinds of CHUNK
    ordinals of a slice, two bytes each (four, if there are more kinds than that).
    """
    spark, at = families.sparkSession, workspace(families.sparkSession, "bootstrap")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    families = kept(families.select("family_id", *by, *COUNTED), "families")
    drawable = families.dropna(subset=by) if by else families  # a null slice meets no draw
    numbered = lambda df, of, name: df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*of)) - 1)
    slices = kept(numbered(drawable.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"), by or ["n"], "slice"), "slices")
    kinds = kept(numbered(drawable.select(F.struct(*COUNTED).alias("of")).distinct(), ["of"], "kind"), "kinds")
    wide = "<u2" if kinds.count() <= 1 << 16 else "<u4"
    placed = ordinals(drawable.select("family_id", *by, F.struct(*COUNTED).alias("of")), by).join(F.broadcast(kinds) if wide == "<u2" else kinds, "of")
    met = placed.join(F.broadcast(slices), by) if by else placed.crossJoin(F.broadcast(slices))

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.empty(len(rows), wide)
        codes[rows["ordinal"].to_numpy() - key[1] * CHUNK] = rows["kind"].to_numpy()
        return pd.DataFrame({"slice": [key[0]], "chunk": [key[1]], "n": [rows["n"].iat[0]], "codes": [codes.tobytes()]})

    cells = met.select("slice", F.floor(F.col("ordinal") / CHUNK).alias("chunk"), "n", "ordinal", "kind").groupBy("slice", "chunk")
    return families, slices, kinds, kept(cells.applyInPandas(chunk, "slice long, chunk long, n long, codes binary"), "chunks"), wide


def hash_bootstrap(families: DataFrame, by: list[str], reps: int) -> DataFrame:
    """What bootstrap() gives for hash_draws(), with no row per draw and no shuffle of draws.

    Tasks get a share of the replicates and the kinds of all families (of HELD chunks of each slice at
    a time; beyond those, digests are made again for the next ones), make the digests in arrays and
    count the kinds drawn. What leaves a task is a row per slice, replicate and kind.
    """
    families, slices, kinds, chunks, wide = _coded(families, by)
    size = max(1, math.ceil(reps / REP_BLOCKS))
    n_blocks = math.ceil(reps / size)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slice", "chunk"])
        held = [(int(s), int(own["n"].iat[0]), int(own["chunk"].iat[0]) * CHUNK, np.frombuffer(b"".join(own["codes"]), wide)) for s, own in rows.groupby("slice")]
        n_kinds = 1 + max(int(codes.max()) for _, _, _, codes in held)
        most = max(n for _, n, _, _ in held)
        out = []
        for rep in range(key[0] * size, min(reps, (key[0] + 1) * size)):
            times = {s: np.zeros(n_kinds, np.int64) for s, _, _, _ in held}
            waiting: dict[int, list[np.ndarray]] = {s: [] for s in times}
            ready = 0
            for first, *sides in digests.drawn(rep, 0, (most + 1) // 2):
                for s, n, low, codes in held:
                    for side, numbers in enumerate(sides):
                        there = (n - side + 1) // 2 - first  # pairs whose number on this side is a draw of the slice
                        if there > 0:
                            at = digests.remainders(numbers[:there], n) - low
                            waiting[s].append(codes[at if len(codes) == n else at[(at >= 0) & (at < len(codes))]])
                ready += len(sides[0])
                if ready >= max(1 << 16, n_kinds) or 2 * (first + len(sides[0])) >= most:
                    for s, parts in waiting.items():
                        if parts:
                            times[s] += np.bincount(np.concatenate(parts), minlength=n_kinds)
                            parts.clear()
                    ready = 0
            for s, x in times.items():
                drawn = np.flatnonzero(x)
                out.append(pd.DataFrame({"slice": s, "rep": rep, "kind": drawn, "times": x[drawn]}))
        return pd.concat(out)

    work = chunks.withColumn("part", F.floor(F.col("chunk") / HELD)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    counted = work.repartition(2 * n_blocks, "block", "part").groupBy("block", "part").applyInPandas(count, "slice long, rep int, kind long, times long")
    whole = counted.join(F.broadcast(kinds), "kind") if wide == "<u2" else counted.join(kinds, "kind")
    resampled = sums(whole.select("slice", "rep", "times", "of.*"), ["slice", "rep"], F.col("times"))
    return _intervals(families, resampled.join(F.broadcast(slices.drop("n")), "slice").drop("slice") if by else resampled, by)


def exact_bootstrap(families: DataFrame, reps: int, seed: int, words: int | None = None) -> DataFrame:
    """What bootstrap() gives for exact_draws(), with no row per draw: blocks of the stream, dealt into at most REP_BLOCKS runs, meet the kinds of all families."""
    families, _, kinds, chunks, wide = _coded(families, [])
    n = families.count()
    n_blocks, drawn = _exact_blocks(families.sparkSession, n, reps, seed, words) if n and reps > 0 else (1, lambda block: iter(()))
    size = math.ceil(n_blocks / REP_BLOCKS)
    n_runs = math.ceil(n_blocks / size)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        low, codes = int(rows["chunk"].iat[0]) * CHUNK, np.frombuffer(b"".join(rows["codes"]), wide)
        n_kinds, times = 1 + int(codes.max()), {}
        for block in range(key[0] * size, min(n_blocks, (key[0] + 1) * size)):
            for at, values in drawn(block):
                while len(values):  # draws of a replicate follow each other
                    rep, own = at // n, values[: n - at % n]
                    place = own.astype(np.int64) - low
                    met = codes[place if len(codes) == n else place[(place >= 0) & (place < len(codes))]]
                    times[rep] = times.get(rep, 0) + np.bincount(met, minlength=n_kinds)
                    at, values = at + len(own), values[len(own) :]
        out = [pd.DataFrame({"rep": rep, "kind": np.flatnonzero(x), "times": x[np.flatnonzero(x)]}) for rep, x in times.items()]
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "kind": [], "times": []}, dtype="int64")

    work = chunks.withColumn("part", F.floor(F.col("chunk") / HELD)).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    counted = work.repartition(2 * n_runs, "run", "part").groupBy("run", "part").applyInPandas(count, "rep int, kind long, times long")
    whole = counted.join(F.broadcast(kinds), "kind") if wide == "<u2" else counted.join(kinds, "kind")
    return _intervals(families, sums(whole.select("rep", "times", "of.*"), ["rep"], F.col("times")), [])


def hash_sample(df: DataFrame, k: int, seed: int, id_col: str) -> DataFrame:
    """K rows, the first by md5(seed:id)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)).cast("binary")), id_col).limit(k)


def exact_sample(df: DataFrame, k: int, seed: int, id_col: str) -> DataFrame:
    """O03 as the standard library draws it: k ordinals by the driver, rows by a semi-join."""
    numbered = ordinals(df, [], id_col)
    n = df.count()
    if n <= k:
        return df
    picked = [(i,) for i in random.Random(seed).sample(range(n), k)]
    return numbered.join(F.broadcast(df.sparkSession.createDataFrame(picked, "ordinal long")), "ordinal", "left_semi").drop("ordinal")  # k rows
