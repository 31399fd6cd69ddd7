"""Target-distribution importance resampling with a dictionary of distinct features.

Every distinct n-gram string is counted once over all documents and hashed once; buckets are sums
over the dictionary. What a bucket gains joins the dictionary again, and the dictionary the
features of each document. The most frequent strings, a number of bounded size, are looked up where
documents are read; all others meet their documents in a shuffle by the string, in which therefore
no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import cut, meet, n_partitions, passing, small_batches
from palimpsest.llm.words import terms

#: Strings of at most FREQUENT_BYTES that are sent to every task: 8 MB of text at most.
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
#: Begins the key under which a document itself passes the join; no feature begins with a space.
APART = b" "


def _hash(text: Column) -> Column:
    return F.xxhash64(F.lit(42), text)


def grams(text: str | None, widest: int) -> tuple[Counter, int]:
    """Runs of 1 to widest consecutive words, joined by one space, with their counts; and the number of words."""
    found: Counter = Counter()
    total, held = 0, []
    for words in terms(text):
        total += len(words)
        found.update(words)
        if widest > 1:
            words = held + words
            for k in range(2, widest + 1):
                # Runs that end among the words held back were counted before.
                found.update(b" ".join(words[i : i + k]) for i in range(max(0, len(held) - k + 1), len(words) - k + 1))
            held = words[1 - widest :]
    return found, total


def dictionary(docs: DataFrame, *, widest: int = 1, text_col: str = "text") -> DataFrame:
    """feature (UTF-8) and n: every distinct feature of all texts and how often it occurs. Nulls have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here: Counter = Counter()
            for text in batch.column(0).to_pylist():
                here.update(grams(text, widest)[0])
            yield pa.RecordBatch.from_pydict({"feature": pa.array(here.keys(), pa.binary()), "n": pa.array(here.values(), pa.int64())})

    return small_batches(docs.select(text_col)).mapInArrow(counted, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, gain from two dictionaries: at most n_buckets rows. Sums of counts are whole; logarithms are doubles."""
    bucketed = lambda d, n: d.groupBy(F.pmod(F.crc32("feature"), F.lit(n_buckets)).alias("bucket")).agg(F.sum("n").alias(n))
    s, t = cut(bucketed(own, "s")), cut(bucketed(target, "t"))
    all_s, all_t = ((x.agg(F.sum(c)).first()[0] or 0) + n_buckets for x, c in ((s, "s"), (t, "t")))
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(all_s)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t)))
    return s.join(t, "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, *, widest: int = 1, n_buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row for every row of docs: its id, n_words, n_features, weight, score and rank (null if not drawn).

    Of the documents with at least least_words words, floor(percent * their number / 100) with the
    highest scores are drawn: weights plus Gumbel noise from the id, which is drawing without
    replacement with odds as exp(weight / 1000). Ties go to the smaller id. Null ids count as empty
    text in the noise and come last among ties; rows that share an id have its noise each; rows that
    are equal each have a rank. Null and empty texts have no features and weight 0. No rows give no
    rows; an empty target makes all buckets' odds those of its smoothing.
    Other columns of docs are not read, so their names do not matter.
    """
    options = {"widest": widest, "n_buckets": n_buckets, "percent": percent, "least_words": least_words, "seed": seed, "frequent": frequent}
    return _weigh(docs, target, id_col=id_col, text_col=text_col, target_col=target_col, **options).drop("_hash", "_copy").withColumnRenamed("_id", id_col)


def _weigh(docs: DataFrame, target: DataFrame, *, widest: int = 1, n_buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, frequent: int = FREQUENT, id_col: str, text_col: str, target_col: str = "text") -> DataFrame:
    with passing(docs.sparkSession):
        found = _weighed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), target.select(F.col(target_col).alias("_text")), widest, n_buckets, frequent)
        return cut(_ranked(found, percent, least_words, seed), lasting=True)


def _weighed(docs: DataFrame, target: DataFrame, widest: int, n_buckets: int, frequent: int) -> DataFrame:
    """_id, _hash (of the text), _copy, n_words, n_features, weight."""
    own = cut(dictionary(docs, widest=widest, text_col="_text"))
    worth = gains(own, dictionary(target, widest=widest, text_col="_text"), n_buckets)  # n_buckets rows
    known = cut(own.withColumn("bucket", F.pmod(F.crc32("feature"), F.lit(n_buckets))).join(F.broadcast(cut(worth)), "bucket").select("feature", "n", "gain"))
    common = known.where(F.octet_length("feature") <= FREQUENT_BYTES).orderBy(F.col("n").desc(), "feature").limit(frequent)
    held = docs.sparkSession.sparkContext.broadcast({bytes(f): g for f, g in common.select("feature", "gain").toLocalIterator()})

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = held.value
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            whole: list[tuple[int, int, int]] = []
            rest: tuple[list, list, list] = ([], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts, n_words = grams(text, widest)
                whole.append((n_words, sum(counts.values()), sum(c * gain_of[f] for f, c in counts.items() if f in gain_of)))
                for f, c in counts.items():
                    if f not in gain_of:
                        for to, x in zip(rest, (i, f, c), strict=True):
                            to.append(x)
            alone = [APART + str(h % 65_521).encode() for h in hashes.to_pylist()]
            yield part(ids, hashes, [1] * len(whole), *zip(*whole, strict=True), alone, [0] * len(whole))
            at, none = pa.array(rest[0], pa.int64()), [0] * len(rest[0])
            yield part(ids.take(at), hashes.take(at), none, none, none, none, *rest[1:])

    def part(*columns) -> pa.RecordBatch:
        kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        made = [c if k is None or isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, ["_id", "_hash", "rows", "n_words", "n_features", "weight", "feature", "times"])

    kind = docs.schema["_id"].dataType.simpleString()
    texts = small_batches(docs.select("_id", "_text", _hash(F.col("_text")).alias("_hash")))
    parts = texts.mapInArrow(looked_up, f"_id {kind}, _hash long, rows long, n_words long, n_features long, weight long, feature binary, times long")
    met = parts.join(known.select("feature", "gain"), "feature", "left")
    summed = met.groupBy("_id", "_hash").agg(
        F.sum("rows").alias("rows"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum(F.col("weight") + F.col("times") * F.coalesce("gain", F.lit(0))).alias("weight")
    )
    # Equal rows were summed together: each has its share.
    return cut(summed.select("_id", "_hash", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"), *[F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")]))


def _ranked(found: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """found with score and rank. Places are counted within ranges of the order, so no task sorts all rows."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = found.withColumn("score", F.col("weight") + noise).withColumn("_in", F.col("n_words") >= least_words)
    order = (F.col("_in").desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_hash").asc(), F.col("_copy").asc())
    ranged = scored.repartitionByRange(n_partitions(found.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_place", F.monotonically_increasing_id()))  # range in the upper bits, place within it in the lower 33
    block = F.shiftright("_place", 33).alias("_block")
    sizes = placed.groupBy(block).agg(F.count("*").alias("_size"), F.count_if("_in").alias("_n_in"))  # a row per range
    w = Window.orderBy("_block")
    starts = sizes.select("_block", (F.sum("_size").over(w) - F.col("_size")).alias("_start"), F.sum("_n_in").over(Window.partitionBy()).alias("_all"))
    at = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.col("_in") & (at <= F.expr(f"_all * {percent} div 100"))
    with_starts = placed.withColumn("_block", block).join(F.broadcast(starts), "_block")
    return with_starts.select("_id", "_hash", "_copy", "n_words", "n_features", "weight", "score", F.when(drawn, at).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs with all their columns, whatever they are called.

    Rows are found by id and text; where the same id and text stand more than once, as many of them
    as were drawn are returned, the first by the hash of all their columns.
    """
    drawn = _weigh(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL").groupBy("_id", "_hash").agg(F.count("*").alias("_n"))
    rows = docs.select(F.col(id_col).alias("_id"), _hash(F.col(text_col)).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    met = meet(rows, drawn, ["_id", "_hash"])
    at = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row")))
    return met.withColumn("_at", at).where("_at <= _n").select("_row.*")
