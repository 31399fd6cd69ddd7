"""The corpus pipeline: toxicity, language, n-gram Jaccard join, mixing, packing over `documents`."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import jaccard, language, mixing, packing, toxicity
from palimpsest.llm.common import cut, table

#: SQL cannot express a trained classifier; the stages are tested against brute force.
ORACLE_SQL = None
#: A document in which no language holds this share of its letters is rejected.
LEAST_SHARE = 0.3


#: Columns that stages read or write; any others pass through untouched, whatever they are called.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def set_apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the columns that it does not know in one struct meanwhile, so none clashes with its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in USED]
        if not others:
            return stage(spark, docs, sf_dir)
        held = docs.select(*[c for c in docs.columns if c in USED], F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
        return stage(spark, held, sf_dir).select(*[F.col(c) if c in USED else F.col(f"_others.`{c}`").alias(c) for c in docs.columns])

    return run


@set_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").drop("score", "predicted")


@set_apart
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language holds LEAST_SHARE of them, go; lang becomes what was found."""
    model = language.fit_languages(docs)
    named = language.identify(docs, model, with_spans=False, with_largest=True)
    kept = named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("largest_share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@set_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more over five-word shingles join, the one with the
    least id stays; of rows that share that id, the first by text. Documents without words stay."""
    found = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    gone = F.max((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0))
    info = cut(found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("node")).agg(gone.alias("_gone"), F.count("*").alias("_n")).where("_gone OR _n > 1"))
    # Rows of other ids stay where they are; only those that may go or repeat are shuffled.
    some, rest = jaccard.split_by(docs, info, "doc_id")
    met = some.withColumn("_words", jaccard.has_words("text")).join(info, F.col("doc_id") == F.col("node"), "left")
    first = Window.partitionBy("doc_id").orderBy(F.col("_words").desc(), F.xxhash64("text"), "text")
    kept = met.withColumn("_at", F.row_number().over(first)).where("NOT _words OR (_at = 1 AND NOT coalesce(_gone, false))")
    return rest.select(*docs.columns).union(kept.select(*docs.columns))


@set_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mixed(docs)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
