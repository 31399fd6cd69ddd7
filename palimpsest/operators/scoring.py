"""Models over prompts: the plug-in point and a recorded stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.judging import family_results, variant_results

#: A scorer takes prefixes and gives the log probabilities of the labels A and B.
Scorer = Callable[[list[str]], list[tuple[float, float]]]


def score(prompts: DataFrame, load: Callable[[], Scorer], batch: int = 64) -> DataFrame:
    """Prompts (with `prefix`) with score_a and score_b; the model is loaded once per worker."""

    @F.pandas_udf("struct<score_a:double,score_b:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for prefixes in batches:
            texts = prefixes.tolist()
            found = [x for i in range(0, len(texts), batch) for x in scorer(texts[i : i + batch])]
            yield pd.DataFrame(found, columns=["score_a", "score_b"])

    return prompts.withColumn("_s", scored("prefix")).select("*", "_s.score_a", "_s.score_b").drop("_s")


#: The one model that this worker holds: its key and itself.
_held: tuple[str, Scorer] | None = None


def held(key: str, load: Callable[[], Scorer]) -> Scorer:
    """The model of that key, loaded where the worker holds another one: a worker has one at a time and keeps it between jobs."""
    global _held
    if _held is None or _held[0] != key:
        _held = None  # the former one goes before the next one comes
        _held = (key, load())
    return _held[1]


def score_kept(prompts: DataFrame, load: Callable[[], Scorer], model_id: str, batch: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """Prompts with score_a and score_b, by a model that the worker keeps; profile: the resources of the scoring stage.

    A profile is for clusters: where Spark runs in one process there are no others to ask for, and it is left out.
    """
    if profile is not None and prompts.sparkSession.sparkContext.master.startswith("local["):
        profile = None
    key = f"{model_id}:{hashlib.sha256(cloudpickle.dumps(load)).hexdigest()}"  # another loader is another model, whatever its name
    texts = prompts.select("*", F.lit(None).cast("double").alias("score_a"), F.lit(None).cast("double").alias("score_b"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            scorer, prefixes = held(key, load), rows["prefix"].tolist()
            found = [x for i in range(0, len(prefixes), batch) for x in scorer(prefixes[i : i + batch])]
            yield rows.assign(score_a=[float(a) for a, _ in found], score_b=[float(b) for _, b in found])

    return texts.mapInPandas(scored, texts.schema, profile=profile)


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Scores recorded by the hash of the prefix; a prefix without one is an error."""
    met = prompts.withColumn("prefix_sha256", F.sha2("prefix", 256)).join(recorded, "prefix_sha256", "left")
    miss = F.raise_error(F.concat(F.lit("no recorded score for "), F.col("prefix_sha256")))
    return met.withColumn("score_a", F.when(F.col("score_a").isNull(), miss).otherwise(F.col("score_a")))


def mirrored(scored: DataFrame) -> DataFrame:
    """Rows per order back to one row per (family, variant) with the scores of c1 and c2."""
    ab = F.col("order_id") == "AB"
    pick = lambda order, c: F.max(F.when(order, F.col(c)))
    return scored.groupBy("family_id", "variant_id", "gold_winner_cid").agg(
        pick(ab, "score_a").alias("scores_ab_c1"), pick(ab, "score_b").alias("scores_ab_c2"), pick(~ab, "score_b").alias("scores_ba_c1"), pick(~ab, "score_a").alias("scores_ba_c2"))


def score_by_model(prompts: DataFrame, loaders: dict[str, Callable[[], Scorer]], batch: int = 64) -> DataFrame:
    """Prompts with model_id, those of each model scored by its own; a worker holds one model at a time.

    A prompt whose model has no loader is an error.
    """
    known = F.col("model_id").isin(*loaders)
    checked = prompts.withColumn("model_id", F.when(known, F.col("model_id")).otherwise(F.raise_error(F.concat(F.lit("no loader for model "), F.coalesce("model_id", F.lit("null"))))))
    out = None
    for model, load in sorted(loaders.items()):
        part = score(checked.where(F.col("model_id") == model), load, batch)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no model to score with")
    return out


def evaluate(prompts: DataFrame, load: Callable[[], Scorer], batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """Prompts of both orders (family_id, variant_id, gold_winner_cid, order_id, prefix) to variant and family results."""
    variants = variant_results(mirrored(score(prompts, load, batch)))
    return variants, family_results(variants)
