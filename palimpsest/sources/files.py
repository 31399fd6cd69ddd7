"""Readers of JSON lines, CSV, run artifacts and configurations."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import validate


class SourceError(ValueError):
    """A source that breaks its contract."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, skip_bad: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped, lines that are no object of the schema
    are an error that names file and text (or dropped with skip_bad)."""
    bad = "_corrupt_record"
    if not skip_bad:
        held = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
        df = spark.read.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
        # Spark does not answer questions about the bad column alone, so the columns come along.
        first = df.withColumn("_file", F.col("_metadata.file_name")).where(F.col(bad).isNotNull()).limit(3).collect()
        if first:
            raise SourceError("; ".join(f"{r['_file']}: {r[bad][:120]}" for r in first))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """The place of each row in its input: file, then position. For keep-first and keep-last rules."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def validated(df: DataFrame, violations: Column) -> DataFrame:
    """Df if every row keeps its contract."""
    validate.abort_on(df.withColumn("violations", violations))
    return df


def read_families(spark: SparkSession, path: str, schema: T.StructType, split: str | None = None, task: str = "qa_key") -> DataFrame:
    """All families are validated before the split is picked; none left is an error."""
    df = validated(read_jsonl(spark, path, schema), validate.family(task))
    df = df if split is None else df.where(F.col("split") == split)
    if df.isEmpty():
        raise SourceError(f"no family in {path}" + (f" for split {split}" if split else ""))
    return df


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings; fields may hold newlines and doubled quotes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_summaries(spark: SparkSession, root: str, summary: T.StructType, bootstrap: T.StructType) -> DataFrame:
    """`<run>/summary_metrics.json` met with `<run>/bootstrap_ci.json` by directory."""
    def one(name: str, schema: T.StructType) -> DataFrame:
        df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
        return df.withColumn("run_dir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))

    out = one("summary_metrics.json", summary).join(one("bootstrap_ci.json", bootstrap), "run_dir", "left")
    if out.isEmpty():
        raise SourceError(f"no summary_metrics.json below {root}")
    return out


def read_groups(spark: SparkSession, roots: dict[str, str], name: str, columns: list[str]) -> DataFrame | None:
    """One CSV of every run of several groups, with run_group; a group whose folder is absent is skipped."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    out = None
    for group, root in sorted(roots.items()):
        p = fs(root)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        df = read_csv(spark, f"{root}/*/{name}", columns).withColumn("run_group", F.lit(group)).withColumn("run_dir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
        out = df if out is None else out.unionByName(df)
    return out


def read_family_files(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*families*.jsonl", task: str | None = None) -> DataFrame:
    """Families of all files below root whose name fits, with file_name; with a task, a family that breaks its contract is an error."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    if task is not None:
        validated(df, validate.family(task))
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def load_config(path: str | Path) -> dict:
    """JSON, else YAML where it is installed; must be a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        held = json.loads(text)
    except json.JSONDecodeError as error:
        try:
            import yaml
        except ImportError:
            raise SourceError(f"{path} is not JSON, and there is no YAML reader") from error
        held = yaml.safe_load(text)
    if not isinstance(held, dict):
        raise SourceError(f"{path} does not hold a mapping")
    return held


def fingerprint(config: dict) -> str:
    """SHA-256 of the sorted, indented JSON."""
    return hashlib.sha256(json.dumps(config, indent=2, sort_keys=True).encode()).hexdigest()


def reusable(saved: dict | None, wanted: dict, keys: tuple[str, ...] = ("stage", "page_size", "max_pages", "entity_class")) -> bool:
    """Whether rows fetched earlier serve: their saved summary agrees in what was asked for."""
    return saved is not None and all(saved.get(k) == wanted.get(k) for k in keys)
