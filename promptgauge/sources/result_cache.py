"""Stored runs: a tree of small JSON records whose path names the model, revision and experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RUN_SCHEMA = (
    "task string, split string, subset string, "
    "version struct<mteb:string, torch:string, `sentence-transformers`:string, `flash-attn`:string, transformers:string>, "
    "encode_kwargs struct<batch_size:int>"
)


def run_path_columns(path: Column) -> list[Column]:
    """``model, revision, experiment_id`` from ``.../<org>__<name>/<revision>/experiments/<id>/<file>``."""
    parts = F.split(path, "/")
    return [
        F.replace(F.element_at(parts, -5), F.lit("__"), F.lit("/")).alias("model"),
        F.element_at(parts, -4).alias("revision"),
        F.element_at(parts, -2).alias("experiment_id"),
    ]


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored run under ``root``, with the columns its path holds."""
    records = (
        spark.read.schema(RUN_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "run_settings.jsonl")
        .json(root)
    )
    return records.select(*run_path_columns(F.col("_metadata.file_path")), "*")


def run_facts(runs: DataFrame) -> DataFrame:
    """Flat columns for the audit."""
    library = F.concat_ws("|", "version.mteb", "version.torch", "version.`sentence-transformers`", "version.transformers")
    return runs.select(
        "model", "revision", "task", "experiment_id", F.col("encode_kwargs.batch_size").alias("batch_size"), library.alias("library")
    )
