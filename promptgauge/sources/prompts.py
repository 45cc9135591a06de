"""Prompt tables on disk: JSON arrays, JSON lines and Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from promptgauge.sources.json_ranges import read_json_array

PROMPT_SCHEMA = (
    "n int, task string, task_description string, dataset_description string, language string, "
    "generated_prompt string, generation_meta struct<prompt:string>"
)


def read_prompts(spark: SparkSession, path: str, schema: str = PROMPT_SCHEMA, lines: bool = False) -> DataFrame:
    """A prompt table of JSON lines, or of one JSON array per file, with a declared schema; either way large files are read by many tasks."""
    return spark.read.schema(schema).json(path) if lines else read_json_array(spark, path, schema)


def write_json_arrays(rows: DataFrame, path: str) -> str:
    """Write the rows as JSON arrays, one per partition, and return the path."""

    def enclosed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([mark + text])], names=["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(enclosed, "value string").write.mode("error").text(path)
    return path


def read_all_prompts(spark: SparkSession, paths: list[str], schema: str = PROMPT_SCHEMA, lines: bool = False) -> DataFrame:
    """Rows of several tables, duplicates kept, with the file they came from. A JSON array is read by one task here."""
    reader = spark.read.schema(schema).option("multiLine", not lines)
    return reader.json(paths).withColumn("source", F.col("_metadata.file_path"))


def generator_file(model: str) -> str:
    """File name of a generator's prompts."""
    return model.replace("/", "-") + "-gen-prompts.json"


def write_prompts(prompts: DataFrame, folder: str, model: str) -> str:
    """Write a generator's prompts as JSON lines and return the path."""
    path = f"{folder.rstrip('/')}/{generator_file(model)}"
    prompts.write.mode("error").json(path)
    return path


def write_dedup(kept: DataFrame, report: DataFrame, folder: str, group_cols: list[str]) -> tuple[str, str]:
    """Write kept rows with all their columns, and the removed report by group."""
    kept_path, report_path = f"{folder.rstrip('/')}/kept", f"{folder.rstrip('/')}/removed"
    kept.write.mode("error").parquet(kept_path)
    writer = report.write.mode("error")
    (writer.partitionBy(*group_cols) if group_cols else writer).parquet(report_path)
    return kept_path, report_path
