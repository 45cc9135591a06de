"""Plan generation requests and render them to text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.functions.text import strip
from promptgauge.functions.wording import DATASET_SECTION, EXAMPLES, LANGUAGE_SECTION, REQUEST, RULE_SECTION


def expand_context_levels(
    catalogue: DataFrame, n: int, language: str, type_col: str = "task_type", task_col: str = "task", text_col: str = "description"
) -> DataFrame:
    """One request per task type, and two per task: with description, and with description and language.

    The key of a request is a digest of what it asks, so it needs no global numbering and is the same
    in every run.
    """
    kind = F.col(type_col).alias("task_description")
    per_type = catalogue.groupBy(type_col).agg(F.array_sort(F.collect_set(task_col)).alias("tasks"))
    broad = per_type.select(
        kind, F.lit("task").alias("level"), F.col("tasks").alias("task_mteb_names"),
        F.lit("").alias("dataset_description"), F.lit("").alias("language"), F.lit("").alias("about"),
    )
    levels = F.array(
        F.struct(F.lit("dataset").alias("level"), F.lit("").alias("language")),
        F.struct(F.lit("language").alias("level"), F.lit(language).alias("language")),
    )
    narrow = catalogue.select(type_col, task_col, text_col, F.explode(levels).alias("l")).select(
        kind, "l.level", F.array(task_col).alias("task_mteb_names"),
        F.col(text_col).alias("dataset_description"), "l.language", F.col(task_col).alias("about"),
    )
    key = F.md5(F.concat_ws("|", "task_description", "level", "about"))
    return broad.unionByName(narrow).select(
        key.alias("request_id"), F.lit(n).alias("n"), "task_mteb_names", "task_description", "dataset_description", "language"
    )


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill the ``{name}`` marks of a fixed text; values are taken as they are, marks inside them are not filled."""
    pieces = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def listed(examples: list[str]) -> str:
    return "\n".join(f'- "{x}"' for x in examples)


def _by_task(task: Column, kind: str, source: Column) -> Column:
    chosen = F.raise_error(F.concat(F.lit("Unsupported task: "), source)).cast("string")
    for name, examples in EXAMPLES.items():
        chosen = F.when(task == name, F.lit(listed(examples[kind]))).otherwise(chosen)
    return chosen


def task_rules(task_description: Column, language: Column, dataset_description: Column) -> Column:
    """Rule section of a request; the language and dataset blocks only where they are not blank."""
    task = strip(F.lower(task_description))
    section = render(
        RULE_SECTION,
        {"task": task, "valid": _by_task(task, "valid", task_description), "invalid": _by_task(task, "invalid", task_description)},
    )
    spoken = F.when(strip(language) != "", render(LANGUAGE_SECTION, {"language": language})).otherwise("")
    grounded = F.when(
        strip(dataset_description) != "", render(DATASET_SECTION, {"dataset_description": dataset_description})
    ).otherwise("")
    return F.concat(section, spoken, grounded)


def request_text(n: Column, task_description: Column, dataset_description: Column, language: Column) -> Column:
    """The whole text sent to a generator."""
    return render(
        REQUEST,
        {
            "n": n,
            "add_rules": task_rules(task_description, language, dataset_description),
            "task_description": task_description,
            "language": language,
            "dataset_description": dataset_description,
        },
    )


def rendered(requests: DataFrame) -> DataFrame:
    text = request_text(F.col("n"), F.col("task_description"), F.col("dataset_description"), F.col("language"))
    return requests.withColumn("input_prompt", text)
