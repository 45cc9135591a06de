"""From requests and answers to one row per task and prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_answers(requests: DataFrame, answers: DataFrame, key: str = "request_id") -> DataFrame:
    """Answers beside the request they belong to, by key and never by row order."""
    return requests.join(answers.select(key, F.struct("prompts").alias("generated_prompts")), key)


def explode_prompts(requests: DataFrame) -> DataFrame:
    """One row per task and prompt; an empty list stays as one row with a null."""
    tasks = requests.select("*", F.explode_outer("task_mteb_names").alias("task")).drop("task_mteb_names")
    return tasks.select("*", F.explode_outer("generated_prompts").alias("generated_prompt")).drop("generated_prompts")


def prompt_rows(requests: DataFrame, drop_unanswered: bool = False) -> DataFrame:
    """The main prompt table: flat columns and ``generation_meta`` with the text that was sent."""
    plain = requests.withColumn("generated_prompts", F.col("generated_prompts.prompts"))
    rows = (
        explode_prompts(plain)
        .withColumn("generation_meta", F.struct(F.col("input_prompt").alias("prompt")))
        .drop("input_prompt")
    )
    return rows.filter(F.col("generated_prompt").isNotNull()) if drop_unanswered else rows


def nested_prompts(nested: DataFrame, order_col: str, task: str | None = None) -> DataFrame:
    """Prompt lists of the old nested shape in row and list order, for one task or all."""
    rows = nested.select(order_col, F.explode("task_mteb_names").alias("task"), "generated_prompts")
    if task is not None:
        rows = rows.filter(F.col("task") == task)
    return rows.select(order_col, "task", F.posexplode("generated_prompts.prompts").alias("pos", "prompt"))


def tasks_of(prompts: DataFrame) -> DataFrame:
    """Distinct tasks with their row counts, sorted for display."""
    return prompts.groupBy("task").agg(F.count("*").alias("n_prompts")).orderBy("task")
