"""Is the base of stored runs complete and comparable?

Input: ``model, task, experiment_id, batch_size, library`` rows, one per stored run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def coverage(runs: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """Stored experiments per model, one column per task."""
    return runs.groupBy("model").pivot("task", tasks).agg(F.count_distinct("experiment_id")).na.fill(0)


def coverage_counts(runs: DataFrame) -> DataFrame:
    """The same grid in rows, for any number of tasks."""
    return runs.groupBy("model", "task").agg(F.count_distinct("experiment_id").alias("n_experiments"))


def gaps(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned ``model, task, experiment_id`` without a stored run."""
    keys = ["model", "task", "experiment_id"]
    return plan.select(*keys).distinct().join(runs.select(*keys).distinct(), keys, "left_anti")


def drift(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct batch sizes and library versions per key; more than one means scores are not comparable as they are."""
    counted = runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.count_distinct("batch_size").alias("n_batch_sizes"),
        F.count_distinct("library").alias("n_libraries"),
        F.array_sort(F.collect_set("batch_size")).alias("batch_sizes"),
    )
    return counted.withColumn("drifts", (F.col("n_batch_sizes") > 1) | (F.col("n_libraries") > 1))


def common_experiments(runs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Runs of the experiments that are stored for all models (or all chosen ones)."""
    chosen = runs if models is None else runs.filter(F.col("model").isin(*models))
    wanted = chosen.agg(F.count_distinct("model").alias("n_models"))
    held = chosen.groupBy("experiment_id").agg(F.count_distinct("model").alias("n_models"))
    everywhere = held.join(wanted, "n_models", "left_semi")
    return chosen.join(everywhere.select("experiment_id"), "experiment_id", "left_semi")
