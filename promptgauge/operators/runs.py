"""Plan evaluation runs, and run them in slices."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.functions.ranking import cumulative_before

RETRIEVAL = "Retrieval"
RAW_PREFIX = "prefix"
INSTRUCT = "instruct"
RUN_KEY = ["model", "revision", "task", "experiment_id"]


def of_task_type(prompts: DataFrame, task_type: str | None = None, type_col: str = "task_description") -> DataFrame:
    return prompts if task_type is None else prompts.filter(F.col(type_col) == task_type)


def of_task_types(prompts: DataFrame, task_types: Iterable[str] | None = None, type_col: str = "task_description") -> DataFrame:
    """Rows of any of the given types; an error when none of them has a row."""
    if not task_types:
        return prompts
    chosen = prompts.filter(F.col(type_col).isin(*task_types))
    if chosen.isEmpty():
        raise ValueError(f"no prompts of types {sorted(task_types)}")
    return chosen


def with_status(prompts: DataFrame, excluded: Iterable[str], task_col: str = "task") -> DataFrame:
    """Excluded tasks stay in the table, marked as skipped."""
    word = F.when(F.col(task_col).isin(*excluded), "SKIPPED: ").otherwise("DONE: ")
    return prompts.withColumn("status", F.concat(word, F.col(task_col)))


def to_run(prompts: DataFrame, excluded: Iterable[str], task_col: str = "task") -> DataFrame:
    return prompts.filter(~F.col(task_col).isin(*excluded))


def prompt_map(task: Column, task_class: Column, prompt: Column) -> Column:
    """Retrieval prompts are keyed for queries only, so documents never take them; other tasks by name."""
    return F.when(
        task_class == RETRIEVAL, F.create_map(F.concat(task, F.lit("-query")), prompt, F.lit("query"), prompt)
    ).otherwise(F.create_map(task, prompt))


def resolved_prompt(prompts: Column, task: Column, task_class: Column, prompt_type: Column) -> Column:
    """The prompt a text gets: by task and prompt type, then task, then task class, then prompt type."""
    exact = F.when(prompt_type.isNotNull(), F.try_element_at(prompts, F.concat(task, F.lit("-"), prompt_type)))
    alone = F.when(prompt_type.isNotNull(), F.try_element_at(prompts, prompt_type))
    return F.coalesce(exact, F.try_element_at(prompts, task), F.try_element_at(prompts, task_class), alone)


def prompted_text(text: Column, prompt: Column, wrapper: Column, template: Column) -> Column:
    """Text as it is encoded: a raw prefix before it, or the prompt set into the wrapper's template before it.

    A null template switches the template off and leaves a raw prefix.
    """
    framed = F.when((wrapper == INSTRUCT) & template.isNotNull(), F.replace(template, F.lit("{instruction}"), prompt))
    return F.concat(F.coalesce(framed, prompt, F.lit("")), text)


def effective_prompts(experiments: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``effective``: built-in prompts for baselines (none for instruct wrappers), the experiment's own otherwise."""
    known = F.col("wrapper").isin(RAW_PREFIX, INSTRUCT)
    builtin = F.when(F.col("wrapper") == RAW_PREFIX, F.col("builtin"))
    chosen = F.when(F.col("is_baseline"), builtin).otherwise(F.col("prompts"))
    unknown = F.raise_error(F.concat(F.lit("Unknown wrapper: "), F.col("wrapper")))
    joined = experiments.join(models.select("model", "wrapper", "builtin", *[c for c in ("template",) if c in models.columns]), "model")
    return joined.withColumn("effective", F.when(known, chosen).otherwise(unknown)).drop("builtin")


def experiment_key(prompts: Column) -> Column:
    """Stable short key of a prompt map, independent of entry order; null for a baseline."""
    entries = F.array_sort(F.map_entries(prompts))
    return F.when(prompts.isNotNull(), F.concat(F.lit("exp_"), F.substring(F.sha2(F.to_json(entries), 256), 1, 16)))


def experiments_of(assigned: DataFrame, include_baseline: bool = True) -> DataFrame:
    """Custom experiment of each assigned prompt and one baseline per model and task.

    ``assigned``: ``model, task, task_class, generated_prompt`` and, if the models have any, ``revision``. A
    baseline repeats with every prompt; the repeats are dropped map-side.
    """
    of = [c for c in ("model", "revision", "task", "task_class") if c in assigned.columns]
    own = prompt_map(F.col("task"), F.col("task_class"), F.col("generated_prompt"))
    kinds = [F.lit(False)] + ([F.lit(True)] if include_baseline else [])
    rows = assigned.select(*of, own.alias("own"), F.explode(F.array(*kinds)).alias("is_baseline"))
    prompts = F.when(~F.col("is_baseline"), F.col("own"))
    keyed = rows.select(*of, "is_baseline", prompts.alias("prompts")).withColumn(
        "experiment_id", experiment_key(F.col("prompts"))
    )
    return keyed.dropDuplicates([c for c in of if c != "task_class"] + ["is_baseline", "experiment_id"])


def not_done(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows without a result; null keys (baselines) compare equal."""
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return plan.alias("p").join(done.select(*keys).distinct().alias("d"), condition, "left_anti")


def in_chunks(work: DataFrame, n_chunks: int, order: list[str]) -> DataFrame:
    """Add ``chunk`` (1-based): contiguous slices of even size, the first ones larger by one where they must be."""
    placed = cumulative_before(work, [], order)
    total = placed.agg(F.max("before")).first()[0]
    total = 0 if total is None else total + 1  # from the written slices: the source is evaluated once
    chunks = max(1, min(n_chunks, total))
    base, more = divmod(total, chunks)
    at = F.col("before")
    edge = F.lit(more * (base + 1))
    early = F.call_function("div", at, F.lit(base + 1))
    late = F.lit(more) + F.call_function("div", at - edge, F.lit(max(base, 1)))
    return placed.withColumn("chunk", (F.when(at < edge, early).otherwise(late) + 1).cast("long")).drop("before")


def run_chunks(
    work: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    n_chunks: int,
    order: Iterable[str] = (),
    out_type: str = "array<double>",
) -> DataFrame:
    """Run a caller's encoder over chunked rows: built once per task, then fed batches in order. A failure stops the job."""

    def encode(batches):
        encoder = factory()
        for batch in batches:
            yield batch.assign(output=encoder(batch))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    # chunk i goes to task i - 1: no sampled bounds that could put two chunks into one task
    spread = work.repartitionById(n_chunks, (F.col("chunk") - 1).cast("int")).sortWithinPartitions("chunk", *order)
    return spread.mapInPandas(encode, f"{fields}, output {out_type}")


def completed(results: DataFrame) -> DataFrame:
    """Rows finished per chunk and status."""
    return results.groupBy("chunk", "status").agg(F.count("*").alias("n_rows"))
