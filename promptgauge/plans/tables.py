"""Operator inputs derived from the given tables, always over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptgauge.operators import runs as run_plans, score_fact
from promptgauge.operators.runs import INSTRUCT, RAW_PREFIX, RETRIEVAL, prompt_map


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt rows: one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").alias("n"),
        F.col("p_type").alias("task"),
        F.col("p_brand").alias("task_description"),
        F.lit("").alias("dataset_description"),
        F.lit("").alias("language"),
        F.col("p_name").alias("generated_prompt"),
    )


TASK_NAMES = {
    "ECONOMY": "retrieval",
    "MEDIUM": "classification",
    "STANDARD": "semantic-similarity",
    "SMALL": "clustering",
    "PROMO": " Retrieval ",
    "LARGE": "Clustering",
}


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task_type, task, description``: tasks are the brands sold under a part type."""
    kinds = F.create_map(*[F.lit(x) for pair in TASK_NAMES.items() for x in pair])
    task = F.concat_ws(" ", "p_type", "p_brand")
    return (
        table(spark, sf_dir, "part")
        .select(kinds[F.col("p_type")].alias("task_type"), task.alias("task"), F.concat(F.lit("Texts about "), "p_brand").alias("description"))
        .distinct()
    )


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, n, raw``: one answer per part, in eight shapes from well formed to not JSON."""
    name, kind = F.col("p_name"), F.col("p_type")
    shape = F.col("p_partkey") % 8
    both = F.concat(F.lit('{"prompts":["'), name, F.lit('","'), kind, F.lit('"]}'))
    raw = (
        F.when(shape <= 2, both)
        .when(shape == 3, F.lit('{"prompts":[]}'))
        .when(shape == 4, F.concat(F.lit('{"prompts":["'), name, F.lit('",'), F.col("p_size"), F.lit("]}")))
        .when(shape == 5, F.concat(F.lit('{"items":["'), name, F.lit('"]}')))
        .when(shape == 6, name)
        .otherwise(F.concat(F.lit('analysis assistantfinal {"prompts":["'), name, F.lit('"]}')))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"), F.lit(2).alias("n"), kind.alias("task"), raw.alias("raw")
    )


def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per part with one or two tasks, to be joined with their answers."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.col("p_size").alias("n"),
        F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).otherwise(F.array("p_type")).alias("task_mteb_names"),
        F.concat(F.lit("Write prompts for "), "p_name").alias("input_prompt"),
    )


def nested_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.array("p_type", "p_brand").alias("task_mteb_names"),
        F.struct(F.array("p_name", "p_type").alias("prompts")).alias("generated_prompts"),
    )


def assigned_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, task, task_class, generated_prompt, finished``: which model runs which prompt, from the order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        lines.join(parts, "l_partkey")
        .join(suppliers, "l_suppkey")
        .groupBy(
            F.concat(F.lit("org/m"), "s_nationkey").alias("model"),
            F.col("p_type").alias("task"),
            F.when(F.col("p_type").isin("SMALL", "LARGE"), RETRIEVAL).otherwise(F.col("p_type")).alias("task_class"),
            F.col("p_name").alias("generated_prompt"),
        )
        .agg(F.bool_and(F.col("l_linestatus") == "F").alias("finished"))
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, wrapper, builtin, template`` from the supplier nations."""
    instruct = F.col("s_nationkey") % 2 == 0
    builtin = F.create_map(F.lit("query"), F.lit("search: "), F.lit("document"), F.lit("passage: "))
    return (
        table(spark, sf_dir, "supplier")
        .select("s_nationkey")
        .distinct()
        .select(
            F.concat(F.lit("org/m"), "s_nationkey").alias("model"),
            F.when(instruct, INSTRUCT).otherwise(RAW_PREFIX).alias("wrapper"),
            builtin.alias("builtin"),
            F.when(instruct, F.lit("Instruct: {instruction}\nQuery: ")).alias("template"),
        )
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_id, role, task, task_class, text``: benchmark items as queries, documents as documents."""
    task = (
        F.when(F.col("lang") == "en", "SMALL").when(F.col("lang") == "fr", "ECONOMY").when(F.col("lang") == "de", "LARGE").otherwise("MEDIUM")
    )
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lit("document").alias("role"), task.alias("task"), "text")
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("text_id"), F.lit("query").alias("role"), F.lit("SMALL").alias("task"), "text"
    )
    both = documents.unionByName(queries)
    return both.withColumn("task_class", F.when(F.col("task").isin("SMALL", "LARGE"), RETRIEVAL).otherwise(F.col("task"))).withColumn(
        "prompt_type", F.when(F.col("task_class") == RETRIEVAL, F.col("role"))
    )


def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, prompt, prompts``: every prompt of a task with its map; prompts are the brands sold under a part type."""
    every = table(spark, sf_dir, "part").select(F.col("p_type").alias("task"), F.concat_ws(" ", F.lit("Find"), "p_brand").alias("prompt")).distinct()
    kind = F.when(F.col("task").isin("SMALL", "LARGE"), RETRIEVAL).otherwise(F.col("task"))
    return every.select("task", "prompt", prompt_map(F.col("task"), kind, F.col("prompt")).alias("prompts"))


def experiment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, prompt, wrapper, template, prompts``: the prompt of every custom experiment, once per wrapper that runs it."""
    every = (
        assigned_prompts(spark, sf_dir)
        .join(models(spark, sf_dir), "model")
        .select("task", "task_class", F.col("generated_prompt").alias("prompt"), "wrapper", "template")
        .distinct()
    )
    return every.select("task", "prompt", "wrapper", "template", prompt_map(F.col("task"), F.col("task_class"), F.col("prompt")).alias("prompts"))


#: language of a document -> its task and what kind of task that is
SCORED_TASKS = {
    "en": ("Search", score_fact.RETRIEVAL),
    "fr": ("Source", score_fact.CLASSIFICATION),
    "de": ("Group", score_fact.CLUSTERING),
    "es": ("Alike", score_fact.SIMILARITY),
}
LABELS = 5


def scored_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCORED_TASKS.values()), "task string, kind string")


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, task, role, prompt_type, label, gold, is_test, text``: what the tasks of :data:`SCORED_TASKS` encode.

    Benchmark items search English documents. The halves of a Spanish document are a pair whose gold is its length.
    """
    names = F.create_map(*[F.lit(x) for lang, (task, _) in SCORED_TASKS.items() for x in (lang, task)])
    digest = F.substring(F.md5(F.col("item_id").cast("string")), 1, 1)
    body = F.coalesce(F.col("text"), F.lit(""))
    half = F.call_function("div", F.length(body), F.lit(2)).cast("int")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), names[F.col("lang")].alias("task"), body.alias("text"), half.alias("half"))
    parts = (
        F.when(F.col("task") == "Search", F.array(F.struct(F.lit("document").alias("role"), F.col("text").alias("text"))))
        .when(
            F.col("task") == "Alike",
            F.array(
                F.struct(F.lit("left").alias("role"), F.substr("text", F.lit(1), F.col("half")).alias("text")),
                F.struct(F.lit("right").alias("role"), F.substr("text", F.col("half") + 1).alias("text")),
            ),
        )
        .otherwise(F.array(F.struct(F.lit("item").alias("role"), F.col("text").alias("text"))))
    )
    gold = F.when(F.col("task") == "Alike", F.length("text")).cast("double")
    shown = documents.filter("task IS NOT NULL").select("item_id", "task", gold.alias("gold"), F.explode(parts).alias("p")).select("item_id", "task", "p.role", "gold", "p.text")
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id"), F.lit("Search").alias("task"), F.lit("query").alias("role"), F.lit(None).cast("double").alias("gold"), body.alias("text")
    )
    return shown.unionByName(queries).select(
        "item_id", "task", "role", F.when(F.col("task") == "Search", F.col("role")).alias("prompt_type"), F.pmod("item_id", F.lit(LABELS)).alias("label"), "gold",
        digest.isin("0", "1", "2").alias("is_test"), "text",
    )


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, wrapper, builtin, template``: a model per region."""
    instruct = F.col("r_regionkey") % 2 == 0
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("org/m"), "r_regionkey").alias("model"),
        F.when(instruct, INSTRUCT).otherwise(RAW_PREFIX).alias("wrapper"),
        F.create_map(F.lit("query"), F.lit("search: "), F.lit("document"), F.lit("passage: ")).alias("builtin"),
        F.when(instruct, F.lit("Instruct: {instruction}\nQuery: ")).alias("template"),
    )


def scored_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of every scored task, and the baseline, ready to be encoded: a region's model runs the brands its suppliers ship."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", F.lit("Find"), "p_brand").alias("generated_prompt"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    regions = suppliers.join(table(spark, sf_dir, "nation"), "n_nationkey").select("l_suppkey", F.concat(F.lit("org/m"), "n_regionkey").alias("model"))
    shipped = lines.join(brands, "l_partkey").join(regions, "l_suppkey").select("model", "generated_prompt").distinct()
    tasks = F.array(*[F.struct(F.lit(task).alias("task"), F.lit(RETRIEVAL if kind == score_fact.RETRIEVAL else kind).alias("task_class")) for task, kind in SCORED_TASKS.values()])
    assigned = shipped.select("model", F.lit("r1").alias("revision"), "generated_prompt", F.explode(tasks).alias("t")).select("model", "revision", "generated_prompt", "t.*")
    models_ = scored_models(spark, sf_dir)
    return run_plans.effective_prompts(run_plans.experiments_of(assigned), models_)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score fact from events; the baseline of a model and task is its first event."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 6).alias("model"),
        F.col("event_type").alias("task"),
        F.col("event_id").alias("experiment_id"),
        F.col("value").alias("score"),
        "ts",
    )
    first = events.groupBy("model", "task").agg(F.min_by("experiment_id", F.struct("ts", "experiment_id")).alias("first"))
    return events.join(first, ["model", "task"]).select(
        "model", "task", "experiment_id", "score", (F.col("experiment_id") == F.col("first")).alias("is_baseline")
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger score fact from order lines, with heavily tied scores and no baselines."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey") % 6).alias("model"),
        F.concat("l_returnflag", "l_linestatus").alias("task"),
        F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("score"),
        F.lit(False).alias("is_baseline"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs from events: the same experiment occurs under several models."""
    slot = F.col("user_id") % 6
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("org/m"), slot).alias("model"),
        F.col("event_type").alias("task"),
        F.concat(F.lit("exp_"), F.substring(F.sha2(F.concat_ws("|", "event_type", "props"), 256), 1, 16)).alias("experiment_id"),
        F.when(F.col("event_id") % 3 == 0, 256).otherwise(32).alias("batch_size"),
        F.when(slot % 2 == 0, "2.18.1").otherwise("2.18.0").alias("library"),
    )


def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs: every event's experiment under its own model and the next one."""
    slots = F.array(F.col("user_id") % 6, (F.col("user_id") + 1) % 6)
    return (
        table(spark, sf_dir, "events")
        .select("event_type", "props", F.explode(slots).alias("slot"))
        .select(
            F.concat(F.lit("org/m"), "slot").alias("model"),
            F.col("event_type").alias("task"),
            F.concat(F.lit("exp_"), F.substring(F.sha2(F.concat_ws("|", "event_type", "props"), 256), 1, 16)).alias("experiment_id"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, vector, is_test``; the split is a digest of the id."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("vector"),
        F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1).isin("0", "1", "2").alias("is_test"),
    )
