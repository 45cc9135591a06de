
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from promptgauge.functions.text import edit_distance, threshold_ppm
from promptgauge.operators import answers, audit, evaluate, requests, reshape, runs, sensitivity
from promptgauge.operators.encode import encode_experiments, prompt_prefixes
from promptgauge.operators.keyed_models import kmeans_clusters, logistic_predictions
from promptgauge.operators.retrieval import nearest
from promptgauge.operators.score_fact import score_fact
from promptgauge.operators.candidates import near_pairs
from promptgauge.operators.collapse import collapse_equal_texts
from promptgauge.operators.coverage import Coverage
from promptgauge.plans import jobs, tables as t
from promptgauge.plans.dedup_texts import Dedup, dedup_texts
from promptgauge.session import fresh_path, spread, written
from promptgauge.sources.prompts import read_all_prompts, read_prompts, write_dedup, write_json_arrays, write_prompts
from promptgauge.sources.result_cache import run_path_columns
from promptgauge.sources.run_tree import read_tree, write_tree

TOP = 10
DRAWS = 50
CHUNKS = 7
EXCLUDED = ["PROMO", "LARGE"]
_settled: dict[tuple, Dedup | DataFrame] = {}


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _part_dedup(spark: SparkSession, sf: str, linkage: str = "single", threshold: float = 0.3) -> Dedup:
    """One deduplication per session serves all its views: its decisions are a written table."""
    key = (spark.sparkContext.applicationId, sf, linkage, threshold)
    if key not in _settled:
        _settled[key] = dedup_texts(t.prompts(spark, sf), "id", "generated_prompt", ["task"], threshold, linkage)
    return _settled[key]


def _document_dedup(spark: SparkSession, sf: str) -> Dedup:
    key = (spark.sparkContext.applicationId, sf, "documents")
    if key not in _settled:
        _settled[key] = dedup_texts(t.table(spark, sf, "documents"), "doc_id", "text", ["lang"], 0.1, "average")
    return _settled[key]


# sources and sinks


def prompt_table_roundtrip_o1_o3(spark, sf):
    fields = "id long, n int, task string, generated_prompt string"
    rows = t.prompts(spark, sf).select("id", "n", "task", "generated_prompt")
    path = write_prompts(rows, fresh_path(spark, "prompts"), "org/generator")
    return read_prompts(spark, path, fields, lines=True)


def prompt_array_o1(spark, sf):
    """Prompts written as JSON arrays and read back in ranges."""
    rows = t.prompts(spark, sf).select("id", "n", "task", "generated_prompt")
    path = write_json_arrays(rows, fresh_path(spark, "prompt-arrays"))
    return read_prompts(spark, path, "id long, n int, task string, generated_prompt string")


def prompt_union_o2(spark, sf):
    fields = "id long, generated_prompt string"
    rows = t.prompts(spark, sf).select("id", "generated_prompt")
    folder = fresh_path(spark, "prompts")
    paths = [write_prompts(rows, folder, name) for name in ("org/one", "org/two", "org/three")]
    # a table is many files on a cluster: the generator is the folder above the file
    source = F.element_at(F.split("source", "/"), -2).alias("source")
    return read_all_prompts(spark, paths, fields, lines=True).select("id", "generated_prompt", source)


def dedup_sinks_o4(spark, sf):
    done = _part_dedup(spark, sf)
    kept, removed = write_dedup(done.kept(), done.removed(), fresh_path(spark, "dedup"), ["task"])
    back = spark.read.parquet(kept).select("task", F.lit("kept").alias("part")).unionByName(
        spark.read.parquet(removed).select("task", F.lit("removed").alias("part"))
    )
    return back.groupBy("task", "part").agg(F.count("*").alias("n_rows"))


def run_paths_o5(spark, sf):
    runs_ = t.table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit("/cache/results/org__m"), F.col("user_id") % 6, F.lit("/rev"), F.col("user_id"), F.lit("/experiments/exp_"),
            F.substring(F.md5(F.col("event_id").cast("string")), 1, 16), F.lit("/run_settings.jsonl"),
        ).alias("path"),
    )
    return runs_.select("event_id", *run_path_columns(F.col("path")))


def _tree_results(spark, sf):
    """Mean values of the events as results: a custom prompt per user, a baseline per task; two revisions of six models."""
    of = [F.concat(F.lit("org/m"), F.col("user_id") % 6).alias("model"), F.concat(F.lit("rev"), F.col("event_id") % 2).alias("revision"), F.col("event_type").alias("task")]
    events = t.table(spark, sf, "events").select(*of, "user_id", "value")
    measured = [F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("n_items")]
    named = F.concat(F.lit("exp_"), F.substring(F.sha2(F.concat_ws("|", "task", "user_id"), 256), 1, 16))
    custom = events.groupBy("model", "revision", "task", "user_id").agg(*measured).withColumn("experiment_id", named).drop("user_id")
    base = events.groupBy("model", "revision", "task").agg(*measured).withColumn("experiment_id", F.lit(None).cast("string"))
    return custom.unionByName(base).withColumn("is_baseline", F.col("experiment_id").isNull())


def run_tree_o5(spark, sf):
    """A result tree is written and read back, one revision of it, baselines beside experiments."""
    rows = _tree_results(spark, sf).withColumns({"name": F.concat("task", F.lit(".json")), "body": F.to_json(F.struct("task", "score", "n_items"))})
    root = fresh_path(spark, "results")
    write_tree(rows, root)
    record = F.from_json("body", "task string, score double, n_items long")
    kept = read_tree(spark, root).filter("revision = 'rev1'")
    return kept.select("model", "revision", "experiment_id", "is_baseline", record.alias("r")).select("model", "revision", "experiment_id", "is_baseline", "r.*")


def nested_prompts_o6(spark, sf):
    return reshape.nested_prompts(t.nested_prompts(spark, sf), "row_id")


# filters and reshaping


def one_task_type_o7(spark, sf):
    return runs.of_task_type(t.prompts(spark, sf), "Brand#7").select("id", "task", "generated_prompt")


def task_types_o8(spark, sf):
    return runs.of_task_types(t.prompts(spark, sf), ["SMALL", "PROMO"], "task").groupBy("task").agg(F.count("*").alias("n_prompts"))


def exclusion_status_o9(spark, sf):
    return runs.with_status(t.prompts(spark, sf), EXCLUDED).select("id", "status")


def explode_prompts_o10_o11_o13(spark, sf):
    checked = answers.validated(t.raw_answers(spark, sf).select("request_id", "raw"))
    joined = reshape.attach_answers(t.answered_requests(spark, sf), checked)
    return reshape.prompt_rows(joined).select(
        "request_id", "n", "task", "generated_prompt", F.col("generation_meta.prompt").alias("sent")
    )


def tasks_o12(spark, sf):
    return reshape.tasks_of(t.prompts(spark, sf))


# requests


def requests_o14(spark, sf):
    planned = requests.expand_context_levels(t.catalogue(spark, sf), 5, "eng")
    return planned.withColumn("task_mteb_names", F.array_join("task_mteb_names", ","))


def task_rules_o15(spark, sf):
    text = requests.task_rules(F.col("task_type"), F.lit("eng"), F.col("description"))
    return t.catalogue(spark, sf).select("task_type", "task", text.alias("rules"))


def request_texts_o16(spark, sf):
    return jobs.plan_requests(t.catalogue(spark, sf)).select("request_id", F.md5("input_prompt").alias("text_digest"), F.length("input_prompt").alias("text_length"))


# answers


def _toy_answers(texts: list[str], attempt: int) -> list[str]:
    """Stands for a generator: a text is answered well from attempt 0..3 on, by its digest."""

    def one(text: str) -> str:
        first = int(hashlib.md5(text.encode()).hexdigest()[0], 16) % 4
        return '{"prompts":["%s"]}' % text if first <= attempt else "no answer"

    return [one(text) for text in texts]


def generated_o17(spark, sf):
    asked = t.prompts(spark, sf).select("id", F.col("generated_prompt").alias("input_prompt"))
    return answers.generate(asked, _toy_answers, 1).select("id", "attempt", "raw")


def marker_cut_o18(spark, sf):
    return t.raw_answers(spark, sf).select("request_id", answers.after_marker(F.col("raw")).alias("content"))


def json_kind_o19(spark, sf):
    parsed = answers.tolerant_json(answers.after_marker(F.col("raw")))
    found = F.try_variant_get(parsed, "$.prompts[0]", "string")
    return t.raw_answers(spark, sf).select("request_id", parsed.isNotNull().alias("is_json"), found.alias("first_prompt"))


def validated_o20(spark, sf):
    checked = answers.validated(t.raw_answers(spark, sf))
    return checked.select("request_id", "reason", "is_valid", F.array_join("prompts", "|").alias("prompts"), "n_returned")


def validity_counts_o21(spark, sf):
    checked = answers.validated(t.raw_answers(spark, sf))
    valid, invalid = answers.split_valid(checked)
    return valid.unionByName(invalid).groupBy("task", "reason").agg(F.count("*").alias("n_answers"))


def retried_o22_o23(spark, sf):
    asked = t.prompts(spark, sf).select(F.col("id").alias("request_id"), F.col("generated_prompt").alias("input_prompt"))
    accepted = answers.retried(asked, _toy_answers, attempts=2)
    return answers.restored(asked, accepted).select("request_id", "attempt", "is_valid", F.array_join("prompts", "|").alias("prompts"))


# near duplicates


def name_distance_o24(spark, sf):
    return _rounded(
        t.prompts(spark, sf).select("id", edit_distance(F.lower("task"), F.col("generated_prompt")).alias("distance")), "distance"
    )


def _part_texts(spark, sf):
    return written(spread(collapse_equal_texts(t.prompts(spark, sf), "id", "generated_prompt", ["task"]).texts, "text_id"), "texts")


def near_pairs_o25(spark, sf):
    pairs = near_pairs(_part_texts(spark, sf), threshold_ppm(0.4))
    return _rounded(pairs.select(F.get_json_object("grp", "$.task").alias("task"), "a", "b", "distance"), "distance")


def near_pair_counts_o26(spark, sf):
    pairs = near_pairs(_part_texts(spark, sf), threshold_ppm(0.2))
    return pairs.groupBy(F.get_json_object("grp", "$.task").alias("task")).agg(F.count("*").alias("n_pairs"))


def single_clusters_o27(spark, sf):
    return _part_dedup(spark, sf).decisions.select("id", "cluster")


def average_clusters_o27(spark, sf):
    return _part_dedup(spark, sf, "average").decisions.select("id", "cluster")


def complete_clusters_o27(spark, sf):
    return _part_dedup(spark, sf, "complete").decisions.select("id", "cluster")


def medoids_o28(spark, sf):
    return _part_dedup(spark, sf).decisions.select("cluster", "kept_id").distinct()


def kept_rows_o29(spark, sf):
    return _part_dedup(spark, sf).kept()


def removed_rows_o30(spark, sf):
    return _rounded(_part_dedup(spark, sf).removed(), "distance", "similarity")


def dedup_summary_o31(spark, sf):
    return _part_dedup(spark, sf).summary()


def dedup_documents_o27_o31(spark, sf):
    return _rounded(_document_dedup(spark, sf).removed(), "distance", "similarity")


def dedup_documents_summary_o31(spark, sf):
    return _document_dedup(spark, sf).summary()


# runs


def prompt_maps_o32(spark, sf):
    kind = F.when(F.col("task").isin("SMALL", "LARGE"), runs.RETRIEVAL).otherwise(F.col("task"))
    made = runs.prompt_map(F.col("task"), kind, F.col("generated_prompt"))
    return t.prompts(spark, sf).select("id", F.explode(made).alias("key", "prompt"))


def resolved_prompts_o33(spark, sf):
    texts = t.texts(spark, sf).groupBy("role", "task", "task_class", "prompt_type").agg(F.count("*").alias("n_texts"))
    found = runs.resolved_prompt(F.col("prompts"), F.col("task"), F.col("task_class"), F.col("prompt_type"))
    return texts.join(t.task_prompts(spark, sf), "task").select("role", "task", "prompt", found.alias("resolved"), "n_texts")


def prompted_texts_o34(spark, sf):
    # the texts of a task are dealt out, each meets every prompt of its task
    joined = spread(t.texts(spark, sf), "text_id").join(t.task_prompts(spark, sf), "task")
    prompt = runs.resolved_prompt(F.col("prompts"), F.col("task"), F.col("task_class"), F.col("prompt_type"))
    wrapper = F.when(F.col("task").isin("SMALL", "MEDIUM"), runs.INSTRUCT).otherwise(runs.RAW_PREFIX)
    shown = runs.prompted_text(F.col("text"), prompt, wrapper, F.lit("Instruct: {instruction}\nQuery: "))
    digest = F.conv(F.substring(F.md5(shown), 1, 8), 16, 10).cast("long")
    return joined.groupBy("role", "task", "prompt").agg(
        F.count("*").alias("n_texts"), F.sum(F.length(shown)).alias("characters"), F.sum(digest).alias("digest_sum")
    )


def experiment_prompts_o33(spark, sf):
    """Each text looks up its prompt in the map of every experiment of its task."""
    prompts = written(t.experiment_prompts(spark, sf), "prompts").dropDuplicates(["task", "prompt"]).select("task", "prompt", "prompts")
    joined = spread(t.texts(spark, sf).drop("text"), "text_id").join(prompts, "task")
    found = runs.resolved_prompt(F.col("prompts"), F.col("task"), F.col("task_class"), F.col("prompt_type"))
    return joined.groupBy("role", "task", "prompt", found.alias("resolved")).agg(F.count("*").alias("n_texts"))


def experiment_texts_o34(spark, sf):
    """Each text meets the prompt of every experiment of its task, as the model's wrapper shows it."""
    joined = spread(t.texts(spark, sf), "text_id").join(written(t.experiment_prompts(spark, sf), "prompts"), "task")
    prompt = runs.resolved_prompt(F.col("prompts"), F.col("task"), F.col("task_class"), F.col("prompt_type"))
    shown = runs.prompted_text(F.col("text"), prompt, F.col("wrapper"), F.col("template"))
    digest = F.conv(F.substring(F.md5(shown), 1, 8), 16, 10).cast("long")
    return joined.groupBy("role", "task", "prompt", "wrapper").agg(
        F.count("*").alias("n_texts"), F.sum(F.length(shown)).alias("characters"), F.sum(digest).alias("digest_sum")
    )


def _experiments(spark, sf):
    return runs.experiments_of(t.assigned_prompts(spark, sf))


def effective_prompts_o35(spark, sf):
    effective = runs.effective_prompts(_experiments(spark, sf), t.models(spark, sf))
    return effective.select("model", "task", "experiment_id", "wrapper", F.explode_outer("effective").alias("key", "prompt"))


def experiments_o36(spark, sf):
    return _experiments(spark, sf).groupBy("model", "task", "task_class", "is_baseline").agg(F.count("*").alias("n_experiments"))


def experiment_keys_o37(spark, sf):
    return _experiments(spark, sf).select("model", "task", "is_baseline", "experiment_id")


def remaining_runs_o38(spark, sf):
    """Runs of two revisions of every model; stored results are of the first only."""
    done = runs.experiments_of(t.assigned_prompts(spark, sf).filter("finished").withColumn("revision", F.lit("r1")))
    assigned = t.assigned_prompts(spark, sf).withColumn("revision", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    left = runs.not_done(runs.experiments_of(assigned), done, runs.RUN_KEY)
    return left.select(*runs.RUN_KEY, "is_baseline")


def chunks_o39(spark, sf):
    return runs.in_chunks(t.prompts(spark, sf).select("id", "task"), CHUNKS, ["id"])


def _length_encoder():
    def encode(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([[float(len(x)), float(x.count("e"))] for x in batch["generated_prompt"]], index=batch.index)

    return encode


def chunk_run_o40(spark, sf):
    work = runs.in_chunks(t.prompts(spark, sf).select("id", "generated_prompt"), CHUNKS, ["id"])
    done = runs.run_chunks(work, _length_encoder, CHUNKS, ["id"])
    return done.select("id", "chunk", F.col("output")[0].alias("characters"), F.col("output")[1].alias("es"))


def chunk_summary_o41(spark, sf):
    rows = runs.with_status(t.prompts(spark, sf), EXCLUDED).select("id", "status", "generated_prompt")
    return runs.completed(runs.run_chunks(runs.in_chunks(rows, CHUNKS, ["id"]), _length_encoder, CHUNKS, ["id"]))


# scores


def similarity_o42(spark, sf):
    v = t.vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("next_label"), F.col("vector").alias("right"))
    pairs = v.join(nxt, "vec_id").select(
        F.concat(F.lit("label_"), "label").alias("experiment"), F.col("vector").alias("left"), "right",
        (-F.abs(F.col("label") - F.col("next_label"))).alias("gold"),
    )
    return _rounded(evaluate.similarity_scores(pairs, ["experiment"]), "spearman")


def _hits(spark, sf):
    v = t.vectors(spark, sf)
    found = nearest(v.select(F.col("vec_id").alias("query_id"), "vector"), v.select(F.col("vec_id").alias("doc_id"), "vector"), TOP, exclude_self=True)
    labels = v.select("vec_id", "label")
    return (
        found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
        .join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("given")), "doc_id")
        .select("query_id", "doc_id", "rank", "similarity", (F.col("wanted") == F.col("given")).cast("int").alias("relevant"))
    )


def nearest_o43(spark, sf):
    return _rounded(_hits(spark, sf), "similarity")


def retrieval_o43(spark, sf):
    v = t.vectors(spark, sf)
    per_label = v.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = v.join(per_label, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return _rounded(evaluate.retrieval_scores(_hits(spark, sf), relevant, TOP), "ndcg", "recall", "mrr")


def _predictions(spark, sf):
    v = t.vectors(spark, sf).withColumn("label", F.col("label").cast("long"))
    return evaluate.centroid_predictions(v.filter(~F.col("is_test")), v.filter("is_test"))


def centroid_predictions_o44(spark, sf):
    return _predictions(spark, sf)


def centroid_classification_o44(spark, sf):
    return _rounded(evaluate.classification_scores(_predictions(spark, sf)), "accuracy", "macro_f1")


def logistic_classification_o44(spark, sf):
    v = t.vectors(spark, sf)
    predicted = evaluate.logistic_predictions(v.filter(~F.col("is_test")), v.filter("is_test"))
    return _rounded(evaluate.classification_scores(predicted), "accuracy", "macro_f1")


def clustering_o45(spark, sf):
    lead = F.slice("vector", 1, 10)
    assigned = t.vectors(spark, sf).select("label", F.array_position(lead, F.array_max(lead)).alias("cluster"))
    return _rounded(evaluate.clustering_scores(assigned), "homogeneity", "completeness", "v_measure")


def kmeans_clustering_o45(spark, sf):
    return _rounded(
        evaluate.clustering_scores(evaluate.kmeans_clusters(t.vectors(spark, sf), 10)), "homogeneity", "completeness", "v_measure"
    )


LETTERS = "eantis "


def _letter_encoder(model: str):
    """Stands for an embedding model: a text becomes its length and its counts of a few letters."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[len(x), *map(x.count, LETTERS)] for x in texts], dtype=float)

    return encode


def _encoded(spark, sf):
    """Every text of the scored tasks under every experiment of every model."""
    return encode_experiments(t.scored_texts(spark, sf), prompt_prefixes(t.scored_experiments(spark, sf)), _letter_encoder)


def experiment_vectors_o33_o34_o40(spark, sf):
    """Prompts meet the texts inside the encoding tasks; here each experiment's vectors are summed up."""
    sums = [F.sum(F.col("vector")[i]).cast("long").alias(name) for i, name in enumerate(["characters", "letters_e", "letters_a"])]
    return _encoded(spark, sf).groupBy("model", "revision", "task", "experiment_id", "is_baseline", "role").agg(F.count("*").alias("n_vectors"), *sums)


def _lead_cluster(rows: DataFrame) -> DataFrame:
    """The letter that leads a text, relative to how often each letter leads elsewhere, is its cluster."""
    lead = F.slice("vector", 2, 6)
    return rows.withColumn("cluster", F.array_position(lead, F.array_max(lead)))


def _score_fact(spark, sf):
    """The fact of a session is encoded and scored once: it is a written table."""
    key = (spark.sparkContext.applicationId, sf, "scores")
    if key not in _settled:
        _settled[key] = score_fact(_encoded(spark, sf), t.scored_kinds(spark), _lead_cluster, TOP)
    return _settled[key]


def score_fact_o42_o45(spark, sf):
    """From plan to scores: every experiment of four kinds of task, each by its own metric."""
    return _rounded(_score_fact(spark, sf), "score")


def fact_leaderboard_o51_o52(spark, sf):
    """The leaderboard of the encoded models, reported and under each model's best prompts."""
    return _rounded(sensitivity.favourable_leaderboard(_score_fact(spark, sf)), "best_mean")


def logistic_per_split_o44(spark, sf):
    """One logistic regression for each of three thirds of the vectors, all fitted together."""
    v = t.vectors(spark, sf).withColumn("third", F.pmod("vec_id", F.lit(3)))
    predicted = logistic_predictions(v.filter(~F.col("is_test")), v.filter("is_test"), ["third"])
    return _rounded(evaluate.classification_scores(predicted, ["third"]), "accuracy", "macro_f1")


def kmeans_per_split_o45(spark, sf):
    """One k-means for each of three thirds of the vectors, as many clusters as labels."""
    v = t.vectors(spark, sf).withColumn("third", F.pmod("vec_id", F.lit(3)))
    scored = evaluate.clustering_scores(kmeans_clusters(v, keys=["third"]), ["third"])
    return _rounded(scored, "homogeneity", "completeness", "v_measure")


# audit


def coverage_o46(spark, sf):
    return audit.coverage_counts(t.runs(spark, sf))


def coverage_grid_o46(spark, sf):
    return Coverage.of(t.runs(spark, sf)).grid()


def coverage_grown_o46(spark, sf):
    """Runs of the library's older version first; the newer ones are merged into their bitmaps."""
    rows = t.runs(spark, sf)
    return Coverage.of(rows.filter("library = '2.18.0'")).plus(rows.filter("library <> '2.18.0'")).counts()


def coverage_gap_bits_o46(spark, sf):
    return Coverage.of(t.runs(spark, sf)).gaps(t.run_plan(spark, sf))


def coverage_gaps_o46(spark, sf):
    return audit.gaps(t.runs(spark, sf), t.run_plan(spark, sf))


def model_drift_o47(spark, sf):
    return audit.drift(t.runs(spark, sf), ["model"]).withColumn("batch_sizes", F.array_join("batch_sizes", ","))


def experiment_drift_o47(spark, sf):
    return audit.drift(t.runs(spark, sf), ["experiment_id"]).withColumn("batch_sizes", F.array_join("batch_sizes", ","))


def common_experiments_o48(spark, sf):
    return audit.common_experiments(t.runs(spark, sf)).groupBy("task", "experiment_id").agg(F.count("*").alias("n_runs"))


def common_bits_o48(spark, sf):
    return Coverage.of(t.runs(spark, sf)).common()


# sensitivity

SPREAD = ("mean", "sd", "min", "max", "p5", "p25", "median", "p75", "p95", "range")


def score_distribution_o49(spark, sf):
    return _rounded(sensitivity.score_distribution(t.scores(spark, sf)), *SPREAD)


def line_score_distribution_o49(spark, sf):
    return _rounded(sensitivity.score_distribution(t.line_scores(spark, sf)), *SPREAD)


def inflation_o50(spark, sf):
    return _rounded(sensitivity.inflation(t.scores(spark, sf)), "baseline", "mean", "gap", "share_below", "z")


def reported_leaderboard_o51(spark, sf):
    return _rounded(sensitivity.reported_leaderboard(t.scores(spark, sf)), "mean_baseline")


def left_out_tasks_o51(spark, sf):
    """Order lines as scores, shipped ones as baselines: a flag that not every model has is left out of leaderboards."""
    rows = t.line_scores(spark, sf).withColumn("is_baseline", F.col("task").endswith("F"))
    return sensitivity.left_out_tasks(rows).withColumn("lacking", F.array_join("lacking", ","))


def favourable_leaderboard_o52(spark, sf):
    return _rounded(sensitivity.favourable_leaderboard(t.scores(spark, sf)), "best_mean")


def favourable_against_worst_o52(spark, sf):
    return _rounded(sensitivity.favourable_leaderboard(t.scores(spark, sf), "worst"), "best_mean")


def prompt_hacking_o53(spark, sf):
    return _rounded(sensitivity.prompt_hacking(t.scores(spark, sf)), "share_inflated", "mean_gap")


def simulated_leaderboards_o54(spark, sf):
    return _rounded(sensitivity.simulated_leaderboards(t.scores(spark, sf), DRAWS), "p_first", "mean_rank")


def robust_leaderboard_o55(spark, sf):
    return _rounded(sensitivity.robust_leaderboard(t.scores(spark, sf)), "mean", "p5", "worst")


def registered() -> dict:
    """Every query of this module by name."""
    found = {}
    for name, value in list(globals().items()):
        if callable(value) and not name.startswith("_") and getattr(value, "__module__", "") == __name__ and "_o" in name:
            if name.rsplit("_o", 1)[1].isdigit():
                found[name] = value
    return found
