"""User-level jobs: each answers one question and is usable alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from promptgauge.operators import audit, answers, evaluate, requests, reshape, runs, sensitivity
from promptgauge.operators.encode import EncoderFactory, encode_experiments, prompt_prefixes
from promptgauge.operators.keyed_models import kmeans_clusters
from promptgauge.operators.score_fact import Clusterer, score_fact
from promptgauge.plans.dedup_texts import dedup_texts  # noqa: F401  (part of the job list)


def plan_requests(catalogue: DataFrame, n: int = 5, language: str = "eng") -> DataFrame:
    """Which texts must be sent to the generator?"""
    return requests.rendered(requests.expand_context_levels(catalogue, n, language))


def collect_answers(
    planned: DataFrame, fn: Callable[[list[str], int], list[str]], attempts: int = 10, drop_unanswered: bool = True,
    batch_size: int = answers.BATCH, in_flight: int = answers.IN_FLIGHT,
) -> DataFrame:
    """Which answers are usable, and what comes out per task? One row per task and prompt."""
    accepted = answers.retried(planned, fn, attempts, batch_size=batch_size, in_flight=in_flight)
    complete = answers.restored(planned, accepted)
    shaped = complete.withColumn("generated_prompts", F.struct("prompts")).drop("prompts", "attempt", "n_returned", "is_valid")
    return reshape.prompt_rows(shaped, drop_unanswered)


def plan_runs(
    assigned: DataFrame, done: DataFrame, excluded: Iterable[str] = (), n_chunks: int = 1, include_baseline: bool = True
) -> DataFrame:
    """Which experiments remain to be run, in which slices?"""
    excluded = list(excluded)
    wanted = runs.to_run(assigned, excluded) if excluded else assigned
    plan = runs.experiments_of(wanted, include_baseline)
    left = runs.not_done(plan, done, [c for c in runs.RUN_KEY if c in plan.columns])  # a new revision is a new run
    return runs.in_chunks(left.withColumn("order_key", F.coalesce("experiment_id", F.lit(""))), n_chunks, ["task", "model", "order_key"])


def encode_and_score(
    work: DataFrame, factory: Callable, n_chunks: int, key: list[str]
) -> DataFrame:
    """What score has each experiment? Pairs of texts are encoded in slices and compared with gold.

    ``work``: key columns, ``chunk``, ``left_text``, ``right_text``, ``gold``. The encoder takes a batch
    and returns the two vectors of a row joined end to end.
    """
    encoded = runs.run_chunks(work, factory, n_chunks)
    half = F.call_function("div", F.size("output"), F.lit(2)).cast("int")
    pairs = encoded.select(
        *key, "gold", F.slice("output", F.lit(1), half).alias("left"), F.slice("output", half + 1, half).alias("right")
    )
    return evaluate.similarity_scores(pairs, key)


def score_experiments(
    texts: DataFrame, experiments: DataFrame, models: DataFrame, kinds: DataFrame, factory: EncoderFactory, clusterer: Clusterer | None = None
) -> DataFrame:
    """What score has each planned experiment, and each baseline? From the plan to the fact table that the reports read.

    ``experiments`` as from :func:`plan_runs`, ``models``: ``model, wrapper, builtin, template``, ``kinds``: ``task, kind``,
    ``texts``: ``item_id, task, role, prompt_type, label, gold, is_test, text``. Texts stay where they lie; the prompts
    travel. Clusters come from a k-means per run unless another clusterer is given.
    """
    prefixes = prompt_prefixes(runs.effective_prompts(experiments, models))
    encoded = encode_experiments(texts, prefixes, factory)
    return score_fact(encoded, kinds, clusterer or (lambda rows: kmeans_clusters(rows, keys=["run"])))


def audit_runs(stored: DataFrame, plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """Is the score base complete and comparable?"""
    found = {
        "coverage": audit.coverage_counts(stored),
        "drift_by_model": audit.drift(stored, ["model"]),
        "drift_by_experiment": audit.drift(stored, ["experiment_id"]),
        "common": audit.common_experiments(stored),
    }
    if plan is not None:
        found["gaps"] = audit.gaps(stored, plan)
    return found


def sensitivity_report(scores: DataFrame, draws: int = 100) -> dict[str, DataFrame]:
    """How far do scores and ranks depend on the prompt?"""
    return {
        "distribution": sensitivity.score_distribution(scores),
        "inflation": sensitivity.inflation(scores),
        "reported": sensitivity.reported_leaderboard(scores),
        "favourable": sensitivity.favourable_leaderboard(scores),
        "hacking": sensitivity.prompt_hacking(scores),
        "simulated": sensitivity.simulated_leaderboards(scores, draws),
        "robust": sensitivity.robust_leaderboard(scores),
    }
