"""One score per experiment and task, whatever the kind of task: the fact table that every later report reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from promptgauge.operators import evaluate
from promptgauge.operators.retrieval import nearest
from promptgauge.session import written

RUN = ["model", "revision", "task", "experiment_id", "is_baseline"]
RETRIEVAL, CLASSIFICATION, CLUSTERING, SIMILARITY = KINDS = ("retrieval", "classification", "clustering", "similarity")
TOP = 10

#: Gives rows of ``run, vec_id, label, vector`` a ``cluster``.
Clusterer = Callable[[DataFrame], DataFrame]


def score_fact(encoded: DataFrame, kinds: DataFrame, clusterer: Clusterer, top: int = TOP) -> DataFrame:
    """``model, revision, task, experiment_id, is_baseline, metric, n_items, score``, one row per run.

    ``encoded``: the columns of a run, ``item_id, role, label, gold, is_test, vector``. ``kinds``: ``task, kind``. Each
    task goes to the metric of its kind; a task of no known kind is an error.

    * retrieval: mean NDCG of the ``query`` rows over the ``document`` rows, which are relevant if the labels agree
    * classification: accuracy on the ``is_test`` rows, by the nearest centroid of the others
    * clustering: V-measure of ``clusterer`` against the labels
    * similarity: rank correlation with ``gold`` between the rows ``left`` and ``right`` of an item

    Metrics with nothing to measure (no query, no test row, no spread) give a null score, and the run stays.
    """
    unknown = kinds.filter(~F.col("kind").isin(*KINDS)).select("kind").first()
    if unknown is not None:
        raise ValueError(f"no metric for tasks of kind {unknown[0]}")
    # a written table has a known size: Spark sends a small one to the vectors, which then stay where they are
    kinds = written(kinds, "kinds")
    # a baseline has no experiment id: runs are told apart by one name without nulls
    run = F.sha2(F.to_json(F.struct(*RUN)), 256)
    rows = written(encoded.join(kinds, "task").withColumn("run", run), "encoded")
    runs = rows.groupBy("run", *RUN, "kind").agg(F.count("*").alias("n_vectors"))

    def of(kind: str) -> DataFrame:
        return rows.filter(F.col("kind") == kind)

    found = [
        _retrieval(of(RETRIEVAL), top),
        _classification(of(CLASSIFICATION)),
        _clustering(of(CLUSTERING), clusterer),
        _similarity(of(SIMILARITY)),
    ]
    scores = found[0]
    for more in found[1:]:
        scores = scores.unionByName(more)
    metric = F.create_map(*[F.lit(x) for pair in zip(KINDS, (f"ndcg_at_{top}", "accuracy", "v_measure", "spearman"), strict=True) for x in pair])
    score = F.when(~F.isnan("score"), F.col("score"))
    return written(
        runs.join(scores, "run", "left").select(*RUN, metric[F.col("kind")].alias("metric"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), score.alias("score")),
        "score-fact",
    )


def _retrieval(rows: DataFrame, top: int) -> DataFrame:
    queries, documents = (rows.filter(F.col("role") == role).select("run", "item_id", "label", "vector") for role in ("query", "document"))
    # ids carry the label along, so relevance needs no join
    asked = F.struct("item_id", "label")
    hits = nearest(queries.select("run", F.struct("item_id", "label").alias("query_id"), "vector"), documents.select("run", asked.alias("doc_id"), "vector"), top, ["run"])
    hits = hits.select("run", "query_id", "rank", F.coalesce((F.col("query_id.label") == F.col("doc_id.label")).cast("int"), F.lit(0)).alias("relevant"))
    per_label = documents.groupBy("run", "label").agg(F.count("*").alias("n_relevant"))
    relevant = queries.select("run", "label", asked.alias("query_id")).join(per_label, ["run", "label"], "left")
    scored = evaluate.retrieval_scores(hits, relevant.select("run", "query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")), top, ["run"])
    return scored.groupBy("run").agg(F.count("*").alias("n_items"), F.avg("ndcg").alias("score"))


def _classification(rows: DataFrame) -> DataFrame:
    rows = rows.select("run", F.col("item_id").alias("vec_id"), "label", "vector", "is_test")
    predicted = evaluate.centroid_predictions(rows.filter(~F.col("is_test")), rows.filter("is_test"), ["run"])
    return evaluate.classification_scores(predicted, ["run"]).select("run", F.col("n").alias("n_items"), F.col("accuracy").alias("score"))


def _clustering(rows: DataFrame, clusterer: Clusterer) -> DataFrame:
    assigned = clusterer(rows.select("run", F.col("item_id").alias("vec_id"), "label", "vector"))
    return evaluate.clustering_scores(assigned, ["run"]).select("run", F.col("n").alias("n_items"), F.col("v_measure").alias("score"))


def _similarity(rows: DataFrame) -> DataFrame:
    pairs = rows.groupBy("run", "item_id").agg(
        F.max(F.when(F.col("role") == "left", F.col("vector"))).alias("left"), F.max(F.when(F.col("role") == "right", F.col("vector"))).alias("right"), F.max("gold").alias("gold")
    )
    return evaluate.similarity_scores(pairs.drop("item_id"), ["run"]).select("run", F.col("n_pairs").alias("n_items"), F.col("spearman").alias("score"))
