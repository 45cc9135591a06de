import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptgauge.functions.ranking import average_ranks, cumulative_before, group_quantiles
from promptgauge.operators import audit, evaluate, retrieval, sensitivity
from promptgauge.plans.jobs import audit_runs, sensitivity_report
from promptgauge.sources.prompts import generator_file, read_all_prompts, read_prompts, write_dedup
from promptgauge.sources.result_cache import read_runs, run_facts


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else rng.choice("xy"), round(rng.gauss(0, 5), 1)) for _ in range(6000)] + [("one", 4.0)]
    return spark.createDataFrame(data, "g string, v double").repartition(5), pd.DataFrame(data, columns=["g", "v"])


def test_quantiles_are_exact(values):
    df, pdf = values
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in group_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["v"].quantile(probs), atol=1e-9)


def test_average_ranks(values):
    df, pdf = values
    got = {(r.g, r.v): r.r for r in average_ranks(df, ["g"], "v", "r").collect()}
    pdf = pdf.assign(r=pdf.groupby("g")["v"].rank())
    assert got == {(g, v): r for g, v, r in pdf.drop_duplicates().itertuples(index=False)}


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id")).repartition(6)
    assert all(r.before == r.id for r in cumulative_before(df, [], ["id"]).collect())


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 11)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 6))
    vectors[10:20] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    hits = evaluate.nearest(df.select(F.col("id").alias("query_id"), "vector"), df.select(F.col("id").alias("doc_id"), "vector"), 4, exclude_self=True, sent_bytes=0)
    got = {(r.query_id, r["rank"]): r.doc_id for r in hits.collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, evaluate.DIGITS)
    np.fill_diagonal(sims, -9)
    for q in range(60):
        assert [got[q, k] for k in range(1, 5)] == np.argsort(-sims[q], kind="stable")[:4].tolist()


def test_retrieval_measures(spark):
    hits = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)], "query_id long, rank int, relevant int")
    relevant = spark.createDataFrame([(1, 2), (2, 5), (3, 0)], "query_id long, n_relevant int")
    got = {r.query_id: r for r in evaluate.retrieval_scores(hits, relevant, 3).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert abs(got[1].ndcg - (1 / np.log2(3) + 0.5) / ideal) < 1e-12 and got[1].recall == 1.0 and got[1].mrr == 0.5
    assert (got[2].ndcg, got[2].recall, got[2].mrr) == (0, 0, 0) and got[3].ndcg == 0


def test_clustering_extremes(spark):
    perfect = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "cluster int, label string")
    r = evaluate.clustering_scores(perfect).first()
    assert abs(r.v_measure - 1) < 1e-12
    lumped = spark.createDataFrame([(1, "a"), (1, "b")], "cluster int, label string")
    r = evaluate.clustering_scores(lumped).first()
    assert abs(r.homogeneity) < 1e-12 and r.completeness == 1.0


def scores(spark):
    rows = [("a", "t", 0, 5.0, True), ("a", "t", 1, 3.0, False), ("a", "t", 2, 9.0, False), ("b", "t", 3, 6.0, True), ("b", "t", 4, 6.0, False)]
    return spark.createDataFrame(rows, "model string, task string, experiment_id long, score double, is_baseline boolean")


def test_sensitivity(spark):
    found = {k: {r.model: r for r in v.collect()} for k, v in sensitivity_report(scores(spark), 20).items()}
    assert found["reported"]["b"]["rank"] == 1 and found["reported"]["a"]["rank"] == 2
    assert found["favourable"]["a"].favourable_rank == 1 and found["favourable"]["a"].can_be_first
    assert found["favourable"]["b"].favourable_rank == 1
    assert found["inflation"]["a"].gap == -1.0 and found["inflation"]["a"].label == "deflated" and found["inflation"]["a"].share_below == 0.5
    assert found["inflation"]["b"].label == "equal" and found["inflation"]["b"].z is None
    assert found["distribution"]["a"].median == 6.0 and found["distribution"]["a"].n == 2
    p = found["simulated"]["a"].p_first
    assert 0 < p < 1 and abs(p + found["simulated"]["b"].p_first - 1) < 1e-9
    again = {r.model: r.p_first for r in sensitivity.simulated_leaderboards(scores(spark).repartition(3), 20).collect()}
    assert again["a"] == p
    assert found["robust"]["a"].rank_worst == 2


def test_favourable_ties_share_a_rank(spark):
    tied = scores(spark).withColumn("score", F.lit(1.0))
    assert {r.favourable_rank for r in sensitivity.favourable_leaderboard(tied).collect()} == {1}


RECORD = (
    '{"task": "%s", "split": "test", "subset": "default", "version": {"mteb": "2", "torch": "2", '
    '"sentence-transformers": "5", "flash-attn": null, "transformers": "4"}, "encode_kwargs": {"batch_size": %d}}\n'
)


def test_run_tree(spark, tmp_path):
    for model, exp, task, batch in [("o__m1", "exp_1", "STS", 32), ("o__m1", "exp_2", "STS", 256), ("o__m2", "exp_1", "STS", 32)]:
        at = tmp_path / model / "rev" / "experiments" / exp
        at.mkdir(parents=True)
        (at / "run_settings.jsonl").write_text(RECORD % (task, batch))
        (at / "other.json").write_text("{}")
    stored = run_facts(read_runs(spark, str(tmp_path)))
    assert {(r.model, r.revision, r.experiment_id) for r in stored.collect()} == {("o/m1", "rev", "exp_1"), ("o/m1", "rev", "exp_2"), ("o/m2", "rev", "exp_1")}
    plan = spark.createDataFrame([("o/m2", "STS", "exp_2"), ("o/m1", "STS", "exp_1")], "model string, task string, experiment_id string")
    found = audit_runs(stored, plan)
    assert [(r.model, r.experiment_id) for r in found["gaps"].collect()] == [("o/m2", "exp_2")]
    assert {r.model: r.drifts for r in found["drift_by_model"].collect()} == {"o/m1": True, "o/m2": False}
    assert {r.experiment_id for r in found["common"].collect()} == {"exp_1"}
    assert audit.common_experiments(stored, ["o/m1"]).count() == 2
    assert {r.model: r.STS for r in audit.coverage(stored).collect()} == {"o/m1": 2, "o/m2": 1}


def test_prompt_files(spark, tmp_path):
    assert generator_file("org/name") == "org-name-gen-prompts.json"
    row = '{"n": 5, "task": "t", "task_description": "d", "dataset_description": "", "language": "", "generated_prompt": "p", "generation_meta": {"prompt": "x"}}'
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(f"[{row},\n {row}]")
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    got = read_prompts(spark, paths[0]).collect()
    assert len(got) == 2 and got[0].generation_meta.prompt == "x"
    both = read_all_prompts(spark, paths)
    assert both.count() == 4 and {r.source.rsplit("/", 1)[1] for r in both.collect()} == {"a.json", "b.json"}
    kept, removed = write_dedup(both.select("task"), both.select("task", "n"), str(tmp_path / "out"), ["task"])
    assert spark.read.parquet(kept).count() == 4 and spark.read.parquet(removed).filter("task = 't'").count() == 4


def test_nearest_with_overlapping_ids_and_keys(spark):
    """A query and a document with one id are different rows, and keys do not meet each other."""
    queries = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "e string, query_id long, vector array<double>")
    corpus = spark.createDataFrame(
        [("a", 1, [2.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [1.0, 0.0]), ("b", 4, [0.0, 3.0])], "e string, doc_id long, vector array<double>"
    )
    got = {(r.e, r["rank"]): r.doc_id for r in evaluate.nearest(queries, corpus, 2, ["e"]).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 1): 4, ("b", 2): 3}
    alone = evaluate.nearest(queries, corpus, 1, ["e"], exclude_self=True).collect()
    assert {(r.e, r.doc_id) for r in alone} == {("a", 2), ("b", 4)}


def test_keyed_scores_equal_scores_one_by_one(spark):
    rng = random.Random(8)
    rows = [(e, i, rng.randrange(3), rng.randrange(3), [rng.gauss(0, 1) for _ in range(4)]) for e in "xyz" for i in range(40)]
    df = spark.createDataFrame(rows, "e string, vec_id long, label long, cluster long, vector array<double>")
    guessed = df.withColumn("predicted", F.col("cluster"))
    both = {r.e: r for r in evaluate.classification_scores(guessed, ["e"]).collect()}
    clusters = {r.e: r for r in evaluate.clustering_scores(df, ["e"]).collect()}
    near = {(r.e, r.vec_id): r.predicted for r in evaluate.centroid_predictions(df.filter("vec_id < 20"), df.filter("vec_id >= 20"), ["e"]).collect()}
    for e in "xyz":
        own = df.filter(F.col("e") == e)
        assert abs(evaluate.classification_scores(own.withColumn("predicted", F.col("cluster"))).first().macro_f1 - both[e].macro_f1) < 1e-12
        assert abs(evaluate.clustering_scores(own).first().v_measure - clusters[e].v_measure) < 1e-12
        single = evaluate.centroid_predictions(own.filter("vec_id < 20"), own.filter("vec_id >= 20")).collect()
        assert {r.vec_id: r.predicted for r in single} == {i: p for (k, i), p in near.items() if k == e}


def test_kmeans_and_logistic_on_separable_vectors(spark):
    rows = [(i, i % 3, [10.0 * (i % 3 == j) + (i % 7) / 100 for j in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    assert evaluate.clustering_scores(evaluate.kmeans_clusters(df, 3)).first().v_measure == pytest.approx(1.0)
    predicted = evaluate.logistic_predictions(df.filter("vec_id < 60"), df.filter("vec_id >= 60"))
    assert evaluate.classification_scores(predicted).first().accuracy == 1.0
