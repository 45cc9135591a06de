import numpy as np
import pytest
from pyspark.sql import functions as F

from promptgauge.operators import runs
from promptgauge.operators.encode import encode_experiments, prompt_prefixes
from promptgauge.operators.score_fact import score_fact
from promptgauge.plans.jobs import score_experiments

TEXTS = "item_id long, task string, role string, prompt_type string, label long, gold double, is_test boolean, text string"
KINDS = [("S", "retrieval"), ("C", "classification"), ("K", "clustering"), ("P", "similarity")]


@pytest.fixture(scope="module")
def length_encoder():
    def factory(model):
        def encode(texts):
            assert len(texts) <= 4
            return np.array([[len(t), t.count("a"), 1] for t in texts])

        return encode

    return factory


@pytest.fixture(scope="module")
def plan(spark):
    assigned = [("m1", "r", t, "Retrieval" if t == "S" else t, p) for t, _ in KINDS for p in ("find", "look for")] + [("m2", "r", "S", "Retrieval", "find")]
    models = [("m1", "prefix", {"query": "q: "}, None), ("m2", "instruct", {}, "I: {instruction} ")]
    experiments = runs.experiments_of(spark.createDataFrame(assigned, "model string, revision string, task string, task_class string, generated_prompt string"))
    return experiments, spark.createDataFrame(models, "model string, wrapper string, builtin map<string,string>, template string")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, "S", "document", "document", i % 2, None, False, "a" * i) for i in range(6)] + [(i, "S", "query", "query", i % 2, None, False, "b" * i) for i in range(3)]
    rows += [(i, "C", "item", None, i % 2, None, i > 6, ("a" if i % 2 else "b") * 9) for i in range(10)]
    rows += [(i, "K", "item", None, i % 2, None, False, ("a" if i % 2 else "b") * 30 + "c" * i) for i in range(8)]
    rows += [(i, "P", side, None, None, float(i), False, "a" * (i if side == "left" else 3) + "b" * 5) for i in range(6) for side in ("left", "right")]
    return spark.createDataFrame([*rows, (9, "C", "item", None, None, None, False, None)], TEXTS)


@pytest.mark.parametrize("sent", [1 << 20, 300])
def test_every_text_meets_the_prompts_of_its_task_once(texts, plan, length_encoder, sent):
    experiments, models = plan
    prefixes = prompt_prefixes(runs.effective_prompts(experiments, models))
    got = encode_experiments(texts.repartition(3), prefixes, length_encoder, 4, sent)
    shown = {}
    for r in prefixes.collect():
        shown.setdefault((r.task, r.prompt_type), []).append((r.model, r.experiment_id, r.prefix))
    want = sorted(
        (model, str(experiment), t.task, t.role, t.item_id, float(len(prefix + (t.text or ""))))
        for t in texts.collect() for model, experiment, prefix in shown.get((t.task, t.prompt_type), [])
    )
    assert sorted((r.model, str(r.experiment_id), r.task, r.role, r.item_id, r.vector[0]) for r in got.collect()) == want
    assert {p for (task, kind), found in shown.items() if (task, kind) == ("S", "document") for m, e, p in found} == {""}
    assert {p for m, e, p in shown["S", "query"]} == {"q: ", "", "find", "look for", "I: find "}


def test_texts_and_prompts_are_not_shuffled_together(spark, sf, plan, length_encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("C").alias("task"), F.lit(None).cast("string").alias("prompt_type"), "doc_id", "text")
    got = encode_experiments(docs, prompt_prefixes(runs.effective_prompts(*plan)), length_encoder)
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "Join" not in plan_text and "MapInArrow" in plan_text


def test_one_fact_for_all_kinds(spark, texts, plan):
    experiments, models = plan
    kinds = spark.createDataFrame(KINDS, "task string, kind string")
    fact = {(r.model, r.task, r.is_baseline, r.experiment_id): r for r in score_experiments(texts, experiments, models, kinds, lambda m: lambda x: np.array([[len(t), t.count("a"), 1.0] for t in x])).collect()}
    assert len(fact) == 4 * 3 + 2  # m1: two prompts and a baseline for each task; m2: one and a baseline
    assert {(r.metric, r.n_items) for r in fact.values()} == {("ndcg_at_10", 3), ("accuracy", 3), ("v_measure", 8), ("spearman", 6)}
    assert all(r.score == 1.0 for (m, t, b, e), r in fact.items() if t in ("C", "K"))
    assert all(0 <= r.score <= 1 for r in fact.values() if r.task == "S")


def test_runs_without_anything_to_measure_stay(spark):
    rows = [("m", "r", "S", None, True, 1, "document", 0, None, False, [1.0]), ("m", "r", "P", "e", False, 1, "left", None, 1.0, False, [1.0])]
    encoded = spark.createDataFrame(rows, "model string, revision string, task string, experiment_id string, is_baseline boolean, item_id long, role string, label long, gold double, is_test boolean, vector array<double>")
    kinds = spark.createDataFrame(KINDS, "task string, kind string")
    found = {r.task: (r.n_items, r.score) for r in score_fact(encoded, kinds, lambda d: d.withColumn("cluster", F.lit(1))).collect()}
    assert found["S"] == (0, None) and found["P"][1] is None
    with pytest.raises(ValueError, match="no metric"):
        score_fact(encoded, spark.createDataFrame([("S", "summary")], "task string, kind string"), lambda d: d)
