import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptgauge.operators import runs
from promptgauge.plans.jobs import encode_and_score, plan_runs


def even(n, chunks):
    chunks = max(1, min(chunks, n))
    base, more = divmod(n, chunks)
    return [base + (i < more) for i in range(chunks)]


@pytest.mark.parametrize("n,chunks", [(10, 3), (7, 7), (3, 8), (1, 1), (9, 0)])
def test_chunks(spark, n, chunks):
    work = spark.range(n).withColumn("id", F.col("id") * 7)
    got = runs.in_chunks(work, chunks, ["id"]).orderBy("id").collect()
    sizes = pd.Series([r.chunk for r in got]).value_counts().sort_index().tolist()
    assert sizes == even(n, chunks) and [r.chunk for r in got] == sorted(r.chunk for r in got)


def test_chunks_of_nothing(spark):
    assert runs.in_chunks(spark.range(0), 3, ["id"]).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2")], "task_description string, task string")
    assert runs.of_task_type(df).count() == 2 and runs.of_task_type(df, "a").count() == 1
    assert runs.of_task_types(df, ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        runs.of_task_types(df, ["z"])
    assert [r.status for r in runs.with_status(df, ["t1"]).orderBy("task").collect()] == ["SKIPPED: t1", "DONE: t2"]
    assert runs.to_run(df, ["t1", "t2"]).count() == 0


def test_prompt_resolution(spark):
    df = spark.createDataFrame(
        [("R", "Retrieval", "query"), ("R", "Retrieval", "document"), ("S", "STS", None)], "task string, kind string, side string"
    ).withColumn("prompts", runs.prompt_map(F.col("task"), F.col("kind"), F.lit("p:")))
    found = runs.resolved_prompt(F.col("prompts"), F.col("task"), F.col("kind"), F.col("side"))
    got = {(r.task, r.side): (r.prompts, r.p) for r in df.select("*", found.alias("p")).collect()}
    assert got[("R", "query")] == ({"R-query": "p:", "query": "p:"}, "p:")
    assert got[("R", "document")][1] is None and got[("S", None)] == ({"S": "p:"}, "p:")


def test_prompted_text(spark):
    df = spark.createDataFrame(
        [("t", "p ", "prefix", "I: {instruction}\nQ: "), ("t", "p", "instruct", "I: {instruction}\nQ: "), ("t", "p ", "instruct", None), ("t", None, "instruct", "I: {instruction}")],
        "x string, p string, w string, m string",
    )
    got = [r[0] for r in df.select(runs.prompted_text(F.col("x"), F.col("p"), F.col("w"), F.col("m"))).collect()]
    assert got == ["p t", "I: p\nQ: t", "p t", "t"]


def assigned(spark):
    return spark.createDataFrame(
        [("m", "R", "Retrieval", "p1"), ("m", "R", "Retrieval", "p2"), ("m", "S", "STS", "p1"), ("m", "S", "STS", "p1")],
        "model string, task string, task_class string, generated_prompt string",
    )


def test_experiments(spark):
    got = runs.experiments_of(assigned(spark)).collect()
    assert sorted((r.task, r.is_baseline) for r in got) == [("R", False), ("R", False), ("R", True), ("S", False), ("S", True)]
    assert all((r.experiment_id is None) == r.is_baseline == (r.prompts is None) for r in got)
    assert all(len(r.experiment_id) == 20 for r in got if not r.is_baseline)
    assert runs.experiments_of(assigned(spark), include_baseline=False).count() == 3


def test_key_ignores_entry_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "2", "a": "1"})], "x map<string,string>, y map<string,string>")
    r = df.select(runs.experiment_key(F.col("x")).alias("x"), runs.experiment_key(F.col("y")).alias("y")).first()
    assert r.x == r.y


def test_effective_prompts(spark):
    models = spark.createDataFrame(
        [("m", "prefix", {"query": "q: "}), ("i", "instruct", {"query": "q: "})], "model string, wrapper string, builtin map<string,string>"
    )
    plan = spark.createDataFrame(
        [("m", True, None), ("m", False, {"S": "p"}), ("i", True, None)], "model string, is_baseline boolean, prompts map<string,string>"
    )
    got = {(r.model, r.is_baseline): r.effective for r in runs.effective_prompts(plan, models).collect()}
    assert got == {("m", True): {"query": "q: "}, ("m", False): {"S": "p"}, ("i", True): None}
    with pytest.raises(Exception, match="Unknown wrapper: odd"):
        runs.effective_prompts(plan, models.withColumn("wrapper", F.lit("odd"))).collect()


def test_plan_runs_skips_what_is_done(spark):
    every = runs.experiments_of(assigned(spark))
    done = every.filter((F.col("task") == "S") & F.col("is_baseline"))
    left = plan_runs(assigned(spark), done, n_chunks=2)
    assert sorted((r.task, r.is_baseline) for r in left.collect()) == [("R", False), ("R", False), ("R", True), ("S", False)]
    assert {r.chunk for r in left.collect()} == {1, 2}
    assert plan_runs(assigned(spark), every).count() == 0
    assert plan_runs(assigned(spark), done, excluded=["R", "S"]).count() == 0


def test_run_stops_on_failure(spark):
    def factory():
        def encode(batch):
            raise RuntimeError("encoder failed")

        return encode

    work = runs.in_chunks(spark.range(3), 2, ["id"])
    with pytest.raises(Exception, match="encoder failed"):
        runs.run_chunks(work, factory, 2).collect()


def test_encode_and_score(spark):
    def factory():
        def encode(batch):
            return pd.Series(
                [[1.0, 0.0, float(len(a)), float(len(b))] for a, b in zip(batch["left_text"], batch["right_text"])], index=batch.index
            )

        return encode

    pairs = [("e", "a" * i, "b" * (10 - i), float(i)) for i in range(1, 10)]
    work = runs.in_chunks(spark.createDataFrame(pairs, "experiment string, left_text string, right_text string, gold double"), 3, ["gold"])
    got = encode_and_score(work, factory, 3, ["experiment"]).first()
    assert got.n_pairs == 9 and abs(got.spearman - 1) < 1e-9


def test_every_experiments_prompt_is_applied(spark, sf):
    from promptgauge.plans import queries, tables

    models = tables.models(spark, sf).select("model", "wrapper")
    assigned = tables.assigned_prompts(spark, sf).join(models, "model").select("task", F.col("generated_prompt").alias("prompt"), "wrapper").distinct()
    of_texts = tables.texts(spark, sf).groupBy("role", "task").agg(F.count("*").alias("n_texts"))
    wanted = of_texts.join(assigned, "task")
    got = queries.experiment_texts_o34(spark, sf)
    cols = ["role", "task", "prompt", "wrapper", "n_texts"]
    assert wanted.count() and sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, wanted.select(cols).collect()))
