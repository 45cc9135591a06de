import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from promptgauge.operators import answers, audit, sensitivity
from promptgauge.operators.coverage import Coverage


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(2)
    rows = [(f"m{rng.randrange(4)}", rng.choice(["a", "b", "odd name"]), f"exp_{rng.randrange(40):02d}") for _ in range(300)]
    return spark.createDataFrame([*rows, ("m0", "a", None)], "model string, task string, experiment_id string").repartition(3)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bitmaps_say_what_the_rows_say(spark, runs):
    named = runs.filter("experiment_id IS NOT NULL")
    held = Coverage.of(runs)
    assert rows_of(held.counts(), "model", "task", "n_experiments") == rows_of(audit.coverage_counts(named), "model", "task", "n_experiments")
    grid = held.grid()
    assert grid.columns == ["model", "a", "b", "odd name"] and rows_of(grid, *grid.columns) == rows_of(audit.coverage(named).select(grid.columns), *grid.columns)
    plan = named.select(F.lit("m1").alias("model"), "task", "experiment_id").unionByName(spark.createDataFrame([("m9", "a", "never seen")], named.schema))
    assert rows_of(held.gaps(plan), "model", "task", "experiment_id") == rows_of(audit.gaps(named, plan), "model", "task", "experiment_id")
    for models in (None, ["m0", "m1"]):
        assert {r[0] for r in held.common(models).collect()} == {r.experiment_id for r in audit.common_experiments(named, models).collect()}
    assert held.common(["m0", "not there"]).collect() == []


def test_new_runs_are_merged_without_the_old_ones(spark, runs):
    named = runs.filter("experiment_id IS NOT NULL")
    first = Coverage.of(named.filter("experiment_id < 'exp_20' OR model = 'm0'"))
    both = first.plus(named.filter("experiment_id >= 'exp_10'"))
    assert rows_of(both.counts(), "model", "task", "n_experiments") == rows_of(audit.coverage_counts(named), "model", "task", "n_experiments")
    numbers = {r.experiment_id: r.number for r in both.numbers.collect()}
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1)) and numbers.items() >= {r.experiment_id: r.number for r in first.numbers.collect()}.items()
    files = {f for f in both.bitmaps.inputFiles()}
    assert files and not any("/part" in f and "runs" in f for f in files)


def test_bitmaps_over_several_buckets(spark):
    many = spark.range(70_000).select(F.lit("m").alias("model"), F.lit("t").alias("task"), F.format_string("e%06d", "id").alias("experiment_id"))
    held = Coverage.of(many)
    assert held.counts().first().n_experiments == 70_000 and held.bitmaps.count() == 3
    assert held.gaps(many.filter("experiment_id >= 'e069990'").unionByName(many.limit(0))).count() == 0
    assert Coverage.of(many.limit(0)).counts().collect() == [] and Coverage.of(many.limit(0)).plus(many).counts().first().n_experiments == 70_000


SCORES = "model string, task string, experiment_id long, score double, is_baseline boolean"


@pytest.fixture(scope="module")
def ragged(spark):
    """``easy`` only ran the easy task, on which everyone is better."""
    rows = []
    for model, tasks in (("easy", ["simple"]), ("full", ["simple", "hard"]), ("best", ["simple", "hard"])):
        for task in tasks:
            level = (0.9 if task == "simple" else 0.3) + (0.05 if model == "best" else 0.02 if model == "full" else 0.0)
            rows += [(model, task, 0, level, True)] + [(model, task, i, level + i / 100, False) for i in range(1, 4)]
    rows += [("full", "no baseline", 1, 0.5, False), ("best", "only baseline", 0, 0.5, True)]
    return spark.createDataFrame(rows, SCORES)


def test_models_are_compared_over_shared_tasks(ragged):
    shared = {r.model: r["rank"] for r in sensitivity.reported_leaderboard(ragged).collect()}
    assert shared == {"best": 1, "full": 2, "easy": 3}
    every = {r.model: r["rank"] for r in sensitivity.reported_leaderboard(ragged, "all").collect()}
    assert every["easy"] == 1
    assert {r.model: r.reported_rank for r in sensitivity.favourable_leaderboard(ragged).collect()} == shared
    assert {r.model: r.rank_mean for r in sensitivity.robust_leaderboard(ragged).collect()} == shared
    ranks = {r.model: r.mean_rank for r in sensitivity.simulated_leaderboards(ragged, 40).collect()}
    assert ranks["best"] < ranks["full"] < ranks["easy"]
    with pytest.raises(ValueError, match="shared"):
        sensitivity.reported_leaderboard(ragged, "some")


def test_left_out_tasks_are_named(ragged):
    found = {(r.task, r.of_baselines): r.lacking for r in sensitivity.left_out_tasks(ragged).collect()}
    assert found == {
        ("hard", True): ["easy"], ("hard", False): ["easy"], ("no baseline", True): ["best", "easy", "full"], ("no baseline", False): ["best", "easy"],
        ("only baseline", True): ["easy", "full"], ("only baseline", False): ["best", "easy", "full"],
    }


def test_groups_that_cannot_be_compared_stay(ragged):
    found = {(r.model, r.task): r for r in sensitivity.inflation(ragged).collect()}
    assert len(found) == 7
    lost, alone = found["full", "no baseline"], found["best", "only baseline"]
    assert (lost.label, lost.mean, lost.baseline, lost.gap, lost.share_below) == ("no baseline", 0.5, None, None, None)
    assert (alone.label, alone.mean, alone.baseline, alone.gap) == ("no custom scores", None, 0.5, None)
    assert {r.model: r.share_inflated for r in sensitivity.prompt_hacking(ragged).collect()} == {"easy": 0.0, "full": 0.0, "best": 0.0}


def test_draws_read_only_their_shelves(spark):
    rng = random.Random(4)
    rows = [(m, "t", i, rng.random(), False) for m in ("a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, SCORES)

    def plain(draws, digits):
        """Numbers all scores."""
        import hashlib

        board = []
        for m in ("a", "b"):
            order = sorted((hashlib.sha256(str(i).encode()).hexdigest()[:digits], i, s) for model, _, i, s, _ in rows if model == m)
            board.append([order[int(hashlib.sha256(f"{m}|t|{d}".encode()).hexdigest()[:15], 16) % len(order)][2] for d in range(draws)])
        return sum(a > b for a, b in zip(*board, strict=True)) / draws

    for shelf_rows, digits in ((4096, 2), (5, 3)):  # more than 256 x 5 scores: longer prefixes
        found = {r.model: r.p_first for r in sensitivity.simulated_leaderboards(df, 30, shelf_rows=shelf_rows).collect()}
        assert found["a"] == pytest.approx(plain(30, digits)) and found["a"] + found["b"] == pytest.approx(1)


def ask(spark, tmp_path, n, bad, batch_size, in_flight, partitions=1):
    log = tmp_path / "log"
    log.mkdir()
    open_, lock, most = [0], threading.Lock(), [0]

    class Generator:
        """Counts calls in files, as it runs in another process."""

        def __getstate__(self):
            return {}

        def __call__(self, texts, attempt):
            me = log / f"{texts[0]}-{len(texts)}-{time.monotonic_ns()}"
            me.write_text("open")
            time.sleep(0.02)
            running = sum(f.read_text() == "open" for f in log.iterdir())
            (log.parent / f"running-{running}").write_text("")
            me.write_text("done")
            if any(t in bad for t in texts):
                raise RuntimeError("refused")
            return [f"re {t}" for t in texts]

    call = Generator()
    df = spark.createDataFrame([(i, f"t{i:03d}") for i in range(n)], "id long, input_prompt string").coalesce(partitions)
    got = answers.generate(df, lambda texts, attempt: call(texts, attempt), 0, batch_size=batch_size, in_flight=in_flight).collect()
    calls = [(f.name.split("-")[0], int(f.name.split("-")[1])) for f in log.iterdir()]
    return got, calls, max(int(f.name.split("-")[1]) for f in tmp_path.glob("running-*"))


def test_calls_are_bounded_and_answers_in_order(spark, tmp_path):
    got, calls, running = ask(spark, tmp_path, 100, set(), 8, 3)
    assert [(r.id, r.raw) for r in got] == [(i, f"re t{i:03d}") for i in range(100)]
    assert max(n for _, n in calls) <= 8 and len(calls) == 13 and running <= 3


def test_a_bad_text_costs_few_more_calls(spark, tmp_path):
    got, calls, _ = ask(spark, tmp_path, 64, {"t037"}, 64, 2)
    assert [r.raw for r in got] == ["" if i == 37 else f"re t{i:03d}" for i in range(64)]
    assert len(calls) == 1 + 2 * 6  # both halves of each of six levels


def test_a_wrong_number_of_answers_is_a_failed_call(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, input_prompt string").coalesce(1)
    got = answers.generate(df, lambda texts, attempt: texts[:1], 0, batch_size=4).orderBy("id").collect()
    assert [r.raw for r in got] == [f"t{i}" for i in range(6)]
