"""How far do scores and ranks depend on the prompt?

Input: a score fact ``model, task, experiment_id, score, is_baseline``. Everything past the first
aggregation has one row per model and task, or per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from promptgauge.functions.ranking import group_quantiles
from promptgauge.session import written

KEYS = ["model", "task"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
SHELF_ROWS = 4_096


def score_distribution(scores: DataFrame) -> DataFrame:
    """Count, mean, spread and exact quantiles of the custom-prompt scores per model and task."""
    custom = scores.filter(~F.col("is_baseline")).select(*KEYS, F.col("score").cast("double").alias("score"))
    moments = custom.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("sd"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    named = [F.col("quantiles")[i].alias(name) for i, name in enumerate(["p5", "p25", "median", "p75", "p95"])]
    quantiles = group_quantiles(custom, KEYS, "score", PROBS).select(*KEYS, *named)
    return moments.join(quantiles, KEYS).withColumn("range", F.col("max") - F.col("min"))


def baselines(scores: DataFrame) -> DataFrame:
    return scores.filter("is_baseline").groupBy(*KEYS).agg(F.avg("score").alias("baseline"))


def inflation(scores: DataFrame) -> DataFrame:
    """Baseline against the custom scores per model and task: gap to the mean, share below it, z and a label.

    A group without a baseline, or without custom scores, stays with that as its label and nulls for what can't be compared.
    """
    base = baselines(scores)
    own = scores.filter(~F.col("is_baseline")).select(*KEYS, "score").join(base, KEYS, "left").groupBy(*KEYS).agg(
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("sd"),
        F.avg(F.when(F.col("score") < F.col("baseline"), 1.0).when(F.col("baseline").isNotNull(), 0.0)).alias("share_below"),
    )
    both = own.join(base, KEYS, "full")
    gap = F.col("baseline") - F.col("mean")
    label = (
        F.when(F.col("baseline").isNull(), "no baseline").when(F.col("mean").isNull(), "no custom scores")
        .when(gap > 0, "inflated").when(gap < 0, "deflated").otherwise("equal")
    )
    return both.select(
        *KEYS, "baseline", "mean", gap.alias("gap"), "share_below",
        F.when(F.col("sd") > 0, gap / F.col("sd")).alias("z"), label.alias("label"),
    )


def shared_tasks(scores: DataFrame, baseline: bool) -> DataFrame:
    """``task``: those in which every model has a baseline, or a custom score. Models without any of that kind don't count."""
    held = scores.filter(F.col("is_baseline") == baseline).groupBy(*KEYS).agg(F.count("*").alias("n"))
    models = held.agg(F.count_distinct("model").alias("n_models"))
    return held.groupBy("task").agg(F.count("*").alias("n_models")).join(models, "n_models", "left_semi").select("task")


def _comparable(scores: DataFrame, baseline: bool, tasks: str) -> DataFrame:
    """The scores that a leaderboard compares."""
    if tasks not in ("shared", "all"):
        raise ValueError(f"tasks must be 'shared' or 'all', got {tasks}")
    return scores if tasks == "all" else scores.join(shared_tasks(scores, baseline), "task", "left_semi").select(*scores.columns)


def left_out_tasks(scores: DataFrame) -> DataFrame:
    """``task, of_baselines, lacking``: tasks that leaderboards over shared tasks leave out, once for baselines and once for custom
    scores, and the models that have none there."""
    held = scores.groupBy(*KEYS, F.col("is_baseline").alias("of_baselines")).agg(F.count("*").alias("n"))
    every = held.groupBy("of_baselines").agg(F.collect_set("model").alias("models"))
    tasks = held.select("task").distinct().withColumn("of_baselines", F.explode(F.array(F.lit(True), F.lit(False))))
    found = held.groupBy("task", "of_baselines").agg(F.collect_set("model").alias("found"))
    lacking = F.array_sort(F.array_except("models", F.coalesce("found", F.array().cast("array<string>"))))
    return tasks.join(every, "of_baselines").join(found, ["task", "of_baselines"], "left").select("task", "of_baselines", lacking.alias("lacking")).filter(F.size("lacking") > 0)


def _ranked(per_model: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    # one row per model (and draw), so the window holds a leaderboard and never the scores
    board = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(value))
    return per_model.withColumn(out, F.rank().over(board))


def reported_leaderboard(scores: DataFrame, tasks: str = "shared") -> DataFrame:
    """Mean baseline over tasks and the rank of each model by it.

    Here and in the other leaderboards models are compared over the tasks they share (:func:`left_out_tasks` names the
    others), unless ``tasks`` is ``"all"``: then each has its own tasks, and one without the hard ones looks better.
    """
    means = baselines(_comparable(scores, True, tasks)).groupBy("model").agg(F.round(F.avg("baseline"), 9).alias("mean_baseline"))
    return _ranked(means, "mean_baseline", "rank")


def favourable_leaderboard(scores: DataFrame, rivals: str = "baseline", tasks: str = "shared") -> DataFrame:
    """Rank of each model when it alone takes its best prompt per task; rivals keep their baseline or their worst score.

    A model's rank is one more than the number of rivals above it, found by a running count over
    targets and rivals sorted together, without pairing models.
    """
    own = _comparable(scores, True, tasks).groupBy(*KEYS).agg(
        F.max("score").alias("best"), F.min("score").alias("worst"), F.avg(F.when(F.col("is_baseline"), F.col("score"))).alias("baseline")
    )
    means = own.groupBy("model").agg(
        F.round(F.avg("best"), 9).alias("best"), F.round(F.avg(rivals), 9).alias("rival")
    )
    entries = means.select("model", F.col("best").alias("value"), F.lit(1).alias("target")).unionByName(
        means.select("model", F.col("rival").alias("value"), F.lit(0).alias("target"))
    )
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("value")).rangeBetween(W.unboundedPreceding, W.currentRow)
    level = W.partitionBy(F.lit(0), "value")
    is_rival = F.when(F.col("target") == 0, 1).otherwise(0)
    counted = entries.withColumn("above", F.sum(is_rival).over(above) - F.sum(is_rival).over(level)).filter("target = 1")
    # a model's own rival entry is never above its best score
    placed = counted.select("model", F.col("value").alias("best_mean"), (F.col("above") + 1).cast("int").alias("favourable_rank"))
    reported = reported_leaderboard(scores, tasks).select("model", F.col("rank").alias("reported_rank"))
    return placed.join(reported, "model").withColumn("can_be_first", F.col("favourable_rank") == 1)


def prompt_hacking(scores: DataFrame) -> DataFrame:
    """Per model: share of tasks whose baseline is above the expected score, and the mean gap, over tasks that have both."""
    return inflation(scores).filter("gap IS NOT NULL").groupBy("model").agg(
        F.avg(F.when(F.col("gap") > 0, 1.0).otherwise(0.0)).alias("share_inflated"), F.avg("gap").alias("mean_gap")
    )


def _draw_number(*parts: Column) -> Column:
    """Repeatable whole number of 60 bits from a digest, more than any group has rows; the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def _shelf(experiment: Column, digits: Column) -> Column:
    return F.substring(F.sha2(experiment.cast("string"), 256), F.lit(1), digits)


def simulated_leaderboards(scores: DataFrame, draws: int, tasks: str = "shared", shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """Probability of rank 1 and mean rank of each model over leaderboards of one drawn prompt per model and task.

    Scores of a group stand on shelves by a digest prefix, two hexadecimal digits long and longer in groups of more than
    256 times ``shelf_rows`` scores, and on a shelf in the order of the experiments. The draws come first: they pick
    places among the counted shelves, and only scores on drawn shelves are read again and numbered.
    """
    custom = _comparable(scores.filter(~F.col("is_baseline")).select(*KEYS, "experiment_id", "score", "is_baseline"), False, tasks).drop("is_baseline")
    totals = custom.groupBy(*KEYS).agg(F.count("*").alias("total"))
    more = F.ceil(F.log(16.0, F.greatest(F.col("total") / (256 * shelf_rows), F.lit(1.0)))).cast("int")
    totals = written(totals.withColumn("digits", F.least(F.lit(2) + more, F.lit(16))), "score-totals")
    shelved = custom.join(totals.select(*KEYS, "digits"), KEYS).withColumn("shelf", _shelf(F.col("experiment_id"), F.col("digits"))).drop("digits")
    sizes = written(shelved.groupBy(*KEYS, "shelf").agg(F.count("*").alias("size")), "shelves")
    running = W.partitionBy(*KEYS).orderBy("shelf")  # one row per shelf
    spans = sizes.withColumn("upto", F.sum("size").over(running)).withColumn("from", F.col("upto") - F.col("size"))
    drawn = totals.select(*KEYS, "total", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn(
        "at", _draw_number(F.col("model"), F.col("task"), F.col("draw").cast("string")) % F.col("total")
    )
    # the draws of a group are held against its shelves as one list, so each shelf is met once
    wanted = drawn.groupBy(*KEYS).agg(F.collect_list(F.struct("draw", "at")).alias("draws"))
    on_shelf = F.filter("draws", lambda d: (d["at"] >= F.col("from")) & (d["at"] < F.col("upto")))
    located = spans.join(wanted, KEYS).select(*KEYS, "shelf", "from", F.explode(on_shelf).alias("d"))
    located = written(located.select(*KEYS, "shelf", "d.draw", (F.col("d.at") - F.col("from")).cast("long").alias("place")), "draws")
    inside = W.partitionBy(*KEYS, "shelf").orderBy("experiment_id")
    read = shelved.join(located.select(*KEYS, "shelf").distinct(), [*KEYS, "shelf"], "left_semi")
    numbered = read.withColumn("place", (F.row_number().over(inside) - 1).cast("long"))
    picked = located.join(numbered, [*KEYS, "shelf", "place"])
    boards = picked.groupBy("draw", "model").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    return _ranked(boards, "mean_score", "rank", ["draw"]).groupBy("model").agg(
        F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("p_first"), F.avg("rank").alias("mean_rank")
    )


def robust_leaderboard(scores: DataFrame, tasks: str = "shared") -> DataFrame:
    """Ranks by mean, by 5th percentile and by worst case, and how far each moves from the reported rank."""
    per_model = score_distribution(_comparable(scores.filter(~F.col("is_baseline")), False, tasks)).groupBy("model").agg(
        F.round(F.avg("mean"), 9).alias("mean"), F.round(F.avg("p5"), 9).alias("p5"), F.round(F.avg("min"), 9).alias("worst")
    )
    ranked = per_model
    for value in ("mean", "p5", "worst"):
        ranked = _ranked(ranked, value, f"rank_{value}")
    reported = reported_leaderboard(scores, tasks).select("model", F.col("rank").alias("reported_rank"))
    joined = ranked.join(reported, "model")
    shifts = [(F.col("reported_rank") - F.col(f"rank_{v}")).alias(f"shift_{v}") for v in ("mean", "p5", "worst")]
    return joined.select("model", "reported_rank", "mean", "p5", "worst", "rank_mean", "rank_p5", "rank_worst", *shifts)
