"""Which experiments are stored for which model and task, as bitmaps.

Experiments are numbered once. A model and task then holds one bitmap for every 32,768 numbers, and counts, grids, gaps and
experiments in common come from the bitmaps alone. New runs give new numbers and bitmaps that are merged into the old
ones; runs seen before are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.functions.ranking import cumulative_before
from promptgauge.session import written

_KEYS = ["model", "task", "bucket"]


def _numbered(ids: DataFrame, after: int) -> DataFrame:
    """``experiment_id, number, bucket, at`` with numbers from ``after + 1``."""
    placed = cumulative_before(ids, [], ["experiment_id"])
    number = F.col("before") + 1 + after
    return placed.select("experiment_id", number.cast("long").alias("number")).select("experiment_id", "number", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("at"))


def _bitmaps(runs: DataFrame, numbers: DataFrame) -> DataFrame:
    """``model, task, bucket, bits``; a baseline has no number and no bit."""
    held = runs.select("model", "task", "experiment_id").distinct().join(numbers, "experiment_id")
    return held.groupBy(*_KEYS).agg(F.bitmap_construct_agg("at").alias("bits"))


def has_bit(bits: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set; false for no bitmap."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


@dataclass(frozen=True)
class Coverage:
    """``numbers``: ``experiment_id, number, bucket, at``; ``bitmaps``: ``model, task, bucket, bits``. Both are written tables."""

    numbers: DataFrame
    bitmaps: DataFrame

    @classmethod
    def of(cls, runs: DataFrame) -> Coverage:
        """The coverage of ``model, task, experiment_id`` rows."""
        ids = runs.filter("experiment_id IS NOT NULL").select("experiment_id").distinct()
        numbers = written(_numbered(ids, 0), "experiment-numbers")
        return cls(numbers, written(_bitmaps(runs, numbers), "coverage"))

    def _with_ids(self, runs: DataFrame) -> DataFrame:
        """The numbers, also of experiments met for the first time."""
        new = runs.filter("experiment_id IS NOT NULL").select("experiment_id").distinct().join(self.numbers, "experiment_id", "left_anti")
        after = self.numbers.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        return written(self.numbers.unionByName(_numbered(new, after)), "experiment-numbers")

    def plus(self, runs: DataFrame) -> Coverage:
        """The coverage with new runs as well."""
        numbers = self._with_ids(runs)
        both = self.bitmaps.unionByName(_bitmaps(runs, numbers))
        return Coverage(numbers, written(both.groupBy(*_KEYS).agg(F.bitmap_or_agg("bits").alias("bits")), "coverage"))

    def counts(self) -> DataFrame:
        """``model, task, n_experiments``."""
        return self.bitmaps.groupBy("model", "task").agg(F.sum(F.bitmap_count("bits")).alias("n_experiments"))

    def grid(self) -> DataFrame:
        """Experiments per model, one column per task that is stored."""
        counts = self.counts()
        tasks = [r[0] for r in counts.select("task").distinct().orderBy("task").collect()]  # the columns
        return counts.groupBy("model").pivot("task", tasks).agg(F.first("n_experiments")).na.fill(0)

    def _set(self, bits: DataFrame) -> DataFrame:
        """``experiment_id`` of every bit that is set in ``bucket, bits`` and whatever columns stand beside them."""
        joined = bits.join(self.numbers.select("experiment_id", "bucket", "at"), "bucket")
        return joined.filter(has_bit(F.col("bits"), F.col("at"))).drop("bucket", "bits", "at")

    def gaps(self, plan: DataFrame) -> DataFrame:
        """Planned ``model, task, experiment_id`` without a stored run."""
        both = Coverage(self._with_ids(plan), self.bitmaps)
        wanted = _bitmaps(plan, both.numbers)
        beside = wanted.join(self.bitmaps.withColumnRenamed("bits", "held"), _KEYS, "left").join(both.numbers.select("experiment_id", "bucket", "at"), "bucket")
        return beside.filter(has_bit(F.col("bits"), F.col("at")) & ~has_bit(F.col("held"), F.col("at"))).select("model", "task", "experiment_id")

    def common(self, models: list[str] | None = None) -> DataFrame:
        """``experiment_id`` stored for every model, or every one of ``models``."""
        chosen = self.bitmaps if models is None else self.bitmaps.filter(F.col("model").isin(*models))
        n_models = chosen.select("model").distinct().count() if models is None else len(set(models))
        per_model = chosen.groupBy("model", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        in_all = per_model.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(F.col("n") == n_models)
        return self._set(in_all.drop("n"))
