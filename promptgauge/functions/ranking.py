"""Positions and exact quantiles inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from promptgauge.session import written


def cumulative_before(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Add ``before``: the total weight (row count by default) of the rows that come earlier in the group.

    ``order`` must be unique inside the group. Rows are range-partitioned on keys and order, so one
    big group is cut over many slices; a slice only needs the total of the slices before it. The
    ranged rows are written first because the cut points are drawn anew each time they are computed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("slice", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    inside = W.partitionBy("slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    totals = ranged.groupBy("slice", *keys).agg(F.sum(amount).alias("slice_total"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("slice_total").over(earlier), F.lit(0))).drop("slice_total")
    return (
        ranged.withColumn("local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, ["slice", *keys])
        .withColumn("before", F.col("local") + F.col("offset"))
        .drop("slice", "local", "offset")
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``keys, value, out``: 1-based average rank of each distinct value of a group."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    placed = cumulative_before(counted, keys, [value], "ties")
    return placed.select(*keys, value, (F.col("before") + (F.col("ties") + 1) / 2).alias(out))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "quantiles") -> DataFrame:
    """``keys, out``: exact interpolated quantiles of each group, in the order of ``probs``.

    Equal values are counted map-side; the distinct ones are placed by :func:`cumulative_before`, so a group of any
    size is cut over many slices. A quantile then reads the two values that hold its lower and upper place.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("ties"))
    placed = written(cumulative_before(counted, keys, ["v"], "ties"), "placed")
    sizes = placed.groupBy(*keys).agg(F.sum("ties").alias("n"))
    place = F.col("p") * (F.col("n") - 1)
    wanted = sizes.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("at", "p")).select(
        *keys, "at", (place - F.floor(place)).alias("part"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("spot")
    )
    # a few wanted places per group; each distinct value is held against the list of its group
    spots = wanted.groupBy(*keys).agg(F.collect_set("spot").alias("spots"))
    held = placed.join(spots, keys).select(
        *keys, "v", F.explode(F.filter("spots", lambda s: (s >= F.col("before")) & (s < F.col("before") + F.col("ties")))).alias("spot")
    )
    per_prob = wanted.join(held, [*keys, "spot"]).groupBy(*keys, "at").agg(
        F.max("part").alias("part"), F.min("v").alias("lower"), F.max("v").alias("upper")
    )
    found = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    return per_prob.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", found.alias("q")))), lambda x: x["q"]).alias(out)
    )
