"""Scores of the four task kinds over a table of embeddings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.functions.ranking import average_ranks
from promptgauge.operators.retrieval import DIGITS, nearest
from promptgauge.session import written


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_pairs, spearman``: rank correlation of cosine and gold with average ranks for ties.

    ``pairs``: keys, ``left``, ``right`` (vectors), ``gold``.
    """
    measured = F.round(cosine(doubles(F.col("left")), doubles(F.col("right"))), DIGITS)
    scored = written(pairs.select(*keys, "gold", measured.alias("cosine")), "pair-scores")
    ranked = scored.join(average_ranks(scored, keys, "cosine", "r"), [*keys, "cosine"]).join(
        average_ranks(scored, keys, "gold", "g"), [*keys, "gold"]
    )
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.corr("r", "g").alias("spearman"))


def retrieval_scores(hits: DataFrame, relevant: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, query_id, ndcg, recall, mrr`` at k. ``hits``: keys, query_id, rank, relevant (0/1); ``relevant``: keys, query_id, n_relevant."""
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    per_query = hits.groupBy(*keys, "query_id").agg(
        F.sum(gain).alias("dcg"),
        F.sum("relevant").alias("found"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
    )
    ideal = [0.0]
    for i in range(k):
        ideal.append(ideal[-1] + 1 / math.log2(i + 2))
    best = F.element_at(F.array(*[F.lit(x) for x in ideal]), F.least(F.col("n_relevant"), F.lit(k)).cast("int") + 1)
    return relevant.join(per_query, [*keys, "query_id"], "left").select(
        *keys,
        "query_id",
        F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(0.0).alias("ndcg"),
        F.when(F.col("n_relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def centroids(train: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, label, vector``: mean vector per label. Partial sums are made map-side; one row per label and place is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = train.select(*keys, "label", array_to_vector(doubles(F.col("vector"))).alias("features"))
    return rows.groupBy(*keys, "label").agg(Summarizer.mean(F.col("features")).alias("mean")).select(*keys, "label", vector_to_array("mean").alias("vector"))


def centroid_predictions(train: DataFrame, test: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, vec_id, label, predicted``: label of the nearest centroid by cosine, lower label on ties."""
    # the id of a query carries its label along, so the test vectors are answered where they lie
    asked = F.struct(F.col("vec_id"), F.col("label"))
    hits = nearest(
        test.select(*keys, asked.alias("query_id"), "vector"),
        centroids(train, keys).select(*keys, F.col("label").alias("doc_id"), "vector"),
        1,
        keys,
    )
    return hits.select(*keys, "query_id.vec_id", "query_id.label", F.col("doc_id").alias("predicted"))


def classification_scores(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, accuracy, macro_f1`` from label and predicted; F1 is 0 for a label never hit."""
    cells = predictions.groupBy(*keys, "label", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("guessed"), hit.alias("hit")).unionByName(
        cells.select(*keys, F.col("predicted").alias("c"), F.lit(0).alias("actual"), F.col("n").alias("guessed"), F.lit(0).alias("hit"))
    )
    per_label = sides.groupBy(*keys, "c").agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    return per_label.groupBy(*keys).agg(
        F.sum("actual").alias("n"),
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg(2 * F.col("hit") / (F.col("actual") + F.col("guessed"))).alias("macro_f1"),
    )


def clustering_scores(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, homogeneity, completeness, v_measure`` of cluster against label, from their counts alone."""
    by = [*keys, "__all"]
    cells = assigned.withColumn("__all", F.lit(1)).groupBy(*by, "cluster", "label").agg(F.count("*").alias("n"))

    def spread(df: DataFrame, name: str) -> DataFrame:
        """n log n summed, the only thing entropies need."""
        return df.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias(name))

    joint = spread(cells, "joint")
    by_cluster = spread(cells.groupBy(*by, "cluster").agg(F.sum("n").alias("n")), "clusters").drop("total")
    by_label = spread(cells.groupBy(*by, "label").agg(F.sum("n").alias("n")), "labels").drop("total")
    one = joint.join(by_cluster, by).join(by_label, by)
    n = F.col("total")
    h_label = F.log(n) - F.col("labels") / n
    h_cluster = F.log(n) - F.col("clusters") / n
    h_label_given = (F.col("clusters") - F.col("joint")) / n
    h_cluster_given = (F.col("labels") - F.col("joint")) / n
    homogeneity = F.when(h_label > 0, 1 - h_label_given / h_label).otherwise(1.0)
    completeness = F.when(h_cluster > 0, 1 - h_cluster_given / h_cluster).otherwise(1.0)
    scored = one.select(*keys, n.alias("n"), homogeneity.alias("homogeneity"), completeness.alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return scored.withColumn(
        "v_measure", F.when(both > 0, 2 * F.col("homogeneity") * F.col("completeness") / both).otherwise(0.0)
    )


def kmeans_clusters(vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``vec_id, label, cluster`` by the distributed k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select("vec_id", "label", array_to_vector(doubles(F.col("vector"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(features).transform(features).select("vec_id", "label", F.col("prediction").alias("cluster"))


def logistic_predictions(train: DataFrame, test: DataFrame, rounds: int = 30) -> DataFrame:
    """``vec_id, label, predicted`` by the distributed logistic regression of Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def features(df: DataFrame) -> DataFrame:
        return df.select("vec_id", F.col("label").cast("double"), array_to_vector(doubles(F.col("vector"))).alias("features"))

    model = LogisticRegression(maxIter=rounds, regParam=0.01).fit(features(train))
    return model.transform(features(test)).select(
        "vec_id", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted")
    )
