import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptgauge.operators import retrieval
from promptgauge.operators.retrieval import nearest

IN_PLACE, BY_QUERIES, BY_BLOCKS = "corpus sent", "queries sent", "blocks"


def expected(queries, corpus, k, exclude_self):
    """Every pair, sorted."""
    found = []
    for key, q, v in queries:
        scored = []
        for other, d, w in corpus:
            if key == other and key is not None and not (exclude_self and q == d):
                both = np.linalg.norm(v) * np.linalg.norm(w)
                scored.append((-round(float(np.dot(v, w) / both) if both else 0.0, 9) + 0.0, d))
        found += [(key, q, d, -s, rank) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)


def sides(named):
    rng = random.Random(4)
    name = (lambda i: f"d{i:03d}") if named else (lambda i: i)

    def vector():
        return [0.0] * 3 if rng.random() < 0.1 else [float(rng.randint(-2, 2)) for _ in range(3)]  # many ties, some zero

    corpus = [(rng.choice(["x", "y", "z", None]), name(i), vector()) for i in range(300)]
    queries = [(rng.choice(["x", "y", "w"]), name(i), vector()) for i in range(40)]
    return queries, corpus


@pytest.mark.parametrize("named", [False, True])
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("way", [IN_PLACE, BY_QUERIES, BY_BLOCKS])
def test_all_ways_give_the_same_rows(spark, monkeypatch, named, exclude_self, way):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 50)
    queries, corpus = sides(named)
    kind = "string" if named else "long"
    left = spark.createDataFrame(queries, f"e string, query_id {kind}, vector array<double>").repartition(3)
    right = spark.createDataFrame(corpus, f"e string, doc_id {kind}, vector array<float>").repartition(5)
    sent = {IN_PLACE: 1 << 20, BY_QUERIES: 10_000, BY_BLOCKS: 10}[way]
    got = nearest(left, right, 7, ["e"], exclude_self, sent)
    assert sorted(((r.e, r.query_id, r.doc_id, r.similarity + 0.0, r["rank"]) for r in got.collect()), key=repr) == expected(queries, corpus, 7, exclude_self)


def test_structs_as_ids(spark):
    queries, corpus = sides(False)
    left = spark.createDataFrame(queries, "e string, query_id long, vector array<double>")
    right = spark.createDataFrame(corpus, "e string, doc_id long, vector array<double>")
    asked = left.withColumn("query_id", F.struct("query_id", F.lit("q").alias("more")))
    held = right.withColumn("doc_id", F.struct("doc_id", F.lit(None).cast("string").alias("more")))
    for sent in (1 << 20, 10_000, 10):
        got = nearest(asked, held, 3, ["e"], sent_bytes=sent).collect()
        assert sorted(((r.e, r.query_id.query_id, r.doc_id.doc_id, r.similarity + 0.0, r["rank"]) for r in got), key=repr) == expected(queries, corpus, 3, False)


def test_a_large_corpus_is_not_shuffled_for_few_queries(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    plan = nearest(queries, corpus, 3, sent_bytes=20_000)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "Scan parquet" in below


def test_nothing_to_search(spark):
    left = spark.createDataFrame([], "query_id long, vector array<double>")
    right = spark.createDataFrame([(1, [1.0]), (2, None)], "doc_id long, vector array<double>")
    asked = right.withColumnRenamed("doc_id", "query_id")
    assert nearest(left, right, 3).collect() == [] and nearest(asked, right.limit(0), 3).collect() == []
    assert [(r.query_id, r.doc_id, r.similarity, r["rank"]) for r in nearest(asked, right, 3).collect()] == [(1, 1, 1.0, 1)]


def test_best_places_are_those_of_whole_sorting():
    """Many columns, ties once rounded, missing and not finite scores: few are sorted, with the places of sorting all."""
    rng = np.random.default_rng(0)
    scores = rng.normal(0, 0.2, (14, 5003)).clip(-1, 1)
    scores[1], scores[2, ::7], scores[3, 2], scores[4] = 0.5, 1.0, -np.inf, -np.inf
    scores[5], scores[6, 5001], scores[7, 9] = np.round(scores[5], 1), np.nan, np.nan
    scores[8, [4000, 30, 77]] = 0.9, 0.9 + 2e-10, 0.9 - 2e-10  # equal once rounded
    sorted_rows = []
    whole, retrieval._sorted_top = retrieval._sorted_top, lambda x, k: sorted_rows.append(len(x)) or whole(x, k)
    try:
        places, values = retrieval._top(scores, 10)
    finally:
        retrieval._sorted_top = whole
    rounded = np.round(scores, 9)
    assert (places == whole(rounded, 10)).all()
    assert np.array_equal(values, np.take_along_axis(rounded, places, axis=1), equal_nan=True)
    assert places[8, :3].tolist() == [30, 77, 4000] and sum(sorted_rows) < 7


@pytest.mark.parametrize(("waiting", "held"), [(3, 1 << 20), (10**6, 1), (10**6, 1 << 20)])
def test_documents_wait_for_each_other(spark, monkeypatch, waiting, held):
    """Whether few or many documents meet the queries at once, the best are the same, ties by id included."""
    monkeypatch.setattr(retrieval, "WAITING", waiting)
    monkeypatch.setattr(retrieval, "WAITING_BYTES", held)
    rng = random.Random(4)
    rows = [(f"r{i % 3}", i, [float(rng.randint(0, 2)), 1.0]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "run string, n long, vector array<double>").repartition(2)
    queries = corpus.filter("n < 12").select("run", F.struct("n").alias("query_id"), "vector")
    documents = corpus.select("run", F.struct("n").alias("doc_id"), "vector")
    got = nearest(queries, documents, 4, ["run"], sent_bytes=1_500).select("run", "query_id.n", "rank", F.col("doc_id.n").alias("found"))
    want = nearest(queries, documents, 4, ["run"]).select("run", "query_id.n", "rank", F.col("doc_id.n").alias("found"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 48


def test_two_large_sides_shuffle_no_vectors(spark, sf, monkeypatch):
    """Queries are sent part by part; what is shuffled and written is a few best of each query."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 100)
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    searched, sizes, plans = retrieval._searched_in_place, [], []

    def seen(left, right, *more):
        sizes.append(left.count())
        found, sent = searched(left, right, *more)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found, sent

    monkeypatch.setattr(retrieval, "_searched_in_place", seen)
    sent_bytes = 100_000
    got = nearest(queries, corpus, 3, exclude_self=True, sent_bytes=sent_bytes)
    assert len(sizes) > 1 and sum(sizes) == v.count()
    assert all("Exchange" not in p and "Scan parquet" in p for p in plans)
    want = nearest(queries, corpus, 3, exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
