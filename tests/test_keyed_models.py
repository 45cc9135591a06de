import random

import numpy as np
import pytest

from promptgauge.operators import evaluate, keyed_models
from promptgauge.operators.keyed_models import kmeans_clusters, logistic_models, logistic_predictions


def plain_logistic(x, y, classes, regularisation=0.01):
    """Newton steps with the whole second derivative."""
    rows, width = np.c_[x, np.ones(len(x))], x.shape[1] + 1
    weights, shrink = np.zeros((classes, width)), np.r_[np.full(x.shape[1], regularisation), 1e-12]
    for _ in range(200):
        raised = np.exp(rows @ weights.T - (rows @ weights.T).max(axis=1, keepdims=True))
        p = raised / raised.sum(axis=1, keepdims=True)
        gradient = (p - np.eye(classes)[y]).T @ rows / len(x) + shrink * weights
        if np.abs(gradient).max() < 1e-10:
            break
        second = np.zeros((classes * width, classes * width))
        for a in range(classes):
            for b in range(classes):
                part = (rows * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ rows / len(x)
                second[a * width : (a + 1) * width, b * width : (b + 1) * width] = part
        second += np.diag(np.tile(shrink, classes)) + 1e-10 * np.eye(classes * width)
        weights -= np.linalg.solve(second, gradient.ravel()).reshape(weights.shape)
    return weights


def keyed_rows():
    rng = random.Random(5)
    rows = []
    for key, noise in (("clear", 0.1), ("noisy", 3.0), ("two", 1.0)):
        for i in range(120):
            label = i % (2 if key == "two" else 3)
            rows.append((key, i, label * 10, [rng.gauss(4.0 * (label == j), noise) for j in range(4)]))
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(keyed_rows(), "e string, vec_id long, label long, vector array<double>")


@pytest.mark.parametrize("block", [2048, 16])
def test_logistic_equals_separate_fits(vectors, monkeypatch, block):
    monkeypatch.setattr(keyed_models.packed, "__defaults__", (block,))
    monkeypatch.setattr(keyed_models, "FAN_IN", 3)  # sums of sums
    found = {r.e: r for r in logistic_models(vectors.repartition(5), ["e"]).collect()}
    for key in ("clear", "noisy", "two"):
        rows = [r for r in keyed_rows() if r[0] == key]
        labels = sorted({r[2] for r in rows})
        expected = plain_logistic(np.array([r[3] for r in rows]), np.array([labels.index(r[2]) for r in rows]), len(labels))
        got = np.array(found[key].weights).reshape(len(labels), -1)
        assert found[key].class_labels == labels and found[key].converged
        # intercepts are fixed up to a common shift
        assert np.allclose(got[:, :-1], expected[:, :-1], atol=2e-3)
        assert np.allclose(got[:, -1] - got[:, -1].mean(), expected[:, -1] - expected[:, -1].mean(), atol=2e-3)


def test_logistic_predictions(spark, vectors):
    train, test = vectors.filter("vec_id < 90"), vectors.filter("vec_id >= 90")
    more = test.unionByName(spark.createDataFrame([("no model", 1, 0, [0.0] * 4)], vectors.schema))
    found = logistic_predictions(train, more, ["e"]).collect()
    assert len(found) == 91 and [r.predicted for r in found if r.e == "no model"] == [None]
    assert all(r.predicted == r.label for r in found if r.e == "clear")
    alone = logistic_predictions(train.filter("e = 'noisy'").drop("e"), test.filter("e = 'noisy'").drop("e")).collect()
    assert {r.vec_id: r.predicted for r in alone} == {r.vec_id: r.predicted for r in found if r.e == "noisy"}


def test_one_class_and_string_labels(spark):
    rows = [("one", str(i), "only", [float(i)]) for i in range(5)] + [("two", str(i), "ab"[i % 2], [float(i % 2)]) for i in range(6)]
    df = spark.createDataFrame(rows, "e string, vec_id string, label string, vector array<float>")
    assert all(r.label == r.predicted for r in logistic_predictions(df, df, ["e"]).collect())


def test_kmeans_finds_separated_groups_for_any_partitioning(spark):
    rng = random.Random(6)
    rows = [(e, i, i % 4, [rng.gauss(20.0 * (i % 4 == j), 1 if e == "x" else 0.2) for j in range(4)]) for e in "xyz" for i in range(200)]
    df = spark.createDataFrame(rows, "e string, vec_id long, label long, vector array<double>")
    one, many = (sorted(map(tuple, kmeans_clusters(d, None, ["e"]).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many and len(one) == len(rows)
    assert [round(r.v_measure, 9) for r in evaluate.clustering_scores(kmeans_clusters(df, 4, ["e"]), ["e"]).collect()] == [1.0] * 3


def test_kmeans_is_a_fixed_point(spark):
    """Every row is nearest to the mean of its own cluster."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 3))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, vector array<double>")
    own = {r.vec_id: r.cluster for r in kmeans_clusters(df, 5).collect()}
    label = np.array([own[i] for i in range(150)])
    means = np.array([x[label == c].mean(axis=0) for c in range(5)])
    assert (((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all()


def test_kmeans_with_fewer_vectors_than_clusters(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (3, 1, [5.0, 5.0]), (4, 1, None)], "vec_id long, label long, vector array<double>")
    found = {r.vec_id: r.cluster for r in kmeans_clusters(df, 10).collect()}
    assert found[1] == found[2] != found[3] and 4 not in found
    assert kmeans_clusters(df.limit(0), 3).collect() == []
