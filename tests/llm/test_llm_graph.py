import numpy as np
import pytest

from promptgauge.llm import graph_search as op

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, ids int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    known = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        known[i] = min(known.get(i, v), v)
    out = {}
    for i, v in known.items():
        if i % every == 0:
            a = np.float32(v).astype(float)
            scores = [(-(np.float32(w).astype(float) * a).sum(), j) for j, w in known.items() if j != i and len(w) == len(v)]
            out[i] = sorted(scores)[:k]
    return out


def recall(found, expected):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q, best in expected.items():
        rows = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and q not in {r["vec_id"] for r in rows}
        assert len(rows) == len(best)
        order = [(-r["score"], r["vec_id"]) for r in rows]
        assert order == sorted(order)
        hit += len({j for _, j in best} & {r["vec_id"] for r in rows})
        total += len(best)
    assert set(got) <= set(expected)
    return hit / max(1, total)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]),
            (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [3.0, 0.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 2.0, 3.5]), (-20, [-1.0, 0.0]), (2**61 + 1, [0.0, 1.0])]
    found = op.nearest_neighbours(table(spark, rows)).collect()
    expected = brute(rows, 20, 20)
    assert recall(found, expected) == 1.0
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    assert scores[0, 9] == 2.0 and scores[40, 41] == 1 + 4 + 10.5


def test_empty_table(spark):
    assert op.nearest_neighbours(table(spark, [])).collect() == []


@pytest.mark.parametrize("shard_rows", [3000, 700])
def test_recall_with_dense_and_equal_groups(spark, shard_rows):
    rng = np.random.default_rng(5)
    dense = rng.normal(0, 1, 24) + rng.normal(0, 0.02, (700, 24))
    v = np.r_[rng.normal(0, 1, (1200, 24)), dense, np.tile(rng.normal(0, 1, 24), (600, 1))].astype(np.float32)
    order = rng.permutation(len(v))
    rows = [(int(i), v[j].tolist()) for i, j in enumerate(order)]
    found = op.nearest_neighbours(table(spark, rows), shard_rows=shard_rows).collect()
    assert recall(found, brute(rows, 20, 20)) >= 0.95


@pytest.mark.parametrize("size", [3e3, 1e25])
def test_recall_beside_extreme_lengths(spark, size):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (1500, 16))
    v[[3, 700, 1100]] *= size
    rows = [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]
    assert recall(op.nearest_neighbours(table(spark, rows)).collect(), brute(rows, 20, 20)) >= 0.97


def test_recall_among_very_near_copies(spark):
    rng = np.random.default_rng(7)
    v = np.r_[rng.normal(0, 1, (600, 16)), rng.normal(0, 1, 16) + rng.normal(0, 1e-4, (900, 16))].astype(np.float32)
    rows = [(i, x) for i, x in enumerate(v[rng.permutation(len(v))].tolist())]
    assert recall(op.nearest_neighbours(table(spark, rows)).collect(), brute(rows, 20, 20)) >= 0.97


def test_query_blocks_and_registered_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = op.participants(vectors)
    index = op.built_index(rows, 5, shard_rows=100)
    found = op.searched(index, rows.filter("vec_id % 3 = 0"), 5, block_queries=20).collect()
    assert recall(found, brute([(r[0], r[1]) for r in vectors.select("vec_id", "embedding").collect()], 5, 3)) >= 0.95


def test_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [0, 1.1], [-3, 0]], float)
    graph = op.Graph(points)
    kept = graph.pruned(np.array([0]), np.array([[1, 2, 3, 4, 5, 1, -1]]))[0]
    flat = graph.points[:, :2]
    assert {tuple(flat[i]) for i in kept if i >= 0} >= {(1.0, 0.0), (0.0, 1.0)} and 2 not in kept and 4 not in kept


@pytest.mark.parametrize("kind", ["unscaled", "heavy lengths", "unit"])
def test_recall_whatever_the_lengths_are(spark, kind):
    """The measured beam, or the whole shard, keeps recall up where no constant beam does."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((5000, 64))
    if kind == "heavy lengths":
        x *= rng.pareto(2, size=(5000, 1)) + 0.1
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in op.nearest_neighbours(df, shard_rows=2500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 5000, 20)
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-products, axis=1)[:, :20]
    recall = np.mean([len(found[q] & set(t)) / 20 for q, t in zip(asked.tolist(), true.tolist())])
    assert recall >= 0.95


def test_the_index_says_how_it_is_searched(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))], "vec_id long, embedding array<double>")
    index = op.built_index(op.participants(df), 5, 300, 16)
    found = index.select("shard", "beam", "recall").distinct().collect()
    assert len(found) == 3 and all(r.recall >= 0.97 and (r.beam == op.WHOLE or r.beam in (16, 32, 64)) for r in found)
