import random
import zlib

import numpy as np
import pytest
from fixtures import ODD, documents

from promptgauge.llm import toxicity as op

LABELS = "doc_id long, quality int, toxic int, text string"
WORDS = {"en": "the and of house river cloud walking slowly".split(), "de": "der und nicht haus fluss wolke langsam auf".split()}
BAD = {"en": "idiot scum moron".split(), "de": ["trottel" + s for s in ("ei", "haft", "en", "isch", "chen")]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, toxic = rng.choice(["en", "de"]), rng.random() < 0.3
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def auc(scores, y):
    pos, neg = scores[y == 1], scores[y == 0]
    return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()


def test_gradients_are_those_of_the_loss():
    model, t = op.Model(3), op.Texts(["a b c d", "", "b", "c c a e f g"])
    rng = np.random.default_rng(0)
    for k, w in model.weights.items():
        model.weights[k] = w.astype(np.float64) + (0 if k == "embedding" else rng.normal(0, 0.2, w.shape))
    toxic = np.array([1.0, 0, 1, 0])

    def loss():
        p = model.raw(t)
        return float(-(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).mean())

    found, buckets = model.gradients(t, toxic, np.ones(4))
    for name in ("out", "prior", "filter1", "filter3", "bias2"):
        w = model.weights[name]
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            step, old = 1e-5, w[at]
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert found[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_best_response_against_plain_convolution():
    model, texts = op.Model(4), ["a b c", "", "d", "e f a b c d e f"]
    t = op.Texts(texts)
    pooled = model.pooled(t)
    for i, text in enumerate(texts):
        vectors = [model.weights["embedding"][op._buckets(w)].sum(axis=0) for w in text.split()]
        for j, width in enumerate(op.WIDTHS):
            kernel, bias = model.weights[f"filter{width}"], model.weights[f"bias{width}"]
            got = [sum(vectors[p + o] @ kernel[o] for o in range(width) if p + o < len(vectors)) + bias for p in range(len(vectors))]
            best = np.maximum(np.max(got, axis=0), 0) if got else np.zeros(op.FILTERS)
            assert np.allclose(pooled[i, j * op.FILTERS : (j + 1) * op.FILTERS], best, atol=1e-5)


def test_held_out_accuracy_and_thresholds(spark):
    rows = corpus(1500)
    docs, labels = documents(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows], LABELS)
    found = {r["doc_id"]: r for r in op.toxicity(docs, labels).collect()}
    assert len(found) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(found[i]["score"], y) for i, _, y in rows if found[i]["held_out"]]
    assert auc(*map(np.array, zip(*held))) > 0.95
    assert np.mean([(s >= op.CUT) == y for s, y in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= op.CUT) for r in found.values())


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(400, 2)
    docs = documents(spark, [r[:2] for r in rows])
    kept = [(i, 1, y, "x") for i, _, y in rows]
    changed = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, q, y, t in kept]
    first, second = (sorted(map(tuple, op.toxicity(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (kept, changed))
    assert first == second


def test_odd_rows_and_labels(spark):
    rows = corpus(200, 3)
    labels = [(i, 1, y, None) for i, _, y in rows] + [(None, 1, 1, "x"), (5, 1, None, "x"), (3, 1, 1, "x"), (3, 1, 0, "x"), (7, None, 9, "x")]
    table = documents(spark, [r[:2] for r in rows] + [(i and i + 1000, t) for i, t in ODD])
    found = op.toxicity(table, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(ODD)
    assert len({r["score"] for r in found if r["doc_id"] in (1003, 1004)}) == 1
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    left = op.without_toxic(table, spark.createDataFrame(labels, LABELS))
    assert left.columns == table.columns
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(repr(r["doc_id"]) for r in found if not r["predicted"])


def test_without_both_classes(spark):
    docs = documents(spark, ODD[:4])
    for rows in ([], [(1, 1, 1, "x"), (2, 1, 1, "x")]):
        assert {r["score"] for r in op.toxicity(docs, spark.createDataFrame(rows, LABELS)).collect()} == {0.0}


def test_empty_table(spark):
    assert op.toxicity(documents(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_toxic_texts_that_are_all_long_are_learnt(spark):
    """None fits the sample's length: they are learnt from by a window, not left out."""
    rows = [(i, (t + " ") * (400 if y else 1), y) for i, t, y in corpus(400, 3)]
    docs, labels = documents(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows], LABELS)
    model = op.fit(docs, labels, longest_fit=1000)
    assert model is not None and max(len(t) for t, (_, _, y) in zip((r[1] for r in rows), rows) if y) > 1000
    scores = {r["doc_id"]: r["score"] for r in op.toxicity_scores(docs, model).collect()}
    assert auc(np.array([scores[i] for i, _, _ in rows]), np.array([y for _, _, y in rows])) > 0.9


def test_whole_texts_of_all_shards_are_learnt(spark):
    """Toxic words stand at the end of long texts only, and the rows lie in several shards."""
    rows = [(i, "the river " * 2500 + t, y) for i, t, y in corpus(240, 5)]
    docs, labels = documents(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows], LABELS)
    model = op.fit(docs, labels, **({"shard_chars": 2_500_000} if hasattr(op, "SHARD_CHARS") else {}))
    found = {r["doc_id"]: r["score"] for r in op.toxicity_scores(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc(*map(np.array, zip(*held))) > 0.8


def test_a_pass_meets_every_row():
    drawn = op._passed(np.random.default_rng(1), np.arange(40), 45)
    assert len(drawn) == 45 and set(drawn.tolist()) == set(range(40))
