"""Many small models at once: a logistic regression or a k-means per key, without a loop over keys.

The vectors of a key are packed into matrices of about ``BLOCK`` rows once. In each round the matrices meet the state of
their key (a small table that Spark broadcasts if it finds it small), and each matrix gives one partial sum.
Partial sums are added in the order of their matrices, a bounded number at a time, so results are the same for
every partitioning of the input. Keys that have converged leave the rounds. Only counts come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from promptgauge.session import written

BLOCK = 2_048
FAN_IN = 64
ALL = "__all"
TRIALS = (4.0, 1.0, 0.3, 0.05)
HISTORY = 8
TOLERANCE = 1e-5

_STATE = "classes long, n double, weights array<double>, step array<double>, scale double, loss double, slope double, gradient array<double>, history array<array<double>>, rounds int, done boolean"


def packed(rows: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``keys, part, ids, labels, dims, cells``: the vectors of a key as matrices. ``rows``: keys, vec_id, label, vector.

    A row's matrix follows from its id alone, and rows lie in it in the order of their ids.
    """
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    sizes = written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("long").alias("parts")), "sizes")
    joined = rows.join(sizes, list(keys))
    one = F.struct("vec_id", "label", F.col("vector").cast("array<double>").alias("vector"))
    packs = joined.groupBy(*keys, F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return written(
        packs.select(
            *keys, "part", F.col("rows.vec_id").alias("ids"), F.col("rows.label").alias("labels"),
            F.size(F.col("rows")[0]["vector"]).alias("dims"), F.flatten("rows.vector").alias("cells"),
        ),
        "packed-vectors",
    )


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [df.schema[c] for c in names]


def _cells(row) -> np.ndarray:
    return np.asarray(row.cells, dtype=float).reshape(len(row.ids), -1)


def _keyed(keys: Sequence[str], *tables: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """Without keys all rows get the same one."""
    return (list(keys), list(tables)) if keys else ([ALL], [t.withColumn(ALL, F.lit(0)) for t in tables])


def _named_rows(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple]:
    """Rows, and their keys by name, whatever the names are."""
    return zip(batch.itertuples(index=False), batch[keys].to_dict("records"), strict=True)


def _summed(parts: DataFrame, keys: Sequence[str], most_part: int) -> DataFrame:
    """``keys, part, sums``: sums of ``sums`` with ``part`` 0 for all; equal-length arrays are added ``FAN_IN`` at a time, in order."""
    schema = parts.select(*keys, "part", "sums").schema

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = reduce(np.add, (np.asarray(x) for x in group["sums"]))
        return group.head(1).assign(sums=[total])

    while True:
        folded = parts.select(*keys, F.call_function("div", F.col("part"), F.lit(FAN_IN)).alias("to"), "part", "sums")
        parts = folded.groupBy(*keys, "to").applyInPandas(lambda g: add(g).assign(part=g["to"].iloc[0]).drop(columns="to")[schema.names], schema)
        if most_part < FAN_IN:
            return parts
        most_part //= FAN_IN
        parts = written(parts, "partial-sums")


def _updated(state: DataFrame, sums: DataFrame, keys: Sequence[str], update: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """The state of each key after ``update(row, sums)``."""
    schema = state.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [update({c: r[c] for c in schema.names}, np.asarray(r["sums"])) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=schema.names)

    return state.join(sums.drop("part"), keys).mapInPandas(run, schema)


def _rounds(packs: DataFrame, state: DataFrame, keys: Sequence[str], work: Callable, update: Callable[[dict, np.ndarray], dict], rounds: int) -> DataFrame:
    """Repeats partial sums and updates until every key is done, or for so many rounds."""
    most = packs.agg(F.max("part")).first()[0] or 0
    partial = StructType([*_fields(packs, [*keys, "part"]), *_parse_datatype_string("sums array<double>").fields])
    finished = []
    for _ in range(rounds):
        open_ = state.filter(~F.col("done"))
        parts = packs.join(open_, keys).mapInPandas(_row_by_row(work, partial.names), partial)
        state = written(_updated(open_, _summed(parts, keys, most), keys, update), "model-state")
        finished.append(state.filter("done"))
        if state.filter(~F.col("done")).isEmpty():
            return reduce(DataFrame.unionByName, finished)
    return reduce(DataFrame.unionByName, [*finished, state.filter(~F.col("done"))])


def _row_by_row(work: Callable, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[names[:-1]].copy()
            made["sums"] = [work(row) for row in batch.itertuples(index=False)]
            yield made

    return run


# logistic regression


def _loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed cross entropy and its gradient; ``weights`` has a row per class, the intercept last."""
    scores = x @ weights[:, :-1].T + weights[:, -1]
    scores -= scores.max(axis=1, keepdims=True)
    raised = np.exp(scores)
    total = raised.sum(axis=1, keepdims=True)
    own = scores[np.arange(len(y)), y] - np.log(total[:, 0])
    rest = raised / total
    rest[np.arange(len(y)), y] -= 1
    return np.r_[-own.sum(), np.c_[rest.T @ x, rest.sum(axis=0)].ravel()]


def _direction(gradient: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Where to go next, from the gradient and the latest moves and changes of the gradient (limited-memory quasi-Newton)."""
    moves, changes = history[0::2], history[1::2]
    q, kept = gradient.copy(), []
    for s, y in zip(moves[::-1], changes[::-1], strict=True):
        a = (s @ q) / (s @ y)
        kept.append(a)
        q -= a * y
    if moves:
        q *= (moves[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(moves, changes, kept[::-1], strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def logistic_models(train: DataFrame, keys: Sequence[str] = (), regularisation: float = 0.01, rounds: int = 60) -> DataFrame:
    """``keys, class_labels, weights, classes, loss, n_rounds, converged``: one multinomial model per key.

    It minimises the mean cross entropy plus half the regularisation times the squared weights without intercepts. Every
    round tries a few step lengths in one pass over the vectors. Rows with a null label take no part.
    """
    keys, (train,) = _keyed(keys, train)
    return _models(train, keys, regularisation, rounds).drop(ALL)


def _models(train: DataFrame, keys: list[str], regularisation: float, rounds: int) -> DataFrame:
    train = train.filter(F.col("label").isNotNull())
    labels = written(train.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("class_labels"), F.count("*").cast("double").alias("n")), "labels")
    packs = packed(train, keys)
    numbered = packs.join(labels.drop("n"), keys).select(
        *keys, "part", "ids", "dims", "cells", F.transform("labels", lambda v: (F.array_position("class_labels", v) - 1).cast("int")).alias("y")
    )
    packs = written(numbered, "numbered-vectors")
    dims = packs.groupBy(*keys).agg(F.max("dims").alias("dims"))
    empty = F.array().cast("array<double>")
    classes = F.size("class_labels").cast("long")
    zeros = F.array_repeat(F.lit(0.0), (classes * (F.col("dims") + 1)).cast("int"))
    start = labels.join(dims, keys).select(
        *keys, classes.alias("classes"), "n", zeros.alias("weights"), zeros.alias("step"), F.lit(1.0).alias("scale"), F.lit(math.inf).alias("loss"), F.lit(0.0).alias("slope"),
        empty.alias("gradient"), F.array().cast("array<array<double>>").alias("history"), F.lit(0).alias("rounds"), F.lit(False).alias("done"),
    )

    def work(row) -> np.ndarray:
        x, y, shape = _cells(row), np.asarray(row.y), (row.classes, -1)
        at, step = (np.asarray(v, dtype=float).reshape(shape) for v in (row.weights, row.step))
        return np.concatenate([_loss_and_gradient(x, y, at + t * row.scale * step) for t in TRIALS])

    def update(row: dict, sums: np.ndarray) -> dict:
        at, step, shape = np.asarray(row["weights"], float), np.asarray(row["step"], float), (row["classes"], -1)
        tried = []
        for t, found in zip(TRIALS, sums.reshape(len(TRIALS), -1) / row["n"], strict=True):
            moved = at + t * row["scale"] * step
            shrunk = moved.reshape(shape).copy()
            shrunk[:, -1] = 0
            tried.append((found[0] + regularisation / 2 * float((shrunk**2).sum()), t * row["scale"], moved, found[1:] + regularisation * shrunk.ravel()))
        loss, length, moved, gradient = min(tried, key=lambda found: found[0])
        row = row | {"rounds": row["rounds"] + 1}
        first = row["rounds"] == 1
        if not first and not loss <= row["loss"] + 1e-4 * length * row["slope"]:
            if row["scale"] < 1e-8:  # no step makes it smaller: it is at the minimum, as far as numbers go
                return row | {"done": True}
            return row | {"scale": row["scale"] * 0.02}
        history = [np.asarray(h) for h in row["history"]]
        if not first:
            move, change = moved - at, gradient - np.asarray(row["gradient"])
            if move @ change > 1e-14 * np.sqrt((move @ move) * (change @ change)):
                history = [*history, move, change][-2 * HISTORY :]
        way = _direction(gradient, history)
        if not way @ gradient < 0:
            history, way = [], -gradient
        if not history:
            way /= max(1.0, np.linalg.norm(way))
        return row | {
            "weights": moved, "step": way, "scale": 1.0, "loss": loss, "slope": float(way @ gradient), "gradient": gradient, "history": history,
            "done": bool(np.abs(gradient).max(initial=0) <= TOLERANCE),
        }

    schema = StructType([*_fields(labels, keys), *_parse_datatype_string(_STATE).fields])
    found = _rounds(packs, written(start.select(*schema.names), "model-state"), keys, work, update, rounds)
    named = labels.select(*keys, "class_labels")
    return written(
        named.join(found, keys).select(*keys, "class_labels", "weights", "classes", "loss", F.col("rounds").alias("n_rounds"), F.col("done").alias("converged")), "logistic-models"
    )


def logistic_predictions(train: DataFrame, test: DataFrame, keys: Sequence[str] = (), regularisation: float = 0.01, rounds: int = 60) -> DataFrame:
    """``keys, vec_id, label, predicted``: the class of the highest score, the lower label on ties; null for a key without a model."""
    keys, (train, test) = _keyed(keys, train, test)
    models = _models(train, keys, regularisation, rounds).select(*keys, "class_labels", "weights", "classes")
    joined = packed(test, keys).join(models, keys, "left")
    kind = train.schema["label"].dataType
    schema = StructType([*_fields(test, keys), test.schema["vec_id"], test.schema["label"], StructField("predicted", kind)])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, named in _named_rows(batch, keys):
                found = [None] * len(row.ids)
                if row.weights is not None:
                    weights = np.asarray(row.weights).reshape(int(row.classes), -1)
                    scores = np.round(_cells(row) @ weights[:, :-1].T + weights[:, -1], 9)
                    found = [row.class_labels[c] for c in scores.argmax(axis=1)]
                made = pd.DataFrame({"vec_id": list(row.ids), "label": list(row.labels), "predicted": pd.Series(found, dtype=object)})
                yield made.assign(**named)[schema.names]

    return joined.mapInPandas(predict, schema).drop(ALL)


# k-means


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def _seeds(packs: DataFrame, wanted: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """``keys, k, centres``: the first centre at random, each further one with chances as the squared distance to the nearest so far.

    Every row draws an exponential waiting time by a hash of its id and divides it by its squared distance; the
    shortest wait wins. That is the wanted chance, and needs no total.
    """
    state = written(wanted.withColumn("centres", F.array().cast("array<double>")).withColumn("done", F.lit(False)), "seeds")
    schema = StructType([*_fields(packs, keys), *_parse_datatype_string("wait double, drawn long, cells array<double>").fields])
    finished = []
    while True:
        joined = packs.select(*keys, "ids", "cells", "dims").join(state, keys)
        joined = joined.withColumn("draws", F.transform("ids", lambda i: F.xxhash64(i, F.col("centres"), F.lit(seed))))

        def wait(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for row, named in _named_rows(batch, keys):
                    x, draws = _cells(row), np.asarray(row.draws, dtype=np.int64)
                    chance = (draws.astype(np.uint64).astype(float) + 0.5) / 2.0**64
                    far = np.ones(len(x))
                    if len(row.centres):
                        far = _distances(x, np.asarray(row.centres).reshape(-1, row.dims)).min(axis=1)
                        far[far <= 1e-12 * (x * x).sum(axis=1)] = 0
                    waits = np.divide(-np.log(chance), far, out=np.full(len(x), np.inf), where=far > 0)
                    best = np.lexsort((draws, waits))[0]
                    made.append((*named.values(), float(waits[best]), int(draws[best]), x[best]))
                yield pd.DataFrame(made, columns=schema.names)

        best = joined.mapInPandas(wait, schema).groupBy(*keys).agg(F.min_by(F.struct("wait", "cells"), F.struct("wait", "drawn")).alias("next"))
        more = F.col("next.wait") < math.inf  # fewer distinct vectors than centres wanted: no more to take
        grown = state.join(best, keys).select(*keys, "k", F.when(more, F.concat("centres", "next.cells")).otherwise(F.col("centres")).alias("centres"), more.alias("more"), F.size("next.cells").alias("dims"))
        state = written(grown.select(*keys, "k", "centres", (~F.col("more") | (F.size("centres") >= F.col("k") * F.col("dims"))).alias("done")), "seeds")
        finished.append(state.filter("done").drop("done"))
        state = state.filter(~F.col("done"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, finished)


def kmeans_clusters(vectors: DataFrame, k: int | None = None, keys: Sequence[str] = (), seed: int = 7, rounds: int = 50) -> DataFrame:
    """``keys, vec_id, label, cluster`` (from 0), a k-means per key; without ``k`` as many clusters as the key has labels.

    Seeds are drawn as in k-means++ by keyed hashes, then means and memberships are renewed until no mean moves. A row
    belongs to the nearest mean, the lower number on ties; a mean that lost all rows stays where it is.
    """
    keys, (vectors,) = _keyed(keys, vectors)
    packs = packed(vectors, keys)
    many = vectors.groupBy(*keys).agg((F.lit(k) if k is not None else F.greatest(F.count_distinct("label"), F.lit(1))).cast("long").alias("k"))
    seeds = written(_seeds(packs, written(many, "wanted"), keys, seed), "seeds")
    start = seeds.select(*keys, "centres", F.lit(0).alias("rounds"), F.lit(False).alias("done"))

    def work(row) -> np.ndarray:
        x, centres = _cells(row), np.asarray(row.centres).reshape(-1, row.dims)
        own = _distances(x, centres).argmin(axis=1)
        sums = np.zeros((len(centres), x.shape[1] + 1))
        np.add.at(sums, own, np.c_[x, np.ones(len(x))])
        return sums.ravel()

    def update(row: dict, sums: np.ndarray) -> dict:
        old = np.asarray(row["centres"])
        # as many columns as a mean has, and the count
        width = len(sums) - len(old)
        sums = sums.reshape(width, -1)
        old = old.reshape(width, -1)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), old)
        return row | {"centres": new.ravel(), "rounds": row["rounds"] + 1, "done": bool(np.abs(new - old).max() <= 1e-9 * max(1.0, np.abs(old).max()))}

    models = _rounds(packs, written(start, "model-state"), keys, work, update, rounds).select(*keys, "centres")
    schema = StructType([*_fields(packs, keys), vectors.schema["vec_id"], vectors.schema["label"], *_parse_datatype_string("cluster int").fields])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, named in _named_rows(batch, keys):
                own = _distances(_cells(row), np.asarray(row.centres).reshape(-1, row.dims)).argmin(axis=1)
                made = pd.DataFrame({"vec_id": list(row.ids), "label": list(row.labels), "cluster": own})
                yield made.assign(**named)[schema.names]

    return packs.join(models, keys).mapInPandas(assign, schema).drop(ALL)
