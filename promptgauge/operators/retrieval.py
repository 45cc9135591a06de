"""Exact cosine top k, keyed, by whichever side is small.

Few queries are sent to the corpus where it lies: every task keeps the best k documents of each query so far and hands
on k rows per query. A small corpus is sent to the queries, which are then answered where they lie. When both
sides are large, the queries are sent part by part. All three ways give the same rows. What is sent is
counted first, in bytes. No vector is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, StructField, StructType

from promptgauge.session import written

DIGITS = 9  # similarities are rounded before they are ranked; ties go by id
QUERY_BLOCK = 2_048  # fewest queries that are sent at a time where there are too many to send at once
CORPUS_BLOCK = 16_384  # fewest documents of a task that searches for such a part, as far as tasks are to be had
SENT_BYTES = 32 << 20  # most bytes of vectors that are sent to every task
AT_ONCE = 1 << 22  # similarities worked on at once
WAITING = 4_096  # documents of a key that are waited for, so that lists of the best are seldom merged
WAITING_BYTES = 32 << 20  # most bytes of waiting documents of all keys
STRETCH = 64  # scores of a row of which the largest is looked at first
CROWDED = 50  # times k candidates from which on a row is sorted as a whole


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero, so its similarity to anything is 0."""
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _numbers(ids: pa.Array) -> np.ndarray:
    """Ids as something numpy can compare: numbers where they are numbers, else Python values; a struct by its fields in order."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    held = np.empty(len(ids), dtype=object)
    for i, value in enumerate(ids.to_pylist()):
        held[i] = tuple(value.values()) if isinstance(value, dict) else value
    return held


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the k best of each row, best first; lower places first among equals once rounded.

    The k-th largest of the maxima of parts of a row is no larger than its k-th largest score, so that one pass finds
    few candidates and only these are rounded and sorted. Rows with many near that bound are sorted as a whole.
    """
    m, n = scores.shape
    k = min(k, n)
    n_parts = n // STRETCH
    if n_parts < 4 * k:
        scores = np.round(scores, DIGITS)
        at = _sorted_top(scores, k)
        return at, np.take_along_axis(scores, at, axis=1)
    maxima = scores[:, : STRETCH * n_parts].reshape(m, STRETCH, n_parts).max(axis=1)
    bound = np.partition(maxima, n_parts - k, axis=1)[:, n_parts - k] - 2 * 10.0**-DIGITS
    row, at = np.divmod(np.flatnonzero(scores >= bound[:, None]), n)
    counts = np.bincount(row, minlength=m)
    crowded = (counts > CROWDED * k) | np.isnan(maxima).any(axis=1) | np.isnan(scores[:, STRETCH * n_parts :]).any(axis=1)
    if crowded.any():
        places, values = np.empty((m, k), dtype=np.int64), np.empty((m, k))
        whole = np.round(scores[crowded], DIGITS)
        places[crowded] = _sorted_top(whole, k)
        values[crowded] = np.take_along_axis(whole, places[crowded], axis=1)
        places[~crowded], values[~crowded] = _top(scores[~crowded], k)
        return places, values
    value = np.round(scores[row, at], DIGITS)
    order = np.lexsort((at, -value, row))[(np.cumsum(counts) - counts)[:, None] + np.arange(k)]
    return at[order], value[order]


def _sorted_top(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    ranked = np.rint(np.nan_to_num(scores, neginf=-2.0) * 10**DIGITS).astype(np.int64) * n + (n - 1 - np.arange(n))
    if k < n:
        at = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        ranked = np.take_along_axis(ranked, at, axis=1)
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return np.take_along_axis(at, np.argsort(-ranked, axis=1), axis=1)


class _Side:
    """One key's share of a table: ids, in their order if need be, and unit vectors."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, ordered: bool = True):
        self.arrow, self.units = ids, unit(matrix)
        if ordered:
            order = np.argsort(_numbers(ids), kind="stable")
            self.arrow, self.units = ids.take(pa.array(order)), self.units[order]

    @cached_property
    def ids(self) -> np.ndarray:
        return _numbers(self.arrow)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def _by_key(batch: pa.RecordBatch | pa.Table, n_keys: int) -> dict[tuple, np.ndarray]:
    """Row numbers of each key; rows with a null key belong to none."""
    if not n_keys:
        return {(): np.arange(batch.num_rows)} if batch.num_rows else {}
    found: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True)):
        if None not in key:
            found.setdefault(key, []).append(row)
    return {key: np.array(rows) for key, rows in found.items()}


def _sides(table: pa.Table, n_keys: int, ordered: bool) -> dict[tuple, _Side]:
    table = table.combine_chunks()
    ids, vectors = (table.column(n_keys + i).combine_chunks() for i in (0, 1))
    return {key: _Side(ids.take(pa.array(rows)), _matrix(vectors.take(pa.array(rows))), ordered) for key, rows in _by_key(table, n_keys).items()}


def _bytes(side: DataFrame) -> tuple[int, int]:
    """Bytes and rows."""
    return tuple(side.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0)), F.count("*")).first())


def _again(side: DataFrame, label: str) -> DataFrame:
    """Something that can be read again and again: a plain scan as it is, else a written table."""
    plan = side._jdf.queryExecution().optimizedPlan().toString()
    plain = not re.search("Python|Pandas|Arrow|UDF|Join|Aggregate|Sort|Window|Generate|Repartition|RDD", plan, re.I)
    return side if plain else written(side, label)


def _plain(side: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    usable = F.col(id_col).isNotNull() & F.col("vector").isNotNull()
    return side.filter(usable).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(id_col).alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, keys: Sequence[str] = (), exclude_self: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``keys, query_id, doc_id, similarity, rank``: exact cosine top k of each query over the whole corpus of its keys.

    Ids may be of any type that can be ordered; those of queries are unique under a key. ``exclude_self`` is for the search of a table in itself: a document then
    never answers the query of its own id. The similarity to a zero vector is 0. Rows with a null id, key or
    vector take no part.
    """
    left, right = _plain(queries, keys, "query_id"), _plain(corpus, keys, "doc_id")
    names = [*keys, "query_id", "doc_id", "similarity", "rank"]
    schema = StructType(
        [StructField(f"k{i}", left.schema[f"k{i}"].dataType) for i in range(len(keys))]
        + [StructField("query_id", left.schema["id"].dataType), StructField("doc_id", right.schema["id"].dataType), StructField("similarity", DoubleType())]
    )
    (right_bytes, n_right), (left_bytes, n_left) = _bytes(right), _bytes(left)
    if right_bytes <= sent_bytes:
        return _answered_in_place(left, right, k, len(keys), exclude_self, schema).toDF(*names)
    order = W.partitionBy(*[f"k{i}" for i in range(len(keys))], "query_id").orderBy(F.desc("similarity"), "doc_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if left_bytes <= sent_bytes:
        return ranked(_searched_in_place(left, right, k, len(keys), exclude_self, schema)[0]).toDF(*names)
    # each part is answered and written before the next is sent, so what is sent and shuffled is that of one part
    n_parts = max(1, min(math.ceil(left_bytes / max(1, sent_bytes)), math.ceil(n_left / QUERY_BLOCK)))
    n_tasks = max(1, min(left.sparkSession.sparkContext.defaultParallelism, math.ceil(n_right / CORPUS_BLOCK)))
    left, right = _again(left, "queries"), _again(right, "corpus").coalesce(n_tasks)
    part = F.pmod(F.xxhash64(*[f"k{i}" for i in range(len(keys))], "id"), F.lit(n_parts))
    answered = []
    for i in range(n_parts):
        found, sent = _searched_in_place(left.filter(part == i), right, k, len(keys), exclude_self, schema)
        answered.append(written(ranked(found), "nearest"))
        sent.destroy()
    return reduce(DataFrame.unionByName, answered).toDF(*names)


def _rows(schema: StructType, key: tuple, queries: pa.Array, documents: pa.Array, similarity: np.ndarray) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    held = [pa.repeat(pa.scalar(value, kinds.field(i).type), len(queries)) for i, value in enumerate(key)]
    return pa.RecordBatch.from_arrays([*held, queries.cast(kinds.field("query_id").type), documents.cast(kinds.field("doc_id").type), pa.array(similarity)], schema=kinds)


def _forget_own(scores: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
    """No query is answered by its own id; ``ids`` are in order."""
    low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for i in np.flatnonzero(high > low).tolist():
        scores[i, low[i] : high[i]] = -np.inf


def _answers(batch: pa.RecordBatch, sides: dict[tuple, _Side], k: int, n_keys: int, exclude_self: bool, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each query in the table that ``sides`` are shares of, with their ranks in it."""
    for key, rows in _by_key(batch, n_keys).items():
        side = sides.get(key)
        if side is None:
            continue
        step = max(1, AT_ONCE // len(side.units))
        for first in range(0, len(rows), step):
            part = pa.array(rows[first : first + step])
            ids = batch.column(n_keys).take(part)
            scores = unit(_matrix(batch.column(n_keys + 1).take(part))) @ side.units.T
            if exclude_self:
                _forget_own(scores, _numbers(ids), side.ids)
            top, value = _top(scores, k)
            value = value.ravel()
            keep = np.isfinite(value)
            query = np.repeat(np.arange(len(part)), top.shape[1])[keep]
            rank = np.tile(np.arange(1, top.shape[1] + 1, dtype=np.int32), len(part))[keep]
            found = _rows(schema, key, ids.take(pa.array(query)), side.arrow.take(pa.array(top.ravel()[keep])), value[keep])
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(rank)], names=[*schema.names, "rank"])


def _answered_in_place(left: DataFrame, right: DataFrame, k: int, n_keys: int, exclude_self: bool, schema: StructType) -> DataFrame:
    """Each query meets the whole corpus of its key at once, so its answer is final, rank included."""
    sent = left.sparkSession.sparkContext.broadcast(right.toArrow())  # bounded: counted by the caller

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(sent.value, n_keys, True)
        for batch in batches:
            yield from _answers(batch, sides, k, n_keys, exclude_self, schema)

    return left.mapInArrow(answer, StructType([*schema.fields, StructField("rank", IntegerType())]))


def _searched_in_place(left: DataFrame, right: DataFrame, k: int, n_keys: int, exclude_self: bool, schema: StructType) -> tuple[DataFrame, Broadcast]:
    """The best of each task's documents for each query, and what was sent for it."""
    sent = left.sparkSession.sparkContext.broadcast(left.toArrow())  # bounded: counted by the caller
    numeric = isinstance(schema["doc_id"].dataType, IntegralType)

    def merged(a: tuple, b: tuple) -> tuple:
        """The k best of two lists per query, each of scores and ids."""
        scores, ids = (np.concatenate(p, axis=1) for p in zip(a, b, strict=True))
        if numeric:
            at = np.lexsort((ids, -scores))[:, :k]
        else:
            at = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores.tolist(), ids.tolist(), strict=True)])
        return np.take_along_axis(scores, at, axis=1), np.take_along_axis(ids, at, axis=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, best, held, waiting = _sides(sent.value, n_keys, False), {}, {}, 0

        def meet(key: tuple) -> int:
            """The waiting documents of a key meet its queries; gives back their bytes."""
            parts = held.pop(key)
            side, found = sides[key], _Side(pa.concat_arrays([ids for ids, _ in parts]), np.concatenate([matrix for _, matrix in parts]))
            tops = []
            step = max(1, AT_ONCE // len(found.ids))
            for first in range(0, len(side.ids), step):
                scores = side.units[first : first + step] @ found.units.T
                if exclude_self:
                    _forget_own(scores, side.ids[first : first + step], found.ids)
                top, value = _top(scores, k)
                tops.append((value, found.ids[top]))
            now = tuple(np.concatenate(p) for p in zip(*tops, strict=True))
            best[key] = merged(best[key], now) if key in best else now
            return sum(ids.nbytes + matrix.nbytes for ids, matrix in parts)

        for batch in batches:
            for key, rows in _by_key(batch, n_keys).items():
                if key not in sides:
                    continue
                part = (batch.column(n_keys).take(pa.array(rows)), _matrix(batch.column(n_keys + 1).take(pa.array(rows))))
                held.setdefault(key, []).append(part)
                waiting += part[0].nbytes + part[1].nbytes
                if sum(len(ids) for ids, _ in held[key]) >= WAITING:
                    waiting -= meet(key)
            if waiting > WAITING_BYTES:  # many keys: none waits longer
                waiting -= sum(map(meet, list(held)))
        for key in list(held):
            meet(key)
        for key, (scores, ids) in best.items():
            query = np.repeat(np.arange(len(scores)), scores.shape[1])
            keep = np.isfinite(scores.ravel())
            documents = pa.array(ids.ravel()[keep].tolist(), to_arrow_schema(schema).field("doc_id").type)
            yield _rows(schema, key, sides[key].arrow.take(pa.array(query[keep])), documents, scores.ravel()[keep])

    return right.mapInArrow(search, schema), sent
