"""Approximate nearest neighbours by inner product: robust-pruned directed graphs over shards.

Distinct vectors are dealt at random, but repeatably, to shards of bounded size, each of vectors whose largest components
are within a factor of 16; a few extreme vectors are so a small shard, which is met whole. For each shard one task builds a
directed graph in batches: a greedy beam search over the graph so far proposes neighbours for each new
vector, and relaxed distance pruning keeps a diverse few (a candidate goes when a kept neighbour is closer to it, by a
factor, than the vector is). Links are made both ways and pruned again where they grow too many. Shards grow with the
table up to a bound. The index is written and shuffled once for a search: the task of a shard reads the written
queries in bounded batches and beam-searches them, and each query's best rows of all shards are ranked.

No fixed beam suits every table: with vectors of very unequal lengths the largest products lie far from where the links
lead. So the recall of each shard is measured when it is built, on ``SAMPLE`` of its own vectors against all of its
rows, with beams of growing width. The narrowest that finds ``TARGET`` of the true neighbours is kept with
the shard, beside the recall measured; where none of ``BEAMS`` does, the shard is met whole by every query.

Largest inner products are turned into smallest distances by one more component that gives all vectors of a
shard the same length. All of it is in double precision: shards and queries are scaled by powers of two, so that no square
overflows, pruning measures from the node, so that near copies are told apart, and a search ranks by the inner
product alone. Scores are inner products of the original vectors.

Equal vectors are one node with the smallest ``k + 1`` of its ids; no more can be among the k nearest of any
query, so this loses nothing, and a vector that a third of all rows share is limited map-side before it is shuffled.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither
do null ids. Of rows with one id the smallest vector counts. A query meets vectors of its own number of components
only. Ties go to the smaller id. With fewer than k candidates a query gets all found. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptgauge.session import fresh_path, written

SHARD_ROWS, MOST_SHARD_ROWS, SHARDS = 8192, 65_536, 1024
BLOCK_QUERIES = 8192
DEGREE, SLACK = 32, 16
BEAM, WIDTH = 96, 4
ALPHA = 1.2
BATCH = 512
ENTRIES, LONGEST = 64, 32
BEAMS, TARGET, SAMPLE = (1, 2, 4), 0.97, 128
WHOLE, MET = -1, 1 << 22  # a shard met whole, and how many rows are then met at once
GATHERED = 96
SEED = 3
CLASS_BITS, CLASS_OFFSET = 4, 2


class Graph:
    """The vectors of one shard with their links; -1 fills unused places of ``links``."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED):
        lengths = (vectors**2).sum(axis=1)
        self.points = np.c_[vectors, np.sqrt(np.maximum(lengths.max(initial=0.0) - lengths, 0))]
        self.links = np.full((len(vectors), DEGREE + SLACK), -1, dtype=np.int32)
        self.degree = np.zeros(len(vectors), dtype=np.int64)
        # several entries at random places: from a single one a dense group around it may offer no way out
        self.order = np.random.default_rng(seed).permutation(len(vectors))
        # and at the longest vectors, where largest products tend to be
        longest = np.argsort(-lengths, kind="stable")[:LONGEST]
        self.order = np.r_[longest, self.order[~np.isin(self.order, longest)]]
        self.entries = self.order[: LONGEST + ENTRIES]

    # building

    def build(self) -> None:
        order = self.order
        chosen = self.pruned(self.entries, np.tile(self.entries, (len(self.entries), 1)))
        self._set(self.entries, chosen)
        self._link_back(self.entries, chosen)
        at = len(self.entries)
        while at < len(order):
            batch = order[at : at + min(BATCH, at)]
            found, _ = self.beam_search(self.points[batch], BEAM)
            chosen = self.pruned(batch, found)
            self._set(batch, chosen)
            self._link_back(batch, chosen)
            at += len(batch)
        over = np.nonzero(self.degree > DEGREE)[0]
        for i in range(0, len(over), BATCH):
            some = over[i : i + BATCH]
            self._set(some, self.pruned(some, self.links[some].astype(np.int64)))

    def _set(self, nodes: np.ndarray, chosen: np.ndarray) -> None:
        self.links[nodes] = -1
        self.links[nodes, : chosen.shape[1]] = chosen
        self.degree[nodes] = (chosen >= 0).sum(axis=1)

    def _rows(self, most: int) -> int:
        """Fewer rows at a time for vectors of many components."""
        return max(8, min(most, most * 128 // self.points.shape[1]))

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most ``DEGREE`` diverse neighbours of each node out of its candidates, -1 where there are fewer."""
        chosen = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        step = self._rows(128)
        for i in range(0, len(nodes), step):
            chosen[i : i + step] = self._pruned(nodes[i : i + step], candidates[i : i + step])
        return chosen

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == nodes[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        near = self.points[candidates] - self.points[nodes][:, None]  # as seen from the node
        far = np.where(bad, np.inf, (near**2).sum(axis=2) / 2)
        order = np.argsort(far, axis=1, kind="stable")[:, :GATHERED]
        far, candidates = np.take_along_axis(far, order, 1), np.take_along_axis(candidates, order, 1)
        near = np.take_along_axis(near, order[:, :, None], 1)
        half = (near**2).sum(axis=2) / 2
        between = half[:, :, None] + half[:, None] - np.matmul(near, near.transpose(0, 2, 1))
        alive, count = np.isfinite(far), np.zeros(len(nodes), dtype=np.int64)
        out, rows = np.full((len(nodes), DEGREE), -1, dtype=np.int32), np.arange(len(nodes))
        for j in range(far.shape[1]):
            take = alive[:, j] & (count < DEGREE)
            if not take.any():
                continue
            at = rows[take]
            out[at, count[at]] = candidates[at, j]
            count[at] += 1
            # squared distances, so the factor is squared too
            alive[at] &= ALPHA * ALPHA * between[at, j] > far[at]
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray) -> None:
        source = np.repeat(nodes, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0].astype(np.int64)
        known = (self.links[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, counts = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, counts)
        full = self.degree[hit] + counts > self.links.shape[1]
        place = self.degree[target] + nth
        fits = ~np.repeat(full, counts)
        self.links[target[fits], place[fits]] = source[fits]
        self.degree[hit[~full]] += counts[~full]
        if full.any():
            crowded, most = hit[full], int(counts[full].max())
            fresh = np.full((len(crowded), most), -1, dtype=np.int64)
            number = np.repeat(np.cumsum(full) - 1, counts)
            fresh[number[~fits], nth[~fits]] = source[~fits]
            self._set(crowded, self.pruned(crowded, np.c_[self.links[crowded], fresh]))

    # searching

    def beam_search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For points with the extra component: the best nodes met, nearest first, and their negative inner products."""
        found, far = np.empty((len(queries), beam), np.int64), np.empty((len(queries), beam))
        step = self._rows(BATCH)
        for i in range(0, len(queries), step):
            found[i : i + step], far[i : i + step] = self._beam(queries[i : i + step], beam)
        return found, far

    def _beam(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        nodes, far = np.full((n, beam), -1, dtype=np.int64), np.full((n, beam), np.inf)
        seen, open_ = np.zeros((n, len(self.points)), dtype=bool), np.zeros((n, beam), dtype=bool)
        first = -(queries @ self.points[self.entries].T)
        rank, many = np.argsort(first, axis=1, kind="stable")[:, :beam], min(beam, len(self.entries))
        nodes[:, :many], far[:, :many] = self.entries[rank], np.take_along_axis(first, rank, 1)
        open_[:, :many], seen[:, self.entries] = True, True
        active = np.arange(n)
        while len(active):
            # the beam is sorted: the first open places are the best
            waiting = open_[active]
            turn = waiting & (np.cumsum(waiting, axis=1) <= WIDTH)
            place = np.argsort(~turn, axis=1, kind="stable")[:, :WIDTH]
            taken = np.take_along_axis(turn, place, 1)
            expand = np.where(taken, np.take_along_axis(nodes[active], place, 1), -1)
            open_[active] &= ~turn
            met = np.where(expand[:, :, None] >= 0, self.links[expand], -1).reshape(len(active), -1).astype(np.int64)
            met = np.sort(met, axis=1)
            fresh = (met >= 0) & ~seen[active[:, None], met]
            fresh[:, 1:] &= met[:, 1:] != met[:, :-1]
            width = int(fresh.sum(axis=1).max(initial=0))
            if width:
                keep = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
                met, fresh = np.take_along_axis(met, keep, 1), np.take_along_axis(fresh, keep, 1)
                seen[np.broadcast_to(active[:, None], met.shape)[fresh], met[fresh]] = True
                new = np.where(fresh, -np.matmul(self.points[met], queries[active][:, :, None])[:, :, 0], np.inf)
                all_far = np.c_[far[active], new]
                best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
                far[active] = np.take_along_axis(all_far, best, 1)
                nodes[active] = np.take_along_axis(np.c_[nodes[active], np.where(fresh, met, -1)], best, 1)
                open_[active] = np.take_along_axis(np.c_[open_[active], fresh], best, 1)
            active = active[open_[active].any(axis=1)]
        return nodes, far

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Node numbers for original query vectors, -1 where fewer are met. A shard not much larger than the beam is met whole."""
        if beam == WHOLE or len(self.points) <= 2 * beam:
            return np.tile(np.arange(len(self.points)), (len(queries), 1))
        return self.beam_search(np.c_[queries, np.zeros(len(queries))], beam)[0]

    def measured_beam(self, k: int, beam: int) -> tuple[int, float]:
        """The narrowest beam that finds enough of the true neighbours of a sample of the shard's own vectors, and its recall."""
        n = len(self.points)
        if n <= 2 * beam:
            return WHOLE, 1.0
        own = np.unique(np.linspace(0, n - 1, SAMPLE).astype(np.int64))
        products = self.points[own, :-1] @ self.points[:, :-1].T
        products[np.arange(len(own)), own] = -np.inf
        many = min(k, n - 1)
        least = -np.partition(-products, many - 1, axis=1)[:, many - 1 : many]  # equal products are equally good
        for width in BEAMS:
            if n <= 2 * beam * width:
                break
            met = self.search(self.points[own, :-1], beam * width)
            hits = (np.take_along_axis(products, np.maximum(met, 0), 1) >= least) & (met >= 0)
            recall = float(np.minimum(hits.sum(axis=1), many).mean() / many)
            if recall >= TARGET:
                return beam * width, recall
        return WHOLE, 1.0


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def _scaled(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Divided by a power of two, so that the largest component of all, or of each row, is from a half to one."""
    most = np.abs(vectors).max(axis=axis, keepdims=True, initial=0.0)
    return np.ldexp(vectors, -np.frexp(most)[1])


_KEY = ["dims", "size_class", "shard"]


def participants(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part, one per id, in double precision."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def built_index(rows: DataFrame, k: int, shard_rows: int | None = None, beam: int = BEAM, seed: int = SEED) -> DataFrame:
    """The written index over :func:`participants`: ``dims, size_class, shard, node, ids, vector, links, beam, recall``.

    Nodes are numbered by shard; ``beam`` is the width the shard is searched with, and ``recall`` what was measured with it.
    """
    equal = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    largest = F.log2(F.array_max(F.transform("vector", F.abs)))
    size_class = F.floor((largest + CLASS_OFFSET) / CLASS_BITS).cast("int")
    nodes = written(nodes.withColumns({"dims": F.size("vector"), "size_class": size_class}), "nodes")
    wanted = F.least(F.greatest(F.count("*") / SHARDS, F.lit(float(SHARD_ROWS))), F.lit(float(MOST_SHARD_ROWS))) if shard_rows is None else F.lit(float(shard_rows))
    counts = written(nodes.groupBy("dims", "size_class").agg(F.ceil(F.count("*") / wanted).alias("shards")), "counts")
    dealt = nodes.join(counts, ["dims", "size_class"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("ids")[0]), F.col("shards")).cast("int")).drop("shards")
    total = counts.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        first = np.array([i[0] for i in table["ids"].to_pylist()])
        table = table.take(np.argsort(first))  # so that the same rows give the same graph
        graph = Graph(_scaled(_matrix(table["vector"])), seed)
        graph.build()
        width, recall = graph.measured_beam(k, beam)
        links = [row[row >= 0].tolist() for row in graph.links]
        n = len(table)
        return pa.Table.from_arrays(
            [*(table[c] for c in _KEY), pa.array(np.arange(n, dtype="i4")), table["ids"], table["vector"], pa.array(links, pa.list_(pa.int32())), pa.array(np.full(n, width, "i4")), pa.array(np.full(n, recall))],
            names=[*_KEY, "node", "ids", "vector", "links", "beam", "recall"],
        )

    schema = "dims int, size_class int, shard int, node int, ids array<long>, vector array<double>, links array<int>, beam int, recall double"
    # few rows and much work: a number of tasks that adaptive execution doesn't fold together
    return written(dealt.repartition(max(1, 2 * total), *_KEY).groupBy(*_KEY).applyInArrow(build, schema), "index")


def _best(raw: np.ndarray, ids: list[list[int]], names: np.ndarray, vectors: np.ndarray, met: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores of the ``k`` best of each query among the nodes it met, its own id left out."""
    query, place = np.nonzero(met >= 0)
    node = met[query, place]
    scores = np.concatenate([(raw[node[i : i + 65_536]] * vectors[query[i : i + 65_536]]).sum(axis=1) for i in range(0, len(node), 65_536)] or [np.array([])])
    many = np.array(list(map(len, ids)), dtype=np.int64)
    flat, starts = np.array([i for of in ids for i in of], dtype=np.int64), np.cumsum(many) - many
    times = many[node]
    before = np.cumsum(times) - times
    found = flat[np.repeat(starts[node] - before, times) + np.arange(times.sum())]
    query, scores = np.repeat(query, times), np.repeat(scores, times)
    other = found != names[query]
    query, scores, found = query[other], scores[other], found[other]
    order = np.lexsort((found, -scores, query))
    query, scores, found = query[order], scores[order], found[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return names[query[keep]], found[keep], scores[keep]


def searched(index: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(vec_id, vector)``, its own id left out."""
    spark = index.sparkSession
    asked = fresh_path(spark, "queries")
    # in files of bounded size, which the task of every shard reads one batch at a time
    queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.size("vector").alias("dims")).write.option("maxRecordsPerFile", 1 << 20).parquet(asked)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = pa.Table.from_batches(list(batches)).sort_by("node")  # a shard is bounded; its answers leave batch by batch
        raw, width = _matrix(nodes["vector"]), nodes["beam"][0].as_py()
        graph = Graph(_scaled(raw), seed)
        for i, row in enumerate(nodes["links"].to_pylist()):
            graph.links[i, : len(row)] = row
        ids = nodes["ids"].to_pylist()
        store, path = _store(asked)
        files = dataset.dataset(path, filesystem=store, format="parquet")
        step = max(1, min(block_queries, MET // len(raw))) if width == WHOLE or len(raw) <= 2 * width else block_queries
        for batch in files.to_batches(batch_size=step, filter=dataset.field("dims") == key[0].as_py()):
            if batch.num_rows:
                names, vectors = batch["query_id"].to_numpy(), _matrix(pa.chunked_array([batch["query"]]))
                columns = _best(raw, ids, names, vectors, graph.search(_scaled(vectors, 1), width), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    shards = max(1, index.select(*_KEY).distinct().count())
    found = index.repartition(2 * shards, *_KEY).groupBy(*_KEY).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20, shard_rows: int | None = None, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index every row and search it for the rows whose id ``query_every`` divides."""
    rows = written(participants(vectors, id_col, vector_col), "vectors")
    index = built_index(rows, k, shard_rows, max(beam, 3 * k))
    return searched(index, rows.filter(F.col("vec_id") % query_every == 0), k)
