"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most d bits share at least 8 - d of their eight positional bytes. Fingerprints are
posted under the values they have at every choice of m byte positions; the members of a list are paired, and the lists
that each pair meets in are tallied. A pair with s bytes in common meets in as many lists as there are choices of m
out of s, so a pair goes on only if its tally reaches the choices of m out of 8 - d, the guaranteed minimum. What is
left is verified by counting the bits that differ.

m is the smallest number of positions at which a fingerprint is expected to meet at most one other by chance, given
how many fingerprints there are: the pairs tallied then grow with the table and not with its square. Lists
longer than ``LIST`` come from groups of near copies. Their members are not paired: they are indexed once more, at
every choice of 8 - d positions. There a pair meets exactly if it shares enough bytes; such a list is split no further, as it
holds at most 256^d fingerprints, is settled by flipping up to d free bits, and hands on one edge per member at most. Two
members of one long list are both indexed again, and a pair without a common long list has its whole tally, so no
link is lost. Only distinct fingerprints are indexed; connected components join the edges.

Words are the runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.

Defined results: null text is empty. A text without words has fingerprint zero and links like any other; one
with fewer words than a shingle is a single shingle. A document with a null id has a fingerprint and gets the
component of its fingerprint; a null component means that no linked document has an id. Repeated ids give
one row per row. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptgauge.llm.batches import per_text
from promptgauge.llm.columns import id_and_text, same_columns
from promptgauge.operators.components import connected_components
from promptgauge.session import written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CHUNK = 1 << 15
LIST = 8
PAIRWISE = 64
BYTES = 8
_PLACES = np.arange(8, dtype=np.intp) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; its shingles are hashed and counted in bounded chunks."""
    words = text.encode("utf-8").lower().split()  # on bytes: A-Z only, and just the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.nonzero(np.frombuffer(joined, np.uint8) == 0x20)[0]
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    starts, ends = np.r_[0, spaces + 1][:n], np.r_[spaces, len(joined)][-n:]
    seen = np.zeros(8 * 256, dtype=np.int64)  # by byte position and value
    for at in range(0, n, CHUNK):
        part = slice(at, at + CHUNK)
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], dtype="<u8")
        seen += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=8 * 256)
    set_in = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, sha: bool = False) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; with ``sha`` the text's SHA-256 between them."""

    def begin():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle, seed) for t in texts], dtype="u8").astype("i8")}

    rows = id_and_text(docs, id_col, text_col)
    return per_text(rows.withColumn("sha", _sha("text")) if sha else rows, begin, "fp long")


def _masks(max_bits: int) -> np.ndarray:
    """Every way to flip one up to ``max_bits`` of 8 * max_bits free bits."""
    free = 8 * max_bits
    return np.array([sum(1 << b for b in some) for k in range(1, max_bits + 1) for some in combinations(range(free), k)], dtype="u8")


def _settled(free: np.ndarray, max_bits: int, masks: np.ndarray) -> np.ndarray:
    """The index of the first member linked, directly or through others, to each of one list's distinct members."""
    m = len(free)
    if m == 2:
        return np.array([0, 0 if int(free[0] ^ free[1]).bit_count() <= max_bits else 1])
    if m <= PAIRWISE:
        near = np.bitwise_count(free[:, None] ^ free[None, :]) <= max_bits
        sides = np.nonzero(near)
    else:
        order = np.argsort(free)
        ranked, sides = free[order], ([], [])
        for mask in masks:
            at = np.minimum(np.searchsorted(ranked, free ^ mask), m - 1)
            hit = ranked[at] == free ^ mask
            sides[0].append(np.nonzero(hit)[0])
            sides[1].append(order[at[hit]])
        sides = tuple(map(np.concatenate, sides))
    label = np.arange(m)
    while True:
        low = label.copy()
        np.minimum.at(low, sides[0], label[sides[1]])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def positions_together(n: int, max_bits: int = MAX_BITS) -> int:
    """How many byte positions make a list, for ``n`` distinct fingerprints."""
    return next((m for m in range(1, BYTES - max_bits) if n * comb(BYTES, m) <= 256**m), BYTES - max_bits)


def _posted(distinct: DataFrame, together: int) -> DataFrame:
    """``node, fp, slot, held``: every fingerprint under its values at every choice of ``together`` byte positions, lists sorted inside tasks."""
    keys = [sum(0xFF << (8 * b) for b in some) for some in combinations(range(BYTES), together)]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    entries = F.array([F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(k)).alias("held")) for i, k in enumerate(signed)])
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = distinct.select("node", "fp", F.explode(entries).alias("p")).select("node", "fp", "p.slot", "p.held")
    return posted.repartition(parts, "slot", "held").sortWithinPartitions("slot", "held", "fp")


def _starts(rows: pd.DataFrame) -> np.ndarray:
    slot, held = rows["slot"].to_numpy(), rows["held"].to_numpy()
    return np.nonzero(np.r_[True, (slot[1:] != slot[:-1]) | (held[1:] != held[:-1])])[0]


def _paired(rows: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """``a, b, bits``: all pairs of each of the short lists, and how many bits differ; members of long lists with themselves and -1 bits."""
    node, fp = rows["node"].to_numpy(), rows["fp"].to_numpy().astype("u8")
    a, b, bits = [], [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LIST)]).tolist():
        first, second = np.triu_indices(size, 1)
        places = starts[sizes == size][:, None]
        i, j = (places + first).ravel(), (places + second).ravel()
        a.append(np.minimum(node[i], node[j]))
        b.append(np.maximum(node[i], node[j]))
        bits.append(np.bitwise_count(fp[i] ^ fp[j]).astype("i4"))
    for start, size in zip(starts[sizes > LIST].tolist(), sizes[sizes > LIST].tolist(), strict=True):
        a.append(node[start : start + size])
        b.append(node[start : start + size])
        bits.append(np.full(size, -1, dtype="i4"))
    kinds = ("i8", "i8", "i4")
    return pd.DataFrame({name: np.concatenate(parts or [np.array([], kind)]).astype(kind) for name, parts, kind in zip(("a", "b", "bits"), (a, b, bits), kinds, strict=True)})


def _pairs_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of all lists; of a list that goes on in the next batch no more than ``LIST`` rows are held."""
    carried, long_list = None, None
    for batch in batches:
        rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
        if not len(rows):
            continue
        starts = _starts(rows)
        sizes = np.diff(np.r_[starts, len(rows)])
        name = tuple(rows.iloc[0][["slot", "held"]])
        if long_list == name:  # the rest of a list known to be long
            sizes[0] = max(sizes[0], 1)
            rest = rows.iloc[: sizes[0]]
            yield pd.DataFrame({"a": rest["node"], "b": rest["node"], "bits": np.full(len(rest), -1, dtype="i4")})
            rows, carried = rows.iloc[sizes[0] :].reset_index(drop=True), None
            if not len(rows):
                continue
            starts = _starts(rows)
            sizes = np.diff(np.r_[starts, len(rows)])
        long_list = tuple(rows.iloc[-1][["slot", "held"]]) if sizes[-1] > LIST else None
        last = len(sizes) if long_list else len(sizes) - 1
        yield _paired(rows, starts[:last], sizes[:last])
        carried = None if long_list else rows.iloc[starts[-1] :]
    if carried is not None:
        yield _paired(carried.reset_index(drop=True), np.array([0]), np.array([len(carried)]))


def tallied(distinct: DataFrame, max_bits: int, together: int) -> DataFrame:
    """``a, b, bits, shared``: pairs by the number of lists they meet in, and the members of long lists with themselves and -1 bits."""
    met = _posted(distinct, together).mapInPandas(_pairs_of_lists, "a long, b long, bits int")
    return met.groupBy("a", "b", "bits").agg(F.count("*").alias("shared"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` that connect just those nodes of ``distinct(node, fp)`` that chains of near fingerprints connect."""
    together = positions_together(distinct.count(), max_bits)
    found = written(tallied(distinct, max_bits, together), "tally")
    enough = (F.col("bits") >= 0) & (F.col("shared") >= comb(BYTES - max_bits, together))
    near = found.filter(enough & (F.col("bits") <= max_bits)).select("a", "b")
    again = found.filter("bits < 0").select(F.col("a").alias("node")).distinct()
    if again.isEmpty():
        return near
    return near.unionByName(_links_of_dense(written(distinct.join(again, "node", "left_semi"), "dense"), max_bits)).distinct()


def _links_of_dense(distinct: DataFrame, max_bits: int) -> DataFrame:
    """The edges of fingerprints in long lists, by lists of all the bytes that near fingerprints must share."""
    # the free bytes of each list, gathered into the low bits
    rest = [[b for b in range(BYTES) if b not in some] for some in combinations(range(BYTES), BYTES - max_bits)]
    masks = _masks(max_bits)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            if not len(rows):
                continue
            starts = _starts(rows)
            carried = rows.iloc[starts[-1] :]  # the last list may go on in the next batch
            yield edges(rows, starts)
        if carried is not None and len(carried):
            yield edges(carried.reset_index(drop=True), np.array([0, len(carried)]))

    def edges(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        node, slot, fp = rows["node"].to_numpy(), rows["slot"].to_numpy(), rows["fp"].to_numpy().astype("u8")
        lists = np.nonzero(np.diff(bounds) > 1)[0]
        a, b = [], []
        for i in lists:
            at = slice(bounds[i], bounds[i + 1])
            free = np.zeros(at.stop - at.start, dtype="u8")
            for low, byte in enumerate(rest[slot[at.start]]):
                free |= ((fp[at] >> np.uint64(8 * byte)) & np.uint64(0xFF)) << np.uint64(8 * low)
            first = _settled(free, max_bits, masks)
            joined = np.nonzero(first != np.arange(len(first)))[0]
            a.append(node[at][first[joined]])
            b.append(node[at][joined])
        if not a:
            return pd.DataFrame({"a": np.array([], "i8"), "b": np.array([], "i8")})
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _posted(distinct, BYTES - max_bits).mapInPandas(settle, "a long, b long").distinct()


def _components(named: DataFrame, max_bits: int) -> DataFrame:
    """The rows of ``named(fp, ...)``, one per fingerprint, with the ``component`` of each; a component is named by a fingerprint."""
    # fingerprints are the nodes: ids may be null or repeat
    nodes = connected_components(links(named.select(F.col("fp").alias("node"), "fp"), max_bits))
    return named.join(nodes.withColumnRenamed("text_id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    found = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    placed = _components(written(found.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct"), max_bits)
    least = placed.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_print = placed.join(least, "component").select("fp", "component_id")
    return found.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns unchanged: the smallest by id (null is the largest), then by digest of the text.

    Rows are told apart by id and text, so rows of different groups may share an id or have none. Of rows
    equal in both one stays, the first by its columns as JSON.
    """
    found = written(fingerprints(docs, shingle, id_col, text_col, sha=True), "fingerprints")
    rows = found.groupBy("fp", "doc_id", "sha").agg(F.count("*").alias("n"))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "n")).alias("lowest")
    placed = _components(written(rows.groupBy("fp").agg(lowest), "distinct"), max_bits)
    stay = placed.groupBy("component").agg(F.min("lowest").alias("lowest"))
    stay = stay.select(F.col("lowest.doc_id").alias("__id"), F.col("lowest.sha").alias("__sha"), F.col("lowest.n").alias("__n"))
    joined = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (_sha(text_col) == F.col("__sha")))
    one = Window.partitionBy("__id", "__sha").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    repeated = joined.filter("__n > 1").withColumn("__at", F.row_number().over(one)).filter("__at = 1")
    return same_columns(joined.filter("__n = 1"), docs).unionByName(same_columns(repeated, docs))
