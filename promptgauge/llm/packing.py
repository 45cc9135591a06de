"""Packing documents into training sequences: first-fit decreasing in randomised groups of documents.

Each document is encoded and cut into pieces of the full sequence length and one shorter rest. A full piece
is a sequence of its own, numbered below zero, and goes nowhere. The rests, at most one of a document, are dealt at
random, but repeatably, to groups of about ``group_docs``; each group is packed by itself with first-fit decreasing, where a tournament tree over the free
space of the bins finds the first bin that fits in logarithmic time. A group is one bounded task; the number
of groups grows with the table. Encoded pieces are written before they are dealt, so a lost executor
never changes a group.

Sequences are filled to ``length`` with padding unless their fill is a power of two (``padded_length``).

Defined results: null text is empty; an empty document is its end id alone. Repeated rows and repeated or
null ids are documents of their own. Equal lengths are packed in the order of the encoded table. An empty table
gives an empty table. Ids are those of the tokenizers library, special strings in a text included.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.llm.batches import per_text
from promptgauge.llm.columns import id_and_text
from promptgauge.llm.tokens import chunk_encoder
from promptgauge.session import written

LENGTH = 2048
GROUP_DOCS = 2048
END_ID = 1
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class BinTree:
    """A tournament tree over bins: every inner node holds the larger free space of its two sides."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, whose free space shrinks."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        chosen = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return chosen


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes must come largest first."""
    tree = BinTree(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def encoded_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, the little-endian 32-bit ``ids``."""

    def begin():
        encode, end = chunk_encoder(tokenizer_path), np.array([end_id], "<u4")

        def work(texts: list[str]) -> dict:
            made = {name: [] for name in ("_row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for row, found in enumerate(encode(texts)):
                ids = np.concatenate([found, end])
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    for name, value in zip(made, (row, start, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None), strict=True):
                        made[name].append(value)
            return made

        return work

    return per_text(id_and_text(docs, id_col, text_col), begin, _PIECE)


def packed(pieces: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``. ``pieces`` comes from :func:`encoded_pieces`."""
    # written: the row numbers that deal documents to groups must not change on a retry
    kept = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = kept.filter(F.col("length") == length).withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")})
    rests = kept.filter(F.col("length") < length)
    groups = max(1, -(-rests.count() // group_docs))
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(groups)).cast("long"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(np.lexsort((rows["start"].to_numpy(), rows["row"].to_numpy(), -rows["length"].to_numpy())))
        bins = np.array(first_fit_decreasing(rows["length"].to_pylist(), length), dtype="int64")
        order = np.argsort(bins, kind="stable")
        rows, bins = rows.take(order), bins[order]
        sizes = rows["length"].to_numpy()
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, bins[1:] != bins[:-1]]
        offsets = before - np.maximum.accumulate(np.where(first, before, 0))
        placed = [pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)]
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.Table.from_arrays([*rows.select(columns).columns, *placed, rows["ids"]], names=[*columns, "sequence_id", "offset", "ids"])

    placed = dealt.groupBy("grp").applyInArrow(pack, _PLACED)
    return placed.unionByName(full.select(*placed.columns))


def padded_length(fill: Column, length: int = LENGTH) -> Column:
    """What a sequence of ``fill`` ids is padded to."""
    return F.when(fill.bitwiseAND(fill - 1) == 0, fill).otherwise(F.lit(length))


def packed_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, end_id: int = END_ID, seed: int = 7, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and pack: one row per piece, with its ids unless ``with_ids`` is off."""
    return packed(encoded_pieces(docs, tokenizer_path, length, end_id, with_ids, id_col, text_col), length, group_docs, seed)
