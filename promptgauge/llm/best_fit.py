"""Best-fit packing online, with a fixed number of open bins.

Every task encodes its own documents and packs them as they come, so nothing is shuffled and nothing waits: a piece
knows its sequence and its place as soon as it is encoded. A task keeps at most ``open_bins`` sequences open.
One whole number is the bitset of the free spaces that open sequences have: a shift and the lowest set bit give
the fullest sequence that a piece still fits. A sequence without free space closes, and when too many are
open the fullest closes first. The pieces of ``window`` documents at a time are placed longest first, which
leaves the short ones to fill the gaps.

A document of at most ``length`` ids is never cut. A longer one is cut into full pieces behind a shorter first one.

The sequences of a task are numbered behind the number of its partition, and the result is written before it is
handed on, so a lost executor never mixes two orders of the same rows. On the last documents of a task
at most ``open_bins`` sequences stay partly filled; partitions of the usual 128 MB hold far more.

Defined results: null text is empty; an empty document is its end id alone. Repeated rows and repeated or null
ids are documents of their own. Pieces of equal length are placed in the order of the table. An empty table gives an
empty table. Ids are those of the tokenizers library, special strings in a text included.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from promptgauge.llm.batches import per_text
from promptgauge.llm.columns import id_and_text
from promptgauge.llm.tokens import chunk_encoder
from promptgauge.session import written

LENGTH = 1024
OPEN_BINS = 1024
WINDOW = 1024
END_ID = 2
_PLACED = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


class OpenBins:
    """The open bins by free space; bit ``f`` of ``spaces`` is set while a bin with ``f`` free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.spaces = self.made = self.open = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _taken(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces ^= 1 << free
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin that a piece goes to, and the place in it where it starts."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            chosen = self._taken(free)
        else:
            free, chosen = self.capacity, self.made
            self.made += 1
        if left := free - size:
            self.bins[left].append(chosen)
            self.spaces |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._taken((self.spaces & -self.spaces).bit_length() - 1)
        return chosen, self.capacity - free


def cut(size: int, length: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document: all full but for the first."""
    first = size % length or length
    return [(0, min(first, size)), *((start, length) for start in range(first, size, length))]


def best_fit_packed(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, open_bins: int = OPEN_BINS, window: int = WINDOW, end_id: int = END_ID,
    with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids`` (little-endian, 32 bits each)."""

    def begin():
        encode, end, bins = chunk_encoder(tokenizer_path), np.array([end_id], "<u4"), OpenBins(length, open_bins)
        numbered = TaskContext.get().partitionId() << 40

        def work(texts: list[str]) -> dict:
            made: dict[str, list] = {name: [] for name in ("_row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")}
            for first in range(0, len(texts), window):
                found = [np.concatenate([ids, end]) for ids in encode(texts[first : first + window])]
                pieces = [(size, row, piece, start) for row, ids in enumerate(found) for piece, (start, size) in enumerate(cut(len(ids), length))]
                pieces.sort(key=lambda p: -p[0])
                for size, row, piece, start in pieces:
                    raw = found[row][start : start + size].tobytes()
                    chosen, offset = bins.place(size)
                    values = (first + row, piece, start, size, zlib.crc32(raw), numbered + chosen, offset, raw if with_ids else None)
                    for name, value in zip(made, values, strict=True):
                        made[name].append(value)
            return made

        return work

    return written(per_text(id_and_text(docs, id_col, text_col), begin, _PLACED), "best-fit")
