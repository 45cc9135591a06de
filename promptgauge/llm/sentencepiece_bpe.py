"""SentencePiece encoding with seeded merge-dropout, and decoding back to the very same text.

Encoding starts from characters and takes candidate merges from an agenda, best score first and leftmost on
ties, as the merge-type model prescribes. Before a merge is made, a hash keyed by the seed, the document, the place
of the chunk in the text, the piece and the place in the chunk decides whether it is skipped for good. The same seed
gives the same pieces; another seed, document or place in the text gives another segmentation. A dropout of 0 gives
the model's own segmentation.

Spaces become the model's space mark, and one mark leads the text. Characters the model does not know,
and a literal space mark in the text, are spelled in bytes, so decoding always returns the text.

No piece of such a model has a space mark after another character; texts are therefore cut before each run of
spaces, and between Latin letters and other characters if no piece of the model has both. The agenda of a chunk is a path of merges until the first skipped one, and from there the path of the chunk
without that merge. Such paths are kept in a bounded cache, one per worker process; every occurrence of a chunk
draws the merges of its path and goes on to the next one where a merge is skipped.

Defined results: null and empty texts have no pieces and decode to the empty text. A document is its id, null
included, and its text; rows equal in both have equal pieces. The variant is a hash of the id that stands beside
the result and takes no part in the draw. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from promptgauge.llm.batches import per_process, per_row
from promptgauge.llm.columns import id_and_text

MARK = "▁"
DROPOUT = 0.1
VARIANTS = 8
SEED = 5
CACHE_PATHS = 1_000_000
SHORT = 80
TOGETHER = 50_000
AT_ONCE = 200_000
_CHUNK = re.compile(" *[^ ]+| +")
_FINER = re.compile(" *(?:[A-Za-z\u00C0-\u024F]+|[^ A-Za-z\u00C0-\u024F]+)| +")
_LAST = (1 << 31) - 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


class Rows:
    """Rows of values of different lengths, one behind the other; they are added at the end and gathered by number."""

    def __init__(self, kind: type):
        self.flat, self.sizes = np.empty(0, kind), np.empty(0, np.int64)
        self.clear()

    def clear(self) -> None:
        self.used = self.count = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, new, held in (("flat", flat, self.used), ("sizes", sizes, self.count)):
            old = getattr(self, name)
            if held + len(new) > len(old):
                grown = np.empty(2 * (held + len(new)), old.dtype)
                grown[:held] = old[:held]
                setattr(self, name, grown)
            getattr(self, name)[held : held + len(new)] = new
        self.used += len(flat)
        self.count += len(sizes)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of the rows of these numbers are in ``flat``, and the rows' sizes."""
        sizes = self.sizes[: self.count]
        starts, wanted = np.cumsum(sizes) - sizes, sizes[at]
        before = np.cumsum(wanted) - wanted
        return np.repeat(starts[at] - before, wanted) + np.arange(wanted.sum()), wanted


class Paths:
    """Agendas of chunks, each a path of merges that none of is skipped, by number.

    A path belongs to a chunk and to the merges skipped in it so far. It has the ids it ends with, its merges in order and,
    for each of these, the number of the path where that merge is skipped too (-1 while it isn't known).
    """

    def __init__(self, model: MergeModel):
        self.model = model
        self.ids, self.merges, self.skipping = Rows(np.uint32), Rows(np.uint64), Rows(np.int32)
        self.parent, self.left = Rows(np.int32), Rows(np.int64)  # the path left, and the place of the merge skipped there
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chunks: list[str] = []
        for rows in (self.ids, self.merges, self.skipping, self.parent, self.left):
            rows.clear()

    def _add(self, chunks: list[str], parent: np.ndarray, left: np.ndarray) -> None:
        without = []  # by number of merges skipped, the last one first
        at, above = left, parent
        while len(at) and at[0] >= 0:  # paths made together have skipped equally many
            without.append(self.merges.flat[at])
            at, above = self.left.flat[above], self.parent.flat[above]
        for i in range(0, len(chunks), TOGETHER):
            part, made = chunks[i : i + TOGETHER], []
            self.ids.add(*self.model.merged_rows(part, 0, made, [w[i : i + TOGETHER] for w in without]))
            owner, named = (np.concatenate([m[j] for m in made] or [np.array([], kind)]) for j, kind in enumerate((np.int32, np.uint64)))
            counts = np.bincount(owner, minlength=len(part))
            self.merges.add(named[np.argsort(owner, kind="stable")], counts)
            self.skipping.add(np.full(len(named), -1), counts)
        ones = np.ones(len(chunks), np.int64)
        self.parent.add(parent, ones)
        self.left.add(left, ones)
        self.chunks += chunks

    def of_chunks(self, chunks: list[str]) -> np.ndarray:
        """The path of each chunk without dropout; -1 for those that are long or have a literal mark."""
        missing = sorted(c for c in set(chunks).difference(self.number) if len(c) <= SHORT and MARK not in c)
        self.number.update(zip(missing, range(len(self.chunks), len(self.chunks) + len(missing)), strict=True))
        none = np.full(len(missing), -1)
        self._add([c.replace(" ", MARK) for c in missing], none, none)
        return np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))

    def drawn(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The path that each chunk ends on, drawn with its key."""
        at, on = at.copy(), np.nonzero(at >= 0)[0]
        while len(on):
            places, counts = self.merges.places(at[on])
            owner = np.repeat(on, counts)
            skipped = np.nonzero(self.model.drawn(self.merges.flat[places], keys[owner]))[0]
            first = skipped[np.r_[True, owner[skipped[1:]] != owner[skipped[:-1]]][: len(skipped)]]
            on, left = owner[first], places[first]
            missing = np.nonzero(self.skipping.flat[left] < 0)[0]
            wanted, one = np.unique(left[missing], return_index=True)
            parent = at[on[missing[one]]]
            self.skipping.flat[wanted] = np.arange(len(self.chunks), len(self.chunks) + len(wanted))
            self._add([self.chunks[k] for k in parent.tolist()], parent, wanted)
            at[on] = self.skipping.flat[left]
        return at


class MergeModel:
    """The vocabulary of a merge-type model, its encoder and its decoder."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.of_byte, self.shown = [-1] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.of_byte[value] = i
                self.shown.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.shown.append(b"")
            else:
                self.number[piece], self.rank[piece] = i, -model.get_score(i)
                self.shown.append(piece.replace(MARK, " ").encode())
        if -1 in self.of_byte:
            raise ValueError("the model cannot spell every byte, so not every text would decode to itself")
        if any(MARK in p.lstrip(MARK) for p in self.number):
            raise ValueError("a piece has a space mark inside")
        # Latin letters and other characters are cut apart where no piece holds both
        self.cut = _CHUNK if any(len(_FINER.findall(p.lstrip(MARK))) > 1 for p in self.number) else _FINER
        self.limit, self.seed = int(dropout * (1 << 24)), seed
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many chunks at once: ids of characters, pieces and ranks of pairs."""
        size = len(self.shown)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        pairs = []
        for piece, n in self.number.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = n
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * size + right, n))
        found = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_piece = np.ascontiguousarray(found[:, 0]), found[:, 1].astype(np.int32)
        ranks = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        self.order, self.length = np.full(size, _LAST, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for piece, n in self.number.items():
            self.order[n], self.length[n] = ranks[self.rank[piece]], len(piece)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes, and its rank; ``_LAST`` where it makes none."""
        wanted = left.astype(np.int64) * len(self.shown) + right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        piece = self.pair_piece[at]
        makes = (self.pair_keys[at] == wanted) & (left >= 0) & (right >= 0)
        return piece, np.where(makes, self.order[piece], np.int32(_LAST))

    def skipped(self, key: int, piece, place, left):
        """Whether the merge to ``piece`` at ``place``, from a left part of ``left`` characters, is dropped. For arrays."""
        return self.drawn(self._named(piece, place, left), np.uint64(key))

    @staticmethod
    def _named(piece, place, left):
        """A merge as a number, to be drawn with the key of a chunk."""
        return piece.astype(np.uint64) * _MIX[0] + place.astype(np.uint64) * _MIX[1] + left.astype(np.uint64) * _MIX[2]

    def drawn(self, named, key):
        """Whether merges, as numbers, are skipped with the keys of their chunks."""
        mixed = (named ^ key) * _MIX[3]
        return ((mixed ^ mixed >> np.uint64(29)) * _MIX[4] >> np.uint64(40)).astype(np.int64) < self.limit

    def key(self, document: int) -> int:
        return zlib.crc32(f"{self.seed}/{document}".encode()) * 0x100000001B3 + document & 0xFFFFFFFFFFFFFFFF

    def keys(self, documents: list[int], counts: list[int]) -> np.ndarray:
        """The key of each chunk of the documents, of which they have so many."""
        many = np.array(counts, dtype=np.int64)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        mixed = np.repeat(np.array([self.key(d) for d in documents], dtype=np.uint64), many) + (place.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        mixed = (mixed ^ mixed >> np.uint64(30)) * _MIX[3]
        mixed = (mixed ^ mixed >> np.uint64(27)) * _MIX[4]
        return mixed ^ mixed >> np.uint64(31)

    def merged_rows(self, chunks: list[str], key: int | np.ndarray, made: list | None = None, without: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many chunks whose spaces are marks, one behind the other, and how many each has; with one key or one for each.

        Each round settles the best candidate of every chunk's agenda. With a list for ``made`` no merges are
        skipped but those of ``without`` (numbers of merges, one for each chunk), and the list gets the chunk and the
        number of all merges, round by round.
        """
        key = np.broadcast_to(np.asarray(key, dtype=np.uint64), len(chunks))
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int32)
        symbol = np.where(self.of_char[chars] >= 0, self.of_char[chars], -1 - chars)  # unknown characters are negative
        owner = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes)
        place = np.arange(len(symbol), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        piece, rank = self._pairs(symbol, np.r_[symbol[1:], symbol[:1]])
        rank[np.r_[owner[1:] != owner[:-1], True]] = _LAST
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            counts = np.diff(np.r_[starts, len(symbol)])
            best = np.minimum.reduceat(rank, starts)
            ended = np.repeat(best == _LAST, counts)
            if ended.any():
                done.append((owner[ended], symbol[ended]))
                symbol, owner, place, piece, rank = (x[~ended] for x in (symbol, owner, place, piece, rank))
                best, counts = best[best != _LAST], counts[best != _LAST]
            at = np.nonzero(rank == np.repeat(best, counts))[0]
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]][: len(at)]]  # the leftmost of each chunk
            if made is not None:
                named, drop = self._named(piece[at], place[at], self.length[symbol[at]]), np.zeros(len(at), dtype=bool)
                for w in without:
                    drop |= w[owner[at]] == named
                rank[at[drop]] = _LAST
                at = at[~drop]
                made.append((owner[at], named[~drop]))
            elif self.limit:
                drop = self.skipped(key[owner[at]], piece[at], place[at], self.length[symbol[at]])
                rank[at[drop]] = _LAST
                at = at[~drop]
            symbol[at] = piece[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where they are when the right parts are gone
            symbol, owner, place, piece, rank = (x[keep] for x in (symbol, owner, place, piece, rank))
            last = len(symbol) - 1
            for i in (at, at[at > 0] - 1):
                right = np.minimum(i + 1, last)
                piece[i], rank[i] = self._pairs(symbol[i], symbol[right])
                rank[i[(i == last) | (owner[i] != owner[right])]] = _LAST
        owners, symbols = (np.concatenate([d[j] for d in done] or [np.array([], np.int32)]) for j in (0, 1))
        order = np.argsort(owners, kind="stable")
        owners, symbols = owners[order], symbols[order]
        unknown = np.nonzero(symbols < 0)[0]
        if len(unknown):
            spelled = [[self.of_byte[b] for b in chr(-1 - c).encode()] for c in symbols[unknown].tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[unknown] = list(map(len, spelled))
            bytes_at = np.repeat(symbols < 0, times)
            owners, symbols = np.repeat(owners, times), np.repeat(symbols, times)
            symbols[bytes_at] = list(chain.from_iterable(spelled))
        return symbols.astype("<u4"), np.bincount(owners, minlength=len(chunks))

    def merged_together(self, chunks: list[str], key: int | np.ndarray) -> list[bytes]:
        """The ids of many chunks, each as 32-bit values."""
        flat, sizes = self.merged_rows(chunks, key)
        return [part.tobytes() for part in np.split(flat, np.cumsum(sizes)[:-1])]

    def _spelled(self, symbols: list[int | str]) -> bytes:
        """Ids of pieces by number; characters that are no piece in bytes."""
        found = array("I")
        for s in symbols:
            found.extend([s] if isinstance(s, int) else [self.of_byte[b] for b in s.encode()])
        return found.tobytes()

    def merged(self, chunk: str, key: int) -> list[str]:
        """The pieces of one chunk of any length and any characters, with a heap and links."""
        symbols: list[str | None] = list(chunk)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (r, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # a part has gone into another piece
            if self.limit and self.skipped(key, *(np.array([x]) for x in (self.number[left + right], i, len(left))))[0]:
                continue
            symbols[i], symbols[j], after[i] = left + right, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def ids(self, chunk: str, key: int) -> bytes:
        """The ids of a chunk of source text as 32-bit values."""
        found: list[int | str] = []
        for i, part in enumerate(chunk.split(MARK)):
            found += [MARK] * (i > 0)
            own = key + i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF  # equal parts are drawn each for itself
            found += [self.number.get(p, p) for p in self.merged(part.replace(" ", MARK), own)] if part else []
        return self._spelled(found)

    def encoder(self) -> Callable[[list[str], list[int]], list[np.ndarray]]:
        """Encodes texts, each with the number of its document."""
        paths = Paths(self)

        def some(chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if len(paths.chunks) > CACHE_PATHS:
                paths.clear()
            at = paths.of_chunks(chunks)
            if self.limit:
                at = paths.drawn(at, keys)
            known = np.nonzero(at >= 0)[0]
            places, sizes = paths.ids.places(at[known])
            flat = paths.ids.flat[places]
            if len(known) == len(chunks):
                return flat, sizes
            alone = np.nonzero(at < 0)[0]  # long or with a literal mark
            own = [np.frombuffer(self.ids(chunks[k], int(keys[k])), "<u4") for k in alone.tolist()]
            counts = np.zeros(len(chunks), np.int64)
            counts[known], counts[alone] = sizes, list(map(len, own))
            every = np.empty(counts.sum(), np.uint32)
            of_known = np.repeat(at >= 0, counts)
            every[of_known], every[~of_known] = flat, np.concatenate(own)
            return every, counts

        def encode(texts: list[str], documents: list[int]) -> list[np.ndarray]:
            cuts = [self.cut.findall(" " + t) if t else [] for t in texts]
            counts = list(map(len, cuts))
            chunks, keys = list(chain.from_iterable(cuts)), self.keys(documents, counts)
            parts = [some(chunks[k : k + AT_ONCE], keys[k : k + AT_ONCE]) for k in range(0, len(chunks), AT_ONCE)]
            flat = np.concatenate([p[0] for p in parts] or [np.array([], np.uint32)])
            ends = np.r_[0, np.cumsum(np.concatenate([p[1] for p in parts] or [np.array([], np.int64)]))]
            last = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            return [flat[ends[i] : ends[j]] for i, j in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]

        return encode

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist()))[1:].decode("utf-8")


def _numbered(docs: DataFrame, variants: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, variant`` and ``document``, the number that tells documents apart in the draw."""
    texts = id_and_text(docs, id_col, text_col)
    variant = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(variants))
    return texts.withColumns({"variant": variant, "document": F.xxhash64("doc_id", "text")})


def _in_process(model_path: str, dropout: float, seed: int) -> tuple[MergeModel, Callable[[list[str], list[int]], list[np.ndarray]]]:
    """The model and its encoder, whose caches outlast the task."""

    def make():
        model = MergeModel(model_path, dropout, seed)
        return model, model.encoder()

    return per_process("merges", model_path, (dropout, seed), make)


def encoded(docs: DataFrame, model_path: str, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, variant, ids`` (an array of ids) for every row."""
    texts = _numbered(docs, variants, seed, id_col, text_col)

    def begin():
        _, encode = _in_process(model_path, dropout, seed)
        return lambda texts, documents: {"ids": encode(texts, documents)}

    return per_row(texts, begin, "ids array<int>", "text", "document")


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``ids`` decoded to ``text``."""
    others = [c for c in rows.columns if c != ids_col]

    def begin():
        model = MergeModel(model_path)

        return lambda texts, ids: {"text": [model.decode(np.asarray(i or [], "u4")) for i in ids]}

    held = rows.select(*others, F.col(ids_col).alias("__ids"), F.lit("").alias("__none"))
    return per_row(held, begin, "text string", "__none", "__ids")


def round_trips(docs: DataFrame, model_path: str, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, variant, n_pieces, ids_crc32, text_sha256, lossless``.

    ``text_sha256`` is that of the decoded text.
    """
    texts = _numbered(docs, variants, seed, id_col, text_col)

    def begin():
        import hashlib

        model, encode = _in_process(model_path, dropout, seed)

        def work(texts: list[str], documents: list[int]) -> dict:
            made = {"n_pieces": [], "ids_crc32": [], "text_sha256": [], "lossless": []}
            for text, ids in zip(texts, encode(texts, documents), strict=True):
                back = model.decode(ids)
                made["n_pieces"].append(len(ids))
                made["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                made["text_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                made["lossless"].append(back == text)
            return made

        return work

    return per_row(texts, begin, "n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean", "text", "document")
