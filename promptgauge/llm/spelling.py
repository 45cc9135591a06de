"""Spelling variants: words one edit apart, grouped under the far more frequent spelling.

Words are counted with column expressions. The counted vocabulary is then composed with itself: the minimised acceptor
of the words, a transducer that changes exactly one symbol, and the acceptor again. The accepted pairs are the pairs of
words one edit apart. Up to the edit both acceptors read the same symbols and are in the same state; after it they read
the same rest, so the pairs are listed by following the acceptor, and at each state meeting the languages behind
two of its symbols (replaced) or behind one symbol and the state itself (inserted or deleted). Minimised states
are shared by many words, and what is behind two states is worked out once.

The composition is partitioned by where it starts. A pair whose first ``PREFIX`` symbols agree is found from the state
behind these symbols; all other pairs have their edit there, so the last ``SUFFIX`` symbols agree, and they are found from
the state behind these in the acceptor of the reversed words. Start states are dealt to tasks of about ``TOGETHER``
words. A start state with more than ``MOST`` words is cut into blocks of words by hash, and every pair of blocks is
composed, so a task stays bounded and no pair is lost. Every pair is found exactly once.

A word's form is its most frequent near word, ties to the smallest, if that is at least ``RATIO`` times as frequent. Counts at
least double along forms, so they end; the last one, the root, is found by doubling steps, each written.

Defined results: null text has no words, a null id is spelled as the empty string in the draw of mistyped
runs. Repeated rows count as often as they occur. Words compare by code points; only A-Z are lower-cased. An empty table,
or one without frequent words, gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.llm.columns import ascii_lower, id_and_text
from promptgauge.session import spread, written

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST = 5
LEAST = 3
RATIO = 2
MISTYPED = 97
PREFIX, SUFFIX = 2, 3
TOGETHER = 20_000
MOST = 60_000


def mistyped(run: Column, doc_id: Column, one_in: int = MISTYPED) -> Column:
    """The run, less one symbol in about ``one_in`` cases, by a hash of document and run."""
    drawn = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = F.pmod(drawn, F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(F.pmod(drawn, F.lit(one_in)) == 0, less).otherwise(run)


def counted_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, one_in: int = MISTYPED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of every word with enough symbols and occurrences, over all texts."""
    texts = id_and_text(docs, id_col, text_col)
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower("text"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.filter(F.length("run") >= shortest).select(mistyped(F.col("run"), F.col("doc_id"), one_in).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """The minimised acceptor of a set of words: states with equal languages behind them are one state.

    ``arcs[s]`` are the symbols and states behind state ``s``, ``ends[s]`` whether a word ends there, ``lengths[s]`` the
    lengths of what is behind it as bits, ``many[s]`` whether that is more than one word.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.ends: list[bool] = []
        self.lengths: list[int] = []
        self.many: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._tails: dict[str, int] = {"": self._state(True, {})}
        self._common: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        words = sorted(set(words))
        self.start = self._built(words, 0, len(words), 0) if words else self._state(False, {})

    def _state(self, end: bool, arcs: dict[str, int]) -> int:
        name = (end, *arcs.items())
        found = self._known.get(name)
        if found is None:
            found = self._known[name] = len(self.arcs)
            self.arcs.append(arcs)
            self.ends.append(end)
            lengths = int(end)
            for s in arcs.values():
                lengths |= self.lengths[s] << 1
            self.lengths.append(lengths)
            self.many.append(end + len(arcs) > 1 or any(self.many[s] for s in arcs.values()))
        return found

    def _tail(self, rest: str) -> int:
        """The state behind which there is just one word."""
        at = next(i for i in range(len(rest) + 1) if rest[i:] in self._tails)
        found = self._tails[rest[at:]]
        for i in range(at - 1, -1, -1):
            found = self._tails[rest[i:]] = self._state(False, {rest[i]: found})
        return found

    def _built(self, words: list[str], low: int, high: int, depth: int) -> int:
        """The state of the sorted words from ``low`` to ``high``, which agree in ``depth`` symbols."""
        if high - low == 1:
            return self._tail(words[low][depth:])
        shared = depth  # symbols that all of them agree in make a chain
        first, last = words[low], words[high - 1]
        while shared < len(first) and first[shared] == last[shared]:
            shared += 1
        end = len(first) == shared
        arcs, i = {}, low + end
        while i < high:
            symbol, j = words[i][shared], i + 1
            while j < high and words[j][shared] == symbol:
                j += 1
            arcs[symbol] = self._built(words, i, j, shared + 1)
            i = j
        found = self._state(end, arcs)
        for symbol in reversed(first[depth:shared]):
            found = self._state(False, {symbol: found})
        return found

    def common(self, a: int, b: int) -> list[str]:
        """What is behind both states."""
        if not self.lengths[a] & self.lengths[b]:
            return []
        if a > b:
            a, b = b, a
        found = self._common.get((a, b))
        if found is None:
            found = [""] if self.ends[a] and self.ends[b] else []
            other = self.arcs[b]
            for symbol, s in self.arcs[a].items():
                t = other.get(symbol)
                if t is not None:
                    found += [symbol + rest for rest in self.common(s, t)]
            self._common[a, b] = found
        return found

    def edits(self, state: int, near_end: int | None) -> list[tuple[str, str]]:
        """Pairs of what is behind the state that are one edit apart and differ at once, with at most ``near_end`` symbols behind the edit."""
        found = self._edits.get(state)
        if found is None:
            found, arcs = [], list(self.arcs[state].items())
            short = -1 if near_end is None else (2 << near_end) - 1
            for i, (x, s) in enumerate(arcs):
                if self.lengths[s] & short:
                    found += [(x + r, y + r) for y, t in arcs[i + 1 :] if self.lengths[s] & self.lengths[t] & short for r in self.common(s, t)]
                    found += [(x + r, r) for r in self.common(s, state) if r[:1] != x]
            if near_end is not None:
                found = [(a, b) for a, b in found if len(a) <= near_end + 1]
            self._edits[state] = found
        return found

    def near(self, from_depth: int, near_end: int | None = None) -> list[tuple[str, str]]:
        """The accepted pairs: words that agree in ``from_depth`` symbols and are one edit apart behind them."""
        found, open_ = [], [("", self.start)]
        while open_:
            path, state = open_.pop()
            if self.many[state]:
                if len(path) >= from_depth:
                    found += [(path + a, path + b) for a, b in self.edits(state, near_end)]
                open_ += [(path + symbol, s) for symbol, s in self.arcs[state].items()]
        return found


def _pairs(side: str, words: list[str]) -> list[tuple[str, str]]:
    """The near pairs among the words of one partition of the composition."""
    if side == "prefix":
        return Acceptor(words).near(PREFIX)
    turned = Acceptor([w[::-1] for w in words]).near(SUFFIX, PREFIX - 1)
    return [(a[::-1], b[::-1]) for a, b in turned if a[: -PREFIX - 1 : -1] != b[: -PREFIX - 1 : -1]]


def near_words(vocabulary: DataFrame, together: int = TOGETHER, most: int = MOST) -> DataFrame:
    """``word, n, near, near_n``: every pair of one edit, once in each direction. ``vocabulary`` has ``word, n``, words of at least five symbols."""
    sides = F.array(
        F.struct(F.lit("prefix").alias("side"), F.substr("word", F.lit(1), F.lit(PREFIX)).alias("key")),
        F.struct(F.lit("suffix").alias("side"), F.substr("word", F.lit(-SUFFIX), F.lit(SUFFIX)).alias("key")),
    )
    entered = vocabulary.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.key")
    sizes = written(entered.groupBy("side", "key").agg(F.count("*").alias("n_words")), "start-states")
    tasks = max(1, -(-(sizes.agg(F.sum("n_words")).first()[0] or 0) // together))
    crowded = sizes.filter(F.col("n_words") > most).select("side", "key", F.ceil(F.col("n_words") / F.lit(most / 2)).cast("int").alias("blocks"))
    blocked = entered.join(crowded, ["side", "key"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("a"), F.greatest(b, own).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    dealt = blocked.select("side", "key", "word", "n", F.coalesce(own, F.lit(0)).alias("block"), F.explode(F.coalesce(met, alone)).alias("met"), "blocks").select(
        "side", "word", "n", "block", (F.col("met.a") != F.col("met.b")).alias("crossed"),
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws("/", "key", "met.a", "met.b")).alias("part"),
    )

    def compose(key: tuple, rows: pa.Table) -> pa.Table:
        counts = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
        found = _pairs(key[0].as_py(), list(counts))
        if key[2].as_py():  # two blocks: pairs inside a block are found where it meets itself
            block = dict(zip(rows["word"].to_pylist(), rows["block"].to_pylist(), strict=True))
            found = [(a, b) for a, b in found if block[a] != block[b]]
        left, right = [a for a, _ in found] + [b for _, b in found], [b for _, b in found] + [a for a, _ in found]
        counted = [[counts[w] for w in side] for side in (left, right)]
        return pa.table({"word": pa.array(left, pa.string()), "n": pa.array(counted[0], pa.int64()), "near": pa.array(right, pa.string()), "near_n": pa.array(counted[1], pa.int64())})

    # light in bytes and heavy in work: a number of tasks that adaptive execution doesn't fold together
    return dealt.repartition(2 * tasks, "side", "part", "crossed").groupBy("side", "part", "crossed").applyInArrow(compose, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word that has a form; ``forms`` has ``word, form``. Each round doubles the steps taken."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        reached = moved.select("word", "root")
        if moved.filter("further IS NOT NULL").isEmpty():
            return reached


def spelling_forms(
    docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, one_in: int = MISTYPED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    if shortest < PREFIX + SUFFIX:
        raise ValueError(f"words need at least {PREFIX + SUFFIX} symbols")
    vocabulary = written(counted_words(docs, shortest, least, one_in, id_col, text_col), "vocabulary")
    near = near_words(spread(vocabulary, "word"))
    # the smallest of (-count, word) is the most frequent near word, ties to the smallest
    per_word = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form"))).alias("best"))
    settled = vocabulary.join(per_word, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")
    chosen = -F.col("best.minus_n") >= ratio * F.col("n")
    formed = written(settled.select("word", F.when(chosen, F.col("best.form")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.minus_n")).alias("form_n")), "forms")
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
