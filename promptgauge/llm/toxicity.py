"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the word, of its first letters (so that unseen forms of a known
stem are not unknown) and its last letters. Filters of several widths slide over the words, the largest
response of each filter over the whole text goes to a logistic output. The fit uses every labelled row that is not held
out, and whole texts: rows are dealt to shards of a bounded number of characters, each shard trains a copy of the
model on all its rows, and the copies are averaged, in a few rounds. Scoring runs over every row in bounded batches.

A fifth of these rows is held back and sets, all of it, a threshold per language. The language is told from the
function words of the text itself, so no column but the text is an input of a score. Raw outputs are stretched
so that the threshold of each language falls on ``CUT``: a score of at least ``CUT`` means toxic in every language.

Convolution by table: for the distinct words of a batch the product with each filter slice is computed
once, and a position's response is a sum of looked-up rows.

Defined results: null and empty texts have no words and get the score of an empty text. A row with a null id
or label is not learnt from; a document with several labels counts as toxic if one says so. Without
toxic or without harmless rows to learn from all scores are 0. Repeated rows get equal scores.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.llm.batches import per_row, per_text, sliced
from promptgauge.llm.columns import id_and_text, same_columns
from promptgauge.session import written

CUT = 0.3
WIDTHS = (1, 2, 3)
FILTERS = 12
DIMS = 16
BUCKETS = 1 << 15
LONGEST_FIT = 1_000_000
SHARD_CHARS = 32_000_000  # characters that one task learns from
ROUNDS = 2  # times that the models of the shards are brought together
PIECE = 1 << 16
GRID = 64  # steps of a logit
FIT_SLICE = 2_000_000
STEPS, BATCH, RATE = 800, 24, 0.01
SEED = 11
_WORD = re.compile(r"\w+")
#: Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for with be this are not have from or at by".split(),
    "de": "der die und das den von zu mit ist nicht ein eine auf für sich dem des im auch als".split(),
    "fr": "le la les et des une du dans qui est pour pas sur au avec ce il sont plus par".split(),
    "es": "el los las y que en del se por con una para no su como más lo pero sus al".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _buckets(word: str) -> list[int]:
    return [zlib.crc32(f"{kind}{part}".encode()) % BUCKETS for kind, part in (("w", word), ("a", word[:4]), ("b", word[:6]), ("z", word[-4:]))]


class Texts:
    """Words of some texts as numbers of distinct words, the texts end to end."""

    words: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    votes: np.ndarray

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        parts = []
        for text in texts:  # one at a time: numbers take far less room than words
            words = _WORD.findall(text.lower())
            parts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
        self.words = np.concatenate([*parts, np.array([], np.int32)])
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buckets = np.fromiter((b for w in number for b in _buckets(w)), np.int32, 4 * len(number)).reshape(-1, 4)
        votes = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words}
        self.votes = np.array([votes.get(w, -1) for w in number], dtype=np.int64)

    def take(self, rows: np.ndarray) -> Texts:
        """Some of the texts, in the order asked for, with just their distinct words."""
        part = object.__new__(Texts)
        part.sizes = self.sizes[rows]
        part.starts = np.cumsum(part.sizes) - part.sizes
        words = [self.words[self.starts[i] : self.starts[i] + self.sizes[i]] for i in rows]
        met, part.words = np.unique(np.concatenate([*words, self.words[:0]]), return_inverse=True)
        part.buckets, part.votes = self.buckets[met], self.votes[met]
        return part

    def languages(self) -> np.ndarray:
        """The language each text has most function words of; the last number where it has none."""
        owner, vote = np.repeat(np.arange(len(self.sizes)), self.sizes), self.votes[self.words]
        n = len(FUNCTION_WORDS)
        counts = np.bincount(owner[vote >= 0] * n + vote[vote >= 0], minlength=len(self.sizes) * n).reshape(-1, n)
        return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1) if len(counts) else 0, n)


class Model:
    """Weights by name; ``thresholds`` by language."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.weights = {"embedding": rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.weights["prior"] = np.zeros(1, np.float32)
        self.thresholds = np.full(len(LANGUAGES), 0.5)

    def vectors(self, t: Texts) -> np.ndarray:
        """The vector of each distinct word."""
        return self.weights["embedding"][t.buckets].sum(axis=1)

    def responses(self, t: Texts, vectors: np.ndarray, width: int) -> np.ndarray:
        """By position: the filters' response to the words from there on. A window that leaves its text sees nothing there."""
        kernel = self.weights[f"filter{width}"]
        got = np.take(vectors @ kernel[0] + self.weights[f"bias{width}"], t.words, axis=0)
        for j in range(1, width):
            more = np.take(vectors @ kernel[j], t.words[j:], axis=0)
            # the last j positions of each text have no word j places on
            for back in range(1, j + 1):
                ends = (t.starts + t.sizes - back)[t.sizes >= back]
                more[ends[ends < len(more)]] = 0
            got[: len(more)] += more
        return got

    def pooled(self, t: Texts) -> np.ndarray:
        """By text the largest response of each filter, at least 0."""
        vectors, best = self.vectors(t), np.zeros((len(t.sizes), FILTERS * len(WIDTHS)), np.float32)
        full = np.nonzero(t.sizes)[0]
        if len(full):
            for i, width in enumerate(WIDTHS):
                got = self.responses(t, vectors, width)
                for k in full:
                    best[k, i * FILTERS : (i + 1) * FILTERS] = got[t.starts[k] : t.starts[k] + t.sizes[k]].max(axis=0)
        return np.maximum(best, 0)

    def placed(self, t: Texts, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`pooled`, with the position of each largest response, -1 where it is not above 0."""
        shape = len(t.sizes), FILTERS * len(WIDTHS)
        best, place = np.zeros(shape, np.float32), np.full(shape, -1)
        for i, width in enumerate(WIDTHS):
            got, here = self.responses(t, vectors, width), slice(i * FILTERS, (i + 1) * FILTERS)
            for k in np.nonzero(t.sizes)[0]:
                part = got[t.starts[k] : t.starts[k] + t.sizes[k]]
                at = part.argmax(axis=0)
                best[k, here], place[k, here] = part[at, np.arange(FILTERS)], at + t.starts[k]
        return np.maximum(best, 0), np.where(best > 0, place, -1)

    def raw(self, t: Texts) -> np.ndarray:
        z = self.pooled(t) @ self.weights["out"] + self.weights["prior"]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1, stretched so that the language's threshold is ``CUT``."""
        t = Texts(texts)
        p, limit = self.raw(t), self.thresholds[t.languages()]
        return np.clip(np.where(p >= limit, CUT + (1 - CUT) * (p - limit) / np.maximum(1 - limit, 1e-9), np.minimum(CUT * p / limit, np.nextafter(CUT, 0))), 0, 1)

    def gradients(self, t: Texts, toxic: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """By weight; that of the embedding has rows for the distinct words only, and their buckets come along."""
        vectors = self.vectors(t)
        best, place = self.placed(t, vectors)
        p = 1 / (1 + np.exp(-(best @ self.weights["out"] + self.weights["prior"])))
        error = ((p - toxic) * weight / len(toxic)).astype(np.float32)
        found = {"out": best.T @ error, "prior": error.sum(keepdims=True)}
        back = error[:, None] * self.weights["out"][None, :] * (place >= 0)
        of_words = np.zeros_like(vectors)
        ends = t.starts + t.sizes
        for i, width in enumerate(WIDTHS):
            here = slice(i * FILTERS, (i + 1) * FILTERS)
            text, f = np.nonzero(place[:, here] >= 0)
            at, g = place[:, here][text, f], back[:, here][text, f]
            kernel = self.weights[f"filter{width}"]
            d_kernel = np.zeros_like(kernel)
            for j in range(width):
                ok = at + j < ends[text]
                words = t.words[at[ok] + j]
                np.add.at(d_kernel[j].T, f[ok], g[ok, None] * vectors[words])
                np.add.at(of_words, words, g[ok, None] * kernel[j].T[f[ok]])
            found[f"filter{width}"] = d_kernel
            found[f"bias{width}"] = np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32)
        found["embedding"] = of_words
        return found, t.buckets


def _summed(model: Model, every: Texts, rows: np.ndarray, toxic: np.ndarray, most_words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """As :meth:`Model.gradients` of the rows, worked on in parts of about ``most_words`` words."""
    total, tables, buckets, start = {}, [], [], 0
    ends = np.cumsum(every.sizes[rows])
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_words, "right")))
        part = rows[start:stop]
        found, at = model.gradients(every.take(part), toxic[part].astype(np.float32), np.full(len(part), len(part) / len(rows), np.float32))
        tables.append(found.pop("embedding"))
        buckets.append(at)
        for name, g in found.items():
            total[name] = total[name] + g if name in total else g
        start = stop
    return total | {"embedding": np.concatenate(tables)}, np.concatenate(buckets)


def _passed(rng: np.random.Generator, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: whole passes in random order, so that every row comes up before one comes again."""
    return np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]


def trained(model: Model, texts: list[str], toxic: np.ndarray, steps: int, seed: int, most_words: int) -> None:
    """Adam on the texts of a shard: ``steps`` steps, or as many as one pass over all of them takes."""
    rng, every = np.random.default_rng(seed), Texts(texts)
    both = [g for g in (np.nonzero(toxic == 1)[0], np.nonzero(toxic == 0)[0]) if len(g)]
    half = BATCH // len(both)
    steps = max(steps, -(-max(map(len, both)) // half))
    drawn = np.concatenate([_passed(rng, g, steps * half).reshape(steps, half) for g in both], axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    for step, rows in enumerate(drawn, 1):
        found, buckets = _summed(model, every, rows, toxic, most_words)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in found.items():
            m, v = moments[name]
            if name == "embedding":
                # only the rows met in this step move
                met = np.nonzero(np.any(g, axis=1))[0]
                rows_met, inverse = np.unique(buckets[met].ravel(), return_inverse=True)
                g_rows = np.zeros((len(rows_met), DIMS), np.float32)
                np.add.at(g_rows, inverse, np.repeat(g[met], buckets.shape[1], axis=0))
                at, g = rows_met, g_rows
            else:
                at = slice(None)
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            model.weights[name][at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)


def _round(rows: DataFrame, model: Model, steps: int, seed: int, most_words: int) -> Model:
    """Every shard trains a copy of ``model``; the mean of the copies, weighted by rows. Copies are added up in pieces by Spark."""
    shapes = [(name, w.shape) for name, w in model.weights.items()]
    flat = np.concatenate([w.ravel() for w in model.weights.values()]).astype(np.float32)
    sent = rows.sparkSession.sparkContext.broadcast(flat)

    def loaded(values: np.ndarray) -> Model:
        made, start = Model(SEED), 0
        for name, shape in shapes:
            size = int(np.prod(shape))
            made.weights[name] = values[start : start + size].reshape(shape).copy()
            start += size
        return made

    def train(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id")
        copy = loaded(sent.value)
        trained(copy, shard["text"].to_pylist(), shard["toxic"].to_numpy().astype(np.int64), steps, seed + shard["shard"][0].as_py(), most_words)
        values = np.concatenate([w.ravel() for w in copy.weights.values()]).astype(np.float32)
        pieces = [values[i : i + PIECE].tobytes() for i in range(0, len(values), PIECE)]
        return pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "shard": pa.array([shard["shard"][0].as_py()] * len(pieces), pa.int32()), "n": [shard.num_rows] * len(pieces), "weights": pieces})

    def mean(copies: pa.Table) -> pa.Table:
        copies = copies.sort_by("shard")
        n = copies["n"].to_numpy()
        total = sum(k * np.frombuffer(w, np.float32).astype(float) for k, w in zip(n, copies["weights"].to_pylist(), strict=True))
        return pa.table({"piece": copies["piece"][:1], "weights": [(total / n.sum()).astype(np.float32).tobytes()]})

    copies = written(rows.select("shard", "doc_id", "text", "toxic").groupBy("shard").applyInArrow(train, "piece int, shard int, n long, weights binary"), "weights")
    pieces = copies.groupBy("piece").applyInArrow(mean, "piece int, weights binary").orderBy("piece").collect()
    return loaded(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in pieces]))


def _thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """By language the threshold with the best F1 over all of ``rows``; a language with few toxic rows takes that of all.

    Raw outputs are counted on a grid of logits, so that the counts of any table are a few thousand numbers.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic")
            for part in sliced(texts, FIT_SLICE):
                t = Texts(texts[part])
                p = np.clip(model.raw(t), 1e-6, 1 - 1e-6)
                cell = np.floor(np.log(p / (1 - p)) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(t.languages().astype(np.int32)), pa.array(cell), toxic[part.start : part.stop].cast(pa.int32())], names=["lang", "cell", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(score, "lang int, cell int, toxic int").groupBy("lang", "cell", "toxic").agg(F.count("*").alias("n")).collect()
    low = min((r["cell"] for r in counted), default=0)
    table = np.zeros((len(LANGUAGES), max((r["cell"] for r in counted), default=0) - low + 1, 2))
    for r in counted:
        table[r["lang"], r["cell"] - low, r["toxic"]] += r["n"]

    def best(cells: np.ndarray) -> float:
        met = np.nonzero(cells.sum(axis=1))[0][::-1]
        hit, miss = np.cumsum(cells[met, 1]), np.cumsum(cells[met, 0])
        at = int(np.argmax(2 * hit / (hit + miss + cells[:, 1].sum())))
        # between the lowest cell taken in and the next below it
        z = (met[at] + met[at + 1] + 1) / 2 if at + 1 < len(met) else met[at] - GRID
        return float(np.clip(1 / (1 + np.exp(-(z + low) / GRID)), 1e-6, 1 - 1e-6))

    overall = best(table.sum(axis=0)) if table[:, :, 1].sum() else 0.5
    return np.array([best(t) if t[:, 1].sum() >= 10 else overall for t in table])


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row's label is kept away from the fit; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, longest_fit: int = LONGEST_FIT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = SEED, shard_chars: int = SHARD_CHARS, rounds: int = ROUNDS) -> Model | None:
    """Fit on the whole texts of all labelled rows that are not held out; None without both classes.

    Of each class four fifths, by a hash of the id, are learnt from and the rest sets the thresholds. ``longest_fit``: characters
    worked on at once in a step, but for a text that is longer.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = id_and_text(docs, id_col, text_col).join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    calibrates = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(5)) == 0
    rows = written(texts.withColumn("calibrates", calibrates), "labelled")
    learnt = rows.filter(~F.col("calibrates"))
    counts = learnt.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum(F.length("text")).alias("chars")).first()
    if not counts["n"] or not 0 < counts["toxic"] < counts["n"]:
        return None
    shards = max(1, -(-counts["chars"] // shard_chars))
    learnt = learnt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(shards)).cast("int"))
    model, rounds = Model(seed), rounds if shards > 1 else 1
    for i in range(rounds):
        model = _round(learnt, model, -(-STEPS // rounds), seed + 1000 * i, max(1, longest_fit // 5))
    model.thresholds = _thresholds(rows.filter("calibrates"), model)
    return model


def toxicity_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""

    def begin():
        return lambda texts: {"score": model.scores(texts) if model else np.zeros(len(texts))}

    return per_text(id_and_text(docs, id_col, text_col), begin, "score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = toxicity_scores(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not scored toxic, all columns unchanged. Rows stay where they are: no shuffle."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    def begin():
        return lambda texts: {"__score": model.scores(texts) if model else np.zeros(len(texts))}

    scored = per_row(docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))), begin, "__score double", "__text")
    return same_columns(scored.filter(F.col("__score") < CUT), docs)
