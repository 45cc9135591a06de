"""Texts under the prompts of their experiments, encoded where the texts lie.

What stands before a text depends only on the experiment, the task and the kind of text (``prompt_prefixes``, a small
table). These prefixes are sent to the tasks that hold the texts, in parts of a checked size; each task joins them
to its texts in a bounded stream for the encoder. No table of texts times prompts is formed or shuffled, only vectors
leave. Texts that several experiments show alike (documents under a query prompt) are encoded once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from promptgauge.operators.runs import prompted_text, resolved_prompt
from promptgauge.session import written

SENT_BYTES = 32 << 20  # most bytes of prefixes sent to every task at once
BATCH = 256
PROMPT_TYPES = (None, "query", "document")

#: Makes the encoder of a model; the encoder turns a list of texts into one row of numbers each.
EncoderFactory = Callable[[str], Callable[[list[str]], np.ndarray]]


def prompt_prefixes(experiments: DataFrame) -> DataFrame:
    """``model, revision, task, experiment_id, is_baseline, prompt_type, prefix``: what stands before the texts of each kind.

    ``experiments`` comes from :func:`runs.effective_prompts`; a model without revisions gets an empty one. The prefix of
    a text without a prompt is empty.
    """
    template = F.col("template") if "template" in experiments.columns else F.lit(None).cast("string")
    revision = F.col("revision") if "revision" in experiments.columns else F.lit("")
    kinds = experiments.withColumn("prompt_type", F.explode(F.array(*[F.lit(k).cast("string") for k in PROMPT_TYPES])))
    prompt = resolved_prompt(F.col("effective"), F.col("task"), F.col("task_class"), F.col("prompt_type"))
    shown = prompted_text(F.lit(""), prompt, F.col("wrapper"), template)
    return kinds.select("model", revision.alias("revision"), "task", "experiment_id", "is_baseline", "prompt_type", F.coalesce(shown, F.lit("")).alias("prefix"))


def encode_experiments(texts: DataFrame, prefixes: DataFrame, factory: EncoderFactory, batch_size: int = BATCH, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Every text under every experiment of its task: the columns of ``texts`` but ``text``, then ``model, revision,
    experiment_id, is_baseline, vector``.

    ``texts`` has ``task, prompt_type, text`` and whatever is to be kept beside the vectors; null text is empty. The
    encoder of a model is made once per task that meets it and gets at most ``batch_size`` texts at a time.
    """
    held = written(prefixes.select("model", "revision", "experiment_id", "is_baseline", "task", "prompt_type", "prefix"), "prefixes")
    size = F.sum(F.octet_length("prefix") + F.octet_length("model") + F.octet_length("revision") + F.octet_length("task") + F.lit(200))
    total = held.agg(size).first()[0]
    if total is None:
        total = 0
    # parts of whole experiments, so that a text meets all kinds of prefixes of an experiment in one part
    parts = max(1, math.ceil(2 * total / sent_bytes))
    part = F.pmod(F.xxhash64("model", "revision", "task", "experiment_id"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_encoded(texts, held.filter(part == i), factory, batch_size) for i in range(parts)])


def _encoded(texts: DataFrame, prefixes: DataFrame, factory: EncoderFactory, batch_size: int) -> DataFrame:
    others = [c for c in texts.columns if c != "text"]
    added = ["model", "revision", "experiment_id", "is_baseline"]
    schema = StructType([texts.schema[c] for c in others] + [prefixes.schema[c] for c in added] + [StructField("vector", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)
    sent = texts.sparkSession.sparkContext.broadcast(prefixes.toArrow())  # bounded: a part of checked size

    def wanted() -> dict[tuple, dict[str, dict[str, list[tuple]]]]:
        """By task and kind of text: model -> prefix -> experiments."""
        found: dict[tuple, dict] = {}
        for row in sent.value.to_pylist():
            prefixed = found.setdefault((row["task"], row["prompt_type"]), {}).setdefault(row["model"], {})
            prefixed.setdefault(row["prefix"], []).append(tuple(row[c] for c in added))
        return found

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, encoders = wanted(), {}
        for batch in batches:
            kinds: dict[tuple, list[int]] = {}
            for row, kind in enumerate(zip(batch.column("task").to_pylist(), batch.column("prompt_type").to_pylist(), strict=True)):
                kinds.setdefault(kind, []).append(row)
            for kind, rows in kinds.items():
                for first in range(0, len(rows), batch_size):
                    some = batch.take(pa.array(rows[first : first + batch_size]))
                    bare, beside = [t or "" for t in some.column("text").to_pylist()], [some.column(c) for c in others]
                    for model, by_prefix in known.get(kind, {}).items():
                        if model not in encoders:
                            encoders[model] = factory(model)
                        for prefix, experiments in by_prefix.items():
                            made = np.asarray(encoders[model]([prefix + t for t in bare]), dtype=float)
                            if made.shape[:1] != (len(bare),):
                                raise ValueError(f"the encoder of {model} gave {made.shape[0]} vectors for {len(bare)} texts")
                            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(bare) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
                            for experiment in experiments:
                                named = [pa.repeat(pa.scalar(v, arrow.field(c).type), len(bare)) for c, v in zip(added, experiment, strict=True)]
                                yield pa.RecordBatch.from_arrays([*beside, *named, vectors.cast(arrow.field("vector").type)], schema=arrow)

    return texts.mapInArrow(encode, schema)
