"""Running Python over texts in bounded Arrow batches. Ids stay Arrow values, so null and very large ids come through."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

SLICE_CHARS = 8_000_000

#: Turns texts into columns by name; with ``_row`` among them, a list of the text number of each row made.
Columns = dict[str, object]


def per_process[T](kind: str, path: str, settings: tuple, make: Callable[[], T]) -> T:
    """What ``make`` makes of a file, made once in a Python worker process and used by all its tasks.

    Functions reach the workers by value, so no module of this package lives there; this one is made in each process.
    """
    held = vars(sys.modules.setdefault("promptgauge_kept", types.ModuleType("promptgauge_kept")))
    name = repr((kind, path, os.stat(path).st_mtime_ns, settings))
    if name not in held:
        for other in [k for k in held if k.startswith(f"('{kind}',")]:
            del held[other]  # one of a kind, so that memory stays bounded
        held[name] = make()
    return held[name]


def sliced(texts: list[str], most: int = SLICE_CHARS) -> Iterator[slice]:
    """Runs of texts of a bounded number of characters (a longer text is a run of its own)."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def per_text(docs: DataFrame, begin: Callable[[], Callable[[list[str]], Columns]], fields: str) -> DataFrame:
    """``doc_id`` and ``fields`` for every text of ``docs(doc_id, text)``; ``begin`` runs once per task."""
    return per_row(docs, begin, fields, "text")


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for any column names, dots included."""
    names, made = df.columns, [f.name for f in schema]
    plain = [f"c{i}" for i in range(max(len(names), len(made)))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain[: len(made)])

    out = StructType([StructField(p, f.dataType, True) for p, f in zip(plain, schema)])
    return df.toDF(*plain[: len(names)]).mapInArrow(renamed, out).toDF(*made)


def per_row(docs: DataFrame, begin: Callable[[], Callable[..., Columns]], fields: str, text_col: str, *more: str) -> DataFrame:
    """As :func:`per_text`, passing on every other column of ``docs`` in front of ``fields``.

    The columns named in ``more`` go to the function as further lists and are not passed on.
    """
    others = [c for c in docs.columns if c not in (text_col, *more)]
    added = _parse_datatype_string(fields)
    schema = StructType([docs.schema[c] for c in others] + list(added.fields))
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            rest, further = batch.select(others), [batch.column(c).to_pylist() for c in more]
            for part in sliced(texts):
                made = work(texts[part], *[f[part] for f in further])
                held = rest.slice(part.start, part.stop - part.start)
                if "_row" in made:
                    held = held.take(pa.array(made["_row"], pa.int64()))
                arrays = [pa.array(made[f.name], f.type, from_pandas=True) for f in arrow]
                yield pa.RecordBatch.from_arrays([*held.columns, *arrays], names=[*others, *arrow.names])

    return arrow_map(docs, run, schema)
