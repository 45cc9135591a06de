"""A JSON array of any size, read by many tasks.

Spark's text reader cuts the file at closing braces, so that any file system and any split size will do. Whether a
piece starts inside a string, and how deep, follows from the pieces before it: every piece is summed up for both
cases, and a running sum over the pieces of a file settles which case holds. With that each piece finds the commas
between the elements of the outer array. Elements that go over the end of a piece are put together by their number.

Defined results: elements of any JSON type; white space between them, and arrays in several files, are fine. An
element that isn't valid under the schema becomes a row of nulls, as with Spark's own reader. Text before or after
the array is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from promptgauge.session import written

PIECE = 256 << 10  # characters of a piece: a row of the written table
CUT = "}"
_ESCAPED = re.compile(r'\\.', re.DOTALL)
_MARKS = re.compile(r'[\[\]{},]')
_SUMMED = "file string, start long, piece long, text string, quotes long, deeper_out long, deeper_in long"


def _plain(text: str) -> str:
    """The text with what is escaped blotted out, places kept."""
    return _ESCAPED.sub("__", text) if "\\" in text else text


def _outside(text: str, in_string: bool) -> Iterator[tuple[int, str]]:
    """Places and texts of the stretches outside strings."""
    at = 0
    for i, stretch in enumerate(_plain(text).split('"')):
        if (i % 2 == 1) == in_string:
            yield at, stretch
        at += len(stretch) + 1


def _deeper(stretches: Iterator[tuple[int, str]]) -> int:
    return sum(s.count("{") + s.count("[") - s.count("}") - s.count("]") for _, s in stretches)


def _pieces(spark: SparkSession, path: str | list[str], piece: int) -> DataFrame:
    """The pieces of all files, each summed up for a start outside and inside a string."""
    lines = spark.read.option("lineSep", CUT).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come in the order of the file; a piece ends with a cutting mark, which the reader took away."""
        held, chars, place, number = [], 0, None, 0

        def done() -> pa.RecordBatch:
            text = "".join(x for value in held for x in (value, CUT))
            row = (*place, number, text, _plain(text).count('"'), _deeper(_outside(text, False)), _deeper(_outside(text, True)))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "start", "piece", "text", "quotes", "deeper_out", "deeper_in"])

        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
                if held and ((file, start) != place or chars >= piece):
                    yield done()
                    number = number + 1 if (file, start) == place else 0
                    held, chars = [], 0
                place = (file, start)
                held.append(value)
                chars += len(value) + 1
        if held:
            yield done()

    return written(lines.mapInArrow(cut, _SUMMED), "json-pieces")


def _elements(text: str, in_string: bool, depth: int) -> list[tuple[str | None, str]]:
    """The texts between the bounds of elements (the outer brackets, and the commas between them), each with the bound before it."""
    found, last, before = [], 0, None
    for at, stretch in _outside(text, in_string):
        for mark in _MARKS.finditer(stretch):
            place, sign = at + mark.start(), mark.group()
            if sign in "[{":
                depth += 1
                bound = sign == "[" and depth == 1
            elif sign in "]}" and depth:
                depth -= 1
                bound = depth == 0
            elif sign == CUT and not text[place + 1 :].strip():  # the mark that was added at the end of the file
                return [*found, (before, text[last:place])]
            else:
                bound = depth == 1
            if bound:
                found.append((before, text[last:place]))
                last, before = place + 1, sign
    return [*found, (before, text[last:])]


def json_array_texts(spark: SparkSession, path: str | list[str], piece: int = PIECE) -> DataFrame:
    """``file, number, text``: every element of the arrays, numbered from 1 in each file."""
    pieces = _pieces(spark, path, piece)
    before = W.partitionBy("file").orderBy("start", "piece").rowsBetween(W.unboundedPreceding, -1)
    summed = pieces.drop("text")
    opened = summed.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("in_string"), F.col("deeper_in")).otherwise(F.col("deeper_out"))
    states = opened.withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0))).select("file", "start", "piece", "in_string", "depth")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece", "text", "in_string", "depth")), strict=True)
            for file, start, number, text, in_string, depth in rows:
                signs, texts = zip(*_elements(text, in_string, depth), strict=True)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array([start] * n), pa.array([number] * n), pa.array(range(n), pa.int64()), pa.array([n - 1] * n, pa.int64()),
                     pa.array(signs, pa.string()), pa.array(texts, pa.string()), pa.array([k in (0, n - 1) for k in range(n)])],
                    names=["file", "start", "piece", "place", "bounds", "sign", "text", "at_end"],
                )

    fields = "file string, start long, piece long, place long, bounds long, sign string, text string, at_end boolean"
    parts = written(pieces.join(states, ["file", "start", "piece"]).mapInArrow(split, fields), "json-elements")
    # an element's number is the number of bounds before it
    counts = parts.filter("place = 0").select("file", "start", "piece", F.coalesce(F.sum("bounds").over(before), F.lit(0)).alias("earlier"))
    numbered = parts.join(counts, ["file", "start", "piece"]).withColumn("number", F.col("earlier") + F.col("place"))
    whole = numbered.filter(~F.col("at_end")).select("file", "number", "sign", "text")
    in_order = F.array_sort(F.collect_list(F.struct("start", "piece", "place", "text")))
    joined = numbered.filter("at_end").groupBy("file", "number").agg(F.max("sign").alias("sign"), F.array_join(F.transform(in_order, lambda p: p["text"]), "").alias("text"))
    # an opening bracket is the first bound, and before it and behind the closing one there is nothing
    blank = ~F.regexp_like("text", F.lit(r"\S"))
    odd = F.coalesce(((F.col("sign") == "[") & (F.col("number") > 1)) | (F.col("sign").isin("]", "}") & ~blank), ~blank)
    checked = F.when(odd, F.raise_error(F.lit("text outside the one JSON array of a file")).cast("boolean")).otherwise(~blank)
    return whole.unionByName(joined).filter(checked).select("file", "number", "text")


def read_json_array(spark: SparkSession, path: str | list[str], schema: str, piece: int = PIECE) -> DataFrame:
    """The elements of JSON arrays as rows of a declared schema."""
    return json_array_texts(spark, path, piece).select(F.from_json("text", schema).alias("row")).select("row.*")
