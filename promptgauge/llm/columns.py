"""Column expressions and small table helpers shared by the operators of this package."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

ASCII_LOWER = {ord(a): b for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)}


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``doc_id, text``, whatever else the table holds; null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def prefixed(df: DataFrame, prefix: str = "__") -> DataFrame:
    """All columns renamed, so that no column of a caller's table can clash."""
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
