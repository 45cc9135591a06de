"""Column expressions on text: whitespace strip and edit distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PPM = 1_000_000


def strip(col: Column) -> Column:
    """Remove all leading and trailing whitespace (``trim`` takes only spaces)."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def threshold_ppm(threshold: float) -> int:
    """A threshold in millionths, so that bounds are whole-number arithmetic."""
    ppm = round(threshold * PPM)
    if not 0 < ppm < PPM:
        raise ValueError(f"threshold must lie strictly between 0 and 1, got {threshold}")
    return ppm


def max_edits(length: Column, ppm: int) -> Column:
    """Largest edit count e with ``e / length < threshold``; negative for empty text."""
    scaled = length.cast("long") * F.lit(ppm) - F.lit(1)
    return F.when(length > 0, F.call_function("div", scaled, F.lit(PPM))).otherwise(-1).cast("int")


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, 0..1; 0 for two empty texts."""
    return F.when(longest(a, b) == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest(a, b))
