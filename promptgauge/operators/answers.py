"""Collect, validate and retry answers of a generator."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.functions.text import strip
from promptgauge.session import written

MARKER = "assistantfinal"
BATCH = 256
IN_FLIGHT = 8
LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true"}


def generate(
    requests: DataFrame, fn: Callable[[list[str], int], list[str]], attempt: int, text_col: str = "input_prompt", batch_size: int = BATCH, in_flight: int = IN_FLIGHT
) -> DataFrame:
    """Add ``raw`` and ``attempt``: the answer of ``fn(texts, attempt)``, in order; ``""`` where the call fails.

    A call gets at most ``batch_size`` texts, and each task has at most ``in_flight`` calls open, so ``fn`` must bear
    being called by several threads; partitions times ``in_flight`` calls run in all. A batch whose call fails, or
    gives another number of answers, is halved until only the texts that fail by themselves are left.
    """

    def answered(texts: list[str]) -> list[str]:
        try:
            found = list(fn(texts, attempt))
            if len(found) == len(texts):
                return found
        except Exception:
            pass
        if len(texts) == 1:
            return [""]
        half = len(texts) // 2
        return answered(texts[:half]) + answered(texts[half:])

    def ask(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                texts = batch[text_col].tolist()
                raw: list[str] = []
                parts = (texts[i : i + batch_size] for i in range(0, len(texts), batch_size))
                open_ = deque(pool.submit(answered, part) for part in islice(parts, in_flight))
                while open_:
                    raw += open_.popleft().result()
                    open_.extend(pool.submit(answered, part) for part in islice(parts, 1))
                yield batch.assign(attempt=attempt, raw=pd.Series(raw, index=batch.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(ask, f"{fields}, attempt int, raw string")


def after_marker(raw: Column) -> Column:
    """Text between the first and second marker, stripped; all of it without a marker."""
    return F.when(raw.contains(MARKER), strip(F.split(raw, MARKER)[1])).otherwise(raw)


def tolerant_json(text: Column) -> Column:
    """VARIANT by a strict parse, then a lenient one, then one without trailing commas; null if all fail."""
    repaired = F.regexp_replace(text, r",\s*([\]}])", "$1")
    return F.coalesce(
        F.try_parse_json(text), F.from_json(text, "variant", LENIENT), F.from_json(repaired, "variant", LENIENT)
    )


def validated(answers: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ``prompts``, ``is_valid``, ``n_returned`` and ``reason`` to a table of raw answers."""
    listed = F.try_variant_get("parsed", "$.prompts", "variant")
    kind = F.schema_of_variant(listed)
    texts = F.try_variant_get("parsed", "$.prompts", "array<string>")
    reason = (
        F.when(F.col("parsed").isNull(), "not_json")
        .when(~F.schema_of_variant("parsed").startswith("OBJECT"), "not_object")
        .when(listed.isNull(), "no_prompts")
        .when(~kind.startswith("ARRAY"), "not_list")
        .when(F.size(texts) == 0, "empty")
        .when((kind != "ARRAY<STRING>") | F.exists(texts, lambda x: x.isNull()), "not_text")
        .otherwise("valid")
    )
    parsed = answers.withColumn("parsed", tolerant_json(after_marker(F.col(raw_col)))).withColumn("reason", reason)
    valid = F.col("reason") == "valid"
    return (
        parsed.withColumn("is_valid", valid)
        .withColumn("prompts", F.when(valid, texts))
        .withColumn("n_returned", F.when(valid, F.size(texts)))
        .drop("parsed")
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("is_valid"), checked.filter(~F.col("is_valid"))


def retried(
    requests: DataFrame,
    fn: Callable[[list[str], int], list[str]],
    attempts: int = 10,
    text_col: str = "input_prompt",
    validator: Callable[[DataFrame], DataFrame] = validated,
    batch_size: int = BATCH,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Accepted answers of a first pass and up to ``attempts`` more over what is still invalid.

    Each pass is written before it is read again: a generator may answer differently when asked twice,
    and an accepted answer is never asked for again.
    """
    pending, accepted = requests, []
    for attempt in range(attempts + 1):
        checked = written(validator(generate(pending, fn, attempt, text_col, batch_size, in_flight)), "answers")
        valid, invalid = split_valid(checked)
        accepted.append(valid)
        pending = invalid.select(*requests.columns)
        if pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, accepted)


def restored(requests: DataFrame, accepted: DataFrame, key: str = "request_id") -> DataFrame:
    """Every request with its accepted answer; requests never answered well keep null prompts."""
    found = accepted.select(key, "attempt", "prompts", "n_returned")
    return requests.join(found, key, "left").withColumn("is_valid", F.col("prompts").isNotNull())
