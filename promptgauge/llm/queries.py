"""The thin queries over whole tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptgauge.llm.best_fit import best_fit_packed
from promptgauge.llm.exact_dedup import exact_duplicates
from promptgauge.llm.graph_search import nearest_neighbours
from promptgauge.llm.licenses import license_scan
from promptgauge.llm.packing import packed_documents
from promptgauge.llm.pii import KINDS, identifiers, span_text
from promptgauge.llm.sentencepiece_bpe import round_trips
from promptgauge.llm.simhash import simhash_groups
from promptgauge.llm.spelling import spelling_forms
from promptgauge.llm.toxicity import toxicity
from promptgauge.llm.url_filter import judged_urls
from promptgauge.llm.warc import archived
from promptgauge.llm.whitening import whitened

#: Fixed by the contract of op6.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_graph_search(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf, "embeddings"))


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf, "documents"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packed_documents(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.drop("ids")


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan(_table(spark, sf, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archived(_table(spark, sf, "pages")).drop("url", "payload", "record_id", "refers_to_record")


def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judged_urls(_table(spark, sf, "pages"), rules)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = identifiers(_table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return round_trips(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(_table(spark, sf, "documents"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_forms(_table(spark, sf, "documents"))


def op12_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return best_fit_packed(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitened(_table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
