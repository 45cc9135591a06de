import importlib
from pathlib import Path

import duckdb
import pytest
from test_llm_packing import PATH, held_to
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from promptgauge.llm import oracles, pii, queries, toxicity
from promptgauge.llm.columns import ASCII_LOWER
from test_llm_simhash import components, plain_fingerprint


def plain(docs, scores):
    """The first four stages in plain Python over ``(doc_id, text)``; the classifier's scores are given."""
    rows = [(i, t) for i, t in docs if scores[i] < toxicity.CUT]
    last = {}
    for i, t in rows:
        body = (t or "").translate(ASCII_LOWER)
        last[body] = max(i, last.get(body, i))
    rows = [(i, t) for i, t in rows if last[(t or "").translate(ASCII_LOWER)] == i]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    group, least = components(set(prints.values())), {}
    for i, f in prints.items():
        least[group[f]] = min(i, least.get(group[f], i))
    return [(i, None if t is None else pii.redacted_text(t)) for i, t in rows if i in set(least.values())]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "pii", "packing"]


def test_pipeline_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], scores)
    rows = [dict(r.asDict(), ids=None) for r in corpus_pipeline.run(spark, sf).collect()]
    held_to(rows, expected, Tokenizer.from_file(PATH), 2048)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_registered():
    names = set(entry_point.queries())
    assert {n.split("_")[0] for n in queries.registered()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.registered()) | {"pipeline"} <= names and set(oracles.ORACLES) <= set(queries.registered())


def test_nothing_else_imports_the_package():
    root = Path(entry_point.__file__).parent
    files = [p for p in root.rglob("*.py") if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert not [p for p in files if "promptgauge.llm" in p.read_text()]
    assert importlib.import_module("promptgauge")
