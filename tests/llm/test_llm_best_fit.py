import random
import zlib

import numpy as np
import pytest
from fixtures import ODD, documents
from tokenizers import Tokenizer

import public_tokenizers
from promptgauge.llm import best_fit as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_best_fit(sizes, capacity, most):
    """Scans all open bins: free space by bin, newest first on ties; the fullest closes when there are too many."""
    open_, made, found = [], 0, []
    for s in sizes:
        fits = [(free, -place, number) for place, (number, free) in enumerate(open_) if free >= s]
        if fits:
            free, place, number = min(fits)
            open_.pop(-place)
        else:
            free, number, made = capacity, made, made + 1
        found.append((number, capacity - free))
        if free > s:
            open_.append((number, free - s))
            if len(open_) > most:
                least = min(f for _, f in open_)
                open_.pop(max(i for i, (_, f) in enumerate(open_) if f == least))
    return found


def test_open_bins_against_a_plain_scan():
    rng = random.Random(2)
    for _ in range(300):
        capacity, most = rng.choice([1, 10, 40, 1024]), rng.choice([1, 2, 5, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 80))]
        bins = op.OpenBins(capacity, most)
        assert [bins.place(s) for s in sizes] == plain_best_fit(sizes, capacity, most)
        assert bins.open == sum(map(len, bins.bins)) <= most


def test_cut():
    assert op.cut(3, 4) == [(0, 3)] and op.cut(4, 4) == [(0, 4)] and op.cut(8, 4) == [(0, 4), (4, 4)]
    assert op.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def held_to(rows, texts, tokenizer, length):
    pieces, fills, at = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0) and r["length"] > 0
        fills[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert max(fills.values(), default=0) <= length
    assert set(pieces) == {i for i, _ in texts}
    for i, found in pieces.items():
        ids = tokenizer.encode(dict(texts)[i] or "", add_special_tokens=False).ids + [2]
        found.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in found] == [(k, *p) for k, p in enumerate(op.cut(len(ids), length))]
        assert all(r["length"] == length for r in found[1:]) and (len(ids) > length or len(found) == 1)
        for r in found:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"] and (r["ids"] is None or bytes(r["ids"]) == part)


@pytest.mark.parametrize("length,open_bins,window", [(1024, 1024, 1024), (64, 1, 1), (1, 2, 3), (50, 3, 4)])
def test_odd_rows(spark, tokenizer, length, open_bins, window):
    unique = [(i, t) for i, t in dict(ODD).items() if i is not None]
    found = op.best_fit_packed(documents(spark, unique), PATH, length, open_bins, window).collect()
    held_to(found, unique, tokenizer, length)


def test_repeated_rows_and_null_ids(spark):
    found = op.best_fit_packed(documents(spark, ODD), PATH, with_ids=False).collect()
    assert sorted(repr(r["doc_id"]) for r in found if r["piece"] == 0) == sorted(repr(i) for i, _ in ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_empty_table(spark):
    assert op.best_fit_packed(documents(spark, []), PATH).collect() == []


def test_whole_table_with_little_padding(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = op.best_fit_packed(docs, PATH, with_ids=False).collect()
    held_to(found, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 1024)
    total = sum(r["length"] for r in found)
    tasks = len({r["sequence_id"] >> 40 for r in found})
    assert len({r["sequence_id"] for r in found}) * 1024 < 1.02 * total + 1024 * (tasks + 1)
