import random
import zlib

import numpy as np
import pytest
from fixtures import ODD, documents
from tokenizers import Tokenizer

import public_tokenizers
from promptgauge.llm import packing as op
from promptgauge.llm.tokens import chunk_encoder, chunks_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    odd = ["", " ", "  a", "a  b", "a \n b", "\n b\t c", "a <|endoftext|> b<|endoftext|>", "it's don't  've 's", "x\u2003y \u3000z", "a\0 b", "\x1c a \x1c  b", "a" * 9000]
    odd += ["".join(rng.choice(" \t\n\x1c\x85\u00a0\u200baZ1'!é漢\0s") for _ in range(30)) for _ in range(1500)]
    encode = chunk_encoder(PATH)
    for _ in range(2):  # from the cache too
        assert [ids.tolist() for ids in encode(odd)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    assert all("".join(chunks_of(t)) == t for t in odd)


def test_first_fit_decreasing_against_a_plain_scan():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 60))), reverse=True)
        free, expected = [], []
        for s in sizes:
            at = next((i for i, f in enumerate(free) if f >= s), len(free))
            if at == len(free):
                free.append(40)
            free[at] -= s
            expected.append(at)
        assert op.first_fit_decreasing(sizes, 40) == expected


def held_to(rows, texts, tokenizer, length, groups=None):
    """Every document's ids lie once in its pieces, every sequence is gapless and not too long."""
    by_text = sorted(texts)
    pieces, fills = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0) and r["length"] > 0
        fills[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert max(fills.values(), default=0) <= length
    assert set(pieces) == {i for i, _ in by_text}
    for i, found in pieces.items():
        ids = tokenizer.encode(dict(texts)[i] or "", add_special_tokens=False).ids + [1]
        found.sort(key=lambda r: r["start"])
        assert [r["start"] for r in found] == np.cumsum([0, *(r["length"] for r in found[:-1])]).tolist()
        assert {r["doc_tokens"] for r in found} == {len(ids)} == {sum(r["length"] for r in found)}
        for r in found:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"] and (r["ids"] is None or bytes(r["ids"]) == part)


@pytest.mark.parametrize("length,group_docs", [(2048, 2048), (64, 3), (1, 2)])
def test_odd_rows(spark, tokenizer, length, group_docs):
    unique = [(i, t) for i, t in dict(ODD).items() if i is not None and len(t or "") < 1000]
    found = op.packed_documents(documents(spark, unique), PATH, length=length, group_docs=group_docs).collect()
    held_to(found, unique, tokenizer, length)


def test_repeated_rows_and_null_ids(spark):
    found = op.packed_documents(documents(spark, ODD), PATH, with_ids=False).collect()
    starts = [r["doc_id"] for r in found if r["start"] == 0]
    assert sorted(map(repr, starts)) == sorted(repr(i) for i, _ in ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_empty_table(spark):
    assert op.packed_documents(documents(spark, []), PATH).collect() == []


def test_padding(spark):
    fills = spark.createDataFrame([(n,) for n in (1, 2, 3, 1024, 1025, 2048)], "n int")
    assert [r[0] for r in fills.select(op.padded_length(fills.n)).collect()] == [1, 2, 2048, 1024, 2048, 2048]


def test_whole_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = op.packed_documents(docs, PATH, with_ids=False).collect()
    held_to(found, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 2048)
    total = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in found}) * 2048 < 1.02 * total + 2048


def test_full_pieces_are_not_grouped(spark):
    """Few documents of many pieces: no group holds more than one rest of each."""
    docs = spark.createDataFrame([(i, "word " * 3000) for i in range(6)], "doc_id long, text string")
    found = op.packed_documents(docs, PATH, length=64, group_docs=2, with_ids=False).collect()
    full = [r for r in found if r["length"] == 64]
    assert len(full) >= 6 * 45 and len({r["sequence_id"] for r in full}) == len(full) and all(r["offset"] == 0 and r["sequence_id"] < 0 for r in full)
    assert len({r["sequence_id"] >> 32 for r in found if r["length"] < 64}) > 1
