import random

import numpy as np
import pytest
import sentencepiece
from fixtures import ODD, documents

import public_tokenizers
from promptgauge.llm import sentencepiece_bpe as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    odd = ["", " ", "  a", "a  b ", "\n x", "漢字 テスト 🎉", "a▁b ▁ c", "x" * 300, " " * 50 + "y", "<s> </s> <unk> <0x41>", "é" * 60, "\0"]
    return odd + ["".join(rng.choice(" \tabcé漢\0thes▁") for _ in range(rng.randint(1, 90))) for _ in range(500)]


def test_no_dropout_is_the_library(texts):
    library, encode = sentencepiece.SentencePieceProcessor(model_file=PATH), op.MergeModel(PATH, 0.0).encoder()
    plain = [t for t in texts if op.MARK not in t]
    assert [i.tolist() for i in encode(plain, [0] * len(plain))] == [library.encode(t) for t in plain]


def test_dropout_is_lossless_seeded_and_varied(texts):
    models = [op.MergeModel(PATH, 0.3, seed) for seed in (1, 1, 2)]
    found = [[i.tolist() for i in m.encoder()(texts, [0] * len(texts))] for m in models]
    assert found[0] == found[1] != found[2]
    other = [i.tolist() for i in models[0].encoder()(texts, [1] * len(texts))]
    assert other != found[0]
    for ids in (found[0], found[2], other):
        assert [models[0].decode(np.array(i, "u4")) for i in ids] == texts


def test_together_is_one_by_one(texts):
    model = op.MergeModel(PATH, 0.2)
    chunks = sorted({c for t in texts for c in t.split(" ") if c and op.MARK not in c}) + [""]
    key = model.key(3)
    assert model.merged_together(chunks, key) == [model.ids(c, key) for c in chunks]


def test_repeated_words_are_cut_in_several_ways():
    word, model = "internationalization", op.MergeModel(PATH, 0.3)
    assert len({tuple(model.merged(op.MARK + word, k)) for k in map(model.key, range(300))}) > 8
    ids = model.encoder()([f"{word} " * 300, f"{word} " * 300], [1, 2])
    assert [model.decode(i) for i in ids] == [f"{word} " * 300] * 2 and ids[0].tolist() != ids[1].tolist()
    cut = {tuple(p for p in w.split("|")) for w in "|".join(model.shown[i].decode() for i in ids[0].tolist()).split(" ")}
    assert len(cut) > 8


def test_encoder_is_each_chunk_by_its_key(texts):
    model = op.MergeModel(PATH, 0.2)
    documents = [i * 7919 - 5 for i in range(len(texts))]
    cuts = [model.cut.findall(" " + t) if t else [] for t in texts]
    keys = iter(model.keys(documents, list(map(len, cuts))).tolist())
    expected = [b"".join(model.ids(c, next(keys)) for c in cut) for cut in cuts]
    assert [i.tobytes() for i in model.encoder()(texts, documents)] == expected


def test_documents_are_drawn_each_for_itself(spark):
    text = "internationalization of representative institutions " * 3
    found = op.encoded(documents(spark, [(i, text) for i in range(60)] + [(1, text)]), PATH).collect()
    assert len({tuple(r["ids"]) for r in found}) > 8 and len({tuple(r["ids"]) for r in found if r["doc_id"] == 1}) == 1


def test_full_dropout_leaves_characters():
    model = op.MergeModel(PATH, 1.0)
    assert [len(i) for i in model.encoder()(["abc de"], [0])] == [7]


def test_odd_rows(spark):
    found = op.round_trips(documents(spark, ODD), PATH).collect()
    assert all(r["lossless"] for r in found) and sorted(repr(r["doc_id"]) for r in found) == sorted(repr(i) for i, _ in ODD)
    assert {r["n_pieces"] for r in found if r["doc_id"] in (3, 4)} == {0}


def test_encode_then_decode(spark):
    rows = [(i, t) for i, t in ODD if i not in (5, 6, 7)]
    back = op.decoded(op.encoded(documents(spark, rows), PATH), PATH)
    assert sorted(repr((r["doc_id"], r["text"])) for r in back.collect()) == sorted(repr((i, t or "")) for i, t in rows)


def test_empty_table(spark):
    assert op.round_trips(documents(spark, []), PATH).collect() == [] and op.decoded(op.encoded(documents(spark, []), PATH), PATH).collect() == []
