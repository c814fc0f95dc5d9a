import hashlib
import random

import numpy as np
import sentencepiece

from benchlens.llm import merge_dropout as M

V = M.vocabulary(M.MODEL)
TEXTS = ["", "Hello  world\n x", " a", "   ", "été 🎉 über\tß\n\n", "a▁b ▁ ▁▁c", "<s> </s> <unk> <0x0A>", "x" * 500, "word " * 3000, "   end ", "日本語 テキスト 한국어", " " * 300 + "z"]


def corpus():
    rng = random.Random(4)
    return TEXTS + ["".join(rng.choice("abcdeeeinnorstth   \n.,é") for _ in range(rng.randrange(200))) for _ in range(200)]


def split(ids, begin):
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def test_without_dropout_it_is_the_models_encoding():
    texts = corpus()
    keys = np.zeros(len(texts), np.uint64)
    model = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    for text, ids in zip(texts, split(*M.encode(texts, keys, V, 0.0)), strict=True):
        if "▁" not in text:
            assert ids == model.encode(text)
        assert M.decode(ids, V) == text


def test_dropout_is_lossless_and_keyed():
    texts = corpus()
    some = [split(*M.encode(texts, M._document_keys(range(len(texts)), seed), V, 0.3)) for seed in (1, 1, 2)]
    assert some[0] == some[1] != some[2]
    assert all(M.decode(i, V) == t for part in some for i, t in zip(part, texts, strict=True))
    plain = split(*M.encode(texts, M._document_keys(range(len(texts)), 1), V, 0.0))
    assert sum(map(len, some[0])) > sum(map(len, plain))
    chars = split(*M.encode(texts, M._document_keys(range(len(texts)), 1), V, 1.0))
    assert len(chars[8]) == len(texts[8]) + 1


def test_blocked_agenda_equals_heap(monkeypatch):
    texts = corpus()
    keys = M._document_keys(range(len(texts)), 5)
    blocked = split(*M.encode(texts, keys, V, 0.2))
    monkeypatch.setattr(M, "SHORT", 1)
    assert split(*M.encode(texts, keys, V, 0.2)) == blocked


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "null id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").repartition(4)
    encoded = M.encode_documents(docs)
    assert {(r.doc_id, r.text) for r in M.decode_documents(encoded).collect()} == {(d, t) for d, t, _ in rows}
    ids = {r.doc_id: r.piece_ids for r in encoded.collect()}
    for r in M.round_trip(docs).collect():
        own = ids[r.doc_id] or []
        assert r.lossless and r.n_pieces == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<i4").tobytes()).hexdigest()
    assert ids[99] is None and ids[0] == []
    assert M.round_trip(docs.limit(0)).collect() == []
