import itertools
import random

import numpy as np
import pytest
import sentencepiece

from coverlake.llm import pieces as P

PATH = P.default_path()
POOL = ["a", "b", "e", "the", "in", " ", "  ", "   ", "\n", "\t", "é", "日本", "ж", "😀", "́", "12", P.MARK, "_", "====", "<0x0A>", "<s>", "\x00", "of the", "tion", "zq"]


def test_ids_and_texts_equal_the_library():
    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), P.Pieces(PATH, cache_words=500), random.Random(4)
    for _ in range(300):
        texts = ["".join(rng.choices(POOL, k=rng.randint(0, 25))) for _ in range(10)]
        for text, ids in zip(texts, own.encode(texts)):
            got = np.frombuffer(ids, "<u4").tolist()
            assert got == lib.encode(text) and own.decode(ids) == lib.decode(got)


def test_best_scores_match_enumeration():
    own = object.__new__(P.Pieces)
    vocabulary = {"a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.2, "ba": -3.1, "c": -5.0, "bc": -4.0, P.MARK: -1.0, P.MARK + "a": -2.2}
    own.id = {p: k for k, p in enumerate(vocabulary)}
    own.score, own.longest, own.fallback, own.unknown, own.packed = list(vocabulary.values()), 3, False, 99, {}
    words = sorted({P.MARK + "".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)})
    for word, ids in zip(words, own._best_scores(words)):
        best = max(sum(vocabulary[p] for p in cut) for cut in segmentations(word, vocabulary))
        got = [list(vocabulary)[k] for k in np.frombuffer(ids, "<u4")]
        assert "".join(got) == word and abs(sum(vocabulary[p] for p in got) - best) < 1e-9


def segmentations(word, vocabulary):
    if not word:
        return [[]]
    return [[word[:k]] + rest for k in range(1, len(word) + 1) if word[:k] in vocabulary for rest in segmentations(word[k:], vocabulary)]


def test_frames(spark):
    rows = [(1, "the same words"), (1, "the same words"), (None, "no id"), (2, None), (3, ""), (4, "long text " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as piece_ids")
    coded = P.encode_pieces(df)
    assert sorted((r.doc_id or 0, r.text) for r in P.decode_pieces(coded).collect()) == sorted((d or 0, t or "") for d, t in rows)
    out = P.encode_column(df)
    assert out.columns == df.columns + ["piece_ids_"] and out.count() == len(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert all(list(r.piece_ids_) == lib.encode(r.text or "") for r in out.collect())
    assert P.encode_column(df.limit(0)).count() == 0


def test_query_matches_the_library(spark):
    import zlib

    from tests.conftest import SF_SMALL
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = P.q_pieces(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r.round_trip


def test_user_pieces_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        data = f.read()
    extra = b"\x0a\x03<u>\x15\x00\x00\x00\x00\x18\x04"        # piece, score, type 4
    path = tmp_path / "m.model"
    path.write_bytes(data + b"\x0a" + bytes([len(extra)]) + extra)
    with pytest.raises(ValueError):
        P.Pieces(str(path))


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    """Texts without blanks, and ever new words: the caches stay small and the ids the library's."""
    monkeypatch.setattr(P, "JOINS", 2000)
    m = P.Pieces(P.default_path())
    m.cache_bytes = 100_000
    library = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    rng = random.Random(2)
    for _ in range(12):
        texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz日本語", k=900)), " ".join("".join(rng.choices("etaoinshr", k=7)) for _ in range(150)),
                 "QUJD" * 300, "one two  three"]
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == library.encode(texts)
        assert max(map(len, m.known)) <= P.LONG_WORD and m.held < 200_000 and m.n_joins < 12_000
        assert sum(map(len, m.joins.values())) <= m.n_joins
