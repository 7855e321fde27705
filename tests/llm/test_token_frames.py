import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coverlake.llm import token_frames as T
from coverlake.llm.common import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(3, "Hello, World! it's <|endoftext|> é"), (1, None), (2, ""), (7, "a\x01b   Σας ÀÉ\x1c\x85"), (7, "second of an id"),
         (None, "no id"), (5, "long word " * 5000)]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_shards_hold_every_text_in_order(spark):
    folder = scratch_path(spark, "test-shards")
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as ids")
    manifest = T.write_token_shards(df, folder, PATH)
    rows = T.digest_tokens(T.read_tokens(manifest, folder), manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (d is not None, d or 0, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for d, t in TEXTS)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 7, 7]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    # any zstd reader gets the concatenation of all frames
    assert manifest.count() == len(TEXTS)


def test_one_document_needs_its_frames_only(tmp_path):
    w = T.ShardWriter(str(tmp_path), 0, 1)
    parts = [bytes([k]) * (k * 1000) for k in range(5)]
    for p in parts:
        w.add(p)
    w.close()
    r = T.ShardReader(str(tmp_path), "shard-000000.zst")
    assert [r.frame(k) for k in (3, 0, 4)] == [parts[3], parts[0], parts[4]]
    import zstandard
    data = (tmp_path / "shard-000000.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(parts)
    damaged = bytearray(data)
    damaged[int(r.at[3]) + 8] ^= 1
    (tmp_path / "shard-000000.zst").write_bytes(bytes(damaged))
    r = T.ShardReader(str(tmp_path), "shard-000000.zst")
    assert r.frame(2) == parts[2]
    with pytest.raises(Exception):
        r.frame(3)


def test_encoder_equals_the_library_when_its_cache_turns_over():
    texts = [f"word{k} Mixed{k % 7} x{k * k} <|startoftext|> it's" for k in range(300)]
    e = T.WordEncoder(PATH, cache_words=100)
    for at in range(0, 300, 40):
        for text, got in zip(texts[at:at + 40], e.encode(texts[at:at + 40])):
            assert np.frombuffer(got, "<u4").tolist() + [1] == ids_of(text)


def test_empty_table(spark):
    folder = scratch_path(spark, "test-shards")
    manifest = T.write_token_shards(spark.createDataFrame([], "doc_id bigint, text string"), folder, PATH)
    assert T.digest_tokens(T.read_tokens(manifest, folder), manifest).count() == 0


ODD = ["a<|endoftext|>b <x Y", "\x1c a\x1cb\x85c's S 'S it'S ʼs İ ﬁ K Å", "'s't're''ve'm'll'd'D", "tab\tx\x0by\x0cz\rq", "x" * 1000 + "\x01y",
       "".join(map(chr, range(33, 600))), " ".join(map(chr, range(33, 3000))), "é\u0301 é ªµº ß", "a\nb\n\nc'\n's", "x" * 500 + "!" * 300 + " " + "x" * 500]


@pytest.mark.parametrize("by_runs", [True, False])
def test_encoder_equals_the_library_on_odd_text(by_runs):
    e = T.WordEncoder(PATH)
    assert e.by_runs
    e.by_runs = by_runs
    assert [list(np.frombuffer(x, "<u4")) + [1] for x in e.encode(ODD)] == [ids_of(t) for t in ODD]


def test_cache_is_bounded_in_bytes():
    e = T.WordEncoder(PATH)
    e.cache_bytes = 20_000
    for k in range(40):
        texts = ["日本語" * 400 + str(k), f"{k}" + "x" * 150, " ".join(f"w{k}q{j}" for j in range(20)), "long" * 100 + f" {k}"]
        assert [list(np.frombuffer(x, "<u4")) + [1] for x in e.encode(texts)] == [ids_of(t) for t in texts]
        assert all(len(w) <= T.LONG_PART for w in e.young) and e.young.held < 60_000


def test_a_document_of_several_frames(spark, monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 7)
    folder = scratch_path(spark, "test-shards")
    manifest = T.write_token_shards(spark.createDataFrame([(1, "one " * 50), (2, "two")], "`doc.id` bigint, text string"), folder, PATH, id_col="doc.id")
    rows = {r.doc_id: r for r in T.digest_tokens(T.read_tokens(manifest, folder), manifest).collect()}
    assert rows[1].ids_crc32 == zlib.crc32(np.array(ids_of("one " * 50), "<u4").tobytes()) and rows[2].n_tokens == 2


def test_query_equals_the_library_on_the_table(spark):
    from tests.conftest import SF_SMALL
    docs = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for d, t in docs:
        ids = ids_of(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = T.q_token_frames(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want
