import zlib

import numpy as np
import pyarrow as pa

from coverlake.llm import language as L
from tests.conftest import SF_MID

SCHEMA = "doc_id bigint, text string, lang string"
WORDS = {"en": "the and of ing with that this from are was have which their would there about", "de": "der die und ung mit dass nicht auch eine sich werden über für",
         "fr": "le la les des est dans pour que qui avec être aux cette plus nous", "es": "el los las una para por como más pero sus está también cuando", "xx": "zzq qqz xkw kwx wzq"}


def rows(n=60):
    rng, out, k = np.random.default_rng(3), [], 0
    for lang, w in WORDS.items():
        for _ in range(n):
            out.append((k, " ".join(rng.choice(w.split(), 25)), lang))
            k += 1
    return out


def test_families_then_pairs(spark):
    data = rows()
    more = [(10_000, None, "en"), (10_001, "123 ... !!", "en"), (10_002, "", None), (None, "the and of with that", "en"), (None, "the and of with that", "en")]
    df = spark.createDataFrame(data + more, SCHEMA).selectExpr("*", "1 as x", "2 as place", "3 as id")
    out = L.identify(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == df.count()
    for d, _, lang in data:
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert by[d].lang_pred == lang and 0 <= by[d].score <= 1
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (10_000, 10_001, 10_002))
    assert not by[None].held_out and by[None].lang_pred == "en"


def test_held_out_rows_teach_nothing(spark):
    data = rows(30)
    held = [(d, t, "en" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in data]      # wrong labels, held out
    a = sorted(map(tuple, L.identify(spark.createDataFrame(data, SCHEMA)).collect()))
    assert a == sorted(map(tuple, L.identify(spark.createDataFrame(held, SCHEMA)).collect()))


def test_nothing_or_one_language_to_learn(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "more", None)], SCHEMA)
    assert {r.lang_pred for r in L.identify(df).collect()} == {"und"}
    df = spark.createDataFrame([(k, "some words", "en") for k in range(8)], SCHEMA)
    assert {r.lang_pred for r in L.identify(df).collect()} == {"en"}
    assert L.identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    out = [r for r in L.q_language(spark, SF_MID).collect() if r.held_out]
    assert len(out) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.98


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 1, (80, 5)), rng.normal(-1, 1, (80, 5))]).astype(np.float32)
    w = L.svm(x, np.arange(160) < 80)
    assert ((np.hstack([x, np.ones((160, 1))]) @ w > 0) == (np.arange(160) < 80)).mean() > 0.95


def test_features_cover_whole_texts_of_any_length():
    f = np.vstack(list(L.features(pa.array(["", "ab " * 2_000_000 + "zzzz", "ab"]))))
    assert f.shape == (3, L.BINS) and not f[0].any() and abs(np.linalg.norm(f[1]) - 1) < 1e-5
