"""Importance resampling against plain Python, crc by crc and rank by rank."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlake.llm import resample as R


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(w):
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, share=R.SHARE):
    corpus, bench = [0] * R.BUCKETS, [0] * R.BUCKETS
    for texts, counts in (([t for _, t in docs], corpus), (target, bench)):
        for t in texts:
            for f in runs(words(t)):
                counts[zlib.crc32(f.encode()) % R.BUCKETS] += 1
    s, t = sum(corpus), sum(bench)
    gain = [math.floor(1000 * math.log((y + 1) * (s + R.BUCKETS) / ((x + 1) * (t + R.BUCKETS)))) for x, y in zip(corpus, bench)]
    rows = []
    for doc_id, text in docs:
        w = words(text)
        f = runs(w)
        weight = sum(gain[zlib.crc32(x.encode()) % R.BUCKETS] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(w)])
    able = sorted((r for r in rows if r[5] >= R.MIN_WORDS), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0]))
    for k, r in enumerate(able[:share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    out = R.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["The", "été", "naïve", "x1", "日本", "Zoo", "a" * 70, "b" * 200] + [f"w{k}" for k in range(60)]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ". ", "\n", "\x7f"]) for _ in range(rng.randrange(0, 70)))
    return [(k, text()) for k in range(n)], [text() for _ in range(9)]


@pytest.mark.parametrize("share", [5, 50, 100])
def test_equals_brute_force(spark, share):
    docs, target = corpus(300)
    assert run(spark, docs, target, share=share) == brute(docs, target, share)


def test_nulls_repeats_long_and_empty(spark):
    docs, target = corpus(80, 3)
    docs += [(None, None), (7, ""), (900, "word " * 50_000), (901, "q" * 200_000), (901, "q" * 200_000)]
    assert run(spark, docs, target, share=30) == brute(docs, target, 30)
    assert run(spark, docs, [], share=30) == brute(docs, [], 30)
    assert run(spark, [], target) == []
    assert {r[4] for r in run(spark, [(1, "few words")], target)} == {None}


def test_equal_rows_at_the_cutoff(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = run(spark, [(5, text)] * 40 + [(None, text)] * 3, ["w1 w2"], share=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 22))


def test_crc_of_runs():
    texts = ["", "One two  THREE four", "é" * 40 + " " + "y" * 65 + " z", "k" * 1000 + " k", "a"]
    data = [t.encode() for t in texts]
    counts, found = R.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert counts.tolist() == [len(words(t)) for t in texts]
    got = sorted((int(d), int(b)) for bucket, text in found for b, d in zip(bucket, text))
    assert got == sorted((d, zlib.crc32(f.encode()) % R.BUCKETS) for d, t in enumerate(texts) for f in runs(words(t)))


@pytest.mark.parametrize("accuracy", [4, 1000])
@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_cutoff(spark, accuracy, k):
    rows = spark.range(1000).select((F.col("id") % 37).alias("score"), F.col("id").alias("doc_id"))
    order = [F.desc("score"), F.asc("doc_id")]
    want = sorted(((-(i % 37), i) for i in range(1000)))[k - 1]
    got, _ = R.bracketed_cutoff(rows, "score", order, k, accuracy)
    assert (-got["score"], got["doc_id"]) == want


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """A sketch that is far off (here: of other ranks) costs passes, not the result."""
    rows = spark.range(5000).select(F.col("id").alias("score"), F.col("id").alias("doc_id"))
    real = F.percentile_approx
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, p, a: real(c, [x * 0.9 for x in p], a))
    got, tries = R.bracketed_cutoff(rows, "score", [F.desc("score"), F.asc("doc_id")], 250)
    assert got["score"] == 4750 and tries > 1


def test_clashing_columns(spark):
    docs, target = corpus(60, 8)
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id bigint, text string, score int, weight int, rank string")
    t = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    assert sorted((tuple(r) for r in R.resample(d, t).collect()), key=repr) == brute(docs, target)
