"""Line dedup against brute force; the perfect hash on its own."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlake.llm import line_dedup as L

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return low if len(low) >= L.MIN_CHARS else None


def brute(rows, min_docs=L.MIN_DOCS):
    held = {}
    low = lambda d: -(1 << 63) if d is None else d
    for doc_id, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")} - {None}:
            held.setdefault(key, []).append(low(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := key_of(x)) is None or len(held[k]) < min_docs or low(doc_id) == max(held[k])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in L.line_dedup(df, **options).collect()), key=repr)


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    common = [f"This line is found in many documents, number {k}" for k in range(12)] + ["x" * 19, "é" * 19, "é" * 20, "Ä" + "ß" * 25]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            line = rng.choice(common) if rng.random() < 0.6 else f"only here {rng.random()} and nowhere else"
            line = line.upper() if rng.random() < 0.2 and line.isascii() else line
            lines.append(rng.choice(["", " ", "\t\t", "\x0b "]) + line + rng.choice(["", "\r", "  ", "\x0c"]))
        rows.append((rng.choice([d, d, d * 10]), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_lines": 3}, {"min_docs": 2}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    assert run(spark, rows, **options) == brute(rows, options.get("min_docs", L.MIN_DOCS))


def test_nulls_repeats_empty_and_long(spark):
    line, other = "a line of enough characters", "another line of enough characters"
    rows = [(1, None), (2, ""), (None, line), (None, line), (3, line), (3, line + "\n" + line), (4, "\n\n"),
            (5, other), (5, other), (5, other), (6, (other + "\n") * 20_000 + line)]
    assert run(spark, rows) == brute(rows)
    only_null = [(None, line)] * 3
    assert run(spark, only_null) == brute(only_null)
    assert run(spark, []) == []
    assert run(spark, [(1, "short"), (2, "short"), (3, "short")]) == brute([(1, "short"), (2, "short"), (3, "short")])


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(k, "a line of enough characters\nrest", 7, "m", [k]) for k in range(3)],
                               "doc_id int, text string, n_lines int, n string, lo array<int>")
    out = L.line_dedup(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n", "lo", "n_lines1", "n_dropped"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (0, "rest", 7, "m", [0], 2, 1), (1, "rest", 7, "m", [1], 2, 1), (2, "a line of enough characters\nrest", 7, "m", [2], 2, 0)]


def test_query_digest(spark):
    rows = corpus(30, 5)
    df = L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(r[0], r[1]) for r in df.select("doc_id", F.sha2("text", 256)).collect()}
    assert got == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t, _, _ in brute(rows)}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
    perfect = L.PerfectHash.build(keys)
    assert len(perfect) == len(keys)
    assert np.array_equal(np.sort(perfect.slots(keys)), np.arange(len(keys)))
    if n > 100:
        assert perfect.sizes.sum() < 5 * len(keys)          # bits a key
        other = perfect.slots(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        assert ((other >= -1) & (other < n)).all()


def test_keys_left_after_the_levels(monkeypatch):
    monkeypatch.setattr(L, "LEVELS", 1)
    keys = np.arange(1, 500, dtype=np.uint64)
    perfect = L.PerfectHash.build(keys)
    assert len(perfect.rest) and np.array_equal(np.sort(perfect.slots(keys)), np.arange(len(keys)))


def test_shard_tells_strangers_apart():
    rng = np.random.default_rng(4)
    lo, hi = (rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64) for _ in range(2))
    shard = L.Shard(L.Shard.build(lo, hi, np.arange(3000) + 2, np.arange(3000) * 10))
    count, top = shard.probe(lo, hi)
    assert (count == np.arange(3000) + 2).all() and (top == np.arange(3000) * 10).all()
    assert not shard.probe(lo, hi + np.uint64(1))[0].any()
    strangers = [rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64) for _ in range(2)]
    assert not shard.probe(*strangers)[0].any()


def test_cache_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(L, "CACHE_BYTES", 5000)
    rng = np.random.default_rng(1)
    for number in range(6):
        lo = rng.integers(0, 1 << 63, 50, dtype=np.int64).view(np.uint64)
        L.ShardFiles.write(str(tmp_path), number, L.Shard.build(lo, lo, np.full(50, 3), np.full(50, number)))
    files = L.ShardFiles(str(tmp_path))
    assert [int(files[k].top[0]) for k in (0, 1, 2, 3, 4, 5, 0)] == [0, 1, 2, 3, 4, 5, 0]
    assert files.size <= 5000 and len(files.held) < 6


def test_needs_two_documents(spark):
    with pytest.raises(ValueError):
        L.drop_repeated_lines(spark.createDataFrame([(1, "")], "doc_id bigint, text string"), "/nowhere", 0, min_docs=1)
