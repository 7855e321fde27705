import random

import numpy as np
import pyarrow as pa

from coverlake.llm import decontaminate as D

BENCH = "item_id bigint, text string"
DOCS = "doc_id bigint, text string"


def words(n, seed, size=3000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64)
        score, start, end = D.align(np.array([np.append(a, [1, 1])], dtype=np.uint64), np.array([np.append(b, [0, 0, 0])], dtype=np.uint64))
        assert score[0] == smith_waterman(a.tolist(), b.tolist())
        if score[0]:
            assert smith_waterman(a.tolist(), b[start[0]:end[0]].tolist()) == score[0]


def edited(item, seed, every):
    rng, out = random.Random(seed), []
    for k, w in enumerate(item):
        if k % every == every - 1:
            kind = rng.randrange(3)
            out += [] if kind == 0 else [f"new{k}"] if kind == 1 else [w, f"new{k}"]
        else:
            out.append(w)
    return out


def found(spark, docs, bench):
    out = D.leaks(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as score", "2 as item_id"), spark.createDataFrame(bench, BENCH))
    return {(r.doc_id, r.item_id): r for r in out.collect()}


def test_copies_and_edited_copies_are_found(spark):
    items = [words(n, n) for n in (16, 30, 45, 60)]
    bench = [(k, " ".join(i)) for k, i in enumerate(items)]
    docs = [(100 + k, " ".join(words(400, 900 + k) + edited(i, k, 6) + words(90, 700 + k))) for k, i in enumerate(items)]
    docs += [(200 + k, "Start. " + ", ".join(w.upper() for w in i) + "!") for k, i in enumerate(items)]
    docs += [(300 + k, " ".join(words(500, 5000 + k))) for k in range(20)]
    docs += [(400, None), (401, ""), (None, " ".join(items[0])), (402, " ".join(items[1])), (402, " ".join(items[1][:18]))]
    got = found(spark, docs, bench)
    assert set(got) == {(100 + k, k) for k in range(4)} | {(200 + k, k) for k in range(4)} | {(None, 0), (402, 1)}
    assert got[402, 1].score == 1.0 and got[200, 0].score == 1.0 and got[100, 0].first_word >= 395


def test_scores_match_brute_force(spark):
    items = [words(25, 3, 12), words(40, 4, 12), words(33, 5, 3000)]
    docs = [(k, words(120, 50 + k, 12)) for k in range(12)] + [(20 + k, words(30, k) + edited(items[k % 3], k, 4 + k) + words(30, k + 9)) for k in range(6)]
    got = found(spark, [(d, " ".join(w)) for d, w in docs], [(k, " ".join(i)) for k, i in enumerate(items)])
    for d, w in docs:
        for k, item in enumerate(items):
            score = smith_waterman(item, w) / (2 * len(item))
            if (d, k) in got:
                assert abs(got[d, k].score - score) < 1e-9 or got[d, k].score >= D.LIMIT
            if d >= 20 and score >= 0.6:
                assert (d, k) in got


def test_a_passage_that_all_documents_hold(spark):
    item = words(30, 8)
    docs = [(k, " ".join(words(20, k) + item + words(20, k + 500))) for k in range(60)]
    assert len(found(spark, docs, [(1, " ".join(item))])) == 60


def test_drop_keeps_the_rest(spark):
    item = " ".join(words(30, 8))
    rows = [(1, item, 1), (2, "clean words only here", 2), (2, "clean words only here", 2), (None, "x", 3), (4, None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b")], BENCH)
    out = D.drop_leaks(df, bench)
    assert out.columns == df.columns and sorted(r.score for r in out.collect()) == [2, 2, 3, 4]
    assert D.drop_leaks(df, bench.limit(0)).count() == 5 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.drop_leaks(df.limit(0), bench).count() == 0 and D.leaks(df.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    items = [words(30, k) for k in range(8)]
    docs = [(k, " ".join(words(50, 90 + k) + i)) for k, i in enumerate(items)]
    assert set(found(spark, docs, [(k, " ".join(i)) for k, i in enumerate(items)])) == {(k, k) for k in range(8)}


def test_every_long_enough_run_holds_a_seed():
    items = D.Items([1], [" ".join(words(40, 1))])
    items.choose({})
    places = sorted(items.seed_at.tolist())
    assert places[0] <= 2 and all(b - a <= D.PICK for a, b in zip(places, places[1:]))
    assert D.passages(pa.array(["", None], pa.string()), items) == []


def rewritten(item, kind):
    """Every third or fourth word replaced, a word put in after each one or two, or the first half alone."""
    if kind in (3, 4):
        return [f"new{k}" if k % kind == kind - 1 else w for k, w in enumerate(item)]
    if kind in (1, 2):
        return [x for k, w in enumerate(item) for x in ([w, f"put{k}"] if k % kind == kind - 1 else [w])]
    return item[:(len(item) + 1) // 2]


def test_all_passages_at_the_limit_are_found(spark):
    rng = random.Random(4)
    items = [words(n, 60 + 7 * n + k, size) for n in (15, 17, 20, 38) for k in range(2) for size in (3000, 40)]
    docs = []
    for k, item in enumerate(items):
        docs += [words(60, 1000 + 10 * k + kind) + rewritten(item, kind) + words(40, 2000 + 10 * k + kind) for kind in range(5)]
        docs.append([w if rng.random() < 0.72 else f"other{rng.randrange(99)}" for w in item])
        docs.append(words(80, 3000 + k, 40))
    got = found(spark, [(d, " ".join(w)) for d, w in enumerate(docs)], [(k, " ".join(i)) for k, i in enumerate(items)])
    scores = {(d, k): smith_waterman(item, w) / (2 * len(item)) for d, w in enumerate(docs) for k, item in enumerate(items)
              if len(set(item) & set(w)) * 4 >= len(set(item))}
    real = {pair: s for pair, s in scores.items() if s >= D.LIMIT}
    assert len(real) > 5 * len(items) and set(got) == set(real)
    assert all(abs(got[pair].score - s) < 1e-9 for pair, s in real.items())
