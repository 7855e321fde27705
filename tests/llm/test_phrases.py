"""Phrase collocations against brute force, and the parse's own properties."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coverlake.llm import phrases as P

SCHEMA = "doc_id bigint, text string, lang string"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, min_count, top=2000, share=100, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    f = {g: c for g, c in f.items() if c >= min_count}
    inside = set()
    for (lang, g), c in f.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if 100 * c >= share * f[lang, g[i:i + k]]:
                    inside.add((lang, g[i:i + k]))
    out = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and (lang, g) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, r, p.decode(), -a, lf, rf, n[lang], -s) for lang, found in out.items()
            for r, (s, a, p, lf, rf) in enumerate(sorted(found)[:top], 1)}


def mined(spark, rows, **options):
    got = P.collocations(spark.createDataFrame(rows, SCHEMA), **options).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "of", "and", "ein", "été", "Ä", "x1", "ÉTÉ", "new", "york", "city"] + [f"w{k}" for k in range(20)]
    copy = " ".join(rng.choice(words) for _ in range(300)) + ". New York City hall"
    out = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for _ in range(rng.randrange(0, 120)))
        out.append((k, (copy if k % 3 == 0 else "") + text, rng.choice(["en", "de", None])))
    return out


def test_equals_brute_force(spark):
    rows = texts(60)
    assert mined(spark, rows, min_count=5, period=4) == brute(rows, 5)
    assert mined(spark, rows, min_count=5, period=64, top=7) == brute(rows, 5, top=7)


def test_share_of_the_longer_phrase(spark):
    rows = texts(40, 5)
    assert mined(spark, rows, min_count=4, share=60) == brute(rows, 4, share=60)


def test_repeated_words_and_overlaps(spark):
    rows = [(1, "a a a a a a a a", "en"), (2, "a b a b a b a b", "en"), (3, "a " * 500, "en"), (3, "a " * 500, "en")]
    assert mined(spark, rows, min_count=3, period=1) == brute(rows, 3)
    assert mined(spark, rows, min_count=3) == brute(rows, 3)


def test_empty_null_and_clashing_columns(spark):
    assert mined(spark, [], min_count=1) == set()
    rows = [(1, None, "en"), (2, "", None), (3, " .,\t", "en"), (4, "one two", None), (4, "one two", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", n int, chunk string")
    assert {tuple(r) for r in P.collocations(df, min_count=2).collect()} == brute(rows, 2)


def test_long_text(spark):
    rng = random.Random(9)
    rows = [(1, " ".join(f"v{rng.randrange(40)}" for _ in range(60_000)), "en")]
    assert mined(spark, rows, min_count=30) == brute(rows, 30)


@pytest.mark.parametrize("period", [1, 3, 50])
def test_every_gram_is_owned_once(period):
    rows = texts(20)
    data = [r[1].encode() for r in rows]
    offsets = np.cumsum([0, *map(len, data)])
    text, own, chunks = P.parse_block(np.frombuffer(b"".join(data), np.uint8), offsets, period, 4)
    got = Counter()
    for o, c in zip(own.tolist(), chunks.to_pylist()):
        words = c.replace("\n", " \n ").split(" ")
        words = [w for w in words if w]
        starts = [k for k, w in enumerate(words) if w != "\n"]
        for k in starts[:o]:
            for size in range(1, 6):
                gram = words[k:k + size]
                if len(gram) == size and "\n" not in gram:
                    got[tuple(gram)] += 1
    want = Counter()
    for r in rows:
        for words in pieces(r[1]):
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    want[tuple(words[i:i + size])] += 1
    assert got == want


def test_copies_share_their_chunks():
    rng = random.Random(1)
    body = " ".join(f"v{rng.randrange(5000)}" for _ in range(4000))
    data = [f"{k} {body}".encode() for k in range(4)]
    _, own, chunks = P.parse_block(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 32, 4)
    assert len(set(chunks.to_pylist())) <= len(chunks) / 4 + 4


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for dtype in (np.uint32, np.int64):
        x = rng.integers(0, 1 << 31, 1000).astype(dtype)
        assert (P.unpacked(P.packed(x), dtype) == x).all()


def test_bits(spark):
    rows = [0, 1, 7, 32767, 32768, (1 << 20) - 1]
    bits = P.bit_array(spark.createDataFrame([(x,) for x in rows], "bit bigint"), 20)
    probe = np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)
    assert np.flatnonzero(P.has_bit(bits, probe)).tolist() == rows


def test_counts_past_64_bits(spark):
    big = 3_000_000_019
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 7)], "lang string, words int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n bigint")
    row = P.scores(phrases, totals).first()
    assert int(row["score"]) == 1000 * (big - 7) * 9 * big // (big * big)


def test_a_block_of_no_words():
    table = pa.table({"lang": pa.array([], pa.string()), "own": pa.array([], pa.int32()), "chunk": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    assert len(P.Block(table)) == 0
