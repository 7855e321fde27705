import random
import re

import pytest

from coverlake.llm import quality as Q
from coverlake.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string"


def counts(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w),
            len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [
    None, "", "  \n\t", "one", "a b c d e a b c d e x", "a a a a a a a a a a a a", "é b ## |x|\n\nsame line\nsame line\nsame line ",
    "x\r\ny\x0bz\x0c<a&b>", "w " * 3000, "\n".join(["the very same line of words"] * 7), "日本 語 " * 9])
def test_counts_match_brute_force(spark, text):
    df = spark.createDataFrame([(1, text, "en", "s")], SCHEMA)
    r = Q.judge(df, keep=["doc_id", "lang", "source"])[0].first()[-1]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)
    words = WORD.findall(text or "")
    assert r.n_stutters == sum(a == b for a, b in zip(words, words[1:]))
    assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_outliers_go_and_clean_rows_stay(spark):
    prose = [(k, " ".join(f"w{(k * 31 + j * 7) % 997}x" for j in range(60)), "en", "a") for k in range(300)]
    junk = [(1000 + k, " ".join(f"###w{(k * 17 + j * 3) % 991}$$$" for j in range(60)), "en", "a") for k in range(10)]
    out = {r.doc_id for r in Q.filter_quality(spark.createDataFrame(prose + junk, SCHEMA)).collect()}
    assert out == {r[0] for r in prose}


def test_groups_have_their_own_limits(spark):
    # a source of tables is judged by its own spread, not by that of the prose
    rows = [(k, " ".join(f"w{(k * 31 + j * 7) % 997}" for j in range(40)), "en", "prose") for k in range(250)]
    rows += [(1000 + k, " ".join(f"| w{(k * 31 + j * 7) % 997}" for j in range(40)), "en", "tables") for k in range(250)]
    assert Q.filter_quality(spark.createDataFrame(rows, SCHEMA)).count() == 500


def test_columns_nulls_repeats_and_empty(spark):
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(1, text, None, None, 5, "r"), (1, text, None, None, 5, "r"), (None, text, "en", "s", 6, "t"), (2, None, "en", "s", 7, "u")]
    df = spark.createDataFrame(rows, SCHEMA + ", quality int, row string")
    out = Q.filter_quality(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.quality) for r in out.collect()) == [(0, 6), (1, 5), (1, 5)]
    assert Q.filter_quality(df.limit(0)).count() == 0


def test_main_path_is_native(spark):
    out, _ = Q.judge(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def lines_of(n, seed=0, words=10):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(1000, 9999)}x" for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("measure", ["symbols", "dup_lines", "repeats", "stutters", "long words", "short words"])
def test_every_measure_can_reject(spark, measure):
    """Documents that are outside in one way only; none of the others goes."""
    prose = [(k, "\n".join(lines_of(40, k)), "en", "a") for k in range(120)]
    base = lines_of(200, 500)
    bad = {"symbols": [x.replace("w1", "$1") for x in base], "dup_lines": [*base[:60], *["ok so"] * 30],
           "repeats": [*base, *base[:14]], "stutters": [x + " " + x.split()[-1] for x in base],
           "long words": [x.replace("x", "xxxx") for x in base], "short words": [x.replace("x", "").replace("w", "") for x in base]}[measure]
    out = {r.doc_id for r in Q.filter_quality(spark.createDataFrame([*prose, (1000, "\n".join(bad), "en", "a")], SCHEMA)).collect()}
    r = Q.judge(spark.createDataFrame([(1000, "\n".join(bad), "en", "a")], SCHEMA), keep=["doc_id", "lang", "source"])[0].first()[-1]
    assert not r.base_failed and out == {k for k, *_ in prose}


def test_a_few_events_reject_no_short_document(spark):
    prose = [(k, "\n".join(lines_of(40, k)), "en", "a") for k in range(120)]
    short = [(1000, "one two three four five six seven eight nine $ # *", "en", "a"), (1001, "one one two two three three four five six seven eight", "en", "a")]
    out = {r.doc_id for r in Q.filter_quality(spark.createDataFrame(prose + [short[0]], SCHEMA)).collect()}
    assert out == {r[0] for r in prose} | {1000}
    rows = Q.judge(spark.createDataFrame(prose + short, SCHEMA))[0].filter("doc_id >= 1000").collect()
    assert len(rows) == 2


def test_merged_sketches_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de"]), rng.choice("ab"), "m", rng.randrange(8)) for _ in range(300)] + [("de", "rare", "m", 7)]
    df = Q.sketches(spark.createDataFrame(rows, "lang string, source string, measure string, bucket int"))
    got = {(r.lang, r.source): (r.q25, r.q50, r.q75) for r in Q.quantiles(Q.merged(df, 20)).collect()}
    from fractions import Fraction
    for lang, source in {r[:2] for r in rows}:
        own, tongue, every = ([b for l, s, _, b in rows if test(l, s)] for test in (
            lambda l, s: (l, s) == (lang, source), lambda l, s: l == lang, lambda l, s: True))  # noqa: B023,E741
        weight = {b: own.count(b) + 20 * (Fraction(tongue.count(b), len(tongue)) + Fraction(every.count(b), len(every))) for b in range(8)}
        total, run, want = sum(weight.values()), 0, []
        for q in (1, 2, 3):
            run = 0
            for b in range(8):
                run += weight[b]
                if 4 * run >= q * total and weight[b]:
                    want.append(b)              # below 64 a bucket is a value
                    break
        assert got[lang, source] == tuple(want)


def test_labelled_documents(spark):
    """Of the labelled documents that pass the base rule, clean ones stay and bad ones go."""
    from tests.conftest import SF_MID
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    judged, name = Q.judge(docs, keep=["doc_id", "lang", "source"])
    rows = judged.select("doc_id", f"{name}.base_failed", f"{name}.kept").join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 200 and sum(good) >= 0.99 * len(good) and len(bad) > 10 and sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["ok"], r["problems"]
