import hashlib
import random
import re

import pytest

from coverlake.llm import secrets as S
from coverlake.llm.automata import learn

BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def brute(text):
    out = []
    for k, (kind, (p, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), k, kind, m.end()) for m in p.finditer(text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans_match_brute_force():
    rng = random.Random(5)
    pool = ["password", "PassWD", "Secret", "token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMN", "0123456789abcdef",
            "deadbeef", "x", "é", "ſ", "K", "\n", "-", ".", "/", "abcdefabcdefabcdef", "Z9"]
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert [s[:3] for s in S.base_spans(text)] == brute(text)


def test_automaton_accepts_the_format_and_no_other():
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    a = learn(["AKIA" + "".join(rng.choices(letters, k=16)) for _ in range(300)])
    same = a.score("AKIA" + "".join(rng.choices(letters, k=16)))
    assert same > -4 and a.score("ZZZZAKIA0123") < -8 and a.score("deadbeefdeadbeef") < -8


@pytest.fixture
def docs(spark):
    rng = random.Random(2)
    digest = lambda n: "".join(rng.choices("0123456789ABCDEF", k=n))
    rows = [(k, f"some words token = \"{digest(32)}\" and more") for k in range(60)]
    rows += [(100, f"a bare {digest(32)} here"), (101, "plain prose with internationalisation2 words"), (102, None), (103, ""), (None, "x " * 20000),
             (100, "repeated id")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'b' as base", "1 as candidates", "9 as n_chars")


def test_learned_spans_add_to_base_ones(docs):
    found, formats = S.train(docs)
    rows = S.secret_spans(found, formats).collect()
    learned = {(r.doc_id, s.value[:0], s.end - s.start) for r in rows for s in r.learned}
    assert learned == {(100, "", 32)}
    assert sum(len(r.base) for r in rows) == 60 and len(rows) == docs.count()


def test_redaction_keeps_rows_and_columns(docs):
    out = S.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert (0, "some words [SECRET]\" and more") in rows and (100, "a bare [SECRET] here") in rows
    assert rows[0, "some words [SECRET]\" and more"].n_chars == len("some words [SECRET]\" and more")
    assert rows[102, None].n_chars == 9 and rows[100, "repeated id"].n_chars == 9


def test_query_digest(spark):
    from tests.conftest import SF_SMALL
    rows = {r.doc_id: r for r in S.q_secrets(spark, SF_SMALL).collect()}
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for t in texts:
        base = brute(t.text or "")
        r = rows[t.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.redact_secrets(df).count() == 0
    found, formats = S.train(spark.createDataFrame([(1, "abc 123456789abcZZZ")], "doc_id bigint, text string"))
    assert formats == [] and S.secret_spans(found, formats).first().learned == []


def brute_runs(text, base):
    """Maximal runs by hand: (start, end) of those that no single base span holds."""
    out, at = [], 0
    ok = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(text):
        end = at
        while end < len(text) and text[end] in ok:
            end += 1
        if end - at >= 12:
            a, b = at, end
            while a < b and text[a] in ".-":
                a += 1
            while b > a and text[b - 1] in ".-":
                b -= 1
            if b - a >= 12 and not any(s[1] <= a and s[2] >= b for s in base):
                out.append((a, b))
        at = max(end, at + 1)
    return out


def test_every_run_is_a_candidate():
    rng = random.Random(8)
    pool = ["tok_", "9f86d081884c7d65", "ZkQw8YtR2", " ", "password=", "abcdefghijklm", "...", "-", "NoDigitsInThisOne", "é", "\n", "AKIA", "ABCDEFGHIJKLMNOPQR", ".", "/"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        base = S.base_spans(text)
        found = S.candidates(text, base)
        assert [(a, b) for _, a, b, _ in found] == brute_runs(text, base)
        for kind, a, b, value in found:
            assert value == text[a:b] and (kind == S.LEARNED) == any(s[1] < b and s[2] > a for s in base)


def test_formats_without_digits_and_ordinary_words(spark):
    """Credentials of letters are found where they stand bare; ordinary long words are not."""
    rng = random.Random(3)
    secret = lambda: "KEY-" + "".join(rng.choices("QWXZJKV", k=20))
    words = ["internationalisation", "responsibilities", "unquestionably", "characteristics", "misunderstanding", "straightforward"]
    rows = [(k, f"secret: {secret()} and {rng.choice(words)}{rng.choice(['', 's', 'ly'])}") for k in range(200)]
    planted = {1000 + k: secret() for k in range(50)}
    rows += [(k, f"bare {v}. {rng.choice(words)}") for k, v in planted.items()]
    found, formats = S.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    learned = {r.doc_id: [s.value for s in r.learned] for r in S.secret_spans(found, formats).collect() if r.learned}
    right = sum(learned.get(k) == [v] for k, v in planted.items())
    assert right >= 45 and not set(learned) - set(planted)         # recall 0.9 or more, no false find


def test_long_values_train_nothing(spark):
    long = "a1" * 200
    found = S.find_secrets(spark.createDataFrame([(1, f"token={long}"), (2, "token=abcdefgh123456")], "doc_id bigint, text string"))
    assert S.labelled(found)["assign"] == ["abcdefgh123456"]


def test_learned_spans_of_the_query_are_those_of_a_plain_scan(spark):
    """The query's spans against base patterns, runs and likelihoods applied text by text."""
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    _, formats = S.train(docs)
    rows = {r.doc_id: r for r in S.q_secrets(spark, SF_SMALL).collect()}
    order, scored = {"assign": 0, "access": 1, "hex": 2, "learned": 3}, 0
    for t in docs.collect():
        text = t.text or ""
        spans = [(a, order[k], f"{k}:{a}:{b}") for k, a, b in brute(text)]
        runs = brute_runs(text, [(k, a, b) for k, a, b in brute(text)])
        scored += len(runs)
        for a, b in runs:
            word = [m.score(text[a:b]) for k, m, _ in formats if k == S.ORDINARY]
            if any(m.score(text[a:b]) >= max([least, *word]) for k, m, least in formats if k != S.ORDINARY):
                spans.append((a, 3, f"learned:{a}:{b}"))
        assert rows[t.doc_id].spans == ",".join(s[2] for s in sorted(spans)) and rows[t.doc_id].n_scored == len(runs)
    assert scored > 500
