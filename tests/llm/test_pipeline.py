import re

import numpy as np
import sentencepiece

import corpus_pipeline
from coverlake.llm import decontaminate as D
from coverlake.llm import pieces, secrets
from coverlake.llm.common import read
from coverlake.llm.quality import QUALITY_CTES
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import smith_waterman
from tests.llm.test_near_copies import brute
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_secrets import brute_runs
from tests.oracle_compare import duck


def leaked(text, items):
    """Full Smith-Waterman, but for pairs that cannot reach the limit: a score is
    at most that of all item words which the text holds anywhere."""
    words = [w for w in re.split(r"[\x00-\x20!-/:-@\[-`{-~]+", text.lower()) if w]
    known = set(words)
    return any(len(i) >= D.SHORTEST and sum(w in known for w in i) >= D.LIMIT * len(i)
               and smith_waterman(i, words) / (D.MATCH * len(i)) >= D.LIMIT for i in items)


def redacted(text, formats):
    """Base patterns and accepted runs, character by character."""
    spans = [(a, b) for _, a, b in brute_spans(text)]
    for a, b in brute_runs(text, brute_spans(text)):
        score = {kind: m.score(text[a:b]) for kind, m, _ in formats}
        if any(score[kind] >= max(least, score.get(secrets.ORDINARY, -1e9)) for kind, _, least in formats if kind != secrets.ORDINARY):
            spans.append((a, b))
    hidden = np.zeros(len(text) + 1, bool)
    starts = set()
    for a, b in sorted(spans):
        if not hidden[a]:
            starts.add(a)
        hidden[a:b] = True
    return "".join(("[SECRET]" if k in starts else "") + ("" if hidden[k] else c) for k, c in enumerate(text))


def test_pipeline_matches_a_brute_force_version(spark):
    """Each stage by other means: SQL, all pairs, full alignment, plain scans, the library."""
    kept = {r[0] for r in duck(SF_SMALL).execute(f"WITH {QUALITY_CTES} SELECT doc_id FROM judged WHERE kept").fetchall()}
    rows = [r for r in read(spark, SF_SMALL, "documents").collect() if r.doc_id in kept]
    classes = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if classes[r.doc_id][0] == r.doc_id]
    items = [[w for w in re.split(r"[\x00-\x20!-/:-@\[-`{-~]+", r.text.lower()) if w] for r in read(spark, SF_SMALL, "benchmark").collect()]
    n = len(rows)
    rows = [r for r in rows if not leaked(r.text, items)]
    assert len(rows) < n
    _, formats = secrets.train(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id bigint, text string"))
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = {r.doc_id: lib.encode(redacted(r.text, formats)) for r in rows}
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "piece_ids"]
    got = {r.doc_id: list(r.piece_ids) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[d], want[d]) for d in got)


def test_stages_take_very_long_texts_and_shared_ids(spark):
    rng = np.random.default_rng(1)
    text = lambda n: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 50_000, 12)) for _ in range(n))
    rows = [(1, text(12_000), "en", "s", 0), (1, text(30), "en", "s", 0), (2, text(40), "en", "s", 0), (3, "x" * 300_000 + " " + text(20), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    out = docs.collect()
    assert {r.doc_id for r in out} >= {1, 2} and sum(r.doc_id == 1 for r in out) == 2 and max(len(r.piece_ids) for r in out) > 300_000


def test_stages_take_empty_tables_and_keep_columns(spark):
    docs = read(spark, SF_SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d e f g h i j k l", None, None, None, "x"), (1, "a b c d e f g h i j k l", None, None, None, "x"),
            (None, "m n o p q r s t u v w", "en", "s", 3, "y"), (2, None, "en", "s", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert sorted((r.doc_id or 0, r.quality) for r in docs.collect()) == [(0, "y"), (1, "x")]
