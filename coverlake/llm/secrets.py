"""Secret scans (1): formats learned by grammar inference.

Three patterns give the base spans.  Their values are the labelled
credentials: a bounded sample of distinct ones per kind (the lowest hashes,
``SAMPLE``) trains one probabilistic automaton per kind by state merging
(``automata.py``).  Every run of 12 or more credential characters in every text is
a candidate, with or without a digit, also the whole run around a base span (only
a run that lies in a base span is that span already).  A bounded sample of the runs
that no base span touches trains one more automaton, that of ordinary words.  A
candidate is added as a ``learned`` span when its likelihood under some format is
as high as that of the labelled credentials (the ``CUT`` quantile of their scores)
and higher than as an ordinary word.

The texts are scanned once, in whole; the spans and candidates are stored,
and only those are scored.  The driver holds the samples (at most 4 x ``SAMPLE``
strings; values of more than ``LONGEST`` characters train nothing, so no format
ends where a value was cut) and the automata.

Defined cases: null text counts as empty; repeated rows are scanned one by
one; without a labelled credential nothing is added; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.automata import Automaton, learn
from coverlake.llm.common import free_name, read, small_batches, stored

# The base patterns (ASCII letters in either case for the keyword).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

LEARNED = "learned"
ORDINARY = "ordinary"
HEX_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
TRIMMED = ".-"
"""Signs that belong to the sentence when a run begins or ends with them."""
LONG_HEX = re.compile(r"[0-9a-f]{16,}")

SAMPLE = 400
"""Labelled credentials of a kind that train its automaton."""
LONGEST = 256
"""Longer values are left out of the training sample."""
CUT = 0.02
"""Share of the labelled credentials that may score below the limit."""

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a maximal run of [0-9a-f] that is long enough: what HEX gives after its failing matches are dropped
    out += [("hex", m.start(), m.end(), m[0]) for r in HEX_RUN.finditer(text) for m in LONG_HEX.finditer(text, r.start(), r.end())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """All runs of credential characters that do not lie in a base span; the
    kind says whether a base span touches the run (``learned``) or none does
    (``ordinary``)."""
    out, k, covered = [], 0, -1         # base spans before k start at or before a; covered: the furthest end of them
    for m in RUN.finditer(text):
        value = m[0].strip(TRIMMED)
        if len(value) < 12:
            continue
        a = m.start() + m[0].index(value)
        b = a + len(value)
        while k < len(base) and base[k][1] <= a:
            covered = max(covered, base[k][2])
            k += 1
        if covered >= b:
            continue
        touched = covered > a or (k < len(base) and base[k][1] < b)
        out.append((LEARNED if touched else ORDINARY, a, b, value))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and candidates (arrays of kind, start, end, value) of each document."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                found = base_spans(text)
                base.append(found)
                more.append(candidates(text, found))
            as_rows = lambda rows: pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in r]
                                             for r in rows], type=span)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_rows(base), as_rows(more)],
                                             names=["doc_id", "base", "candidates"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id bigint, base array<{SPAN}>, candidates array<{SPAN}>")


def labelled(found: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """The training samples: per kind the ``sample`` distinct values of lowest
    hash, and as many ordinary runs."""
    both = found.select(F.explode(F.concat("base", F.filter("candidates", lambda s: s.kind == ORDINARY))).alias("s"))
    values = both.filter(F.length("s.value") <= LONGEST).select("s.kind", "s.value").distinct()
    out = {}
    for kind in (*KINDS, ORDINARY):
        rows = values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        out[kind] = [r.value for r in rows]
    return out


def learn_formats(examples: dict[str, list[str]], cut: float = CUT) -> list[tuple[str, Automaton, float]]:
    """(kind, automaton, lowest score that counts as the kind's format); none
    without a labelled credential."""
    out = []
    for kind, values in examples.items():
        if values and (kind != ORDINARY or out):
            automaton = learn(values)
            scores = sorted(automaton.score(v) for v in values)
            out.append((kind, automaton, scores[int(cut * len(scores))]))
    return out


def format_margin(formats: list[tuple[str, Automaton, float]], value: str) -> float:
    """How far the best format's likelihood is above its limit and above that of
    an ordinary word (0 or more: accepted)."""
    word = max((a.score(value) for kind, a, _ in formats if kind == ORDINARY), default=float("-inf"))
    best = float("-inf")
    for kind, a, least in formats:
        if kind != ORDINARY:
            score = a.score(value)
            best = max(best, min(score - least, score - word))
    return best


def secret_spans(found: DataFrame, formats: list[tuple[str, Automaton, float]]) -> DataFrame:
    """``found`` with ``learned``: the accepted candidates and their margin."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,value:string,margin:double>>")
    def accept(rows: pd.Series) -> pd.Series:
        def one(spans):
            scored = ((dict(s), format_margin(formats, s["value"])) for s in (spans if spans is not None else ()))
            return [s | {"kind": LEARNED, "margin": m} for s, m in scored if m >= 0]
        return rows.map(one)

    return found.withColumn("learned", accept("candidates"))


def train(docs: DataFrame, **columns) -> tuple[DataFrame, list[tuple[str, Automaton, float]]]:
    """What was found in the documents (stored), and the learned formats."""
    found = stored(find_secrets(docs, **columns), "secrets")
    return found, learn_formats(labelled(found))


def redact(text: str | None, formats: list[tuple[str, Automaton, float]], mark: str = "[SECRET]") -> str | None:
    """The text with every span, base or learned, replaced by ``mark``;
    overlapping spans are replaced as one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted([s[1:3] for s in base] + [c[1:3] for c in candidates(text, base) if format_margin(formats, c[3]) >= 0])
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced and ``length_col``
    (if there) set to the new length of a changed text; every row stays."""
    _, formats = train(docs, id_col=id_col, text_col=text_col)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, formats))

    new = free_name(docs, "redacted")
    text = F.col(f"`{text_col}`")
    out = docs.withColumn(new, clean(text))
    columns = {text_col: F.col(new)}
    if length_col in docs.columns:
        n = F.col(f"`{length_col}`")
        columns[length_col] = F.when(F.col(new).eqNullSafe(text), n).otherwise(F.length(new)).cast(docs.schema[length_col].dataType)
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def span_list(spans: Column) -> Column:
    """kind:start:end of an array of spans by start, then kind, comma-joined."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, LEARNED)]), s.kind)
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s).alias("rank"), F.concat_ws(":", s.kind, s.start, s.end).alias("span")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s.span), ",")


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, formats = train(read(spark, sf_dir, "documents"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    out = secret_spans(found, formats)
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_list(plain("base")), 256).alias("base_sha256"),
                      span_list(F.concat(plain("base"), plain("learned"))).alias("spans"),
                      F.size("learned").cast("bigint").alias("n_learned"), F.size("candidates").cast("bigint").alias("n_scored"))
