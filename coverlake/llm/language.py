"""Language ID (7): family first, then one-versus-one linear SVMs within it.

A text's features are its letter bigrams and trigrams (lower case, over UTF-8
bytes, everything but letters as one blank), counted over the whole text into
``BINS`` hashed bins, square-rooted and scaled to length one.  Linear support
vector machines tell the families apart (one against the rest) and, within a
family, each pair of languages; the pairs vote.

The training rows are a bounded sample: about ``PER_LANGUAGE`` documents of
each language (``PER_FAMILY`` of each family for the first step), taken by a
hash of the id, so a frequent language does not crowd out the others.  Each
classifier is a group of its own in Spark; its weights (``BINS`` numbers) are
what the driver and the tasks hold.  All texts are predicted where they are.

Defined cases: null text, or text without a letter, is ``und`` with score 0,
as is every text if nothing could be learned; rows without an id are
predicted, are not held out, and are not learned from; languages outside the
family table are families of their own; ties in the vote go to the larger sum
of margins, then to the first name; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import binary, blocks, read, small_batches, utf8

# The family of some languages (ISO 639-1).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

BINS = 4096
PER_LANGUAGE = 500
PER_FAMILY = 500
COST = 10.0
EPOCHS = 20

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return FAMILY.get(lang, f"only {lang}")


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Feature rows (float32) of blocks of lower-cased texts."""
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        lo = offsets[i]
        text = _LETTER[data[lo:offsets[j]]].astype(np.uint32)
        n = j - i
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets[i:j + 1]))
        count = np.zeros(n * BINS)
        for size in (2, 3):
            m = len(text) - size + 1
            if m <= 0:
                continue
            code = text[:m] * np.uint32(1) + np.uint32(size << 24)
            for k in range(1, size):
                code = code * np.uint32(257) + text[k:k + m]
            inside = row[:m] == row[size - 1:]
            bin_ = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            count += np.bincount(row[:m][inside] * BINS + bin_[inside], minlength=n * BINS)
        x = np.sqrt(count).astype(np.float32).reshape(n, BINS)
        yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, positive: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (with a bias as the last one) of a linear support vector
    machine, by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    size, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(x)):
            new = min(max(alpha[k] - (y[k] * (w @ x[k]) - 1) / size[k], 0.0), cost)
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                alpha[k] = new
    return w.astype(np.float32)


class Model:
    """Families, their languages, and the weights of the classifiers."""

    def __init__(self, weights: dict[tuple[str, str, str], np.ndarray], langs: list[str]):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.members.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(self.members)
        self.family = np.array([weights["family", f, ""] for f in self.names]) if len(self.names) > 1 else None
        self.pairs = {f: [(a, b, weights["pair", m[a], m[b]]) for a in range(len(m)) for b in range(a + 1, len(m))]
                      for f, m in self.members.items()}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each feature row."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.family is None:
            which, score = np.zeros(len(x), np.int64), np.ones(len(x))
        else:
            margin = x @ self.family.T
            share = np.exp(2 * (margin - margin.max(axis=1, keepdims=True)))
            which = margin.argmax(axis=1)
            score = share.max(axis=1) / share.sum(axis=1)
        out = np.empty(len(x), dtype=object)
        for k, name in enumerate(self.names):
            rows = np.flatnonzero(which == k)
            langs = self.members[name]
            votes, total, sure = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for a, b, w in self.pairs[name]:
                margin = x[rows] @ w
                chance = 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
                for c, won, sign in ((a, margin >= 0, 1), (b, margin < 0, -1)):
                    votes[:, c] += won
                    total[:, c] += sign * margin
                    sure[:, c] += chance if sign > 0 else 1 - chance
            best = np.array([max(range(len(langs)), key=lambda c: (v[c], t[c], -c)) for v, t in zip(votes, total)], dtype=np.int64)
            out[rows] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                score[rows] *= sure[np.arange(len(rows)), best] / (len(langs) - 1)
        return list(out), np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame) -> Model | None:
    """The model of rows (id, text, lang), lower-cased texts with a letter."""
    spark = labelled.sparkSession
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per language
    if not counts:
        return None
    langs = sorted(counts)
    families: dict[str, int] = {}
    for lang in langs:
        families[family_of(lang)] = families.get(family_of(lang), 0) + counts[lang]
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000.0
    plan = []                # (language, classifier, part, share of the language's rows, positive)
    for lang in langs:
        mine = family_of(lang)
        if len(families) > 1:
            plan += [(lang, "family", f, "", PER_FAMILY / families[mine], f == mine) for f in families]
        plan += [(lang, "pair", *sorted((lang, other)), PER_LANGUAGE / counts[lang], lang < other)
                 for other in langs if other != lang and family_of(other) == mine]
    if not plan:
        return Model({}, langs)
    most = {lang: max([p[4] for p in plan if p[0] == lang], default=0.0) for lang in langs}
    shares = spark.createDataFrame([(a, min(1.0, s)) for a, s in most.items()], "lang string, most double")
    sample = labelled.join(F.broadcast(shares), "lang").withColumn("place", place).filter("place < most")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in features(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), binary([v.tobytes() for v in x])],
                                                 names=["lang", "place", "x"])
                at += len(x)

    rows = sample.select("lang", "place", "text").mapInArrow(vectors, "lang string, place double, x binary")
    jobs = spark.createDataFrame([(a, k, p, q, float(min(1.0, s)), y) for a, k, p, q, s, y in plan],
                                 "lang string, kind string, p string, q string, share double, positive boolean")
    dealt = rows.join(F.broadcast(jobs), "lang").filter("place < share").select("kind", "p", "q", "positive", "x")

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["x"]), np.float32).reshape(len(group), BINS)
        order = np.lexsort((group["x"].map(zlib.crc32).to_numpy(), group["positive"].to_numpy()))
        w = svm(x[order], group["positive"].to_numpy()[order])
        return pd.DataFrame({"kind": [key[0]], "p": [key[1]], "q": [key[2]], "w": [w.tobytes()]})

    fitted = dealt.groupBy("kind", "p", "q").applyInPandas(fit, "kind string, p string, q string, w binary").collect()
    return Model({(r.kind, r.p, r.q): np.frombuffer(r.w, np.float32) for r in fitted}, langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.  Learned from rows with
    an id and a language that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    key, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(key.alias("id"), held_out(key).alias("out"), F.when(letter, F.lower(text)).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = learn(rows.filter("id is not null and lang is not null and not out and text is not null").select("id", "text", "lang"))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for x in features(batch.column(2)):
                pred, score = shared.value.predict(x) if shared.value else (["und"] * len(x), np.zeros(len(x)))
                langs += pred
                scores += score.tolist()
            known = batch.column(2).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([a if k else "und" for a, k in zip(langs, known)], pa.string()),
                pa.array([s if k else 0.0 for s, k in zip(scores, known)], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("id", "out", "text").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
