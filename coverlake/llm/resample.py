"""Target-distribution importance resampling (12): array-scored weights, a bracketed cutoff.

Features (runs of one to three words) fall into ``BUCKETS`` buckets by the crc32
of their bytes.  Both tables are counted per bucket; the gains of the buckets are
one array, which every task gets (its length is a parameter), and a document's
weight is the sum of the gains at its features.  A word's crc32 is computed once;
that of a run follows from those of its words, since a crc32 is linear: the bytes
that come after only shift it.

The documents drawn are those with the highest scores (weight plus a keyed Gumbel
draw, so this is sampling without replacement in proportion to the weights).  The
cutoff is found without sorting all scores: a mergeable quantile sketch gives two
scores that should lie around it, exact counts outside of them tell whether they
do (if not, the bracket is widened and counted again), and only the rows in the
bracket are sorted.

Defined cases: null or empty text has no words, no features, weight 0; a null id
counts as an empty one in the draw and sorts first in ties; repeated rows are drawn
one by one, and equal ones in any order; an empty table gives an empty result, an
empty target table gains that follow from zero counts; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import blocks, read, small_batches, stored, utf8, word_bounds
from coverlake.operators.splits import global_row_number

BUCKETS = 10_000
RUN = 3
SEED = 42
MIN_WORDS = 20
SHARE = 5
"""Documents drawn, in hundredths of those with ``MIN_WORDS`` words."""
ACCURACY = 1000
"""The sketch's rank error is the number of rows over this, whatever that number."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_LONG = 64
"""Words of more bytes take the plain crc32."""
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of each byte in the usual reflected form (polynomial
    0xEDB88320), and what a crc32 becomes when n zero bytes follow, by n and by
    its four bytes."""
    global _tables
    if _tables is None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
        shift = np.zeros((_LONG + 2, 4, 256), dtype=np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
        for n in range(1, _LONG + 2):
            shift[n] = one[shift[n - 1] & 255] ^ (shift[n - 1] >> 8)
        _tables = one, shift
    return _tables


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The crc32 when ``n`` zero bytes follow (without the final complement)."""
    _, shift = tables()
    n, crc = n.copy(), crc.copy()
    while True:
        step = np.minimum(n, _LONG + 1)
        crc = (shift[step, 0, crc & 255] ^ shift[step, 1, (crc >> 8) & 255]
               ^ shift[step, 2, (crc >> 16) & 255] ^ shift[step, 3, crc >> 24])
        n -= step
        if not n.any():
            return crc


def word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each word, a byte of all words at a time."""
    one, _ = tables()
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(-length, kind="stable")
    by_length = -length[order]
    n_long = int(np.searchsorted(by_length, -_LONG))
    for k in order[:n_long].tolist():
        out[k] = zlib.crc32(data[start[k]:start[k] + length[k]].tobytes())
    order, by_length = order[n_long:], by_length[n_long:]
    state, at = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32), start[order]
    for k in range(-int(by_length[0]) if len(order) else 0):
        live = int(np.searchsorted(by_length, -k))
        state[:live] = one[(state[:live] ^ data[at[:live] + k]) & 255] ^ (state[:live] >> 8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN,
             buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words per text, [(bucket, text number) of the runs of k words for each k])."""
    data = _LOWER[data]
    start, end, counts = word_bounds(data, offsets, _APART)
    length = end - start
    crc = word_crcs(data, start, length)
    text = np.repeat(np.arange(len(counts)), counts)
    spaced = crc ^ shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), length)       # of a blank and the word
    out, runs = [(crc % np.uint32(buckets), text)], crc
    for k in range(2, run + 1):
        m = len(crc) - k + 1
        if m <= 0:
            break
        runs = shifted(runs[:m], length[k - 1:] + 1) ^ spaced[k - 1:]
        same = text[:m] == text[k - 1:]
        out.append(((runs % np.uint32(buckets))[same], text[:m][same]))
    return counts, out


def _texts(df: DataFrame, text_col: str, *others: Column) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{text_col}`").cast("string").alias("text"), *others)


def bucket_counts(df: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """Features of the table in each bucket: ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                lo = offsets[i]
                for bucket, _ in features(data[lo:offsets[j]], offsets[i:j + 1] - lo, run, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = _texts(df, text_col).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """1000 times the log of the ratio of the smoothed shares, rounded down."""
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus, target)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    array = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                lo = offsets[i]
                counts, runs = features(data[lo:offsets[j]], offsets[i:j + 1] - lo, run, buckets)
                n, weight = np.zeros(j - i, dtype=np.int64), np.zeros(j - i, dtype=np.int64)
                for bucket, text in runs:
                    n += np.bincount(text, minlength=j - i)
                    before = np.concatenate([[0], np.cumsum(array.value[bucket])])
                    edge = np.searchsorted(text, np.arange(j - i + 1))
                    weight += before[edge[1:]] - before[edge[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(n), pa.array(weight)],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return _texts(docs, text_col, F.col(f"`{id_col}`").cast("bigint").alias("id")).mapInArrow(
        score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw of the key, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def bracketed_cutoff(rows: DataFrame, score: str, order: list[Column], k: int, accuracy: int = ACCURACY):
    """The ``k``-th row in ``order`` (descending ``score`` first), and how often
    the bracket was counted.  ``rows`` has ``k`` rows at least."""
    n = rows.count()
    value, share, reach, tries = F.col(score), 1 - k / n, 2, 0
    while True:
        tries += 1
        ends = [max(0.0, share - reach / accuracy), min(1.0, share + reach / accuracy)]
        lo, hi = rows.agg(F.percentile_approx(value, ends, accuracy).alias("q")).first()["q"]
        least, most = (None if ends[0] == 0 else lo), (None if ends[1] == 1 else hi)
        above = F.count_if(value > F.lit(most)) if most is not None else F.lit(0).cast("bigint")
        below = F.count_if(value < F.lit(least)) if least is not None else F.lit(0).cast("bigint")
        out = rows.agg(above.alias("above"), below.alias("below")).first()
        if out["above"] < k <= n - out["below"]:
            break
        reach *= 4
    inside = rows.filter((F.lit(True) if most is None else value <= F.lit(most)) & (F.lit(True) if least is None else value >= F.lit(least)))
    place = global_row_number(inside, order, col="place")
    return place.filter(F.col("place") == k - 1 - out["above"]).first(), tries


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row (rank null: not drawn)."""
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, target_text_col, run, buckets))
    scored = stored(weights(docs, gain, id_col, text_col, run).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    k = share * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    cut, _ = bracketed_cutoff(able.select("score", "doc_id"), "score", order, k)
    last = F.lit(cut["doc_id"]).cast("bigint")
    at_most = F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= last, F.lit(False))
    first = (F.col("n_words") >= min_words) & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & at_most))
    drawn = global_row_number(scored.filter(first).select(*out), order, col="rank")
    rank = F.when(F.col("rank") < k, F.col("rank") + 1)          # equal rows at the cutoff: as many as are due
    return drawn.select(*out, rank.cast("bigint").alias("rank")).unionByName(
        scored.filter(~first).select(*out, F.lit(None).cast("bigint").alias("rank")))


def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


RESAMPLE_SQL = f"""
WITH RECURSIVE bytes AS (SELECT b, xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END) AS v, 1 AS step FROM (SELECT unnest(generate_series(0, 255)) AS b)
  UNION ALL SELECT b, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bytes WHERE step < 8),
one AS (SELECT b, v FROM bytes WHERE step = 8),
lowered AS (SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
listed AS (SELECT side, id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered),
runs AS (SELECT side, id, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS f
         FROM listed, (SELECT unnest(generate_series(1, {RUN})) AS k) WHERE len(w) >= k),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
longest AS (SELECT max(length(h)) // 2 AS n FROM hexed),
moved AS (SELECT b, 0 AS after, v FROM one
  UNION ALL SELECT m.b, m.after + 1, xor(o.v, m.v >> 8) FROM moved m JOIN one o ON o.b = m.v & 255 WHERE m.after < (SELECT n FROM longest)),
bare AS (SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS v UNION ALL SELECT b.n + 1, xor(o.v, b.v >> 8) FROM bare b JOIN one o ON o.b = b.v & 255 WHERE b.n < (SELECT n FROM longest)),
digits AS (SELECT b, printf('%02X', b) AS hh FROM one),
spread AS (SELECT f, length(h) // 2 AS n, unnest(generate_series(0, length(h) // 2 - 1)) AS i, h FROM hexed),
crcs AS (SELECT s.f, xor(xor(bit_xor(m.v), any_value(z.v)), 4294967295) % {BUCKETS} AS bucket FROM spread s JOIN digits d ON d.hh = substr(s.h, 2*s.i + 1, 2)
         JOIN moved m ON m.b = d.b AND m.after = s.n - 1 - s.i JOIN bare z ON z.n = s.n GROUP BY s.f),
placed AS (SELECT side, id, bucket FROM runs JOIN crcs USING (f)),
counted AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM placed GROUP BY bucket),
whole AS (SELECT sum(s) AS s, sum(t) AS t FROM counted),
gain AS (SELECT bucket, CAST(floor(1000*ln(CAST((c.t + 1)*(w.s + {BUCKETS}) AS DOUBLE)/CAST((c.s + 1)*(w.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g FROM counted c, whole w),
weighed AS (SELECT id, count(*) AS n, sum(g) AS g FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT l.id AS doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight, len(l.w) AS n_words,
           CAST(coalesce(g, 0) AS BIGINT) + CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || l.id), 1, 8) AS BIGINT) + 0.5)/4294967296.0))) AS BIGINT) AS score
           FROM listed l LEFT JOIN weighed USING (id) WHERE l.side = 0),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN d.rank <= {SHARE}*d.n // 100 THEN d.rank END AS rank FROM scored s LEFT JOIN drawn d USING (doc_id)"""
