"""Phrase collocation mining (11): prefix-free parsing, counts by distinct chunk.

Texts are parsed into overlapping chunks cut where the content says so: a
chunk begins at each word whose pair with the word before hashes to 0 modulo
``PERIOD`` (and at a text's first word), owns the words up to the next
beginning, and carries up to ``max_words - 1`` words more of the same piece.
Equal passages are cut alike wherever they stand, so copies fall on the same
chunks: the distinct chunks are the dictionary, their numbers of occurrences
the parse frequencies.  Every n-gram is counted in the one chunk that owns its
first word, times that chunk's frequency; the overlap is counted nowhere else.

Only phrases of ``min_count`` occurrences matter, and a part of a phrase is at
least as frequent as the phrase.  So words are counted first, then, by hash, pairs of
frequent words and triples of frequent pairs; what is frequent sets bits of
arrays of a fixed size (``BITS``), which the next pass is sent.  The last one
counts the phrases themselves, as text, where all words, pairs and triples
have their bit.  A bit set by another hash only leaves more to count, so the
counts are exact at any size; a full array would leave more work, not another
result.

Within a block of 8 MB equal n-grams are recognised by 64-bit hash before
their text is cut out once.

Defined cases: null or empty text has no words; null language counts as
``und``; repeated rows count as often as they stand there; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverlake.llm.common import blocks, hash_words, mix, read, scratch_path, small_batches, stored, utf8
from coverlake.session import shuffle_partitions

PERIOD = 64
"""Mean number of words that a chunk owns."""
MAX_WORDS = 5
MIN_COUNT = 100
SHARE = 100
TOP = 2000
BITS = 26
"""log2 of the bits of a frequent-hash array (8 MB), whatever the input."""
BLOCK = 8 << 20
"""Text bytes that are counted together."""

_K = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
_JOINTS = np.zeros(256, dtype=bool)
_JOINTS[[10, 32]] = True
"""Bytes between the words of a chunk: a blank, or a line feed between pieces."""

CHUNKS = "lang string, own int, chunk string, n bigint"


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (length[0] of them), first[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def parse_block(data: np.ndarray, offsets: np.ndarray, period: int,
                overlap: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, owned words, chunk) of the chunks of consecutive texts."""
    data = _LOWER[data]
    words, start, end, counts = hash_words(data, offsets, _APART)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    text = np.repeat(np.arange(len(counts)), counts)
    opens = np.ones(n, dtype=bool)
    opens[1:] = text[1:] != text[:-1]
    broken = np.ones(n, dtype=bool)             # a piece ends after this word
    seen = np.concatenate([[0], np.cumsum(_BREAK[data])])
    broken[:-1] = opens[1:] | (seen[start[1:]] != seen[end[:-1]])
    cut = opens.copy()
    cut[1:] |= mix(words[1:] * _K + words[:-1]) % np.uint64(period) == 0
    first = np.flatnonzero(cut)
    own = np.diff(np.append(first, n))
    last = first + own
    going = np.ones(len(first), dtype=bool)
    for _ in range(overlap):
        going &= ~broken[last - 1]
        last = last + going
    inside = ranges(first, last - first)
    width = (end - start)[inside] + 1
    out = np.append(data, np.uint8(10))[ranges(start[inside], width)]
    joint = np.cumsum(width) - 1
    out[joint] = np.where(broken[inside], 10, 32)
    closing = np.cumsum(last - first) - 1       # the last word of each chunk
    out[joint[closing]] = 10
    bounds = np.concatenate([[0], joint[closing] + 1]).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    return text[first], own.astype(np.int32), chunks


def parse(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", period: int = PERIOD,
          overlap: int = MAX_WORDS - 1) -> DataFrame:
    """The dictionary: each language's distinct chunks with the number of words
    that they own and the number of times that the parse holds them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                lo = offsets[i]
                text, own, chunks = parse_block(data[lo:offsets[j]], offsets[i:j + 1] - lo, period, overlap)
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + i)), pa.array(own),
                                                      chunks.cast(pa.string()), pa.array(np.ones(len(own), np.int64))],
                                                     names=["lang", "own", "chunk", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parsed = rows.mapInArrow(run, CHUNKS).groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n"))
    path = scratch_path(docs.sparkSession, "llm-chunks")
    parsed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(parsed.schema).parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK) -> Iterator[pa.Table]:
    """Batches put together up to ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """The words of consecutive chunks: hashes that tell languages apart,
    where pieces end, and the weight of each word (0 in the overlap)."""

    def __init__(self, table: pa.Table):
        data, offsets = utf8(table.column("chunk"))
        self.data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        words, self.start, self.end, counts = hash_words(self.data, offsets, _JOINTS)
        lang = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, self.lang = lang.dictionary, np.repeat(lang.indices.to_numpy(), counts)
        names = [x.encode() for x in self.langs.to_pylist()]
        salt = hash_words(np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)]), np.zeros(256, bool))
        keys = np.zeros(len(names), dtype=np.uint64)
        keys[np.flatnonzero(salt[3])] = salt[0]
        self.words = mix(words + keys[self.lang] * _K)
        first = np.cumsum(counts) - counts
        place = np.arange(len(words)) - np.repeat(first, counts)
        self.weight = np.where(place < np.repeat(table.column("own").to_numpy(), counts),
                               np.repeat(table.column("n").to_numpy(), counts), 0)
        self.broken = self.data[np.minimum(self.end, len(self.data) - 1)] == 10 if len(words) else np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.words)

    def longer(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Hashes of k words from those of k - 1."""
        m = len(self.words) - k + 1
        return mix(grams[:m] * _K + self.words[k - 1:])


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Is the bit set that the top bits of a hash name?"""
    at = hashes >> np.uint64(64 - len(bits).bit_length() - 2)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, all second ones, ..., so
    that the zeros of small numbers stand together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, inverse, weight)
    return keys, n


def range_bits(n: int) -> int:
    """log2 of the number of hash ranges that ``n`` occurrences are dealt into: about a million each."""
    return min(31, max(5, (n >> 20).bit_length()))


def frequent_hashes(chunks: DataFrame, occurrences, min_count: int, rbits: int, bits: int = BITS) -> DataFrame:
    """(bit): the top ``bits`` bits of the hashes that occur ``min_count`` times.
    ``occurrences(table)`` gives hashes and weights.  A task adds up what it holds,
    keeps 32 + ``rbits`` bits of each hash, and sends each range of hashes as a sorted,
    delta-coded block; a range is merged in one place.  Hashes that agree in those
    bits are counted together, which only lets more through."""

    def flush(keys, weight):
        keys, n = summed(np.concatenate(keys), np.concatenate(weight))
        number = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(keys))
        low, rows = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows.append((number[i], packed(np.diff(low[i:j], prepend=np.uint32(0))), packed(n[i:j])))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                                          names=["number", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weight, held = [], [], 0
        for table in gathered(batches, 2):
            hashes, n = occurrences(table)
            if len(hashes):
                k, n = summed(hashes >> np.uint64(32 - rbits), n)
                keys.append(k)
                weight.append(n)
                held += len(k)
            if held > 1 << 21:
                yield flush(keys, weight)
                keys, weight, held = [], [], 0
        if held:
            yield flush(keys, weight)

    def merge(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), np.uint32), dtype=np.uint64) for x in table.column("keys")]
        keys, n = summed(np.concatenate(keys), np.concatenate([unpacked(x.as_py(), np.int64) for x in table.column("n")]))
        often = keys[n >= min_count] | (np.uint64(table.column("number")[0].as_py()) << np.uint64(32))
        return pa.table({"bit": pa.array(np.unique(often >> np.uint64(32 + rbits - bits)).astype(np.int64))})

    sent = chunks.mapInArrow(run, "number bigint, keys binary, n binary")
    return sent.groupBy("number").applyInArrow(merge, "bit bigint")


def bit_array(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """An array of 2 ** ``bits`` bits with those of the column ``bit`` set."""
    place = F.col("bit") + 1
    rows = rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in rows.toLocalIterator():          # 2 ** (bits - 15) rows of 4 kB at most
        lo = (row["bucket"] - 1) * 4096
        part = np.frombuffer(row["bitmap"], dtype=np.uint8)
        out[lo:lo + len(part)] = part[:len(out) - lo]
    return out


def as_text(b: Block, first: np.ndarray, k: int) -> pa.Array:
    """The ``k`` words from each of the words ``first``."""
    width = b.end[first + k - 1] - b.start[first]
    bounds = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    text = b.data[ranges(b.start[first], width)]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(text)).cast(pa.string())


def counted(b: Block, at: np.ndarray, grams: np.ndarray, k: int) -> pa.RecordBatch:
    """lang, words, phrase, n of the n-grams at the words ``at``."""
    _, one, inverse = np.unique(grams[at], return_index=True, return_inverse=True)
    n = np.zeros(len(one), dtype=np.int64)
    np.add.at(n, inverse, b.weight[at])
    one = at[one]
    return pa.RecordBatch.from_arrays([b.langs.take(pa.array(b.lang[one])), pa.array(np.full(len(one), k, np.int32)),
                                       as_text(b, one, k), pa.array(n)], names=["lang", "words", "phrase", "n"])


PHRASES = "lang string, words int, phrase string, n bigint"


def word_counts(chunks: DataFrame, min_count: int) -> DataFrame:
    """(lang, words = 1, phrase, f) of the words that occur ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 2):
            b = Block(table)
            yield counted(b, np.flatnonzero(b.weight), b.words, 1)

    return chunks.mapInArrow(run, PHRASES).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def word_bits(words: DataFrame, bits: int = BITS) -> DataFrame:
    """(bit) of each frequent word, by the hash that ``Block`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.array(np.ones(batch.num_rows, np.int32))
            b = Block(pa.table({"lang": batch.column(0), "own": one, "chunk": batch.column(1), "n": one}))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(b.words >> np.uint64(64 - bits)).astype(np.int64))], names=["bit"])

    return words.select("lang", "phrase").mapInArrow(run, "bit bigint")


def linked(b: Block, words: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each word: may it and the next one be a frequent pair?  And the pairs' hashes."""
    grams, often = b.longer(b.words, 2), has_bit(words, b.words)
    good = ~b.broken[:-1] & often[:-1] & often[1:]
    return (good if pairs is None else good & has_bit(pairs, grams)), grams


def pair_hashes(words):
    """Occurrences of pairs of frequent words."""

    def occurrences(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        b = Block(table)
        if len(b) < 2:
            return b.words[:0], b.weight[:0]
        good, grams = linked(b, words.value)
        at = np.flatnonzero(good & (b.weight[:-1] > 0))
        return grams[at], b.weight[at]

    return occurrences


def triple_hashes(words, pairs):
    """Occurrences of three words whose pairs are frequent."""

    def occurrences(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        b = Block(table)
        if len(b) < 3:
            return b.words[:0], b.weight[:0]
        good, grams = linked(b, words.value, pairs.value)
        at = np.flatnonzero(good[:-1] & good[1:] & (b.weight[:-2] > 0))
        return b.longer(grams, 3)[at], b.weight[at]

    return occurrences


def phrase_counts(chunks: DataFrame, words, pairs, triples, max_words: int, min_count: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases of 2 to ``max_words`` words that occur ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 2):
            b = Block(table)
            if len(b) < 2:
                continue
            pair, grams = linked(b, words.value, pairs.value)
            alive, triple = pair, None
            for k in range(2, min(max_words, len(b)) + 1):
                if k > 2:
                    grams = b.longer(grams, k)
                    if k == 3:
                        triple = pair[:-1] & pair[1:] & has_bit(triples.value, grams)
                        alive = triple
                    else:
                        alive = alive[:len(grams)] & triple[k - 3:k - 3 + len(grams)]
                yield counted(b, np.flatnonzero(alive & (b.weight[:len(grams)] > 0)), grams, k)

    found = chunks.mapInArrow(run, PHRASES)
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def whole(c: Column) -> Column:
    """A long as a decimal whose products have 38 digits: exact up to 1e19 x 1e19."""
    return c.cast("decimal(19,0)")


def scores(phrases: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one stands for.

    It is enough to compare a candidate with those of one word more: a longer
    one that holds it is at most as frequent as the ones between."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), cut).select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - words)").alias("right"))
    lefts = parts.select("lang", F.col("part").alias("left"), F.col("part_f").alias("l"))
    rights = parts.select("lang", F.col("part").alias("right"), F.col("part_f").alias("r"))
    valued = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    valued = valued.withColumn("score", F.call_function("div", whole(F.lit(1000) * F.col("a")) * whole(F.col("n")),
                                                        whole(F.col("l")) * whole(F.col("r"))))
    lowest = valued.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inside = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    longer = (phrases.filter("words > 2").select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase")
              .agg(F.max("f").alias("longer")))
    alone = lowest.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return alone.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, period: int = PERIOD) -> DataFrame:
    """Per language the ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    chunks = parse(docs, lang_col, text_col, period, max_words - 1)
    totals = stored(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")), "totals")
    rbits, send = range_bits(totals.agg(F.sum("n")).first()[0] or 0), spark.sparkContext.broadcast
    words = stored(word_counts(chunks, min_count), "words")
    often = send(bit_array(word_bits(words)))
    pairs = send(bit_array(frequent_hashes(chunks, pair_hashes(often), min_count, rbits)))
    triples = send(bit_array(frequent_hashes(chunks, triple_hashes(often, pairs), min_count, rbits)))
    longer = stored(phrase_counts(chunks, often, pairs, triples, max_words, min_count), "phrases")
    best, parts = scores(words.unionByName(longer), totals, share), shuffle_partitions(spark)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while parts:                                 # P parts, then about its square root, then one: no task ranks more than top x sqrt(P)
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
        parts = 0 if parts == 1 else int(parts ** 0.5) if parts > 3 else 1
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                       F.col("score").cast("bigint").alias("score"))


def q_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


PHRASES_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
          FROM listed, (SELECT unnest(generate_series(1, {MAX_WORDS})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= {MIN_COUNT}),
cuts AS (SELECT lang, phrase, k, f AS a, unnest(generate_series(1, k - 1)) AS cut, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
sides AS (SELECT lang, phrase, k, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS lp, array_to_string(list_slice(w, cut + 1, k), ' ') AS rp FROM cuts),
valued AS (SELECT s.lang, s.phrase, s.a, s.cut, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * s.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM sides s JOIN f x ON x.lang = s.lang AND x.phrase = s.lp JOIN f y ON y.lang = s.lang AND y.phrase = s.rp JOIN n ON n.lang = s.lang),
low AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (SELECT lang, f, string_split(phrase, ' ') AS w, k, unnest(generate_series(2, k - 1)) AS size FROM often WHERE k > 2),
inside AS (SELECT lang, f, unnest(list_transform(generate_series(1, k - size + 1), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS phrase FROM inner_phrases),
longer AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= {TOP}"""
