"""Benchmark decontamination (10): rare word pairs as seeds, then Smith-Waterman.

Words are lower-cased and split at white space and ASCII punctuation.  A
passage is aligned word by word with an item (match 2, mismatch and gap -1),
and the best local score over that of a perfect copy is the passage's score.
``LIMIT`` or more is a leak.

Seeds are an item's word pairs: each word with the next one and with the one
after it.  No passage that reaches the limit goes unaligned.  Of two matches that
follow each other in an alignment, none, one, or more edits lie between; with
b1 and b2 the number of the first two, the score is at most 2 + 2 * b1 + b2.
Matches without an edit between them are neighbours in item and text, with one
edit they are at most two words apart in either.  So a text must hold pairs
of the item that weigh ``2 * limit * words - 2`` (2 for neighbours in both, else
1, once per place of the item), and one of them is among the item's rarest
pairs, as many as it takes that the others weigh less.  These rarest pairs
(counted over all documents) open the passages; the weight of all pairs
within reach decides which of them are aligned.

The benchmark is a stated query set: it is taken in blocks of about
``BLOCK_WORDS`` words, and each block goes to all tasks (that is the bound of
what is broadcast; an item that is longer is a block of its own).  Documents
are not shuffled: every task aligns its own, whole texts.  A passage that
very many documents hold is work for each of these documents alone.

Defined cases: a null text has no passage; an item of fewer than three words
matches nothing; items with equal texts both match; rows with
equal ids are judged one by one and the best score of an id and item counts;
other columns do not matter; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import PUNCTUATION, blocks, hash_words, read, small_batches, utf8

SHORTEST = 3
PICK = 2
"""Each word is paired with that many of the next words: two matches with one edit between are that far apart."""
MATCH, MISMATCH, GAP = 2, -1, -1
LIMIT = 0.5
BLOCK_WORDS = 300_000
CELLS = 1 << 18
"""Cells of one row of the alignment matrices that are scored together, and pairs that are weighed together."""
_UNIT = 1 << 32     # a cell is score * _UNIT + start word: one maximum keeps both


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per row) of blocks of a text column."""
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        lo = offsets[i]
        words, _, _, counts = hash_words(data[lo:offsets[j]], offsets[i:j + 1] - lo, PUNCTUATION)
        yield i, words, counts


def pairs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in the row, distance) of the word pairs within one row."""
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - (np.cumsum(counts) - counts)[row]
    parts = []
    for step in range(1, PICK + 1):
        inside = np.flatnonzero(row[:-step] == row[step:])
        pair = words[inside] * np.uint64(0x9E3779B97F4A7C15) + words[inside + step]
        parts.append((pair, row[inside], place[inside], np.full(len(inside), step)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of the values of ranges, one after the other."""
    times = np.maximum(0, stop - start)
    which = np.repeat(np.arange(len(times)), times)
    return which, np.arange(len(which)) + (start - np.cumsum(times) + times)[which]


class Lookup:
    """Membership of hashes in a bounded set: a bit table, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that are in the set, their numbers in the set)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


class Items:
    """A block of the benchmark: word hashes of each item, and its seeds."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, w, c in texts_of(pa.array([t.lower() for t in texts], pa.string())):
            words.append(w)
            rows.append(c)
        counts = np.concatenate(rows)
        self.words = np.split(np.concatenate(words), np.cumsum(counts)[:-1]) if len(counts) else []
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.seed, self.seed_item, self.seed_at, self.step = pairs_of(np.concatenate(words), counts)
        self.lookup = Lookup(self.seed)

    def choose(self, frequency: dict[int, int], limit: float = LIMIT) -> None:
        """Openers: the rarest places of each item (ties by hash), all but
        those that together weigh less than a passage at ``limit`` needs."""
        self.limit = limit
        self.need = np.maximum(1, np.ceil(MATCH * limit * self.lengths - 1e-6).astype(np.int64) - 2)
        self.reach = np.maximum(1, np.floor(MATCH * (1 - limit) * self.lengths + 1e-6).astype(np.int64))      # edits at the limit
        key = np.searchsorted(self.lookup.hashes, self.seed)
        # the distinct pairs of each item, and where a place finds its pairs among them
        self.own, slot = np.unique(self.seed_item * len(self.lookup.hashes) + key, return_inverse=True)
        self.own_first = np.searchsorted(self.own, np.arange(len(self.ids) + 1) * len(self.lookup.hashes))
        self.place_first = np.append(0, np.cumsum(np.maximum(0, self.lengths - 1)))
        place = self.place_first[self.seed_item] + self.seed_at
        self.slots = np.full((PICK, self.place_first[-1]), -1, dtype=np.int64)
        self.slots[self.step - 1, place] = slot - self.own_first[self.seed_item]
        n = np.array([frequency.get(h, 0) for h in self.lookup.hashes.view(np.int64).tolist()], dtype=np.int64)
        rank = np.bincount(place, n[key], minlength=self.place_first[-1])
        near = np.zeros(self.place_first[-1], dtype=np.uint64)
        near[place[self.step == 1]] = self.seed[self.step == 1]
        opens = np.zeros(self.place_first[-1], dtype=bool)
        for k in range(len(self.ids)):
            lo, hi = self.place_first[k], self.place_first[k + 1]
            if self.lengths[k] >= SHORTEST:
                opens[lo + np.lexsort((near[lo:hi], rank[lo:hi]))[:hi - lo - (self.need[k] - 1) // 2]] = True
        some = np.flatnonzero(opens[place])
        some = some[np.argsort(key[some], kind="stable")]
        self.open_item, self.open_at = self.seed_item[some], self.seed_at[some]
        self.open_first, self.open_last = (np.searchsorted(key[some], np.arange(len(self.lookup.hashes)), side=e) for e in ("left", "right"))

    def weigh(self, item: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, places of the item) that the pairs ``start`` to ``stop`` of a text hold of each item."""
        base = np.append(0, np.cumsum(self.own_first[item + 1] - self.own_first[item]))
        held = np.zeros(base[-1] + 1, dtype=np.int64)         # the last one is for pairs past the item's end
        c, h = spread(start, stop)
        code = item[c] * len(self.lookup.hashes) + key[h]
        slot = np.searchsorted(self.own, code)
        slot[slot == len(self.own)] = 0
        hit = self.own[slot] == code
        slot, near = (base[c] + slot - self.own_first[item[c]])[hit], (step[h] == 1)[hit]
        held[slot] = 1
        held[slot[near]] = 2
        c, place = spread(self.place_first[item], self.place_first[item + 1])
        weight = held[base[c] + self.slots[0, place]]
        for slots in self.slots[1:]:
            weight = np.maximum(weight, np.minimum(1, held[np.where(slots[place] < 0, base[-1], base[c] + slots[place])]))
        return np.bincount(c, weight, len(item)).astype(np.int64), np.bincount(c, weight > 0, len(item)).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of padded rows (C x m words with 1, C x w with 0 as
    padding): (score, start, end) of the best local alignment of each row."""
    rows, width = passage.shape
    steps = np.arange(width + 1, dtype=np.int64)
    fresh = np.broadcast_to(steps, (rows, width + 1))
    slope = -GAP * _UNIT * steps
    cell, best, end = fresh.copy(), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(item.shape[1]):
        pair = np.where(passage == item[:, i:i + 1], MATCH * _UNIT, MISMATCH * _UNIT)
        new = np.maximum(cell + GAP * _UNIT, fresh)
        np.maximum(new[:, 1:], cell[:, :-1] + pair, out=new[:, 1:])
        cell = np.maximum(np.maximum.accumulate(new + slope, axis=1) - slope, fresh)   # gaps along the passage
        at = cell.argmax(axis=1)
        top = cell[np.arange(rows), at]
        better = top // _UNIT > best // _UNIT
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best // _UNIT, best % _UNIT, end


def passages(column: pa.Array, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item number, score, first word, last word + 1, seeds) of the
    best passage of each text and item that reaches the limit."""
    found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    lengths, limit = items.lengths, items.limit
    for base, words, counts in texts_of(column):
        first = np.cumsum(counts) - counts
        pairs, row, place, step = pairs_of(words, counts)
        hit, key = items.lookup.find(pairs)
        order = np.argsort(first[row[hit]] + place[hit], kind="stable")
        hit, key = hit[order], key[order]
        row, place, step = row[hit], place[hit], step[hit]
        h, opener = spread(items.open_first[key], items.open_last[key])
        if not len(h):
            continue
        r, n, diagonal = row[h], items.open_item[opener], place[h] - items.open_at[opener]
        stretch = diagonal // items.reach[n]
        order = np.lexsort((stretch, n, r))
        r, n, diagonal, stretch = r[order], n[order], diagonal[order], stretch[order]
        run = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (n[1:] != n[:-1]) | (stretch[1:] != stretch[:-1])))
        lowest, highest = np.minimum.reduceat(diagonal, run), np.maximum.reduceat(diagonal, run)
        r, n = r[run], n[run]
        lo = np.maximum(0, lowest - items.reach[n])
        hi = np.minimum(counts[r], highest + lengths[n] + items.reach[n])
        at = first[row] + place
        a, b = np.searchsorted(at, first[r] + lo), np.searchsorted(at, first[r] + hi)
        size = np.cumsum(b - a + PICK * lengths[n])
        weight, seeds = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        k = 0
        while k < len(r):
            end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + CELLS, side="right")))
            weight[k:end], seeds[k:end] = items.weigh(n[k:end], a[k:end], b[k:end], key, step)
            k = end
        todo = np.flatnonzero(weight >= items.need[n])
        if not len(todo):
            continue
        r, n, lo, hi, seeds = r[todo], n[todo], lo[todo], hi[todo], seeds[todo]
        by_size = np.argsort(np.maximum(hi - lo, lengths[n]), kind="stable")
        at = 0
        while at < len(by_size):
            take, widest = at + 1, int((hi - lo)[by_size[at]])
            while take < len(by_size):
                wider = max(widest, int((hi - lo)[by_size[take]]))
                if wider * (take - at + 1) > CELLS:
                    break
                take, widest = take + 1, wider
            part = by_size[at:take]
            at = take
            own = np.ones((len(part), int(lengths[n[part]].max())), dtype=np.uint64)
            text = np.zeros((len(part), int((hi - lo)[part].max())), dtype=np.uint64)
            for k, c in enumerate(part):
                own[k, :lengths[n[c]]] = items.words[n[c]]
                text[k, :hi[c] - lo[c]] = words[first[r[c]] + lo[c]:first[r[c]] + hi[c]]
            score, start, end = align(own, text)
            for k, c in enumerate(part):
                s = float(score[k]) / (MATCH * int(lengths[n[c]]))
                key = base + int(r[c]), int(n[c])
                value = s, int(lo[c] + start[k]), int(lo[c] + end[k]), int(seeds[c])
                if s >= limit and (key not in found or value[0] > found[key][0]):
                    found[key] = value
    return [(*key, *value) for key, value in sorted(found.items())]


def benchmark_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words, one at a time."""
    rows = items.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    n_words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = 1 + n_words // BLOCK_WORDS
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if block:
            yield Items([r.id for r in block], [r.text for r in block])


def frequencies(texts: DataFrame, items: Items) -> dict[int, int]:
    """Documents that hold each pair of the block, over the whole corpus."""
    lookup = texts.sparkSession.sparkContext.broadcast(items.lookup)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lookup.value.hashes), dtype=np.int64)
        for batch in batches:
            for _, words, counts in texts_of(batch.column(0)):
                pairs, row, _, _ = pairs_of(words, counts)
                hit, pair = lookup.value.find(pairs)
                if len(hit):
                    seen = np.unique(row[hit] * len(total) + pair) % len(total)
                    total += np.bincount(seen, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lookup.value.hashes[some].view(np.int64)), pa.array(total[some])], names=["pair", "n"])

    found = texts.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in found.collect()}        # at most the block's pairs


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive), n_seeds: the
    best passage of each document and item that reaches ``limit``."""
    spark, out = docs.sparkSession, None
    small_batches(spark)
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_seeds bigint"
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"))
    for items in benchmark_blocks(benchmark):
        items.choose(frequencies(_texts(docs, text_col), items), limit)
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, item_ids = batch.column(0), shared.value.ids
                found = [(ids[r].as_py(), item_ids[n], *rest) for r, n, *rest in passages(batch.column(1), shared.value)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (
                        pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", -F.col("first_word"), "last_word", "n_seeds")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("first_word"), "b.last_word", "b.n_seeds")


def _leaked(shared):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for r, *_ in passages(pa.array(texts, pa.string()), shared.value):
            out[r] = True
        return pd.Series(out)

    return leaked


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` without the rows that hold a leaked passage."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs
    for items in benchmark_blocks(benchmark):
        items.choose(frequencies(_texts(docs, text_col), items), limit)
        shared = spark.sparkContext.broadcast(items)

        kept = kept.filter(~_leaked(shared)(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    return kept


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
