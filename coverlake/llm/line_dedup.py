"""Line dedup (13): a sharded minimal perfect hash over line hashes, probed by documents.

A line's key is the line without the white space around it, ASCII capitals in
lower case; keys of ``min_chars`` code points and more count.  One pass gives each
distinct key's 128-bit hash, the documents that hold it and the largest id among
them (combined in the task, then by partial aggregates: a line of every document
is a row per task).  The hashes found in two documents or more are dealt into
shards of about ``SHARD_LINES``.  A shard is a minimal perfect hash (levels of bit
arrays; a key sits at the first level where no other key of the shard that is
still left has its bit, its number is the rank of that bit) with three arrays in
that order: fingerprint, count, largest id.  A key that was not among the hashes is
told by its fingerprint, so lines found once need no slot.

Documents are then read once more where they stand: a task hashes the lines of a
block, goes through them shard by shard and probes the arrays.  No line and no
text is shuffled or joined.  A worker holds the shards that it used last, up to
``CACHE_BYTES``; shards are files in the shared scratch folder.

Lines are counted by all 128 bits of their hash.  A probe finds its slot by one half
and compares the other one, 64 bits, so a line that is not in the index passes for
one that is at most about once in 2 ** 64 / shards probes.

Defined cases: null text counts as empty, which is one empty line; each row is a
document of its own, also if its id is repeated, and all rows of the largest id
keep their lines; a null id is below all others; an empty table gives an empty
result; other columns of any name are kept.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import free_name, mix, read, scratch_path, small_batches, stored
from coverlake.llm.token_frames import filesystem

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_LINES = 1 << 18
"""Mean number of lines of a shard."""
CACHE_BYTES = 96 << 20
SPACE = b" \t\n\x0b\x0c\r"
GAMMA = 2
"""Bits of a level for each key that is left."""
LEVELS = 40
"""Keys left after so many levels (none, unless hashes agree) are listed in order instead."""
NO_ID = np.iinfo(np.int64).min


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, bits, left = [], [], np.unique(keys)
        while len(left) and len(sizes) < LEVELS:
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.sort(left))

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for other keys any number, or -1."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                return out
            at = self.place(keys[todo], level, size) + self.base[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            under = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == keys[todo], self.before[-1] + at, -1)
        return out


class Shard:
    """A perfect hash with the arrays that it indexes."""

    FIELDS = ("sizes", "bits", "rest", "fingerprint", "count", "top")

    def __init__(self, arrays: dict):
        self.hash = PerfectHash(arrays["sizes"], arrays["bits"], arrays["rest"])
        self.fingerprint, self.count, self.top = arrays["fingerprint"], arrays["count"], arrays["top"]
        self.nbytes = sum(arrays[f].nbytes for f in self.FIELDS) + self.hash.before.nbytes

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray, count: np.ndarray, top: np.ndarray) -> dict:
        perfect = PerfectHash.build(lo)
        slot, n = perfect.slots(lo), len(perfect)
        out = {"sizes": perfect.sizes, "bits": perfect.bits, "rest": perfect.rest, "fingerprint": np.zeros(n, np.uint64),
               "count": np.zeros(n, np.uint32 if count.max(initial=0) < 1 << 32 else np.uint64), "top": np.zeros(n, np.int64)}
        out["fingerprint"][slot], out["count"][slot], out["top"][slot] = hi, count, top
        return out

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each key; count 0 for a key that is not in the shard."""
        if not len(self.fingerprint):
            return np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        slot = self.hash.slots(lo)
        known = (slot >= 0) & (self.fingerprint[slot] == hi)
        return np.where(known, self.count[slot], 0).astype(np.int64), self.top[slot]


class ShardFiles:
    """Shards of a folder; the last used ones stay in memory."""

    def __init__(self, folder: str):
        self.fs, self.root = filesystem(folder)
        self.held: OrderedDict[int, Shard] = OrderedDict()
        self.size = 0

    @staticmethod
    def write(folder: str, number: int, arrays: dict) -> None:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        buffer, temporary = io.BytesIO(), f"{root}/.{uuid.uuid4().hex}.tmp"
        np.savez(buffer, **arrays)
        with fs.open_output_stream(temporary) as out:
            out.write(buffer.getvalue())
        fs.move(temporary, f"{root}/shard-{number:06d}.npz")

    def __getitem__(self, number: int) -> Shard:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        with self.fs.open_input_file(f"{self.root}/shard-{number:06d}.npz") as f:
            arrays = np.load(io.BytesIO(f.read()))
            shard = Shard({k: arrays[k] for k in Shard.FIELDS})
        self.held[number], self.size = shard, self.size + shard.nbytes
        while self.size > CACHE_BYTES and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return shard


def digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' 128-bit hashes."""
    import xxhash
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def line_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(lo, hi, n, top): each line hash, the documents with it, their largest id."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                doc_id = NO_ID if doc_id is None else doc_id
                for key in {line_key(line, min_chars) for line in (text.as_py() or b"").split(b"\n")}:
                    if key is None:
                        continue
                    have = found.get(key)
                    if have is None:
                        found[key] = [1, doc_id]
                    else:
                        have[0] += 1
                        have[1] = max(have[1], doc_id)
            if found:
                halves, values = digests(list(found)).view(np.int64), np.array(list(found.values()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (halves[:, 0], halves[:, 1], values[:, 0], values[:, 1])],
                                                 names=["lo", "hi", "n", "top"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "lo bigint, hi bigint, n bigint, top bigint").groupBy("lo", "hi").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"))


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                shard_lines: int = SHARD_LINES) -> int:
    """Write the shards of the lines found in two documents or more to
    ``folder``; the number of shards (0 if there is no such line)."""
    lines = stored(line_counts(docs, id_col, text_col, min_chars).filter("n > 1"), "lines")
    n = lines.count()
    shards = -(-n // shard_lines)
    if not shards:
        return 0

    def build(table: pa.Table) -> pa.Table:
        lo, hi, count, top = (table.column(c).to_numpy() for c in ("lo", "hi", "n", "top"))
        number = table.column("shard")[0].as_py()
        ShardFiles.write(folder, number, Shard.build(lo.view(np.uint64), hi.view(np.uint64), count, top))
        return pa.table({"shard": pa.array([number], pa.int64()), "n": pa.array([len(lo)], pa.int64())})

    dealt = lines.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("bigint"))
    written = dealt.groupBy("shard").applyInArrow(build, "shard bigint, n bigint").agg(F.sum("n"), F.count("*")).first()
    if written[0] != n:
        raise RuntimeError(f"{written[0]} of {n} lines indexed")
    missing = set(range(shards)) - {r[0] for r in dealt.select("shard").distinct().collect()}
    empty = np.zeros(0, np.int64)
    for number in missing:                       # only in tiny tables: a shard that no line fell into
        ShardFiles.write(folder, number, Shard.build(empty.view(np.uint64), empty.view(np.uint64), empty, empty))
    return shards


def drop_repeated_lines(docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines whose key ``min_docs`` (2 at least) documents
    hold, except in the largest id; the columns ``n_lines`` (before) and
    ``n_dropped`` follow (with a number if the table has such a column)."""
    if min_docs < 2:
        raise ValueError("lines of a single document are not in the index")
    small_batches(docs.sparkSession)
    names = [free_name(docs, "n_lines"), free_name(docs, "n_dropped")]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ShardFiles(folder)
        for batch in batches:
            ids = [NO_ID if x is None else int(x) for x in batch.column(id_at).to_pylist()]
            texts = [(x.as_py() or b"").split(b"\n") for x in batch.column(text_at).cast(pa.string()).cast(pa.binary())]
            keys, doc, line = [], [], []
            for d, lines in enumerate(texts):
                for k, x in enumerate(lines):
                    key = line_key(x, min_chars)
                    if key is not None:
                        keys.append(key)
                        doc.append(d)
                        line.append(k)
            dropped = [0] * len(ids)
            if keys and shards:
                lo, hi = np.ascontiguousarray(digests(keys).T)
                shard = np.mod(hi.view(np.int64), shards)
                gone = np.zeros(len(keys), dtype=bool)
                owner = np.array([ids[d] for d in doc], dtype=np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(order))):
                    at = order[a:b]
                    count, top = files[int(shard[at[0]])].probe(lo[at], hi[at])
                    gone[at] = (count >= min_docs) & (owner[at] != top)
                for k in np.flatnonzero(gone).tolist():
                    texts[doc[k]][line[k]] = None
                    dropped[doc[k]] += 1
            kept = [b"\n".join([x for x in lines if x is not None]) for lines in texts]
            columns = list(batch.columns)
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, texts), pa.int64()), pa.array(dropped, pa.int64())],
                                             names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, `{names[0]}` bigint, `{names[1]}` bigint")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES) -> DataFrame:
    """Index and probe: ``docs`` with the kept lines as text, ``n_lines``, ``n_dropped``."""
    folder = scratch_path(docs.sparkSession, "llm-line-shards")
    shards = build_index(docs, folder, id_col, text_col, min_chars, shard_lines)
    return drop_repeated_lines(docs, folder, shards, id_col, text_col, min_chars, min_docs)


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
held AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING n >= {MIN_DOCS})
SELECT k.doc_id, count(*) AS n_lines, count(h.key) FILTER (WHERE k.doc_id <> h.top) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY place) FILTER (WHERE h.key IS NULL OR k.doc_id = h.top), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON h.key = k.key GROUP BY k.doc_id"""
