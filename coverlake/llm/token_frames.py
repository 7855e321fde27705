"""Token-ID output (3): one zstandard frame per document, a seek table at
the end of each shard.

A shard is a file in the public zstd *seekable format*: independent frames,
then one skippable frame that lists, per frame, the compressed size, the
content size and the low 32 bits of the XXH64 of the content.  Any zstd
reader can decompress the file from front to back; a reader that wants some
documents seeks to the table at the end and decompresses their frames only,
checking each checksum.

Documents are range-partitioned and sorted by ``doc_id``, so shards hold
ascending ids and a task writes one shard.  Files go to a folder that all
executors share, under a temporary name that is then renamed: a retried task
writes the same bytes again.

Defined cases: null text counts as empty (only the end id); null ``doc_id``
sorts first; equal ``doc_id`` are ordered by a hash of
the text; other columns are ignored;
an empty table gives no shard and no row.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverlake.llm.common import binary, read, scratch_path, small_batches, stored

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("size", "<u4"), ("content", "<u4"), ("checksum", "<u4")])

FRAME_IDS = 1 << 24
"""Ids in one frame at most; a longer document takes several frames."""
CACHE_WORDS = 400_000
"""Encoded words of a generation; a worker keeps two generations."""
CACHE_BYTES = 96 << 20
"""Bytes of a generation, with ``ENTRY_BYTES`` for each entry."""
ENTRY_BYTES = 150
LONG_PART = 200
"""Longer parts (texts without blanks) are not kept."""

PLAIN_SIGNS = r"!-;=-@\[-~ß-öø-ÿ"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
"""The sign that a byte-level model has for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""

MANIFEST = "doc_id bigint, shard string, shard_no int, first_frame bigint, n_frames int, in_shard bigint, n_tokens bigint"


class Known(dict):
    """Ids of runs and parts; what it does not hold it takes from the
    generation before or encodes, and keeps."""

    def __init__(self, encoder: "WordEncoder", old: dict[str, bytes]):
        super().__init__()
        self.encoder, self.old, self.held = encoder, old, 0
        self.tokenize, self.plain = encoder.tokenizer.model.tokenize, encoder.PLAIN.fullmatch

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if not self.encoder.by_runs or not self.plain(part):
                ids = self.encoder.alone(part)
            else:
                shown = part if part.isascii() else "".join([BYTE_SIGNS[x] for x in part.encode()])
                ids = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(part) <= LONG_PART:
            self[part] = ids
            self.held += len(part) + len(ids) + ENTRY_BYTES
        return ids


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    The tokenizer must split at white space before its merges and drop it
    (``word_bpe_49k.json`` does): then the ids of a text are those of its
    blank-separated parts.  A part of printable ASCII without capitals and ``<``, and
    of the small letters of Latin-1, is cut into the runs that the tokenizer's own
    pattern gives (letters, digits, other signs), and the model encodes each distinct
    run once.  This is done for a tokenizer that a list of probes shows to work so.
    Other parts are kept whole; new ones are encoded together, with a control
    character between them whose single id shows where each ends; a part that holds
    that character is encoded on its own.

    The cache is bounded in bytes and in entries; a part of more than ``LONG_PART``
    characters (a text without blanks) is encoded but not kept.
    """

    MARK = "\x01"
    PLAIN = re.compile(rf"[{PLAIN_SIGNS}]+")
    # a part with another sign as a whole; else the pattern's runs
    RUNS = re.compile(rf"(?<![^ \n])[{PLAIN_SIGNS}]*+[^ \n{PLAIN_SIGNS}][^ \n]*|"
                      r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~']+")
    PROBES = ("it's we're i'll he'd they've i'm don't", "abc123def 4.5-6", "a!?b ...--c :;'' 's 'sx x'tt''re", "http://x.y/z?a=1&b=%20#q_r~s",
              "{[()]}@^`|\\$*+ ,", "0123456789 antidisestablishmentarianism qqqzzzxxx",
              "déjà ßtraße'll ñandú9 àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.encode(f" {self.MARK} ", add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")]
        self.lowers = ids[0] == ids[1] and all(t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache_words, self.cache_bytes, self.by_runs = cache_words, CACHE_BYTES, self.lowers
        self.young = Known(self, {})
        self.by_runs = self.lowers and all(self.encode([p])[0] == self.alone(p) for p in self.PROBES)
        self.young = Known(self, {})

    def alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _lower(self, text: str) -> str:
        """ASCII capitals in lower case, if the tokenizer does so anyway and
        no special token could come out of it: fewer distinct parts."""
        return text.encode().lower().decode() if self.lowers and "<" not in text else text

    def _learn(self, words: list[str]) -> None:
        """Encode new parts together."""
        words = [w for w in words if self.mark is not None and self.MARK not in w and len(w) <= LONG_PART]
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(ids == self.mark) * 4).tolist() + [len(ids) * 4]
            if len(ends) != len(part):
                raise AssertionError("the mark's id stands in another place")
            data, first = ids.tobytes(), 0
            for w, end in zip(part, ends):
                self.young[w] = data[first:end]
                self.young.held += len(w) + end - first + ENTRY_BYTES
                first = end + 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.cache_words or self.young.held > self.cache_bytes:
            self.young.old = {}
            self.young = Known(self, self.young)       # the last generation stays for words that recur
        at = self.young.__getitem__
        if self.by_runs:
            return [b"".join(map(at, self.RUNS.findall(self._lower(t or "")))) for t in texts]
        parts = [self._lower(t or "").replace("\n", " ").split(" ") for t in texts]
        self._learn([w for w in set().union(*parts) if w and w not in self.young and w not in self.young.old])
        return [b"".join([at(w) for w in p if w]) for p in parts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared file system of a folder (local mount, HDFS, object store)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def checksum(content: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class ShardWriter:
    """Appends frames; ``close`` adds the seek table and renames the file."""

    def __init__(self, folder: str, number: int, level: int):
        import zstandard
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/shard-{number:06d}.zst"
        self.temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []

    def add(self, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.entries.append((len(frame), len(content), checksum(content)))

    def close(self) -> None:
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        footer = FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Random access to the frames of a shard."""

    def __init__(self, folder: str, name: str):
        import zstandard
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        count, flag, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{name}: no seek table")
        length = count * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(length, size - FOOTER.size - length), dtype=ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.entries["size"].astype(np.int64))])
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        e = self.entries[k]
        content = self.decompressor.decompress(self.file.read_at(int(e["size"]), int(self.at[k])),
                                               max_output_size=int(e["content"]))
        if len(content) != e["content"] or checksum(content) != e["checksum"]:
            raise ValueError(f"frame {k}: checksum differs")
        return content


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1,
                       id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Encode every text, write the shards to ``folder`` and return the
    manifest: the document's shard, its frames, its place in the shard."""
    small_batches(docs.sparkSession)
    tail = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, in_shard, number = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for at in range(0, len(ids), 500):
                for doc_id, content in zip(ids[at:at + 500], encoder(tokenizer_path).encode(texts[at:at + 500])):
                    content += tail
                    if writer is None:
                        writer = ShardWriter(folder, number, level)
                    first = len(writer.entries)
                    for k in range(0, max(1, len(content)), 4 * FRAME_IDS):
                        writer.add(content[k:k + 4 * FRAME_IDS])
                    n = len(content) // 4
                    rows.append((doc_id, f"shard-{number:06d}.zst", number, first, len(writer.entries) - first, in_shard, n))
                    in_shard += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["doc_id", "shard", "shard_no", "first_frame", "n_frames", "in_shard", "n_tokens"])
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, its ids (binary, little-endian unsigned 32-bit) and ``shard``,
    ``in_shard`` for the documents of a manifest, or of a part of it."""
    small_batches(manifest.sparkSession)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for row in part.to_pylist():
                    if row["shard"] != name:
                        name, reader = row["shard"], ShardReader(folder, row["shard"])
                    out.append(b"".join(reader.frame(row["first_frame"] + k) for k in range(row["n_frames"])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(5),
                                                  binary(out)], names=["doc_id", "shard", "shard_no", "in_shard", "ids"])

    return manifest.mapInArrow(fetch, "doc_id bigint, shard string, shard_no int, in_shard bigint, ids binary")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each shard; one row per shard, so the running sum is short."""
    shards = manifest.groupBy("shard_no").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = F.sum("shard_tokens").over(W.orderBy("shard_no").rowsBetween(W.unboundedPreceding, -1))
    return shards.select("shard_no", F.coalesce(before, F.lit(0)).alias("shard_start"))


def digest_tokens(tokens: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                names=["doc_id", "shard_no", "in_shard", "n_tokens", "ids_crc32"])

    read_back = tokens.mapInArrow(crc, "doc_id bigint, shard_no int, in_shard bigint, n_tokens bigint, ids_crc32 bigint")
    return (read_back.join(shard_starts(manifest), "shard_no")
            .select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"))


def q_token_frames(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers
    folder = scratch_path(spark, "llm-token-shards")
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_shards(read(spark, sf_dir, "documents"), folder, path)
    return digest_tokens(read_tokens(manifest, folder), manifest)
