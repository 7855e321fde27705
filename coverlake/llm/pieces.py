"""SentencePiece encoding and decoding (8): Viterbi over a trie of words.

A normalised text is cut in front of every marker run that follows other
characters; no piece spans such a cut, so the marked words are encoded on
their own.  The distinct marked words of a block of documents are sorted,
which lays them out as a trie in depth-first order: a word keeps the forward
states of the prefix that it shares with the word before it, and only the
rest of it is scored.  The forward state of a prefix is its best last piece:

* ``unigram`` models: the piece that ends the segmentation of highest score;
* ``bpe`` models: the piece that ends the prefix in the merge order that the
  scores define.  Exactly one piece both ends the prefix and stands next to
  the last piece of the shorter prefix without the two merging differently,
  so the same forward pass gives the library's result, not a re-scored one.

A character without a piece gives its UTF-8 bytes' pieces (byte fallback) or
the unknown id.  Encoded words are kept per worker up to ``CACHE_WORDS`` and
``CACHE_BYTES``, answers on neighbouring pieces up to ``JOINS``.
Nothing is shuffled: documents are read, encoded and decoded where they are.

Defined cases: null or empty text has no pieces and decodes to the empty
text; repeated rows are encoded one by one; other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import binary, read, small_batches

MARK = "▁"
CACHE_WORDS = 400_000
"""Encoded words that a worker keeps; the cache starts anew beyond it."""
CACHE_BYTES = 96 << 20
"""The same in bytes, with ``ENTRY_BYTES`` for each word."""
ENTRY_BYTES = 150
LONG_WORD = 200
"""Words of more characters (texts without blanks) are encoded but not kept."""
JOINS = 600_000
"""Remembered answers on whether a piece may follow another one."""
BLOCK = 1000
"""Documents whose distinct words are sorted together."""


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message (the model file's format)."""
    k = 0

    def varint() -> int:
        nonlocal k
        x = shift = 0
        while True:
            b = message[k]
            k += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while k < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[k:k + size]
            k += size


class Pieces:
    """Pieces, scores and normaliser settings of a model file."""

    # Piece types and model types of the file format.
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    MODELS = {1: "unigram", 2: "bpe"}

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(x for k, v in model if k == 2 for x in _fields(v))
        self.kind = self.MODELS[trainer.get(3, 1)]
        self.score: list[float] = []
        self.type: list[int] = []
        self.id: dict[str, int] = {}
        self.text: list[str] = []
        self.bytes = [0] * 256
        self.unknown = 0
        for k, v in model:
            if k != 1:
                continue
            piece = dict(_fields(v))
            n, kind, text = len(self.text), piece.get(3, 1), piece[1].decode()
            self.text.append(text)
            self.type.append(kind)
            self.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            if kind == self.NORMAL:
                self.id[text] = n
            elif kind == self.BYTE:
                self.bytes[int(text[3:5], 16)] = n
            elif kind == self.UNKNOWN:
                self.unknown = n
            elif kind in (self.USER, self.UNUSED):
                raise ValueError(f"piece {text!r}: user-defined and unused pieces are not supported")
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("a piece spans two marked words")
        self.fallback = any(t == self.BYTE for t in self.type)
        self.longest = max(map(len, self.id), default=1)
        self.joins: dict[str, dict[str, bool]] = {}
        self.packed: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.cache_words, self.cache_bytes, self.held, self.n_joins = cache_words, CACHE_BYTES, 0, 0
        self.content = [self._content(n) for n in range(len(self.text))]

    def _content(self, n: int) -> bytes:
        if self.type[n] == self.BYTE:
            return bytes([int(self.text[n][3:5], 16)])
        if self.type[n] == self.UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.type[n] == self.CONTROL else self.text[n].replace(MARK, " ").encode()

    # --- merges ---------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                n = self.id.get(parts[k] + parts[k + 1])
                if n is not None and (best is None or self.score[n] > best[0]):
                    best = self.score[n], k
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def _joins(self, a: str, b: str) -> bool:
        return self.merge(a + b) == ([a, b] if a else [b])

    # --- encoding -------------------------------------------------------
    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words in ascending order (depth-first trie order)."""
        return self._best_scores(words) if self.kind == "unigram" else self._best_merges(words)

    def _emit(self, parts: list[str]) -> bytes:
        packed = self.packed
        for p in parts:
            if p not in packed:
                if len(packed) > 200_000:
                    packed.clear()
                n = self.id.get(p)
                found = [n] if n is not None else [self.bytes[b] for b in p.encode()] if self.fallback else [self.unknown]
                packed[p] = np.array(found, dtype="<u4").tobytes()
        return b"".join([packed[p] for p in parts])

    def _best_merges(self, words: list[str]) -> list[bytes]:
        ids, longest, joins = self.id, self.longest, self.joins
        last = [""]                         # last[i]: the piece that ends the prefix of i characters
        right = [joins.setdefault("", {})]  # right[i]: whether a piece may follow it
        before, out = "", []
        for word in words:
            if self.n_joins > JOINS:        # what the current prefix needs stays in ``right``
                joins.clear()
                self.n_joins = 0
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], right[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                for size in range(1, min(i, longest) + 1):
                    piece = word[i - size:i]
                    if size > 1 and piece not in ids:
                        continue
                    fits = right[i - size].get(piece)
                    if fits is None:
                        fits = right[i - size][piece] = self._joins(last[i - size], piece)
                        self.n_joins += 1
                    if fits:
                        last.append(piece)
                        follow = joins.get(piece)
                        if follow is None:
                            follow = joins[piece] = {}
                        right.append(follow)
                        break
                else:
                    raise AssertionError(f"no segmentation of {word[:i]!r}")
            parts, i = [], len(word)
            while i:
                parts.append(last[i])
                i -= len(last[i])
            out.append(self._emit(parts[::-1]))
            before = word
        return out

    def _best_scores(self, words: list[str]) -> list[bytes]:
        ids, score, longest = self.id, self.score, self.longest
        unseen = min(score, default=0.0) - 10.0     # the library's penalty for an unknown character
        last, total = [""], [0.0]
        before, out = "", []
        for word in words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], total[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                best, which = None, ""
                for size in range(min(i, longest), 0, -1):
                    piece = word[i - size:i]
                    n = ids.get(piece)
                    if n is None and size > 1:
                        continue
                    s = total[i - size] + (unseen if n is None else score[n])
                    if best is None or s > best:
                        best, which = s, piece
                last.append(which)
                total.append(best)
            parts, i = [], len(word)
            while i:
                parts.append(last[i])
                i -= len(last[i])
            out.append(self._emit(parts[::-1]))
            before = word
        return out

    def normalise(self, text: str) -> str:
        return self.processor.normalize(text) if text else ""

    @staticmethod
    def marked_words(text: str) -> list[str]:
        """Cuts in front of each marker run that follows another character."""
        parts = text.split(MARK)
        if len(parts) == 1:
            return parts
        out, marks = ([parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(MARK * marks + p)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.marked_words(self.normalise(t or "")) for t in texts]
        words = set().union(*split)
        fresh = {w for w in words if w not in self.known}
        if len(self.known) + len(fresh) > self.cache_words or self.held > self.cache_bytes:
            self.known, self.held = {"": b""}, 0
            fresh = words - {""}
        fresh = sorted(fresh)
        found = dict(zip(fresh, self.encode_sorted(fresh)))
        once = {w: found.pop(w) for w in fresh if len(w) > LONG_WORD}
        self.known.update(found)
        self.held += sum(len(w) + len(x) + ENTRY_BYTES for w, x in found.items())
        if once:
            return [b"".join([once[w] if w in once else self.known[w] for w in words]) for words in split]
        at = self.known.__getitem__
        return [b"".join(map(at, words)) for words in split]

    # --- decoding -------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the blank that normalising put in front."""
        at = self.content.__getitem__
        data = b"".join(map(at, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and self.normalise("a")[:1] == MARK else text


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id and its ids (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    path = model_path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = model(path).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids)], names=["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    small_batches(encoded.sparkSession)
    path = model_path or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model(path).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def encode_column(docs: DataFrame, model_path: str | None = None, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` as an array of integers in the
    new column ``out`` (with underscores added if the name is taken)."""
    small_batches(docs.sparkSession)
    path = model_path or default_path()
    while out in docs.columns:
        out += "_"

    @F.pandas_udf("array<int>")
    def ids(texts):
        values = texts.tolist()
        found = []
        for at in range(0, len(values), BLOCK):
            found += [np.frombuffer(x, "<u4").astype(np.int32) for x in model(path).encode(values[at:at + BLOCK])]
        return type(texts)(found, dtype=object)

    return docs.withColumn(out, ids(F.col(f"`{text_col}`").cast("string")))


def q_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, and of the decoded text its code points,
    crc32 and whether it is the document's text."""
    path = default_path()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column(1).to_pylist()
                ids = model(path).encode(texts)
                back = [model(path).decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(t) for t in back], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    pa.array([t == (x or "") for t, x in zip(back, texts)], pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "decoded_crc32", "round_trip"])

    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(both, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_chars bigint, "
                                 "decoded_crc32 bigint, round_trip boolean")
