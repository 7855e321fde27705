"""N-gram Jaccard join (5): MinHash LSH forest, then exact verification.

A document is its set of five-word shingles (lower case; a shorter text is
one shingle).  Equal sets are one node.  Each node has ``TREES`` signatures,
the labels of as many sorted prefix tries; two nodes match in a trie when
their labels share a prefix.  Matching starts with whole labels and shortens
the prefix until pairs at the threshold are found with the target recall:

    1 - (1 - threshold ** prefix) ** TREES >= RECALL

(0.99993 for 24 tries and prefixes of 5 at 0.8).  Matches join nodes into
clusters.  Within a cluster every pair is verified on the exact sets, by
blocks: a cluster is dealt into ``n`` parts of a bounded number of nodes and
shingles, and each pair of parts is a group of its own, so a huge group of
near copies is many small tasks and gives rows in proportion to its nodes,
not to its pairs.  A part pair returns, per node, its number of links and the
smallest node that it hangs together with; these make the classes.

Defined cases: a text without words is linked to nothing; rows that repeat
an id count as one document (its class is the smallest of them), but when copies
are dropped each of their texts is judged on its own; rows
without an id are left out of the result; other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import binary, blocks, free_name, hash_words, mix, read, small_batches, stored, utf8, window_hashes
from coverlake.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
"""Values of a whole label."""
RECALL = 0.9999
FEW = 8
"""A shingle of at most so many nodes of a group is counted pair by pair."""
BUCKETS = 1 << 20
"""Hash buckets of the ids that are compared; texts in no such bucket are not shuffled."""
PART_NODES = 512
PART_SHINGLES = 500_000
"""A part of a cluster holds about this many nodes and shingles (a node with more is on its own)."""


def recall(prefix: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    return 1 - (1 - threshold ** prefix) ** trees


def prefix_length(threshold: float = THRESHOLD, target: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the matched prefix from the whole label until the recall is reached."""
    prefix = depth
    while prefix > 1 and recall(prefix, threshold, trees) < target:
        prefix -= 1
    return prefix


def seeds(n: int) -> np.ndarray:
    """Odd multipliers of the hash functions."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each (lower-cased) text."""
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        lo = offsets[i]
        words, _, _, counts = hash_words(data[lo:offsets[j]], offsets[i:j + 1] - lo)
        whole = window_hashes(words, size)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(whole[at:at + n - size + 1])
            else:
                yield window_hashes(words[at:at + n], n) if n else np.zeros(0, np.uint64)
            at += n


def node_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def labels(sets: list[np.ndarray], trees: int, prefix: int) -> np.ndarray:
    """Hash of the first ``prefix`` label values of each non-empty set, per tree."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.empty((len(sets), trees * prefix), dtype=np.uint64)
    for k, a in enumerate(seeds(trees * prefix)):
        values[:, k] = np.minimum.reduceat((flat * a) >> np.uint64(16), starts)
    out = np.zeros((len(sets), trees), dtype=np.uint64)
    out += np.arange(trees, dtype=np.uint64)      # a trie's prefixes are its own
    for k in range(prefix):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k::prefix])
    return out.view(np.int64)


def sign(docs: DataFrame, trees: int, prefix: int) -> DataFrame:
    """id, h, node, size (distinct shingles) and the tries' matched prefixes of each
    text; ``docs`` has id, text and h, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sets, done = batch.column(0), batch.column(2), [], 0

            def emit(sets, at):
                keys = [node_key(s) if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                rows = iter(labels(full, trees, prefix).tolist() if full else [])
                prefixes = [next(rows) if len(s) else [] for s in sets]
                return pa.RecordBatch.from_arrays([
                    ids.slice(at, len(sets)), hashes.slice(at, len(sets)), binary(keys), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "h", "node", "size", "prefixes"])

            held = 0
            for s in shingle_sets(batch.column(1)):
                sets.append(s)
                held += len(s)
                if held > 100_000:
                    yield emit(sets, done)
                    done, sets, held = done + len(sets), [], 0
            if sets:
                yield emit(sets, done)

    return docs.mapInArrow(run, "id bigint, h bigint, node binary, size int, prefixes array<bigint>")


def clusters(nodes: DataFrame) -> DataFrame:
    """(key, cluster): nodes that the forest's matches hold together, by
    the 64-bit ``xxhash64`` of the node; two nodes that share one would only be
    compared once more."""
    at = nodes.select(F.xxhash64("node").alias("key"), F.explode("prefixes").alias("prefix"))
    heads = at.groupBy("prefix").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = at.join(heads, "prefix").select(F.col("key").alias("a"), F.col("head").alias("b"))
    return connected_components(edges).select(F.col("node").alias("key"), F.col("root").alias("cluster"))


def link_parts(sets: list[np.ndarray], weight: np.ndarray, part: np.ndarray, same: bool,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each node: the documents it is linked to, and the
    first node that it hangs together with.  Unless ``same``, only pairs of
    nodes of different parts count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), dtype=np.float32)
    few = (count[column] > 1) & (count[column] <= FEW)       # shingles of a few nodes: count their pairs one by one
    c, o = column[few], owner[few]
    for d in range(1, FEW):
        hit = c[d:] == c[:-d]
        pair = np.bincount(o[:-d][hit] * n + o[d:][hit], minlength=n * n).reshape(n, n)
        common += pair + pair.T
    many = count[column] > FEW                               # of many: a bounded slab of the incidence matrix at a time
    kept, column = np.unique(column[many], return_inverse=True)
    owner = owner[many]
    for lo in range(0, len(kept), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        slab = np.zeros((n, min(4096, len(kept) - lo)), dtype=np.float32)
        slab[owner[a:b], column[a:b] - lo] = 1
        common += slab @ slab.T
    link = common / (sizes[:, None] + sizes[None, :] - common) >= threshold - 1e-6
    np.fill_diagonal(link, False)
    if not same:
        link &= part[:, None] != part[None, :]
    root = np.arange(n)
    while True:                                   # smallest label of the neighbours until nothing changes
        new = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return (link * weight[None, :]).sum(axis=1), root
        root = new


def verify(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from each pair of parts, for nodes with a link.
    ``docs`` has id and text; a node's set is read from its representative."""
    keyed = nodes.select("node", "rep", "size", "weight", F.xxhash64("node").alias("key"))
    members = stored(clusters(nodes).join(keyed, "key"), "members")
    parts = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / PART_NODES), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("n_parts"))
    members = stored(members.join(parts, "cluster").select(
        "node", "cluster", "rep", "weight", "n_parts",
        F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int").alias("part")), "parts")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["node", "cluster", "weight", "n_parts", "part"])
            texts = batch.column(0)
            keep, sets = [], []
            for k, s in enumerate(shingle_sets(texts)):
                if node_key(s) == rows.column(0)[k].as_py():      # an id may be that of another text, too
                    keep.append(k)
                    sets.append(s.tobytes())
                if len(keep) == 256:
                    yield pa.RecordBatch.from_arrays([*rows.take(pa.array(keep)).columns, binary(sets)], names=[*rows.schema.names, "shingles"])
                    keep, sets = [], []
            if keep:
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(keep)).columns, binary(sets)], names=[*rows.schema.names, "shingles"])

    # texts that cannot be a member's stay where they are: at most BUCKETS numbers are broadcast
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = F.broadcast(members.select(place("rep").alias("place")).distinct())
    docs = docs.join(wanted, place(docs["id"]) == wanted["place"], "left_semi")
    text = docs.join(members, docs["id"] == members["rep"]).select("text", "node", "cluster", "weight", "n_parts", "part")
    sets = text.mapInArrow(fetch, "node binary, cluster bigint, weight bigint, n_parts int, part int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other")
    dealt = sets.select("*", other).select(
        "node", "weight", "part", "shingles", "cluster", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")     # repeated rows of a representative
        found = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        links, root = link_parts(found, group["weight"].to_numpy(np.float64), group["part"].to_numpy(), key[1] == key[2], threshold)
        node = group["node"].to_numpy(dtype=object)
        linked = links > 0
        return pd.DataFrame({"node": node[linked], "root": node[root[linked]], "links": links[linked].astype(np.int64)})

    return dealt.groupBy("cluster", "p", "q").applyInPandas(compare, "node binary, root binary, links bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 target_recall: float = RECALL) -> DataFrame:
    """id, h, first, n_links of each row with an id: ``h`` is the hash of its
    (lower-cased) text, ``first`` the smallest (id, h) that it hangs together with."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col).filter("id is not null")
    signed = stored(sign(rows, TREES, prefix_length(threshold, target_recall)), "signed")
    nodes = stored(signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("id", "h")).alias("first"), F.countDistinct("id").alias("weight"), F.first("size").alias("size"),
        F.first("prefixes").alias("prefixes")).withColumn("rep", F.col("first.id")), "nodes")
    verified = stored(verify(rows.select("id", "text"), nodes, threshold), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ranked = (nodes.select("node", "first", "weight").join(links, "node", "left").join(roots, "node", "left")
              .select("node", "first", "weight", "links", F.coalesce("root", "node").alias("root")))
    ranked = stored(ranked, "ranked")
    classes = ranked.groupBy("root").agg(F.min("first").alias("class"))
    named = ranked.join(classes, "root").select("node", "class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "h", "node").join(named, "node", "left").select(
        "id", "h", F.coalesce("class", F.struct("id", "h")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 target_recall: float = RECALL) -> DataFrame:
    """One row per id: ``class_id`` (the smallest id that it hangs together
    with) and ``n_links`` (other documents at the threshold or above)."""
    found = text_classes(docs, id_col, text_col, threshold, target_recall)
    return found.groupBy("id").agg(F.min("first.id").alias("class_id"), F.max("n_links").alias("n_links")).select(
        F.col("id").alias(id_col), "class_id", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one text of each class: that of the smallest id.  Rows
    that share an id count by their texts: one whose text is no copy stays.
    Rows without an id stay."""
    found = text_classes(docs, id_col, text_col, **options)
    kept, mark, key = free_name(docs, "kept_id"), free_name(docs, "kept_text"), F.col(f"`{id_col}`")
    keep = found.filter((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))).select(F.col("id").alias(kept), F.col("h").alias(f"{mark}_"))
    text = F.xxhash64(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = docs.filter(key.isNotNull()).withColumn(mark, text)
    first = rows.join(keep, (key.cast("bigint") == F.col(kept)) & (F.col(mark) == F.col(f"{mark}_")), "left_semi").dropDuplicates([id_col, mark]).drop(mark)
    return first.unionByName(docs.filter(key.isNull()))


def q_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
