import random

import numpy as np
import pytest

from coverlake.llm import near_copies as N
from coverlake.llm.components import connected_components
from tests.conftest import SF_MID

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    ids, root, links = sorted(sets), {d: d for d in sets}, {d: 0 for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            s, t = sets[a], sets[b]
            if s and t and min(len(s), len(t)) >= 0.8 * max(len(s), len(t)):
                common = len(s & t)
                if common / (len(s) + len(t) - common) >= 0.8 - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (find(d), links[d]) for d in ids}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in N.jaccard_join(df).collect()}


def variants(n, seed, words=120, edits=6):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"v{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    texts = variants(40, 1) + variants(25, 2, 40, 4) + ["same text of seven words all over"] * 9 + ["two words", "Two  words", "one", "", None, " \n"]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    assert result(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as size", "3 as id")) == brute(rows)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_NODES", 7)
    rows = list(enumerate(variants(60, 3)))
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in N.q_jaccard_join(spark, SF_MID).collect()} == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, "a b c d e f g"), (4, "other words that are not the same"), (4, "other words that are not the same"),
            (None, "no id"), (None, "no id"), (8, None), (7, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept_id", "2 as node")
    out = N.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 3, 4, 7, 8]
    assert N.drop_near_copies(df.limit(0)).count() == 0 and N.jaccard_join(df.limit(0)).count() == 0


def test_prefix_is_as_long_as_the_recall_allows():
    k = N.prefix_length()
    assert N.recall(k) >= N.RECALL > N.recall(k + 1)
    assert N.prefix_length(target=0.5) > k


def test_link_counts_of_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    weight, part = rng.integers(1, 4, 40).astype(float), rng.integers(0, 2, 40)
    for same in (True, False):
        links, _ = N.link_parts(sets, weight, part, same, 0.45)
        for a in range(40):
            want = sum(weight[b] for b in range(40) if a != b and (same or part[a] != part[b])
                       and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.45)
            assert links[a] == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (52, 51)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_texts_that_share_an_id_are_judged_on_their_own(spark):
    one, two, three = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(1, one), (1, two), (2, two + " end"), (3, three), (3, three), (4, one.upper()), (5, ""), (5, None), (None, one)]
    out = N.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(1, one), (1, two), (3, three), (None, one)] + [
        (r.doc_id, r.text) for r in out if r.doc_id == 5], key=repr) and sum(r.doc_id == 5 for r in out) == 1
