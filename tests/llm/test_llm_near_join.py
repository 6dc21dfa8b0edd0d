import random

import numpy as np
import pytest

from shopgrain.llm import near_join as op
from shopgrain.llm.shingles import shingle_set


def brute(rows):
    """Class and links of each row number, every pair compared."""
    sets = [set(shingle_set(t or "").tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    ids = [None if least[find(i)][0] else least[find(i)][1] for i in range(len(rows))]
    return [(doc, ids[i], links[i]) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, groups, members, words=120, passage=""):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for _ in range(members):
            new = list(base)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(words)] = f"x{rng.randint(0, 9**9)}"
            rows.append((len(rows), " ".join(new) + passage))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df):
    return sorted([tuple(r) for r in op.join(df).collect()], key=str)


def test_small_groups_match_brute_force(spark):
    common = " " + " ".join(f"license{i}" for i in range(40))
    rows = near_copies(1, 60, 3) + [(1000 + i, t + common) for i, t in near_copies(2, 90, 1, 80)]
    assert got(frame(spark, rows)) == sorted(brute(rows), key=str)


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 32)
    rows = near_copies(3, 1, 230) + [(1000 + i, t) for i, t in near_copies(4, 20, 2)]
    assert got(frame(spark, rows)) == sorted(brute(rows), key=str)


def test_awkward_rows(clashing, awkward_rows):
    assert got(clashing) == sorted(brute([(r[0], r[1]) for r in awkward_rows if shingle_set(r[1] or "").size]) +
                                   [(r[0], r[0], 0) for r in awkward_rows if not shingle_set(r[1] or "").size], key=str)


def test_one_of_each_class_stays(spark, clashing, awkward_rows):
    rows = near_copies(5, 30, 3)
    kept = [r.doc_id for r in op.one_of_each(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, c, _ in brute(rows)})
    out = op.one_of_each(clashing)
    assert out.columns == clashing.columns
    worded = [r for r in out.collect() if shingle_set(r.text or "").size]
    classes = {c for _, c, _ in brute([(r[0], r[1]) for r in awkward_rows if shingle_set(r[1] or "").size])}
    assert sorted(r.doc_id for r in worded) == sorted(classes)


def test_recall_of_the_paths_alone(spark):
    """Pairs near the threshold meet in a bucket, and signatures let them through."""
    rng, rows = random.Random(7), []
    for g in range(150):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        cut = base[: rng.randint(163, 172)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(cut))]
    want = brute(rows)
    assert sum(n for _, _, n in want) > 200
    assert got(frame(spark, rows)) == sorted(want, key=str)


def test_exact_similarity_ways_agree():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    every = np.triu(np.ones((40, 40), bool), 1)
    both = op.similar(texts, every, 0.3)
    for i, j in zip(*np.nonzero(every), strict=True):
        one = np.zeros((40, 40), bool)
        one[i, j] = True
        assert op.similar(texts, one, 0.3)[i, j] == both[i, j]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61)]])
def test_components(spark, edges):
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    found = {r.node[0]: r.root[0] for r in op.components(df).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == root


def test_empty_table(no_docs):
    assert op.join(no_docs).count() == 0 and op.one_of_each(no_docs).count() == 0
