"""The classifier on held-out rows, and its parts against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopgrain.llm import toxicity as op

BAD = ["idiotic", "worthless", "scumbag"]


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        toxic = i % 5 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


def test_held_out_rows(spark):
    docs, labels = corpus(1500)
    got = op.judge(*tables(spark, docs, labels)).collect()
    assert len(got) == len(docs) and all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    right = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in out]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [tuple(r) for r in op.judge(*tables(spark, docs, labels)).collect()] == [tuple(r) for r in got]


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = corpus(400)
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (op.judge(*tables(spark, docs, x)).collect() for x in (labels, turned))
    assert a == b


def test_counts_and_ratios(spark):
    docs, labels = corpus(60)
    train = op.training_rows(*tables(spark, docs, labels))
    text, label = dict(docs), {i: y for i, y in labels if not held(i)}
    counts = {r["bucket"]: (r["n_toxic"], r["n_clean"]) for r in op.gram_counts(train).collect()}
    want = {}
    for i, y in label.items():
        for g in [-1, *set(map(int, op.gram_set(text[i])))]:
            t, c = want.get(g, (0, 0))
            want[g] = (t + y, c + 1 - y)
    assert counts == want
    n_toxic, n_clean = want.pop(-1)
    for r in op.ratios(op.gram_counts(train), n_toxic, n_clean, 50).collect():
        t, c = want[r["bucket"]]
        assert r["ratio"] == pytest.approx(math.log((t + 1) / (n_toxic + 2) / ((c + 1) / (n_clean + 2))))


@pytest.mark.parametrize("text", ["", " ", "a", "ab", "an idiot", "É😀 \n\t x", "\ud800", "long text of many words " * 50])
@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_blocks_give_the_same_grams(text, block):
    chars = " " + " ".join(text.lower().split()) + " "
    whole = [len(chars) - n + 1 for n in op.SIZES if len(chars) >= n]
    assert sum(len(g) for g in op.grams(text, block)) == (sum(whole) if len(chars) > 2 else 0)
    assert np.array_equal(op.gram_set(text, block), op.gram_set(text))


def test_scores_follow_the_model():
    model = op.Model(op.gram_set(" idiot ")[:5], np.array([1.0, 2, 3, 4, 5]), -2.0)
    assert model.log_odds("you idiot", model.table()) == model.log_odds("you idiot " * 99, model.table(), 16)
    assert model.log_odds("", model.table()) == -2.0


def test_awkward_tables(spark, awkward, clashing, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (2, 0), (3, None), (4, 0), (5, 1), (None, 1), (7, 0), (8, 1), (99, 1)], "doc_id long, toxic int"
    ).withColumn("text", F.lit("x"))
    got = op.judge(awkward, labels)
    assert got.count() == awkward.count() and got.filter("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert sorted(map(str, op.judge(clashing, labels).collect())) == sorted(map(str, got.collect()))
    assert op.judge(no_docs, labels).count() == 0
    none, all_toxic = labels.limit(0), labels.filter("toxic = 1")
    assert {r["predicted"] for r in op.judge(awkward, none).collect()} == {0}
    assert {r["predicted"] for r in op.judge(awkward, all_toxic).collect()} == {1}
