"""Spelling variants against a plain search, and the signatures against every edit."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopgrain.llm import spelling_variants as op

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near_of(n):
    same, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            same[i, len(w), w[:i] + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(n):
    near = near_of(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_random_words_of_few_letters(spark):
    """Many rearranged words, so that signatures collide, and counts that make chains of forms."""
    rng = random.Random(1)
    n = {}
    for _ in range(600):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        n[w] = rng.choice([2, 3, 20, 25, 200, 250, 2500, 30_000])
    got = rows_of(op.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    assert any(f and r != f for _, f, r, *_ in got)


@pytest.mark.parametrize("long", [0, 256])
def test_every_edit_of_a_word_is_found(spark, monkeypatch, long):
    """Also where words are compared letter by letter."""
    monkeypatch.setattr(op, "LONG", long)
    word = "anagrama"
    edits = {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in "abgz"}
    edits |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abgz"}
    edits |= {word[:i] + word[i + 1:] for i in range(len(word))}
    edits.discard(word)
    table = spark.createDataFrame([(w, 2) for w in [word, *edits]], "word string, n long")
    pairs = {frozenset((r["word"], r["other"])) for r in op.near_pairs(table).collect()}
    assert {frozenset((word, e)) for e in edits} <= pairs
    near = near_of({w: 2 for w in [word, *edits]})
    assert pairs == {frozenset((a, b)) for a in near for b in near[a]}


def test_documents(spark, awkward, awkward_rows, no_docs, clashing):
    text = " ".join(["Straße Éléphant elephant ELEPHANTS elephanto naïveté"] * 12 + ["elephan elephan elephzant"])
    rows = [(i, text) for i in range(8)] + [(None, text), (9, None), (10, ""), (11, "a" * 1000 + " " + "a" * 1001)] * 2
    got = rows_of(op.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(words_of(rows))
    want = brute(words_of([(r[0], r[1]) for r in awkward_rows]))
    assert rows_of(op.variants(awkward)) == want == rows_of(op.variants(clashing))
    assert rows_of(op.variants(no_docs)) == []


def test_very_long_words(spark):
    """Time grows with a word's length."""
    long = "abcdefghij" * 20_000
    table = spark.createDataFrame([(long, 2), (long + "k", 30), ("k" + long, 3), (long[::-1], 5)], "word string, n long")
    got = {len(r["word"]) * (1 if r["word"] < "b" else 2): (r["n_near"], r["form_n"]) for r in op.grouped(table).collect()}
    assert got[200_000] == (2, 30) and got[200_001] == (1, None)


@pytest.mark.parametrize("doc, run", [(d, r) for d in ("", "7", "12345") for r in ("abcdefg", "éàüßxyzw", "zzzzzzzz")])
def test_planted_misspellings(spark, doc, run):
    row = spark.range(1).select(op.misspelt(F.lit(doc), F.lit(run), 2).alias("x")).first()
    h = zlib.crc32(f"{doc}:{run}".encode())
    assert row["x"] == (run[: h % len(run)] + run[h % len(run) + 1:] if h % 2 == 0 else run)
