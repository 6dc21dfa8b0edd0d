"""The trie against one built in plain Python from whole sequences."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopgrain.llm import conversation_trie as op

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children.get(node, 0) == 0
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(node))))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children.get(node, 0), leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def awkward_rows():
    rng = random.Random(3)
    rows = [
        (c if rng.random() < 0.95 else 700, rng.choice([t, t, t, None, 1]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "", "zé😀"]))
        for c in range(-110, 220) for t in range(rng.choice([0, 1, 2, 3, 7, 12]))
    ]
    rows += [(None, 1, "u", "x")] * 3 + rows[:5]
    # Long ways that part late, one very long text, and many copies of one conversation.
    rows += [(300, i, "u", str(i % 3)) for i in range(60)] + [(400, i, "u", str(i % 3)) for i in range(65)]
    return rows + [(500, 0, "u", "long " * 100_000)] + [(i, 0, "u", "hot") for i in range(1000, 1100)]


@pytest.mark.parametrize("height, chunk", [(2, 4), (5, 16), (8, 4096)])
def test_against_plain_python(spark, height, chunk):
    """Bands and pieces of few and of many turns."""
    rows = awkward_rows()
    table = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(r) for r in op.trie(table, height, chunk).collect()), key=str)
    assert got == brute(rows)


def test_columns_of_any_name_and_no_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a")]
    table = spark.createDataFrame(rows, TURNS)
    clashing = table.withColumns({c: F.lit(7) for c in ("depth", "node", "parent", "chars", "last", "_pos", "Turn_digest", "odd.name")})
    got = op.trie(clashing)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert [f.dataType.simpleString() for f in got.schema][:7] == ["bigint"] * 7
    assert op.trie(table.limit(0)).collect() == []


def test_rounds_and_rows_are_bounded(spark):
    """One way of 600 turns and band height 8: the figures of a node go to at most 8 ancestors a level."""
    rows = [(0, i, "u", f"t{i}") for i in range(600)]  # the head of its family, so it keeps all its turns
    nodes = {r["depth"]: r for r in op.trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(nodes) == 601 and all(r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in nodes.values())
