import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgrain.llm import mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes):
    """Targets by resharing the excess again and again; sizes in source order."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    rest, free = 1.5 * sum(sizes), set(range(len(sizes)))
    while free:
        level = rest / sum(weights[i] for i in free)
        above = {i for i in free if weights[i] * level > 2 * sizes[i]}
        for i in above or free:
            out[i] = 2.0 * sizes[i] if above else weights[i] * level
        rest -= sum(out[i] for i in above)
        free = free - above if above else set()
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=7))
def test_targets_are_the_fixed_point(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in op.targets(df).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(shares(sizes))


def test_plan_of_awkward_rows(awkward, awkward_rows):
    got = op.plan(awkward).collect()
    n = [len(WORD.findall(r[1] or "")) for r in awkward_rows]
    totals = Counter()
    for r, k in zip(awkward_rows, n, strict=True):
        totals[r[3]] += k
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shares([totals[s] for s in order]), strict=True))
    want = []
    for r, k in zip(awkward_rows, n, strict=True):
        rate = target[r[3]] / totals[r[3]] if totals[r[3]] else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        want.append((r[0], k, totals[r[3]], round(target[r[3]], 6), k * (int(rate) + (u < rate - int(rate)))))
    assert sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got], key=str) == sorted(want, key=str)
    assert all(r.taken <= 2 * r.size for r in got)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(9000)], "doc_id long, text string, source string"
    )
    rows = op.plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    for source, target in {(r.source, r.target) for r in rows}:
        assert taken[source] == pytest.approx(target, rel=0.1)
    assert {(r.doc_id, r.taken) for r in op.plan(docs.repartition(7)).collect()} == {(r.doc_id, r.taken) for r in rows}


def test_mixed_emits_the_planned_copies(clashing):
    plan = Counter()
    for r in op.plan(clashing).collect():
        plan[r.doc_id] += r.copies
    out = op.mixed(clashing)
    assert out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_many_sources_take_the_salted_join(spark, awkward, monkeypatch):
    want = sorted([(r.doc_id, r.taken) for r in op.plan(awkward).collect()], key=str)
    monkeypatch.setattr(op, "BROADCAST_SOURCES", 0)
    assert sorted([(r.doc_id, r.taken) for r in op.plan(awkward).collect()], key=str) == want


def test_empty_table(no_docs):
    assert op.plan(no_docs).count() == 0 and op.mixed(no_docs).count() == 0
