import hashlib
import re
from collections import defaultdict

from shopgrain.llm import exact_dedup as op

SPACE = re.compile(r"[\x20\x09-\x0D]")


def index(spark, tmp_path, name="index"):
    return op.DigestIndex.open(spark, f"{tmp_path}/{name}", buckets=3)


def brute(rows):
    """doc_id -> list of (keep_id, group_size) and the number of kept rows of each text."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()].append((doc, text or ""))
    out = []
    for h, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc, keep, len(members), h) for doc, _ in members]
    return sorted(out, key=str), len(groups)


def test_verdicts_match_brute_force(spark, tmp_path, awkward, awkward_rows):
    got = op.verdicts(awkward, index(spark, tmp_path), "b1").collect()
    want, n = brute([(r[0], r[1]) for r in awkward_rows])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_later_batches_meet_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    more = spark.createDataFrame([(3, "ab"), (4, "d"), (5, "d ")], "doc_id long, text string")
    op.verdicts(docs, index(spark, tmp_path), "one").collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in op.verdicts(more, index(spark, tmp_path), "two").collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    # A batch that runs again is judged as before and adds nothing.
    again = op.verdicts(more, index(spark, tmp_path), "two").collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in again} == got
    assert spark.table(index(spark, tmp_path).table).count() == 3


def test_index_is_read_without_a_shuffle(spark, tmp_path):
    i = index(spark, tmp_path)
    docs = spark.createDataFrame([(n, f"t{n}") for n in range(50)], "doc_id long, text string")
    op.verdicts(docs, i, "one").collect()
    new = spark.createDataFrame([("x", 1)], "digest string, keep_id long").hint("merge")
    plan = new.join(spark.table(i.table).select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_unique_keeps_whole_rows(spark, tmp_path, clashing, awkward_rows):
    got = op.unique(clashing, index(spark, tmp_path), "b").collect()
    want, n = brute([(r[0], r[1]) for r in awkward_rows])
    assert len(got) == n
    assert sorted([r.doc_id for r in got], key=str) == sorted({(h, k) for _, k, _, h in want} and
                                                              [k for _, k in {(h, k) for _, k, _, h in want}], key=str)
    assert got[0].__fields__ == clashing.columns
    assert op.unique(clashing, index(spark, tmp_path), "later").count() == 0


def test_empty_table(spark, tmp_path, no_docs):
    assert op.verdicts(no_docs, index(spark, tmp_path), "b").count() == 0
    assert op.unique(no_docs, index(spark, tmp_path), "c").count() == 0
