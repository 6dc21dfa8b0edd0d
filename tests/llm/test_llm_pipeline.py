"""The stages of the pipeline on planted documents, each against plain Python on what the one before kept."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from test_llm_mixing import shares
from test_llm_near_join import brute as classes_of
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    """(doc_id, text, kind) with exact copies, near copies, copies that differ in white space, and bad texts."""
    rng = random.Random(8)
    stop = ["the", "of", "and", "to", "in", "a", "is", "that"]
    rows = []
    for i in range(240):
        words = [rng.choice(stop) if rng.random() < 0.3 else f"w{rng.choice('aeiou')}{rng.randint(0, 4000)}" for _ in range(120)]
        rows.append((". ".join(" ".join(words[j:j + 12]) for j in range(0, 120, 12)) + ".\nEnd of it.", "clean"))
    clean = [t for t, _ in rows]
    rows += [(clean[3], "copy")] * 5 + [(clean[4] + "  \n", "copy"), (clean[4].replace(" ", "  "), "copy")]
    for at in (7, 7, 8):
        words = clean[at].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((" ".join(words), "near"))
    for t in clean[20:44]:
        rows.append((" ".join(f"{w}###" for w in t.split()), "bad"))
    rows += [("too short", "bad"), ("", "bad"), (None, "bad"), ("again and again it says the same few words. " * 40, "bad")]
    rng.shuffle(rows)
    return [(i, t, k) for i, (t, k) in enumerate(rows)]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The planted rows, and for each stage its name, its input and its output."""
    planted = documents()
    rows = [(i, t, "en", ["hot", "hot", "b", None][i % 4], len(t or "")) for i, t, _ in planted]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{n}")
        after = spark.read.parquet(f"{path}/{n}")
        out.append((name, docs, after))
        docs = after
    return planted, path, out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_order_and_columns(staged):
    _, _, out = staged
    assert [n for n, *_ in out] == ["quality rules", "exact dedup", "n-gram jaccard join", "mixing sources", "packing"]
    for _, before, after in out[:-1]:
        assert after.columns == before.columns


def test_quality_rules_reject_bad_texts_only(staged):
    planted, _, out = staged
    assert sorted(texts(out[0][2])) == [i for i, _, kind in planted if kind != "bad"]


def test_exact_dedup_keeps_one_of_each_text(staged):
    _, before, after = staged[2][1]
    groups = defaultdict(list)
    for i, t in texts(before).items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert sorted(texts(after)) == sorted(min(g)[1] for g in groups.values())


def test_near_copies_leave_one_of_each_class(staged):
    _, before, after = staged[2][2]
    rows, kept = list(texts(before).items()), set(texts(after))
    members = defaultdict(set)
    for doc, cls, _ in classes_of(rows):
        members[cls].add(doc)
    assert max(map(len, members.values())) == 3
    assert all(len(m & kept) == 1 for m in members.values()) and kept <= set(dict(rows))


def test_mix_takes_the_planned_copies(staged):
    _, before, after = staged[2][3]
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text))) for r in before.collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shares([size[s] for s in order]), strict=True))
    want = Counter()
    for i, s, _ in rows:
        rate = target[s] / size[s]
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] += int(rate) + (u < rate - int(rate))
    assert Counter(r.doc_id for r in after.collect()) == +want


def test_packing_gives_every_token_once(staged):
    _, before, after = staged[2][4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for r in before.collect():
        want[r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1] += 1
    pieces = after.collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id, p.doc_tokens] += p.length
    assert tokens == Counter({k: n * k[1] for k, n in want.items()})
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    full = sum(sum(n for _, n in s) == 2048 for s in by.values())
    assert full >= len(by) - 1


def test_run_gives_the_rows_of_the_last_stage(spark, staged):
    _, path, out = staged
    cols = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    key = lambda r: tuple(r[c] for c in cols)
    assert Counter(map(key, corpus_pipeline.run(spark, path).collect())) == Counter(map(key, out[-1][2].collect()))
