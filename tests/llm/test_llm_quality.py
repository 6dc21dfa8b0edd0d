import random
import re
from collections import Counter

from shopgrain.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_signals_match_brute_force(spark, awkward, awkward_rows):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["x y", "", " ", "x y ", "#|z"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += [r[1] for r in awkward_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[k] for k in op.BASE) for r in op.signals(df, "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def corpus(spark, n=600):
    rng = random.Random(5)
    stop = ["the", "of", "and", "to", "in", "a", "is", "that"]
    rows = []
    for i in range(n):
        words = [rng.choice(stop) if rng.random() < 0.25 else f"w{rng.randint(0, 4000)}o" for _ in range(120)]
        text, kind = ". ".join(" ".join(words[j : j + 12]) for j in range(0, 120, 12)) + ".\nEnd of it.", i % 10
        if kind == 0:
            text = " ".join(w + "###" for w in words)
        elif kind == 1:
            text = " ".join(w.upper() for w in words)
        rows.append((i, text, kind > 1))
    return spark.createDataFrame(rows, "doc_id long, text string, good boolean")


def test_rules_are_weighed_and_clean_documents_stay(spark):
    docs = corpus(spark)
    rows = op.judge(docs).join(docs.select("doc_id", "good"), "doc_id").collect()
    assert all(r.kept for r in rows if r.good)
    assert sum(r.kept for r in rows if not r.good) <= 0.02 * len(rows)
    model = op.fit(op.signals(docs, "text").select(*[v.alias(k) for k, v in op.votes().items()]))
    assert 0.75 < model.good < 0.85 and model.right_good["symbols"] > 0.95


def test_estimation_matches_plain_python(spark):
    import math

    docs = corpus(spark, 200)
    voted = op.signals(docs, "text").select(*[v.alias(k) for k, v in op.votes().items()])
    rules = voted.columns
    table = [tuple(r) for r in voted.collect()]
    model = op.RuleModel()
    for _ in range(4):
        sums = Counter()
        for votes in table:
            lg, lb = math.log(model.good), math.log1p(-model.good)
            for k, v in zip(rules, votes, strict=True):
                g, b = model.right_good[k], model.right_bad[k]
                if v:
                    lg += math.log(g if v > 0 else 1 - g)
                    lb += math.log(1 - b if v > 0 else b)
            p = 1 / (1 + math.exp(lb - lg))
            sums["good"] += p
            for k, v in zip(rules, votes, strict=True):
                if v:
                    sums["gv", k] += p
                    sums["bv", k] += 1 - p
                    sums["gr", k] += p * (v > 0)
                    sums["br", k] += (1 - p) * (v < 0)
        belief = lambda r, n, guess, least: min(op.MOST, max(least, (r + 10 * guess) / (n + 10)))
        model = op.RuleModel(
            belief(sums["good"], len(table), 0.85, op.LEAST),
            {k: belief(sums["gr", k], sums["gv", k], 0.95, 0.5) for k in rules},
            {k: belief(sums["br", k], sums["bv", k], 0.4, op.LEAST) for k in rules},
        )
    got = op.fit(voted, steps=4)
    assert abs(got.good - model.good) < 1e-9
    assert all(abs(got.right_bad[k] - model.right_bad[k]) < 1e-9 for k in rules)


def test_kept_documents_are_whole(clashing, awkward):
    want = sorted([r.doc_id for r in op.judge(awkward).filter("kept").collect()], key=str)
    out = op.good_documents(clashing)
    assert out.columns == clashing.columns
    assert sorted([r.doc_id for r in out.collect()], key=str) == want


def test_empty_table(no_docs):
    assert op.judge(no_docs).count() == 0 and op.good_documents(no_docs).count() == 0
