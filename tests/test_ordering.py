import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopgrain.functions.ordering import percentiles, ranked, top_n
from shopgrain.functions.tenancy import keep_bound, mark_tenants, scope, tenant_bound
from shopgrain.operators.customers import score_quintil


def frame(spark, data):
    df = spark.createDataFrame(data, "client_key string, k string, v int")
    return df.withColumn("v", F.col("v").cast("decimal(28,2)"))


def expected(data):
    groups = defaultdict(list)
    for g, k, v in data:
        groups[g].append((-v, k))
    out = {}
    for g, items in groups.items():
        run = 0
        for pos, (nv, k) in enumerate(sorted(items), 1):
            run -= nv
            out[g, k] = (pos, len(items), run, -sum(x for x, _ in items))
    return out


@pytest.mark.parametrize("bound", [None, 3])
def test_ranked_with_a_hot_shop_and_one_value_in_a_third_of_rows(spark, bound):
    rnd = random.Random(7)
    data = [("hot", f"k{i:04d}", 5 if i % 3 == 0 else rnd.randint(-50, 50)) for i in range(1500)]
    data += [("b", f"k{i}", rnd.randint(0, 3)) for i in range(40)] + [("c", "only", 9)]
    df = frame(spark, data)
    if bound:
        df = mark_tenants(df, bound)
    out = ranked(
        df, ["client_key"], [-F.col("v"), F.col("k")], {"v": F.col("v")},
    )
    got = {(r.client_key, r.k): (r._pos, r._n, int(r._cum_v), int(r._sum_v)) for r in out.collect()}
    assert got == expected(data)


def test_a_large_group_spans_ranges_of_even_size(spark):
    df = frame(spark, [("hot", f"k{i:05d}", 1) for i in range(8000)] + [("small", "k", 1)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df.repartition(8), ["client_key"], [F.col("v"), F.col("k")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Places alone are read from the sorted files without a window over the rows.
    assert "row_number" not in plan
    sizes = [r["count"] for r in spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).groupBy(
        F.shiftright("_id", 33)).count().collect()]
    assert sum(sizes) == 8001 and len(sizes) == 4 and max(sizes) < 2 * min(sizes)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_percentiles_match_numpy(spark, values):
    data = [("a", f"k{i}", v) for i, v in enumerate(values)]
    out = percentiles(
        frame(spark, data), ["client_key"], "v", {"p25": 0.25, "p75": 0.75, "p5": 0.05}
    ).first()
    want = np.percentile(values, [25, 75, 5])
    assert np.allclose([out.p25, out.p75, out.p5], want)


@pytest.mark.parametrize("astray", [False, True])
def test_percentiles_order_only_the_values_around_them(spark, monkeypatch, astray):
    from shopgrain.functions import ordering

    rnd = random.Random(3)
    data = [("hot", rnd.gauss(0, 1)) for _ in range(30000)] + [("tied", 4.0)] * 5000 + [("tied", float(i)) for i in range(9)]
    data += [("three", float(i)) for i in (5, 1, 9)] + [("one", 2.5)]
    df = spark.createDataFrame(data, "client_key string, v double").repartition(6).unionByName(
        spark.createDataFrame([("one", None), ("none", None)], "client_key string, v double"))
    ordered = []
    monkeypatch.setattr(ordering, "ranked", lambda d, *a, **k: (ordered.append(d.count()), ranked(d, *a, **k))[1])
    if astray:
        # A sketch that names the ends of the group for every point: all brackets miss.
        monkeypatch.setattr(F, "percentile_approx", lambda x, ps, _: F.array(*[F.max(x)] * len(ps)))
    points = {"p5": 0.05, "p75": 0.75, "p100": 1.0}
    got = {r.client_key: (r.p5, r.p75, r.p100) for r in percentiles(df, ["client_key"], "v", points).collect()}
    want = {g: np.percentile([v for h, v in data if h == g], [5, 75, 100]) for g in ("hot", "tied", "three", "one")}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[g], want[g], rtol=1e-12) for g in want)
    assert astray or ordered[0] < 300


@pytest.mark.parametrize("bound", [None, 3])
def test_tied_totals_span_ranges(spark, bound):
    rnd = random.Random(5)
    # Nine in ten rows of the hot shop have one value, which fills several ranges.
    data = [("hot", f"k{i:05d}", 5 if i % 10 else rnd.randint(-9, 19)) for i in range(4000)]
    data += [("b", f"k{i}", rnd.randint(-2, 2)) for i in range(30)] + [("c", "only", 9)]
    df = frame(spark, data)
    if bound:
        df = mark_tenants(df, bound)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df, ["client_key"], [-F.col("v"), F.col("k")], {"v": F.col("v")}, peers=1)
        got = {(r.client_key, r.k): (r._pos, int(r._cum_v), int(r._peers_v)) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = expected(data)
    for g, k, v in data:
        pos, _, cum, _ = places[g, k]
        assert got[g, k][:2] == (pos, cum)
    sums = {(g, v): sum(x for h, _, x in data if h == g and x >= v) for g, v in {(g, v) for g, _, v in data}}
    assert all(got[g, k][2] == sums[g, v] for g, k, v in data)


def test_quintile_closed_form(spark):
    pd = pytest.importorskip("pandas")
    sizes = [1, 2, 3, 4, 5, 6, 7, 10, 11, 23, 100, 699]
    df = spark.createDataFrame([(n, k) for n in sizes for k in range(1, n + 1)], "n int, k int")
    got = defaultdict(list)
    for r in df.select("n", "k", score_quintil(F.col("k"), F.col("n")).alias("s")).orderBy("n", "k").collect():
        got[r.n].append(r.s)
    for n in sizes[1:]:
        want = (pd.qcut(pd.Series(range(1, n + 1)), q=5, labels=False, duplicates="drop") + 1).tolist()
        assert got[n] == want, n
    assert got[1] == [1]
    for n in (100, 699, 23):
        counts = [got[n].count(s) for s in range(1, 6)]
        assert max(counts) - min(counts) <= 1


def test_top_n_limits_before_the_exchange(spark):
    df = frame(spark, [("a", f"k{i}", i) for i in range(50)] + [("b", "z", 1)])
    out = top_n(df, 3, F.desc("v"), F.asc("k"))
    assert sorted((r.client_key, int(r.v)) for r in out.collect()) == [("a", 47), ("a", 48), ("a", 49), ("b", 1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_tenant_bound_travels(spark):
    df = mark_tenants(frame(spark, [("a", "k", 1), ("b", "k", 2)]), 7)
    assert tenant_bound(df.groupBy("client_key").agg(F.sum("v").alias("s"))) == 7
    assert tenant_bound(scope(df, "a")) == 1 and scope(df, "a").count() == 1
    plain = frame(spark, [("a", "k", 1)])
    assert tenant_bound(plain) is None and tenant_bound(keep_bound(plain, df)) == 7
