import random
from collections import Counter
from datetime import date, datetime, timedelta
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from shopgrain.functions.tenancy import tenant_column
from shopgrain.operators import abcxyz, anomaly, basket, customers, forecast, pricing
from shopgrain.plans import queries


def test_abc_boundary_and_ties(make):
    i = make.itens([("a", "1", f"p{k}", 1, 1, 0, t, "2024-01-01") for k, t in enumerate((80, 5, 5, 5, 5))]
                   + [("b", "1", "z", 1, 1, 0, 0, "2024-01-01")])
    got = {(r.client_key, r.produto_key): (r.classe, r.percentual_acumulado) for r in abcxyz.abc(i).collect()}
    assert got == {
        ("a", "p0"): ("A", 80.0), ("a", "p1"): ("B", 85.0), ("a", "p2"): ("B", 90.0), ("a", "p3"): ("B", 95.0),
        ("a", "p4"): ("C", 100.0), ("b", "z"): ("C", None),
    }


def test_abc_shares_rise_to_100(make):
    rnd = random.Random(3)
    i = make.itens([("a", str(k), f"p{k % 37}", 1, 1, 0, rnd.randint(1, 900), "2024-01-01") for k in range(300)])
    out = abcxyz.abc(i).orderBy("percentual_acumulado").collect()
    assert out[-1].percentual_acumulado == 100.0
    assert abs(sum(r.percentual for r in out) - 100) < 0.5
    assert [r.classe for r in out] == sorted(r.classe for r in out)
    fat = [r.faturamento for r in out]
    assert fat == sorted(fat, reverse=True)


def test_xyz_counts_present_months_only(make):
    i = make.itens([
        ("a", "1", "um", 5, 1, 0, 1, "2024-01-01"), ("a", "2", "zero", 0, 1, 0, 1, "2024-01-01"),
        ("a", "3", "var", 1, 1, 0, 1, "2024-01-01"), ("a", "4", "var", 9, 1, 0, 1, "2024-06-01"),
        ("a", "5", "var", 0, 1, 0, 1, "2024-09-01"),
    ])
    got = {r.produto_key: (r.media, r.desvio, r.cv, r.classe_xyz) for r in abcxyz.xyz(i).collect()}
    assert got["um"] == (5.0, 0.0, 0.0, "X") and got["zero"] == (0.0, 0.0, 0.0, "X")
    assert got["var"] == (3.333, 4.933, 1.48, "Z")
    both = {r.produto_key: r.classe_abc_xyz for r in abcxyz.abc_xyz(i).collect()}
    assert both["var"][1] == "Z" and set(both) == {"um", "zero", "var"}


def test_rfm_scores_ties_and_null_customer(make):
    v = make.vendas(
        [("a", str(k), f"2024-01-{k + 1:02d} 12:00:00", f"c{k}", "v", 10 * (k + 1), 0) for k in range(6)]
        + [("a", "n", "2024-01-31 12:00:00", None, "v", 999, 0), ("b", "1", "2024-01-01 00:00:00", "x", "v", 5, 0)]
    )
    got = {(r.client_key, r.cliente_id): r for r in customers.rfm(v, datetime(2024, 2, 1)).collect()}
    assert len(got) == 7
    # Equal counts are placed by key; the place decides the score.
    assert [got["a", f"c{k}"].score_f for k in range(6)] == [1, 1, 2, 3, 4, 5]
    assert [got["a", f"c{k}"].score_r for k in range(6)] == [1, 2, 3, 4, 5, 5]
    assert got["a", "c5"].segmento == "campeon" and got["a", "c5"].score_rfm == "555"
    assert got["a", "c0"].recencia == 30
    one = got["b", "x"]
    assert (one.score_r, one.score_f, one.score_m) == (5, 1, 1)


def brute_rules(baskets, support, conf, lift):
    n = len(baskets)
    sup = Counter()
    for b in baskets:
        for k in (1, 2, 3):
            sup.update(combinations(sorted(set(b)), k))
    sup = {s: c / n for s, c in sup.items() if c / n >= support}
    out = set()
    for s in sup:
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = tuple(x for x in s if x not in a)
                cf = sup[s] / sup[a]
                if cf >= conf and cf / sup[c] >= lift:
                    out.add((", ".join(a), ", ".join(c)))
    return sup, out


def test_basket_matches_brute_force(make):
    rnd = random.Random(11)
    baskets = [rnd.choices("ABCDEFGH", k=rnd.randint(1, 6)) for _ in range(60)]
    baskets += [list("XYZ") + rnd.choices("AB", k=1) for _ in range(12)] + [list("AB")] * 36
    data = [("a", str(n), p, 1, 1, 0, 1) for n, b in enumerate(baskets) for p in b]
    data += [("small", str(n), p, 1, 1, 0, 1) for n in range(9) for p in "AB"]
    sets = basket.itemsets(make.itens(data), 0.05)
    want_sets, want_rules = brute_rules(baskets, 0.05, 0.2, 1.2)
    got = {tuple(r.itens): r.suporte for r in sets.collect()}
    assert set(got) == set(want_sets)
    assert all(abs(got[s] - want_sets[s]) < 1e-12 for s in got)
    rules = basket.regras(sets)
    found = {(r.antecedents, r.consequents): r.lift for r in rules.collect()}
    assert set(found) == want_rules and ("X, Y", "Z") in found
    for (a, c), lift in found.items():
        if (c, a) in found:
            assert found[c, a] == lift
    hints = rows(basket.sugestoes(rules, "X"), "antecedents")
    assert len(hints) == 5 and all("X" in h[0].split(", ") for h in hints)
    assert basket.top_regras(rules, 4).count() == 4


def test_ten_baskets_are_enough_nine_are_not(make):
    nine = [("a", str(n), p, 1, 1, 0, 1) for n in range(9) for p in "AB"]
    ten = [("b", str(n), p, 1, 1, 0, 1) for n in range(10) for p in "AB"]
    out = rows(basket.itemsets(make.itens(nine + ten), 0.5), "client_key", "contagem")
    assert out == [("b", 10)] * 3


def dealt_shop(make, single=False):
    """Forty finished sales and one open one, of five products in three categories; three of them hold one product twice."""
    lines = [(k, p) for k in range(40) for p in range(5) if (k + p) % 3 or k % 4 == 0] + [(k, 1) for k in range(3)]
    frames = dict(
        itens=make.itens([("a", f"s{k}", f"p{p}", 1, 1, 0, 1) for k, p in [*lines, (40, 0)]]).drop("data_venda"),
        vendas=make.vendas([("a", f"s{k}", "2024-01-01 10:00:00", "c", "v", 1, 0) for k in range(40)]
                           + [("a", "s40", "2024-01-01 10:00:00", "c", "v", 1, 0, "pendente")]),
        produtos=make.produtos([("a", f"p{p}", "n", f"C{p % 3}", 1, 2) for p in range(5)]),
    )
    if single:
        frames = {k: df.select(tenant_column("a"), *df.drop("client_key").columns) for k, df in frames.items()}
    return SimpleNamespace(**frames), [[f"C{p % 3}" for k, p in lines if k == n] for n in range(40)]


@pytest.fixture
def no_broadcast(spark):
    """Tiny items would be broadcast to the sales, which those of a real shop are not."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("single", [False, True])
def test_basket_tasks_do_not_grow_with_the_items(make, monkeypatch, no_broadcast, single):
    """More items make more tasks than the session has partitions; a sale stays in one task, and the sets are the same."""
    shop, baskets = dealt_shop(make, single)
    seen, itemsets = [], basket.itemsets
    monkeypatch.setattr(basket, "itemsets", lambda i, *a: seen.append(i) or itemsets(i, *a))
    plain = {tuple(r.itens): r.suporte for r in queries._sets(shop, 0.05).collect()}
    monkeypatch.setattr(basket, "ITEMS_IN_TASK", 10)
    dealt = {tuple(r.itens): r.suporte for r in queries._sets(shop, 0.05).collect()}
    n = -(-shop.itens.count() // 10)
    assert n > 4 and seen[1].rdd.getNumPartitions() == n
    where = seen[1].select("venda_key", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(where) == 40 and len({r.task for r in where}) > 4
    # Gathering the baskets adds no shuffle that the session's partitions bound.
    gathered = seen[1].groupBy("client_key", "venda_key").agg(F.collect_set("produto_key").alias("b"))
    assert gathered.rdd.getNumPartitions() == n
    assert dealt == plain == {s: pytest.approx(v) for s, v in brute_rules(baskets, 0.05, 0.2, 1.2)[0].items()}


@pytest.mark.parametrize("sent, strategy", [(1024, "broadcast"), (-1, "merge")])
def test_expanded_baskets_are_never_gathered_in_the_driver(make, monkeypatch, sent, strategy):
    """Frequent products and pairs go to the baskets, or both are shuffled; the planner is not left to send the baskets."""
    monkeypatch.setattr(basket, "SENT_BYTES", sent)
    shop, baskets = dealt_shop(make, single=True)
    joins, join_found = [], basket._join_found
    monkeypatch.setattr(basket, "_join_found", lambda *a: joins.append(join_found(*a)) or joins[-1])
    sets = queries._sets(shop, 0.05)
    levels = [line for line in sets._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(levels) == 3 and all("rightHint=(strategy=" in line for line in levels)
    for joined in joins:
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert f"rightHint=(strategy={strategy})" in plan.split("Join ")[1].splitlines()[0]
    assert len(joins) == 3
    got = {tuple(r.itens): r.suporte for r in sets.collect()}
    assert got == {s: pytest.approx(v) for s, v in brute_rules(baskets, 0.05, 0.2, 1.2)[0].items()}


@pytest.mark.parametrize("name", ["insights_vendas", "rotacao_temporal", "ler_insights"])
def test_items_of_the_sales_page_meet_many_sales_in_tasks_that_follow_them(make, monkeypatch, no_broadcast, name):
    seen = []
    monkeypatch.setattr(queries, "_sales_page", lambda s, *a: seen.append(queries._itens_ok(s)) or seen[0])
    for later in ("_history", "_now"):
        monkeypatch.setattr(queries, later, lambda s: None)
    monkeypatch.setattr(queries.insights, "rotacao_temporal", lambda df, *a: df)
    monkeypatch.setattr(queries.insights, "ler_insights", lambda df, *a: df)
    monkeypatch.setattr(basket, "ITEMS_IN_TASK", 10)
    shop, _ = dealt_shop(make)
    few = rows(queries._itens_ok(SimpleNamespace(**vars(shop))), "venda_key", "produto_key")
    monkeypatch.setattr(queries, "SALES_SENT", 40)
    queries.TEXTS[name](shop)
    assert seen[0].rdd.getNumPartitions() == -(-shop.itens.count() // 10)
    assert rows(seen[0], "venda_key", "produto_key") == few


def test_large_catalogue_is_not_met_by_sorting_the_items(make, monkeypatch):
    shop, _ = dealt_shop(make)
    before = rows(queries._by_category(SimpleNamespace(**vars(shop))), "venda_key", "produto_key")
    monkeypatch.setattr(queries, "PRODUCTS_SORTED", 4)
    after = queries._by_category(SimpleNamespace(**vars(shop)))
    assert "strategy=shuffle_hash" in after._jdf.queryExecution().optimizedPlan().toString()
    assert rows(after, "venda_key", "produto_key") == before


def monthly(key, prices, quantities):
    return [
        ("a", f"{key}{m}", key, q, p, 0, round(p * q, 2), f"2024-{m + 1:02d}-10")
        for m, (p, q) in enumerate(zip(prices, quantities))
    ]


def test_elasticity_matches_a_fit(make):
    p = [10, 11, 9, 12, 10, 13, 8, 10]
    q = [100, 85, 120, 70, 101, 60, 140, 99]
    i = make.itens(
        monthly("fit", p, q) + monthly("flat", [5] * 7, [1, 2, 1, 2, 1, 2, 3])
        + monthly("steady", [5] * 7, [2] * 7) + monthly("short", p[:5], q[:5])
        + monthly("gap", [4, 5, 6, 4, 5, 7], [0, 3, 2, 0, 4, 1])
    )
    known = make.produtos([("a", "fit", "Produto", None, 1, 2)])
    got = {r.produto_key: r for r in pricing.elasticidade(i, known).collect()}
    assert set(got) == {"fit", "flat", "steady"}
    dp = np.diff(p) / np.array(p[:-1]) * 100
    dq = np.diff(q) / np.array(q[:-1]) * 100
    slope, _ = np.polyfit(dp, dq, 1)
    r = got["fit"]
    assert r.elasticidade == round(slope, 3) and r.r2 == round(np.corrcoef(dp, dq)[0, 1] ** 2, 3)
    assert (r.nome, r.categoria, r.tipo) == ("Produto", None, "elastico")
    assert r.receita_total == float(sum(a * b for a, b in zip(p[1:], q[1:])))
    assert (got["flat"].elasticidade, got["flat"].r2, got["flat"].tipo) == (0.0, 0.0, "inelastico")
    assert (got["steady"].r2, got["steady"].nome, got["steady"].categoria) == (1.0, "steady", "")
    grid = {r.variacao_preco: r for r in pricing.cenario_preco(
        pricing.elasticidade(i, known).filter("produto_key = 'flat'")).collect()}
    assert len(grid) == 13 and grid[0.0].impacto_receita == 0.0 and grid[-30.0].impacto_pct == -30.0


def test_margin_without_revenue_or_product(make):
    i = make.itens([("a", "1", "p1", 2, 10, 1, 19), ("a", "1", "zero", 1, 1, 0, 0), ("a", "1", "novo", 1, 1, 0, 5)])
    p = make.produtos([("a", "p1", "Um", "C", 4, 10), ("a", "zero", "Zero", "C", 4, 10)])
    got = {r.produto_key: (r.custo_total, r.margem_bruta, r.pct_margem) for r in pricing.margem(i, p).collect()}
    assert got == {"p1": (8.0, 11.0, 57.89), "zero": (4.0, -4.0, None), "novo": (None, None, None)}


def daily_items(key, n, qty, start=date(2024, 1, 1)):
    return [("a", f"{key}{d}", key, qty(d), 1, 0, 1, str(start + timedelta(days=d))) for d in range(n)]


def test_forecast_routes_and_bands(make):
    i = make.itens(
        daily_items("one", 1, lambda d: 10) + daily_items("d29", 29, lambda d: 1 + d % 3)
        + daily_items("d30", 30, lambda d: 4)
        + daily_items("week", 140, lambda d: 20 if (date(2024, 1, 1) + timedelta(days=d)).weekday() == 5 else 10)
    )
    out = forecast.forecast(i, 14)
    got = {}
    for r in out.collect():
        got.setdefault(r.produto_key, []).append(r)
    assert all(len(v) == 14 for v in got.values())
    one = got["one"][0]
    assert (one.quantidade_prevista, one.quantidade_min, one.quantidade_max, one.metodo) == (10, 8, 12, "media_movel")
    assert got["d29"][0].metodo == "media_movel" and got["d30"][0].metodo == "sazonal"
    assert {r.quantidade_prevista for r in got["d30"]} == {4.0}
    for r in got["week"]:
        near = 20 if r.data.weekday() == 5 else 10
        assert abs(r.quantidade_prevista - near) < 2.5 and 0 <= r.quantidade_min <= r.quantidade_prevista
    assert min(r.data for r in got["one"]) == date(2024, 1, 2)


def test_forecast_summary_covers_31_days_from_the_first(spark):
    days = [("a", "p", date(2024, 1, 1) + timedelta(days=d), 1.0, 0.5, 2.0, "m") for d in range(60)]
    days += [("a", "late", date(2024, 3, 1), 9.0, 9.0, 9.0, "m")]
    df = spark.createDataFrame(days, "client_key string, produto_key string, data date, quantidade_prevista double, "
                                     "quantidade_min double, quantidade_max double, metodo string")
    cols = ("produto_key", "quantidade_prevista", "quantidade_min", "quantidade_max")
    assert rows(forecast.forecast_resumo(df), *cols) == [("late", 9.0, 9.0, 9.0), ("p", 31.0, 15.5, 62.0)]
    assert rows(forecast.forecast_resumo(df, per_shop=True), *cols) == [("p", 31.0, 15.5, 62.0)]


def test_one_cent_sale_with_a_huge_discount_stops_nothing(make):
    v = make.vendas(
        [("a", str(k), "2024-01-01 10:00:00", "c", "v1", 100, 5) for k in range(30)]
        + [("a", "cent", "2024-01-01 10:00:00", "c", "v1", "0.01", 20000)]
    )
    got = anomaly.anomalias_desconto(v).collect()
    assert [r.venda_key for r in got] == ["cent"] and got[0].pct_desconto == 2e8


def test_default_thresholds_find_planted_rules(make):
    """40 of 100 baskets hold a and b together; the rest hold one article of many."""
    items = [("s", str(k), p, 1, 10, 0, 10) for k in range(40) for p in ("a", "b")]
    items += [("s", str(k), f"x{k % 30}", 1, 10, 0, 10) for k in range(40, 100)]
    found = basket.regras(basket.itemsets(make.itens(items))).collect()
    assert sorted((r.antecedents, r.consequents, r.support, r.confidence, r.lift) for r in found) == [
        ("a", "b", 40.0, 100.0, 2.5), ("b", "a", 40.0, 100.0, 2.5),
    ]


def test_odd_discounts(make):
    v = make.vendas(
        [("a", str(k), "2024-01-01 10:00:00", "c", "v1", 100, 5) for k in range(30)]
        + [("a", "odd", "2024-01-01 10:00:00", "c", "v2", 100, 60), ("a", "free", "2024-01-01 10:00:00", "c", "v1", 0, 9)]
        + [("same", str(k), "2024-01-01 10:00:00", "c", "v1", 100, 5) for k in range(5)]
    )
    out = anomaly.anomalias_desconto(v)
    assert rows(out, "client_key", "venda_key", "pct_desconto") == [("a", "odd", 60.0)]
    pct = [5.0] * 30 + [60.0, 0.0]
    z = (60 - np.mean(pct)) / np.std(pct, ddof=1)
    assert out.first().z_score == pytest.approx(z, rel=1e-9)
    total = anomaly.resumo_anomalias(out.limit(0), out, v)
    assert rows(total, "client_key", "total_descontos_anomalos", "valor_descontos", "total_anomalias_venda") == [
        ("a", 1, 60.0, 0), ("same", 0, 0.0, 0)]


def test_sellers(make):
    v = make.vendas([
        ("a", "1", "2024-01-01", "c", "v1", 10, 1), ("a", "2", "2024-01-01", "c", "v2", 30, 0),
        ("a", "3", "2024-01-01", "c", None, 99, 0), ("solo", "4", "2024-01-01", "c", "v", 5, 0),
        ("eq", "5", "2024-01-01", "c", "x", 5, 0), ("eq", "6", "2024-01-01", "c", "y", 5, 0),
    ])
    got = {(r.client_key, r.vendedor_id): (r.desconto_medio, r.z_ticket) for r in anomaly.anomalias_vendedor(v).collect()}
    assert got == {
        ("a", "v1"): (10.0, -0.71), ("a", "v2"): (0.0, 0.71), ("solo", "v"): (0.0, None),
        ("eq", "x"): (0.0, 0.0), ("eq", "y"): (0.0, 0.0),
    }


def test_isolation_scores_find_planted_sales(make):
    rnd = random.Random(5)
    usual = [
        ("a", f"n{k}", f"2024-03-{1 + k % 28:02d} {8 + k % 10:02d}:00:00", "c", "v", round(rnd.gauss(100, 10), 2),
         round(abs(rnd.gauss(5, 1)), 2)) for k in range(380)
    ]
    odd = [("a", f"odd{k}", "2024-03-03 03:00:00", "c", "v", 5000 + k, 900) for k in range(8)]
    few = [("few", str(k), "2024-03-03 03:00:00", "c", "v", k, 0) for k in range(49)]
    v = make.vendas(usual + odd + few)
    out = anomaly.anomalias_vendas(v).collect()
    assert {r.client_key for r in out} == {"a"}
    assert {f"odd{k}" for k in range(8)} <= {r.venda_key for r in out}
    assert len(out) <= 0.05 * 388 + 1
    worst = sorted(out, key=lambda r: r.anomalia_score)[:8]
    assert all(r.venda_key.startswith("odd") for r in worst)
    again = anomaly.anomalias_vendas(v).collect()
    assert sorted((r.venda_key, r.anomalia_score) for r in again) == sorted((r.venda_key, r.anomalia_score) for r in out)


def test_isolation_batches_do_not_change_scores(make, monkeypatch):
    v = make.vendas([("a", str(k), "2024-03-03 10:00:00", "c", "v", k * k, k % 7) for k in range(120)])
    one = {r.venda_key: r.anomalia_score for r in anomaly.pontuar_vendas(v, trees=10).collect()}
    monkeypatch.setattr(anomaly, "ROWS_PER_BATCH", 25)
    many = {r.venda_key: r.anomalia_score for r in anomaly.pontuar_vendas(v, trees=10).collect()}
    assert one == many and len(one) == 120


def test_shops_may_have_their_own_churn_days(spark):
    base = spark.createDataFrame(
        [("a", "x", 1, 10.0, 50), ("a", "y", 1, 5.0, 20), ("b", "z", 1, 7.0, 50)],
        "client_key string, cliente_id string, frequencia int, valor_total double, recencia int",
    )
    limits = spark.createDataFrame([("a", 10), ("c", 1)], "client_key string, churn_days int")
    assert rows(customers.clientes_inativos(base), "client_key", "cliente_id") == [("a", "x"), ("b", "z")]
    assert rows(customers.clientes_inativos(base, limits=limits), "client_key", "cliente_id") == [
        ("a", "x"), ("a", "y"), ("b", "z")]


def test_forests_in_place_and_by_batch_agree(spark, make, monkeypatch):
    """Sales are not shuffled while the forests are small, and the scores are the same either way."""
    rows = [(s, f"v{i}", f"2024-01-{1 + i % 28:02d}T{8 + i % 10:02d}:00:00", "c", "x", 10 + i * i % 97, i % 7) for s in "ab" for i in range(120)]
    rows += [("few", f"v{i}", "2024-01-01T10:00:00", "c", "x", i, 0) for i in range(20)]
    sales = make.vendas(rows)
    near = anomaly.pontuar_vendas(sales, trees=10)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInPandas" in plan
    monkeypatch.setattr(anomaly, "FOREST_BYTES", 0)
    far = anomaly.pontuar_vendas(sales, trees=10)
    key = lambda df: sorted((r.client_key, r.venda_key, r.anomalia_score) for r in df.collect())
    assert key(near) == key(far) and len(key(near)) == 240
