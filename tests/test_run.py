from datetime import datetime

from shopgrain.plans import analytics
from shopgrain.plans.analytics import ShopTables, run_analytics, segment_limits
from shopgrain.schema import Segment
from shopgrain.sources.tables import TableStore


def test_full_run_over_two_shops_then_again(spark, make, tmp_path):
    sales, items = [], []
    for shop, n in (("a", 70), ("b", 55)):
        for k in range(n):
            day = f"2024-{1 + k % 6:02d}-{1 + k % 27:02d} {8 + k % 9:02d}:00:00"
            sales.append((shop, str(k), day, f"c{k % 9}", f"v{k % 3}", 100 + k, 90 if k == 5 else k % 4))
            for p in ("p1", "p2") if k % 3 else ("p1", "p3"):
                price = 10 + (k % 6) + len(p)
                items.append((shop, str(k), p, 1 + k % 5, price, 0, price * (1 + k % 5)))
    prods = [(s, f"p{k}", f"Produto {k}", "Cat", 3, 12) for s in "ab" for k in (1, 2, 3)]
    clients = spark.createDataFrame(
        [("a", "construcao"), ("b", "padaria")], "client_key string, segment string"
    )
    assert {r.client_key: (r.abc_a, r.churn_days) for r in segment_limits(clients).collect()} == {
        "a": (0.8, 45), "b": (0.8, 45)}
    tables = ShopTables(make.vendas(sales), make.itens(items).drop("data_venda"), make.produtos(prods), clients)
    store = TableStore(spark, str(tmp_path / "t"))
    names = run_analytics(tables, store, datetime(2024, 7, 1), min_lift=1.0)
    assert set(store.names()) <= set(names)
    shops = {n: {r.client_key for r in store.read(n).select("client_key").distinct().collect()} for n in names}
    for n in ("abc_resultado", "rfm_resultado", "forecast_resumo", "elasticidade_resultado", "margem_resultado",
              "anomalias_vendas", "anomalias_vendedores", "insights_cache", "basket_cache"):
        assert shops[n] == {"a", "b"}, n
    first = {(r.client_key, r.tipo): r.prioridade for r in store.read("insights_cache").collect()}
    assert first["a", "vendedor_anomalia"] == 1
    run_analytics(tables, store, datetime(2024, 7, 1, 6), min_lift=1.0)
    second = {(r.client_key, r.tipo): r.prioridade for r in store.read("insights_cache").collect()}
    # Shown six hours ago: pushed back by ten.
    assert second == {k: v + 10 for k, v in first.items()}
    run_analytics(tables, store, datetime(2024, 7, 9), min_lift=1.0)
    assert {(r.client_key, r.tipo): r.prioridade for r in store.read("insights_cache").collect()} == first


def test_a_shop_without_rules_does_not_stop_the_run(spark, make, tmp_path):
    sales = [("a", str(k), f"2024-01-{1 + k % 28:02d} 10:00:00", f"c{k % 5}", "v", 50 + k, 0) for k in range(60)]
    items = [("a", str(k), f"p{k % 4}", 1, 10, 0, 10) for k in range(60)]
    tables = ShopTables(make.vendas(sales), make.itens(items).drop("data_venda"), make.produtos([("a", "p1", "Um", "C", 3, 12)]))
    store = TableStore(spark, str(tmp_path / "t"))
    names = run_analytics(tables, store, datetime(2024, 7, 1))
    assert store.load_result("basket_resultado").count() == 0
    assert store.load_result("abc_resultado").count() == 4 and "insights_cache" in names


def test_each_segment_has_its_own_churn_days(spark, make, tmp_path, monkeypatch):
    """Customers who stayed away for 20 days are late in the shop of ten days only."""
    monkeypatch.setitem(analytics.SEGMENTS, "padaria", Segment(churn_days=10))
    sales = [(s, str(k), f"2024-01-{1 + k % 28:02d} 10:00:00", f"c{k % 28 // 14}", "v", 50 + k, 0) for s in "ab" for k in range(56)]
    items = [(s, str(k), f"p{k % 4}", 1, 10, 0, 10) for s in "ab" for k in range(56)]
    people = spark.createDataFrame([(s, f"c{k}", f"C{k}", True) for s in "ab" for k in (0, 1)], "client_key string, cliente_key string, nome string, ativo boolean")
    clients = spark.createDataFrame([("a", "construcao"), ("b", "padaria")], "client_key string, segment string")
    produtos = make.produtos([("a", "p1", "Um", "C", 3, 12)])
    tables = ShopTables(make.vendas(sales), make.itens(items).drop("data_venda"), produtos, clients, people)
    store = TableStore(spark, str(tmp_path / "t"))
    names = run_analytics(tables, store, datetime(2024, 7, 1))
    assert "clientes_inativos" in names
    assert [(r.client_key, r.cliente_id) for r in store.read("clientes_inativos").collect()] == [("b", "c0")]
