from datetime import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from shopgrain.functions.periods import PERIODS, end_of_day, period_start
from shopgrain.operators import catalog, sales

AS_OF = datetime(2024, 12, 31)


def test_kpis_trend_previous_zero(make):
    v = make.vendas([
        ("a", "1", "2024-12-10 10:00:00", "c", "v", 90, 10), ("b", "2", "2024-11-30 10:00:00", "c", "v", 50, 0),
        ("b", "3", "2024-12-01 00:00:00", "c", "v", 100, 0), ("b", "4", "2024-12-05 00:00:00", "c", "v", 999, 0, "pendente"),
        ("c", "5", "2020-01-01 00:00:00", "c", "v", 5, 0),
    ])
    got = {(r.client_key, r.kpi): (r.atual, r.anterior, r.variacao) for r in sales.vendas_kpis_trend(v, "month", AS_OF).collect()}
    assert got["a", "faturamento"] == (90.0, 0.0, 100.0)
    assert got["a", "perc_desconto"] == (10.0, 0.0, 10.0)
    assert got["b", "faturamento"] == (100.0, 50.0, 100.0)
    assert got["b", "total_transacoes"] == (1.0, 1.0, 0.0)
    assert got["c", "faturamento"] == (0.0, 0.0, 0.0)
    assert len(got) == 12


def test_clock_is_each_shops_last_sale_without_as_of(make):
    v = make.vendas([
        ("a", "1", "2024-03-31 10:00:00", "c", "v", 1, 0), ("b", "1", "2023-01-15 10:00:00", "c", "v", 2, 0),
    ])
    got = rows(sales.top_dias(v, "week"), "client_key", "dia", "faturamento")
    assert got == [("a", "2024-03-31", 1.0), ("b", "2023-01-15", 2.0)]


@pytest.mark.parametrize("days,kept", [(6, 6), (7, 1), (9, 3)])
def test_tendencia_warm_up(make, days, kept):
    v = make.vendas([
        ("a", str(d), f"2024-12-{31 - d:02d} 08:00:00", "c", "v", 10 * (d + 1), 0) for d in range(days)
    ])
    out = sales.vendas_tendencia(v, "week", AS_OF)
    got = rows(out, "dia", "media_movel")
    assert len(got) == kept
    assert got[-1] == ("2024-12-31", round(sum(10 * (d + 1) for d in range(min(days, 7))) / min(days, 7), 2))


def test_period_starts(spark):
    df = spark.createDataFrame([(AS_OF,)], "t timestamp_ntz")
    start = lambda p, k: df.select(period_start(p, end_of_day(F.col("t")), k)).first()[0]
    # A day November lacks runs over into December.
    assert start("month", "rolling") == datetime(2024, 12, 1, 23, 59, 59)
    assert start("outro", "rolling") == start("week", "rolling") == datetime(2024, 12, 24, 23, 59, 59)
    assert start("month", "trend") == datetime(2024, 11, 25)
    assert start("week", "current") == datetime(2024, 12, 25)
    assert start("week", "calendar") == datetime(2024, 12, 30)
    assert start("year", "previous") == datetime(2023, 1, 1)
    with pytest.raises(ValueError):
        period_start("outro", F.col("t"), "trend")
    assert PERIODS == ("week", "month", "year")


def test_comparativo_clamps_days(make):
    v = make.vendas([
        ("a", "1", "2024-03-31 10:00:00", "c", "v", 5, 0), ("a", "2", "2024-02-29 10:00:00", "c", "v", 7, 0),
    ])
    got = {r.label: (r.atual, r.anterior) for r in sales.comparativo(v, "month").collect()}
    assert len(got) == 31 and got["31"] == (5.0, 7.0) and got["29"] == (0.0, 7.0) and got["1"] == (0.0, 0.0)


def test_mix_and_sellers_keep_nulls(make):
    v = make.vendas([
        ("a", "1", "2024-12-30 10:00:00", "c", None, 50, 5), ("a", "2", "2024-12-30 11:00:00", "c", "v1", 30, 0),
        ("a", "3", "2024-12-30 11:00:00", "c", "v1", 0, 0),
    ])
    i = make.itens([("a", "1", "p1", 2, 1, 0, 20), ("a", "1", "px", 3, 1, 0, 30), ("a", "2", "p1", 1, 1, 0, 30)])
    p = make.produtos([("a", "p1", "Um", "Cat", 1, 2)])
    mix = sales.mix_categorias(i, v, p, "week", AS_OF)
    assert rows(mix, "categoria", "faturamento") == [("Cat", 50.0), ("Sem Categoria", 30.0)]
    assert rows(sales.mix_share(mix), "categoria", "percentual") == [("Cat", 62.5), ("Sem Categoria", 37.5)]
    got = {r.id: (r.vendas, r.faturamento, r.ticket, r.upa, round(r.desconto, 4)) for r in
           sales.ranking_vendedores(v, i, "week", AS_OF).collect()}
    assert got == {"Não Informado": (1, 50.0, 50.0, 5.0, round(500 / 55, 4)), "v1": (2, 30.0, 15.0, 0.5, 0.0)}


def test_heatmap_grid(make):
    v = make.vendas([
        ("a", "1", "2024-12-30 10:05:00", "c", "v", 50, 0), ("a", "2", "2024-12-29 23:00:00", "c", "v", 200, 0),
        ("a", "3", "2024-12-28 08:00:00", "c", "v", 100, 0),
    ])
    heat = sales.vendas_heatmap(v, "month", AS_OF)
    assert rows(heat, "dia", "hora") == [("Dom", "23h"), ("Seg", "10h"), ("Sáb", "08h")]
    grid = {(r.dia, r.hora): r.intensidade for r in sales.heatmap_normalizado(heat).collect()}
    assert len(grid) == 66 and grid["Seg", "10h"] == 0.25 and grid["Sáb", "08h"] == 0.5 and grid["Ter", "08h"] == 0.0


def test_abc_sql_ties_share_the_sum(make):
    i = make.itens([("a", "1", f"p{k}", 1, 1, 0, t) for k, t in enumerate((70, 10, 10, 5, 5))])
    p = make.produtos([("a", "p0", "Zero", None, 1, 2)])
    got = {r.produto_key: (r.nome, r.classe) for r in catalog.produtos_abc_sql(i, p).collect()}
    assert got == {"p0": ("Zero", "A"), "p1": ("p1", "B"), "p2": ("p2", "B"), "p3": ("p3", "C"), "p4": ("p4", "C")}


def test_reorder_without_forecast(spark, make):
    stock = spark.createDataFrame(
        [("a", "p1", 2.0, 5.0), ("a", "p2", 3.0, 5.0), ("a", "p3", 4.0, 5.0), ("a", "p4", 9.0, 5.0)],
        "client_key string, produto_key string, quantidade double, quantidade_min double",
    )
    p = make.produtos([("a", "p1", "Um", "C", 1, 2)])
    fc = spark.createDataFrame(
        [("a", "p1", 30.4), ("a", "p2", 0.0)], "client_key string, produto_key string, quantidade_prevista double"
    )
    got = {r.produto_key: (r.nome, r.dias_cobertura, r.pedido_sugerido) for r in
           catalog.sugestao_reposicao(stock, p, fc).collect()}
    assert got == {"p1": ("Um", 2.0, 28.0), "p2": ("p2", 0.0, 0.0), "p3": ("p3", 0.0, 0.0)}


def test_dead_stock_and_cascade(spark, make):
    v = make.vendas([("a", "1", "2024-12-01 10:00:00", "c", "v", 1, 0), ("a", "2", "2024-01-01 10:00:00", "c", "v", 1, 0)])
    i = make.itens([("a", "1", "p1", 1, 1, 0, 1), ("a", "2", "p2", 1, 1, 0, 1)])
    p = make.produtos([("a", f"p{k}", "mesmo nome", "C" if k < 3 else "D", 2, 3) for k in range(1, 5)])
    stock = spark.createDataFrame([("a", f"p{k}", q) for k, q in ((1, 5.0), (2, 4.0), (3, 3.0), (4, 0.0))],
                                  "client_key string, produto_key string, quantidade double")
    idle = catalog.dead_stock(stock, p, i, v, AS_OF)
    assert rows(idle, "produto_key") == [("p2",), ("p3",)]
    ranking = p.select("client_key", F.col("produto_key").alias("id"), "nome", "categoria")
    rules = spark.createDataFrame([("a", "p1", "p4"), ("a", "p4", "p3"), ("a", "p2", "p1")],
                                  "client_key string, antecedents string, consequents string")
    parts = catalog.filtro_cascata(ranking, p, rules, idle, categoria="C")
    assert rows(parts["dead_stock"], "produto_key") == [("p2",)]
    assert rows(parts["basket"], "antecedents") == [("p1",), ("p2",)]
    only = catalog.filtro_cascata(ranking, p, rules, idle, produto="p3")
    assert rows(only["basket"], "antecedents") == [("p4",)] and rows(only["elasticidade"], "produto_key") == [("p3",)]


def test_items_are_pruned_by_month(spark, make, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from shopgrain.operators import catalog
    from shopgrain.sources.tables import TableStore

    v = make.vendas([
        (shop, f"{m}", f"2024-{m:02d}-15 10:00:00", "c", "v", 10 * m, 0) for shop in ("a", "b") for m in range(1, 13)
    ])
    i = make.itens([(shop, f"{m}", "p", m, 10, 0, 10 * m, f"2024-{m:02d}-15 10:00:00") for shop in ("a", "b") for m in range(1, 13)])
    store = TableStore(spark, str(tmp_path / "t"))
    for name, df in (("vendas", v), ("itens_venda", i)):
        store.save_result(name, df.withColumn("mes", F.trunc("data_venda", "month")), ["client_key", "mes"])
    sales_table, items = store.read("vendas"), store.read("itens_venda").drop("data_venda")
    p = make.produtos([(s, "p", "P", "Cat", 3, 12) for s in ("a", "b")])
    stock = p.select("client_key", "produto_key", F.lit(5).alias("quantidade"))
    at = datetime(2024, 12, 20)
    for df in (
        sales.home_kpis(sales_table, items, at, shops=p), sales.mix_categorias(items, sales_table, p, "month", at),
        sales.ranking_vendedores(sales_table, items, "month", at), catalog.dead_stock(stock, p, items, sales_table, at),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Scans with articles or quantities are those of the items; stock and catalogue are no files here.
        scans = [x for x in plan.splitlines() if "FileScan" in x and ("quantidade#" in x or "produto_key#" in x)]
        assert scans and all("mes#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    got = {r.client_key: (r.faturamento, r.itens_por_venda) for r in sales.home_kpis(sales_table, items, at).collect()}
    assert got == {"a": (120.0, 12.0), "b": (120.0, 12.0)}
    assert [r.faturamento for r in sales.mix_categorias(items, sales_table, p, "month", datetime(2024, 12, 10)).collect()] == [230.0, 230.0]
    # Known shops: the sales are scanned once for the answer.
    plan = sales.vendas_kpis_trend(sales_table.drop("mes"), "month", at, shops=p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
