from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shopgrain.operators import insights, monitor

COLS = "client_key string, tipo string, prioridade int, titulo string, mensagem string, acao string, href string, " \
       "categoria string, icone string, _seq int"
NOW = datetime(2024, 5, 5, 12)


def some(spark, *lines):
    return spark.createDataFrame(
        [(shop, tipo, prio, "t", "m", "a", "h", cat, "i", seq) for shop, tipo, prio, cat, seq in lines], COLS
    )


def order(df):
    return [r.tipo for r in df.orderBy("client_key", "prioridade", "_seq").collect()]


def test_three_of_different_categories_then_fill(spark):
    df = some(spark, ("a", "e1", 1, "x", 1), ("a", "e2", 2, "x", 2), ("a", "e3", 3, "y", 3), ("a", "e4", 4, "z", 4),
              ("b", "f1", 1, "x", 1), ("b", "f2", 2, "x", 2), ("b", "f3", 3, "x", 3), ("b", "f4", 4, "x", 4))
    got = {(r.client_key, r.tipo) for r in insights.top3_diverso(df).collect()}
    assert got == {("a", "e1"), ("a", "e3"), ("a", "e4"), ("b", "f1"), ("b", "f2"), ("b", "f3")}


def test_rotation_uses_the_last_24_hours_once(spark):
    df = some(spark, ("a", "e1", 1, "x", 1), ("a", "e2", 2, "y", 2), ("b", "e1", 1, "x", 1))
    seen = lambda h: NOW - timedelta(hours=h)
    hist = spark.createDataFrame([("a", "e1", seen(23)), ("a", "e1", seen(2)), ("a", "e2", seen(25))],
                                 "client_key string, tipo string, gerado_em timestamp_ntz")
    got = {(r.client_key, r.tipo): r.prioridade for r in insights.rotacao_temporal(df, hist, NOW).collect()}
    assert got == {("a", "e1"): 11, ("a", "e2"): 2, ("b", "e1"): 1}


def test_critical_stock_text_by_class(spark):
    fc = spark.createDataFrame([("a", "p1", 1234.5), ("a", "p2", 10.0), ("b", "p1", 2.5), ("c", "p9", 0.0)],
                               "client_key string, produto_key string, quantidade_prevista double")
    abc = spark.createDataFrame([("a", "p1", "A"), ("b", "p1", "B")], "client_key string, produto_key string, classe string")
    got = {r.client_key: r for r in insights.ins_estoque_critico(fc, abc).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].prioridade, got["a"].titulo) == (1, "Ruptura iminente")
    assert "demanda prevista: 1234 unidades" in got["a"].mensagem
    assert (got["b"].prioridade, got["b"].mensagem) == (3, "Produto p1 com demanda prevista de 2 unidades nos próximos 30 dias.")


def test_vip_churn_is_above_the_upper_quartile(spark):
    data = [("a", f"c{i}", float(i * 100), 10 * i, "em_risco" if i >= 6 else "fiel") for i in range(1, 9)]
    df = spark.createDataFrame(data, "client_key string, cliente_id string, valor_total double, recencia long, segmento string")
    r = insights.ins_churn_vip(df).first()
    assert r.mensagem == ("2 cliente(s) de alto valor sem comprar há em média 75 dias. Valor histórico em risco: R$ 1,500. "
                          "Entre em contato esta semana.")


def test_focus_category_and_reader(spark):
    abc = spark.createDataFrame([("a", f"p{k}", "A" if k < 4 else "C") for k in range(6)],
                                "client_key string, produto_key string, classe string")
    prod = spark.createDataFrame([("a", "p0", "Z"), ("a", "p1", "B"), ("a", "p2", "B"), ("a", "p3", "Z"), ("a", "p4", "Q")],
                                 "client_key string, produto_key string, categoria string")
    assert "'B'" in insights.ins_categoria_foco(abc, prod).first().mensagem
    cache = some(spark, *[("a", f"t{k:02d}", k, "vendas" if k > 8 else "x", k) for k in range(14)]).withColumn(
        "gerado_em", F.lit(NOW).cast("timestamp_ntz"))
    assert insights.ler_insights(cache).count() == 10
    assert sorted(r.tipo for r in insights.ler_insights(cache, "vendas").collect()) == ["t09", "t10", "t11"]


def test_monitor(spark):
    at = lambda h: NOW - timedelta(hours=h)
    logs = spark.createDataFrame([
        ("a", "csv", "success", 1, 1, None, at(1), at(1) + timedelta(seconds=3)),
        ("a", "csv", "success", 1, 1, None, at(2), at(2) + timedelta(seconds=4)),
        ("b", "csv", "error", 0, 0, "x", at(24), at(24)), ("z", "csv", "success", 1, 1, None, at(30), at(29)),
    ], "client_key string, connector_type string, status string, records_read long, records_written long, "
       "error_message string, started_at timestamp_ntz, finished_at timestamp_ntz")
    one = lambda df: df.first().value
    assert one(monitor.etl_execucoes_24h(logs, NOW)) == 3
    assert one(monitor.etl_erros_24h(logs, NOW)) == 1
    assert one(monitor.etl_duracao_media(logs, NOW)) == 4
    assert one(monitor.etl_execucoes_24h(logs)) == 3
    shops = spark.createDataFrame([("a", "Loja A", "construcao", "csv", True), ("b", "Aa", "outro", "csv", True),
                                   ("c", "C", "x", "csv", False)], "client_key string, name string, segment string, "
                                                                    "erp_type string, active boolean")
    assert [r.client_key for r in monitor.clientes_ativos(shops).collect()] == ["b", "a"]
    assert monitor.clientes_ativos(shops, "c").count() == 0
    assert [r.client_key for r in monitor.etl_ultimas(logs, shops).collect()] == ["a", "a", "b"]
