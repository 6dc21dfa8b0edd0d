"""Registered queries: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.functions import periods, totals
from shopgrain.functions.numbers import fmt_brl
from shopgrain.functions.privacy import mascarar_pii
from shopgrain.functions.tenancy import tenant_column
from shopgrain.operators import (
    abcxyz, anomaly, basket, catalog, customers, forecast, insights, monitor, pricing, report,
    sales,
)
from shopgrain.plans import ingest_queries
from shopgrain.sources import canonical
from shopgrain.sources.driver_tables import SHOP, DriverShop, DriverShops
from shopgrain.sources.shared import materialize

Query = Callable[[SparkSession, str], DataFrame]


def floats(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the type the comparison uses."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def on_shop(build: Callable[[DriverShop], DataFrame]) -> Query:
    return lambda spark, path: floats(build(DriverShop(spark, path)))


def _starts(shop: DriverShop) -> DataFrame:
    kinds = (
        "rolling", "double", "to_date", "calendar", "current", "previous", "compare", "trend",
    )
    last = shop.vendas.groupBy("client_key").agg(F.max("data_venda").alias("_last"))
    end = periods.end_of_day(F.col("_last"))
    cells = F.array(*[
        F.struct(
            F.lit(p).alias("periodo"), F.lit(k).alias("tipo"),
            periods.period_start(p, end, k).alias("inicio"),
        )
        for k in kinds for p in periods.PERIODS
    ])
    return last.select("client_key", F.inline(cells))


SALES = {
    "read_vendas": lambda s: canonical.read_vendas(s.vendas_com_desconto),
    "read_itens_venda": lambda s: canonical.read_itens_venda(s.itens, s.vendas),
    "read_clientes_ativos": lambda s: canonical.read_clientes_ativos(s.clientes),
    "read_produtos_ativos": lambda s: canonical.read_produtos_ativos(s.produtos),
    "home_kpis": lambda s: sales.home_kpis(s.vendas, s.itens),
    "vendas_resumo": lambda s: sales.vendas_resumo(s.vendas_com_desconto),
    "vendas_por_dia_week": lambda s: sales.vendas_por_dia(s.vendas, "week"),
    "vendas_por_dia_month": lambda s: sales.vendas_por_dia(s.vendas, "month"),
    "vendas_por_dia_year": lambda s: sales.vendas_por_dia(s.vendas, "year"),
    "vendas_tendencia_week": lambda s: sales.vendas_tendencia(s.vendas, "week"),
    "vendas_tendencia_month": lambda s: sales.vendas_tendencia(s.vendas, "month"),
    "vendas_tendencia_year": lambda s: sales.vendas_tendencia(s.vendas, "year"),
    "top_dias_week": lambda s: sales.top_dias(s.vendas, "week"),
    "top_dias_year": lambda s: sales.top_dias(s.vendas, "year"),
    "vendas_por_hora": lambda s: sales.vendas_por_hora(s.vendas_por_evento, "week"),
    "mix_categorias": lambda s: sales.mix_categorias(s.itens, s.vendas, s.produtos, "year"),
    "vendas_kpis_trend_week": lambda s: sales.vendas_kpis_trend(s.vendas_com_desconto, "week"),
    "vendas_kpis_trend_month": lambda s: sales.vendas_kpis_trend(s.vendas_com_desconto, "month"),
    "vendas_kpis_trend_year": lambda s: sales.vendas_kpis_trend(s.vendas_com_desconto, "year"),
    "ranking_vendedores": lambda s: sales.ranking_vendedores(
        s.vendas_com_desconto, s.itens, "year"
    ),
    "vendas_heatmap": lambda s: sales.vendas_heatmap(s.vendas_por_evento, "month"),
    "period_starts": _starts,
    "comparativo_week": lambda s: sales.comparativo(s.vendas, "week"),
    "comparativo_month": lambda s: sales.comparativo(s.vendas, "month"),
    "comparativo_year": lambda s: sales.comparativo(s.vendas, "year"),
    "mix_share": lambda s: sales.mix_share(
        sales.mix_categorias(s.itens, s.vendas, s.produtos, "year")
    ),
    "heatmap_normalizado": lambda s: sales.heatmap_normalizado(
        sales.vendas_heatmap(s.vendas_por_evento, "month")
    ),
    "dia_detalhe": lambda s: sales.dia_detalhe(sales.vendas_por_dia(s.vendas, "year")),
    "dia_extremos": lambda s: sales.dia_extremos(sales.vendas_por_dia(s.vendas, "year")),
}


def shared(build: Callable[[DriverShop], DataFrame]) -> Callable[[DriverShop], DataFrame]:
    """Build an intermediate result once per query, however many steps read it."""
    def get(s: DriverShop) -> DataFrame:
        made = s.__dict__.setdefault("_made", {})
        if build.__name__ not in made:
            made[build.__name__] = build(s)
        return made[build.__name__]

    return get


#: Fewer sales may be broadcast, which spares the items a shuffle.
SALES_SENT = 4_000_000


@shared
def _itens_ok(s: DriverShop) -> DataFrame:
    itens = s.itens
    if "_dealt" in s.__dict__ and s.vendas.count() > SALES_SENT:
        itens = basket.by_sale(itens, itens.count())
    return canonical.read_itens_venda(itens, s.vendas)


def dealt(build: Callable[[DriverShop], DataFrame]) -> Callable[[DriverShop], DataFrame]:
    """Let the items of a query meet their sales in tasks whose number grows with the items.

    For sums of so many groups that a task finds few items of each: more tasks
    then hardly make more partial sums.
    """
    def get(s: DriverShop) -> DataFrame:
        s.__dict__.update(_dealt=True)
        return build(s)

    return get


def summed(
    unit: str, build: Callable[[DriverShop], DataFrame], prices: bool = False
) -> Callable[[DriverShop], DataFrame]:
    """Let the steps of a query read one pass over the items: their sums by product and ``unit``, written once.

    Sales with their discount, which take a pass over the items too, are also
    written once then.  ``prices`` says whether a step reads the unit prices.
    """
    def get(s: DriverShop) -> DataFrame:
        s.__dict__.update(_unit=unit, _prices=prices)
        return build(s)

    return get


@shared
def _sold(s: DriverShop) -> DataFrame:
    """Items for a single reader, or what :func:`summed` asks for."""
    if "_unit" not in s.__dict__:
        return _itens_ok(s)
    items = _itens_ok(s) if s.__dict__["_prices"] else _itens_ok(s).drop("preco_unitario")
    return materialize(totals.sold(items, s.__dict__["_unit"]))


@shared
def _whole(s: DriverShop) -> DataFrame:
    """The same for steps that need no period: days are summed once for all of them."""
    return materialize(totals.sold(_sold(s), "product")) if s.__dict__.get("_unit") == "day" else _sold(s)


@shared
def _priced(s: DriverShop) -> DataFrame:
    sales = s.vendas_com_desconto
    return materialize(sales.drop("canal")) if "_unit" in s.__dict__ else sales


@shared
def _classes(s: DriverShop) -> DataFrame:
    return abcxyz.abc_xyz(_sold(s))


@shared
def _abc(s: DriverShop) -> DataFrame:
    return abcxyz.abc(_whole(s))


@shared
def _margin(s: DriverShop) -> DataFrame:
    return pricing.margem(_whole(s), s.produtos)


@shared
def _elast(s: DriverShop) -> DataFrame:
    return pricing.elasticidade(_sold(s), s.produtos)


@shared
def _idle(s: DriverShop) -> DataFrame:
    return catalog.dead_stock(s.estoque, s.produtos, s.itens, s.vendas)


@shared
def _ranking(s: DriverShop) -> DataFrame:
    return catalog.ranking_produtos(s.produtos, s.itens, s.vendas, _classes(s), _margin(s))


@shared
def _rfm(s: DriverShop) -> DataFrame:
    return customers.rfm(s.vendas)


@shared
def _customers(s: DriverShop) -> DataFrame:
    return customers.clientes_rfm_base(s.clientes, s.vendas)


CATALOG = {
    "estoque_alertas": lambda s: catalog.estoque_alertas(s.estoque, s.produtos),
    "estoque_completo": lambda s: catalog.estoque_completo(s.estoque, s.produtos),
    "estoque_completo_filtrado": lambda s: catalog.estoque_completo(
        s.estoque, s.produtos, categoria="Brand#7", alerta=True
    ),
    "estoque_kpis": lambda s: catalog.estoque_kpis(s.estoque, s.produtos),
    "produtos_abc_sql": lambda s: catalog.produtos_abc_sql(s.itens, s.produtos),
    "dead_stock": _idle,
    "dead_stock_totals": lambda s: catalog.dead_stock_totals(_idle(s)),
    "catalog_kpis": summed("product", lambda s: catalog.catalog_kpis(
        s.produtos, _abc(s), _margin(s), _idle(s)
    )),
    "matriz_abc_xyz": lambda s: abcxyz.matriz_abc_xyz(_classes(s)),
    "matriz_abc_xyz_pivot": lambda s: abcxyz.matriz_abc_xyz_pivot(_classes(s)),
    "abc_kpis": lambda s: abcxyz.abc_kpis(_classes(s)),
    "ranking_produtos": summed("month", _ranking),
    "elasticidade_view": lambda s: pricing.elasticidade_view(_elast(s)),
    "matriz_preco": summed("month", lambda s: pricing.matriz_preco(_elast(s), _ranking(s)), prices=True),
    "margem_kpis": summed("month", lambda s: pricing.margem_kpis(_margin(s), _elast(s)), prices=True),
    "elasticidade_contagem": lambda s: pricing.elasticidade_contagem(_elast(s)),
}

CUSTOMERS = {
    "clientes_rfm_base": _customers,
    "resumo_segmentos_sql": lambda s: customers.resumo_segmentos_sql(s.clientes, s.vendas),
    "clientes_inativos": lambda s: customers.clientes_inativos(_customers(s)),
    "segmento_kpis": lambda s: customers.segmento_kpis(
        customers.resumo_segmentos_sql(s.clientes, s.vendas)
    ),
    "score_quintil": lambda s: _rfm(s).select(
        "client_key", "cliente_id", "score_r", "score_f", "score_m"
    ),
    "rfm": _rfm,
    "segmento_rfm": lambda s: _rfm(s).groupBy("client_key", "segmento").agg(
        F.count(F.lit(1)).alias("clientes")
    ),
    "clientes_em_risco": lambda s: customers.clientes_em_risco(_rfm(s)),
    "resumo_segmentos": lambda s: customers.resumo_segmentos(_rfm(s)),
}

ALGORITHMS = {
    "abc": _abc,
    "xyz": lambda s: abcxyz.xyz(_itens_ok(s)),
    "abc_xyz": _classes,
    "resumo_abc": lambda s: abcxyz.resumo_abc(_abc(s)),
    "elasticidade": _elast,
    "cenario_preco": lambda s: pricing.cenario_preco(_elast(s)),
    "margem": _margin,
}


#: A larger catalogue is hashed by part instead of sorting all items to meet it.
PRODUCTS_SORTED = 2_000_000


def _named(s: DriverShop) -> DataFrame:
    """Items with the category in place of the product."""
    names = s.produtos.select("client_key", "produto_key", "categoria")
    if s.produtos.count() > PRODUCTS_SORTED:
        names = names.hint("shuffle_hash")
    return s.itens.join(names, ["client_key", "produto_key"]).withColumn("produto_key", F.col("categoria"))


@shared
def _by_category(s: DriverShop) -> DataFrame:
    """Items of finished sales with the category in place of the product."""
    return canonical.read_itens_venda(_named(s), s.vendas)


def _sets(s: DriverShop, support: float = 0.01) -> DataFrame:
    """Sets of categories; baskets are built where their items met the sale, without a further shuffle."""
    itens = basket.by_sale(_named(s), s.itens.count())
    return basket.itemsets(canonical.read_itens_venda(itens, s.vendas), support)


def _listed(sets: DataFrame) -> DataFrame:
    return sets.withColumn("itens", F.array_join("itens", ", "))


@shared
def _rules(s: DriverShop) -> DataFrame:
    return basket.regras(_sets(s), 0.1, 1.0)


@shared
def _forecast(s: DriverShop) -> DataFrame:
    return forecast.forecast(_sold(s))


@shared
def _summary(s: DriverShop) -> DataFrame:
    return forecast.forecast_resumo(_forecast(s))


def _few_days(s: DriverShop) -> DataFrame:
    daily = forecast.diario(_itens_ok(s))
    n = daily.groupBy("client_key", "produto_key").agg(F.count(F.lit(1)).alias("_n"))
    few = n.filter(F.col("_n") < forecast.ENOUGH_DAYS).drop("_n")
    return daily.join(few, ["client_key", "produto_key"], "left_semi")


@shared
def _odd_discounts(s: DriverShop) -> DataFrame:
    return anomaly.anomalias_desconto(_priced(s))


@shared
def _odd_sales(s: DriverShop) -> DataFrame:
    return anomaly.anomalias_vendas(s.vendas_por_evento)


MODELS = {
    "itemsets": lambda s: _listed(_sets(s)),
    "itemsets_trios": lambda s: _listed(_sets(s, 0.005)),
    "regras": _rules,
    "regras_padrao": lambda s: basket.regras(_sets(s)),
    "regras_trios": lambda s: basket.regras(_sets(s, 0.005), 0.1, 1.0),
    "sugestoes": lambda s: basket.sugestoes(_rules(s), "Brand#7"),
    "top_regras": lambda s: basket.top_regras(_rules(s), 50),
    "basket_view": lambda s: catalog.basket_view(_rules(s)),
    "forecast_media_movel": lambda s: forecast.forecast_media_movel(_few_days(s)),
    "forecast_sazonal": lambda s: forecast.forecast_sazonal(forecast.diario(_by_category(s))),
    "forecast": _forecast,
    "forecast_categoria": lambda s: forecast.forecast(_by_category(s)),
    "forecast_resumo": _summary,
    "forecast_resumo_loja": lambda s: forecast.forecast_resumo(_forecast(s), per_shop=True),
    "forecast_resumo_categoria": lambda s: forecast.forecast_resumo(
        forecast.forecast(_by_category(s))
    ),
    "sugestao_reposicao": lambda s: catalog.sugestao_reposicao(
        s.estoque, s.produtos, _summary(s)
    ),
    "forecast_por_produto": lambda s: catalog.forecast_por_produto(
        _summary(s), s.estoque, s.produtos
    ),
    "anomalias_desconto": _odd_discounts,
    "anomalias_vendedor": lambda s: anomaly.anomalias_vendedor(s.vendas_com_desconto),
    "descontos_por_vendedor": lambda s: anomaly.descontos_por_vendedor(_odd_discounts(s)),
    "anomalias_vendas": _odd_sales,
    "anomalias_por_hora": lambda s: anomaly.anomalias_por_hora(_odd_sales(s)),
    "resumo_anomalias": lambda s: anomaly.resumo_anomalias(
        _odd_sales(s), _odd_discounts(s), s.vendas
    ),
}


@shared
def _resumo(s: DriverShop) -> DataFrame:
    return sales.vendas_resumo(_priced(s))


@shared
def _sellers(s: DriverShop) -> DataFrame:
    return anomaly.anomalias_vendedor(_priced(s))


def _history(s: DriverShop) -> DataFrame:
    """Each event read as one earlier showing of an insight."""
    tipo = (
        F.when(F.col("event_type") == "purchase", "performance")
        .when(F.col("event_type") == "error", "anomalia_desconto")
        .when(F.col("event_type") == "click", "venda_cruzada")
        .otherwise("outro")
    )
    return s.table("events").select(
        tenant_column(SHOP), tipo.alias("tipo"), F.col("ts").alias("gerado_em")
    )


def _now(s: DriverShop):
    return s.table("events").agg(F.max("ts")).scalar()


def _home(s: DriverShop, history: bool) -> DataFrame:
    return insights.insights_home(
        _summary(s), _abc(s), _rfm(s), _odd_discounts(s), _rules(s), _margin(s),
        _resumo(s), *((_history(s), _now(s)) if history else ()),
    )


def _sales_page(s: DriverShop, history: bool) -> DataFrame:
    return insights.insights_vendas(
        _sellers(s), _rules(s), _abc(s), s.produtos,
        *((_history(s), _now(s)) if history else ()),
    )


def _cascade(s: DriverShop) -> DataFrame:
    """The four blocks of the page for one category, in long form.

    Rules are over categories here; each category stands for its first product.
    """
    firsts = s.produtos.groupBy("client_key", "categoria").agg(
        F.min("produto_key").alias("_first")
    )

    def by_product(rules: DataFrame, side: str) -> DataFrame:
        names = firsts.withColumnRenamed("categoria", side)
        return rules.join(names, ["client_key", side]).withColumn(side, F.col("_first")).drop("_first")

    rules = by_product(by_product(_rules(s), "antecedents"), "consequents")
    blocks = catalog.filtro_cascata(_ranking(s), _elast(s), rules, _idle(s), categoria="Brand#7")

    def lines(name: str, item: str, other: Column, value: str) -> DataFrame:
        return blocks[name].select(
            "client_key", F.lit(name).alias("bloco"), F.col(item).alias("item"),
            other.alias("par"), F.col(value).cast("double").alias("valor"),
        )

    none = F.lit("")
    return (
        lines("ranking", "id", none, "faturamento")
        .unionByName(lines("elasticidade", "produto_key", none, "elasticidade"))
        .unionByName(lines("basket", "antecedents", F.col("consequents"), "lift"))
        .unionByName(lines("dead_stock", "produto_key", none, "capital_parado"))
    )


TEXTS = {
    "ins_estoque_critico": summed("day", lambda s: insights.ins_estoque_critico(
        _summary(s), _abc(s)
    )),
    "ins_churn_vip": lambda s: insights.ins_churn_vip(_rfm(s)),
    "ins_anomalia_desconto": lambda s: insights.ins_anomalia_desconto(_odd_discounts(s)),
    "ins_combo": lambda s: insights.ins_combo(_rules(s)),
    "ins_margem_alta": summed("product", lambda s: insights.ins_margem_alta(_margin(s), _abc(s))),
    "ins_performance": lambda s: insights.ins_performance(_resumo(s)),
    "ins_vendedor": lambda s: insights.ins_vendedor(_sellers(s)),
    "ins_venda_cruzada": lambda s: insights.ins_venda_cruzada(_rules(s)),
    "ins_categoria_foco": lambda s: insights.ins_categoria_foco(
        _abc(s), s.produtos
    ),
    "rotacao_temporal": dealt(lambda s: insights.rotacao_temporal(
        _sales_page(s, False).drop("top3"), _history(s), _now(s)
    )),
    "top3_diverso": summed("day", lambda s: insights.top3_diverso(_home(s, False).drop("top3"))),
    "insights_home": summed("day", lambda s: _home(s, True)),
    "insights_vendas": dealt(lambda s: _sales_page(s, True)),
    "ler_insights": dealt(lambda s: insights.ler_insights(
        _sales_page(s, False).withColumn(
            "gerado_em", F.lit("2024-01-01").cast("timestamp_ntz")
        ), "vendas",
    )),
    "ler_insights_home": summed("day", lambda s: insights.ler_insights(
        _home(s, False).withColumn("gerado_em", F.lit("2024-01-01").cast("timestamp_ntz"))
    )),
    "filtro_cascata": summed("month", _cascade, prices=True),
    "relatorio_semanal": lambda s: report.relatorio_semanal(
        _resumo(s), _abc(s), _rfm(s),
        catalog.estoque_alertas(s.estoque, s.produtos),
    ),
    "fmt_brl": lambda s: s.vendas.select(
        "client_key", "venda_key", fmt_brl(F.col("total")).alias("total_brl")
    ),
    "mascarar_pii_documentos": lambda s: mascarar_pii(
        s.table("documents").select("doc_id", "text")
    ),
    "mascarar_pii_conversas": lambda s: mascarar_pii(
        s.table("conversations").select("conv_id", "turn", "text")
    ),
    "etl_execucoes_24h": lambda s: monitor.etl_execucoes_24h(s.etl_logs),
    "etl_erros_24h": lambda s: monitor.etl_erros_24h(s.etl_logs),
    "etl_duracao_media": lambda s: monitor.etl_duracao_media(s.etl_logs),
    "etl_ultimas": lambda s: monitor.etl_ultimas(s.etl_logs, s.clients),
    "clientes_ativos": lambda s: monitor.clientes_ativos(s.clients),
}


STORED = {
    "save_result": lambda s: ingest_queries.saved_result(s, abcxyz.matriz_abc_xyz(_classes(s))),
    "publish_cache": lambda s: ingest_queries.cached_top(s, _rules(s)),
    "publicar_insights": summed("day", lambda s: ingest_queries.published(
        s, _home(s, False), _sales_page(s, False)
    )),
}


# The same operators over many shops, one of which has half of the sales.
SHOPS = {
    "vendas_resumo_lojas": lambda s: sales.vendas_resumo(s.vendas_com_desconto),
    "home_kpis_lojas": lambda s: sales.home_kpis(s.vendas, s.itens),
    "ranking_vendedores_lojas": lambda s: sales.ranking_vendedores(
        s.vendas_com_desconto, s.itens, "year"
    ),
    "abc_lojas": _abc,
    "rfm_lojas": _rfm,
    "anomalias_desconto_lojas": _odd_discounts,
}


def all_queries() -> dict[str, Query]:
    groups = {
        **SALES, **CATALOG, **CUSTOMERS, **ALGORITHMS, **MODELS, **TEXTS,
        **ingest_queries.INGEST, **STORED,
    }
    queries = {name: on_shop(build) for name, build in groups.items()}
    many = {
        name: lambda spark, path, build=build: floats(build(DriverShops(spark, path)))
        for name, build in SHOPS.items()
    }
    return {**queries, **many}
