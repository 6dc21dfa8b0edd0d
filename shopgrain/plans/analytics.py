"""The periodic analytics run: all results of all shops, saved and published."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.operators import (
    abcxyz, anomaly, basket, customers, forecast, insights, pricing, sales,
)
from shopgrain.operators.publish import HISTORY, publicar_insights
from shopgrain.schema import SEGMENTS, Segment
from shopgrain.sources import canonical
from shopgrain.sources.shared import materialize
from shopgrain.sources.tables import TableStore


@dataclass(frozen=True)
class ShopTables:
    """Canonical tables of all shops."""

    vendas: DataFrame
    itens: DataFrame
    produtos: DataFrame
    clients: DataFrame | None = None
    #: Customers; without them no result names those who stay away.
    clientes: DataFrame | None = None


def segment_limits(clients: DataFrame) -> DataFrame:
    """Thresholds of each shop by its segment."""
    other = Segment()

    def by_segment(field: str) -> Column:
        col = F.lit(getattr(other, field))
        for name, values in SEGMENTS.items():
            col = F.when(F.col("segment") == name, getattr(values, field)).otherwise(col)
        return col.alias(field)

    return clients.select("client_key", *map(by_segment, ("abc_a", "abc_b", "churn_days")))


def run_analytics(
    tables: ShopTables, store: TableStore, now: datetime, as_of: datetime | None = None,
    min_support: float = 0.01, min_confidence: float = 0.2, min_lift: float = 1.2,
) -> list[str]:
    """Compute, save and publish every result; returns the names of the tables.

    Later steps read the saved results of earlier ones, so each result is
    computed once however many insights use it.
    """
    done: list[str] = []

    def save(name: str, df: DataFrame) -> DataFrame:
        store.save_result(name, df)
        done.append(name)
        saved = store.load_result(name)
        return saved if saved.columns != ["client_key"] else df.limit(0)

    # The join of items with their sales feeds five algorithms: run it once.
    itens = materialize(canonical.read_itens_venda(tables.itens, tables.vendas))
    produtos = canonical.read_produtos_ativos(tables.produtos)
    limits = None if tables.clients is None else segment_limits(tables.clients)

    classes = save("abc_resultado", abcxyz.abc_xyz(itens, limits=limits))
    scores = save("rfm_resultado", customers.rfm(tables.vendas, as_of))
    if tables.clientes is not None:
        # Each shop's segment says after how many days a customer stays away.
        base = customers.clientes_rfm_base(tables.clientes, tables.vendas)
        save("clientes_inativos", customers.clientes_inativos(base, limits=limits))
    sets = basket.itemsets(basket.by_sale(itens, itens.count()), min_support)
    rules = save("basket_resultado", basket.regras(sets, min_confidence, min_lift))
    predictions = save("forecast_resultado", forecast.forecast(itens))
    summary = save("forecast_resumo", forecast.forecast_resumo(predictions))
    elast = save("elasticidade_resultado", pricing.elasticidade(itens, produtos))
    margins = save("margem_resultado", pricing.margem(itens, produtos))
    save("anomalias_vendas", anomaly.anomalias_vendas(tables.vendas))
    discounts = save("anomalias_descontos", anomaly.anomalias_desconto(tables.vendas))
    sellers = save("anomalias_vendedores", anomaly.anomalias_vendedor(tables.vendas))

    for name, df in (
        ("abc_xyz_cache", classes), ("elasticidade_cache", elast), ("margem_cache", margins),
    ):
        store.publish_cache(name, df)
    store.publish_cache(
        "basket_cache", rules, 50, F.desc("lift"), F.asc("antecedents"), F.asc("consequents")
    )
    done += ["abc_xyz_cache", "elasticidade_cache", "margem_cache", "basket_cache"]

    past = (store.read(HISTORY), now) if store.exists(HISTORY) else ()
    home = insights.insights_home(
        summary, classes, scores, discounts, rules, margins, sales.vendas_resumo(tables.vendas),
        *past,
    )
    page = insights.insights_vendas(sellers, rules, classes, produtos, *past)
    publicar_insights(store, home, page, now)
    return [*done, "insights_cache", HISTORY]
