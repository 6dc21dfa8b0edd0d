"""Price elasticity, what-if prices and gross margin.

``itens`` are items of finished sales or their sums (``totals.sold``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, div0, money_sum, rint
from shopgrain.functions.tenancy import attach
from shopgrain.functions.totals import sold
from shopgrain.schema import WIDE_MONEY
from shopgrain.sources.shared import materialize

KEY = ["client_key", "produto_key"]
GRID = tuple(range(-30, 31, 5))

# The advice shown for each class.
ADVICE = {
    "elastico": "Reduzir preço pode aumentar receita total",
    "inelastico": "Preço pouco sensível — evite descontos desnecessários",
    "moderado": "Elasticidade moderada — avalie caso a caso",
}


def elasticidade(
    itens: DataFrame, produtos: DataFrame, min_months: int = 6, min_changes: int = 5
) -> DataFrame:
    """Slope of quantity change on price change between months with sales."""
    monthly = sold(itens, "month").select(
        *KEY, "_mes", div0(F.col("_preco"), F.col("_precos")).alias("_p"), dbl("_qtd").alias("_q"),
        F.col("_fat").alias("_r"),
    )
    # A product has one row per month, so its window is bounded by the calendar.
    by_month = Window.partitionBy(*KEY).orderBy("_mes")

    def change(col: str) -> Column:
        before = F.lag(col).over(by_month)
        return (F.try_divide(F.col(col), before) - 1.0) * 100.0

    changes = monthly.select(
        *KEY, "_p", "_q", "_r", change("_p").alias("_dp"), change("_q").alias("_dq"),
        F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("_months"),
    ).filter(
        (F.col("_months") >= min_months) & F.col("_dp").isNotNull() & F.col("_dq").isNotNull()
    )
    fits = changes.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.regr_slope("_dq", "_dp"), F.lit(0.0)).alias("_e"),
        # Constant prices leave nothing to explain: 1 for constant demand, else 0.
        F.coalesce(
            F.regr_r2("_dq", "_dp"), F.when(F.var_pop("_dq") == 0, 1.0).otherwise(0.0)
        ).alias("_r2"),
        F.avg("_p").alias("_p"),
        F.sum("_r").alias("_r"),
    ).filter(F.col("_n") >= min_changes)
    e = F.col("_e")
    kind = F.when(e < -1, "elastico").when(e > -0.5, "inelastico").otherwise("moderado")
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    known = produtos.select(*KEY, "nome", "categoria", F.lit(True).alias("_known"))
    return (
        fits.withColumn("tipo", kind)
        .join(known, KEY, "left")
        .select(
            *KEY,
            F.when(F.col("_known"), F.col("nome")).otherwise(F.col("produto_key")).alias("nome"),
            F.when(F.col("_known"), F.col("categoria")).otherwise(F.lit("")).alias("categoria"),
            rint(e, 3).alias("elasticidade"),
            rint(F.col("_r2"), 3).alias("r2"),
            "tipo",
            F.element_at(advice, F.col("tipo")).alias("recomendacao"),
            rint(F.col("_p"), 2).alias("preco_medio"),
            rint(F.col("_r"), 2).alias("receita_total"),
        )
    )


def cenario_preco(elast: DataFrame, changes: Sequence[float] = GRID) -> DataFrame:
    """Expected effect of each price change on every product."""
    v, revenue = F.col("variacao_preco"), F.col("receita_total")
    grid = elast.withColumn(
        "variacao_preco", F.explode(F.array(*[F.lit(float(c)) for c in changes]))
    )
    moved = F.col("elasticidade") * v
    after = revenue * (1.0 + v / 100.0) * (1.0 + moved / 100.0)
    return grid.select(
        *KEY,
        rint(F.col("preco_medio"), 2).alias("preco_atual"),
        rint(F.col("preco_medio") * (1.0 + v / 100.0), 2).alias("preco_novo"),
        "variacao_preco",
        rint(moved, 2).alias("variacao_qtd"),
        rint(revenue, 2).alias("receita_atual"),
        rint(after, 2).alias("receita_nova"),
        rint(after - revenue, 2).alias("impacto_receita"),
        rint(F.try_divide(after - revenue, revenue) * 100.0, 2).alias("impacto_pct"),
    )


def margem(itens: DataFrame, produtos: DataFrame) -> DataFrame:
    """Revenue, cost and gross margin per product; no revenue gives no percentage."""
    per_product = sold(itens, "product").select(
        *KEY, F.col("_fat").alias("_r"), F.col("_qtd").alias("_q"), F.col("_desc").alias("_d")
    )
    cost = F.col("_q") * F.col("preco_custo")
    gross = F.col("_r") - cost
    return per_product.join(
        produtos.select(*KEY, "nome", "categoria", "preco_custo", "preco_venda"), KEY, "left"
    ).select(
        *KEY,
        dbl("_r").alias("receita"), dbl("_q").alias("quantidade"), dbl("_d").alias("desconto"),
        "nome", "categoria", dbl("preco_custo").alias("preco_custo"),
        dbl("preco_venda").alias("preco_venda"),
        rint(cost, 2).alias("custo_total"),
        rint(gross, 2).alias("margem_bruta"),
        rint(F.try_divide(dbl(gross), dbl("_r")) * 100.0, 2).alias("pct_margem"),
    )


def margem_kpis(margens: DataFrame, elast: DataFrame) -> DataFrame:
    """Totals of the price page and its best and worst product."""
    def named(agg, sign: int) -> Column:
        return agg(
            F.when(F.col("pct_margem").isNotNull(), F.struct("nome", "produto_key", "pct_margem")),
            F.when(
                F.col("pct_margem").isNotNull(),
                F.struct(F.col("pct_margem") * sign, F.col("margem_bruta") * -1, "produto_key"),
            ),
        )

    sums = margens.groupBy("client_key").agg(
        F.sum(F.col("receita").cast(WIDE_MONEY)).alias("_r"),
        F.sum(F.col("margem_bruta").cast(WIDE_MONEY)).alias("_m"),
        named(F.min_by, -1).alias("_best"),
        named(F.min_by, 1).alias("_worst"),
    )
    elastic = elast.groupBy("client_key").agg(
        F.count(F.when(F.col("tipo") == "elastico", 1)).alias("produtos_elasticos")
    )
    return attach(sums, elastic, how="left").fillna(0, ["produtos_elasticos"]).select(
        "client_key",
        dbl("_r").alias("receita_total"),
        dbl("_m").alias("margem_total"),
        F.when(F.col("_r") > 0, dbl("_m") / dbl("_r") * 100.0).otherwise(F.lit(0.0)).alias(
            "pct_margem"
        ),
        "produtos_elasticos",
        F.col("_best.nome").alias("maior_margem_nome"),
        F.col("_best.pct_margem").alias("maior_margem_pct"),
        F.col("_worst.nome").alias("menor_margem_nome"),
        F.col("_worst.pct_margem").alias("menor_margem_pct"),
    )


def elasticidade_contagem(elast: DataFrame) -> DataFrame:
    return elast.groupBy("client_key", "tipo").agg(F.count(F.lit(1)).alias("quantidade"))


def elasticidade_view(elast: DataFrame) -> DataFrame:
    return elast.filter(F.col("receita_total") > 0).select(
        *KEY, "elasticidade", F.col("tipo").alias("interpretacao"),
        F.col("receita_total").alias("receita"),
    ).orderBy("client_key", F.desc("receita"), "produto_key")


def matriz_preco(elast: DataFrame, ranking: DataFrame) -> DataFrame:
    """Quadrant of each product: price sensitivity against recent revenue.

    A product the ranking does not list counts as a high seller.  The mean and
    the products read the ranking, which is written once for both.
    """
    ranking = materialize(ranking.select("client_key", "id", "faturamento"))
    mean = ranking.groupBy("client_key").agg(
        div0(money_sum("faturamento"), F.count("faturamento")).alias("_mean")
    )
    sold = ranking.select(
        "client_key", F.col("id").alias("produto_key"), F.col("faturamento").alias("_fat")
    )
    elastic = F.col("elasticidade") < -1
    high = F.col("_fat").isNull() | (F.col("_fat") >= F.coalesce("_mean", F.lit(0.0)))
    quadrant = (
        F.when(elastic & high, "chama-cliente")
        .when(~elastic & high, "ouro-oculto")
        .when(elastic, "gira-estoque")
        .otherwise("margem-segura")
    )
    seen = elasticidade_view(elast)
    return (
        attach(seen.join(sold, KEY, "left"), mean, how="left")
        .select(*KEY, "elasticidade", "receita", quadrant.alias("quadrante"))
    )
