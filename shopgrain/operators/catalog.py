"""Products, stock and the views on top of the algorithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, div0, money_sum
from shopgrain.functions.ordering import ranked, top_n
from shopgrain.functions.periods import days_before, items_since, sale_keys, with_starts
from shopgrain.functions.tenancy import attach
from shopgrain.schema import WIDE_MONEY
from shopgrain.sources.shared import materialize

KEY = ["client_key", "produto_key"]


def _stock(estoque: DataFrame, produtos: DataFrame) -> DataFrame:
    known = produtos.select(*KEY, "nome", "categoria", "preco_venda", "preco_custo")
    return estoque.select(*KEY, "quantidade", "quantidade_min").join(known, KEY, "left").select(
        *KEY,
        F.coalesce("nome", "produto_key").alias("nome"),
        F.coalesce("categoria", F.lit("")).alias("categoria"),
        "quantidade", "quantidade_min",
        F.coalesce("preco_venda", F.lit(0)).cast("decimal(12,2)").alias("preco_venda"),
        F.coalesce("preco_custo", F.lit(0)).cast("decimal(12,2)").alias("preco_custo"),
        (F.col("quantidade") <= F.col("quantidade_min")).alias("alerta"),
    )


def estoque_alertas(estoque: DataFrame, produtos: DataFrame) -> DataFrame:
    """Stock at or below its minimum, lowest first."""
    low = estoque.filter(F.col("quantidade") <= F.col("quantidade_min"))
    return _stock(low, produtos).select(
        *KEY, "nome", "quantidade", "quantidade_min"
    ).orderBy("client_key", "quantidade", "produto_key")


def estoque_completo(
    estoque: DataFrame, produtos: DataFrame, categoria: str | None = None,
    alerta: bool | None = None,
) -> DataFrame:
    """All stock with product data, alerts first; optional filters of the page."""
    rows = _stock(estoque, produtos)
    if categoria is not None:
        rows = rows.filter(F.col("categoria") == categoria)
    if alerta is not None:
        rows = rows.filter(F.col("alerta") == alerta)
    return rows.orderBy("client_key", F.desc("alerta"), "quantidade", "produto_key")


def estoque_kpis(estoque: DataFrame, produtos: DataFrame) -> DataFrame:
    worth = F.col("quantidade") * F.col("preco_custo")
    return _stock(estoque, produtos).groupBy("client_key").agg(
        F.count(F.lit(1)).alias("total_skus"),
        F.count(F.when(F.col("alerta"), 1)).alias("alertas"),
        dbl(F.sum(worth)).alias("valor_estoque"),
        F.count(F.when(~F.col("alerta"), 1)).alias("estoque_ok"),
    )


def produtos_abc_sql(itens: DataFrame, produtos: DataFrame) -> DataFrame:
    """Class by cumulative revenue over all sales; equal revenues share one sum."""
    per_product = materialize(itens.groupBy(*KEY).agg(money_sum("total").alias("_fat")))
    cumulated = ranked(
        per_product, ["client_key"], [-F.col("_fat"), F.col("produto_key")],
        {"fat": F.col("_fat").cast(WIDE_MONEY)}, peers=1,
    )
    share = F.try_divide(dbl("_peers_fat"), dbl("_sum_fat"))
    return (
        cumulated.join(produtos.select(*KEY, "nome", "categoria"), KEY, "left")
        .select(
            *KEY,
            F.coalesce("nome", "produto_key").alias("nome"),
            F.coalesce("categoria", F.lit("")).alias("categoria"),
            dbl("_fat").alias("faturamento"),
            F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C").alias("classe"),
        )
    )


def dead_stock(
    estoque: DataFrame, produtos: DataFrame, itens: DataFrame, vendas: DataFrame,
    as_of=None, days: int = 90,
) -> DataFrame:
    """Stocked products without a sale in the last ``days`` days."""
    recent_sales, at = with_starts(vendas, vendas, as_of, start=days_before(days))
    keys = sale_keys(itens, vendas)
    recent = recent_sales.filter(F.col("data_venda") >= at["start"]).select(*keys)
    sold = (
        items_since(itens, vendas, as_of, days_before(days)).select(*keys, "produto_key")
        .join(recent, keys, "left_semi")
        .select(*KEY).distinct()
    )
    idle = (
        estoque.filter(F.col("quantidade") > 0).select(*KEY, "quantidade")
        .join(sold, KEY, "left_anti")
    )
    return idle.join(produtos.select(*KEY, "nome", "preco_custo"), KEY).select(
        *KEY, "nome", "quantidade", "preco_custo",
        (F.col("quantidade") * F.col("preco_custo")).alias("capital_parado"),
    ).orderBy("client_key", F.desc("capital_parado"), "produto_key")


def dead_stock_totals(idle: DataFrame) -> DataFrame:
    return idle.groupBy("client_key").agg(
        dbl(F.sum(F.coalesce("capital_parado", F.lit(0)))).alias("capital_total"),
        dbl(F.sum("quantidade")).alias("itens_total"),
    )


def catalog_kpis(
    produtos: DataFrame, classes: DataFrame, margens: DataFrame, idle: DataFrame
) -> DataFrame:
    """Size of the catalogue, weight of class A, mean margin and idle capital."""
    def money(col: str) -> Column:
        return F.col(col).cast(WIDE_MONEY)

    in_a = F.col("classe") == "A"
    size = produtos.groupBy("client_key").agg(F.count(F.lit(1)).alias("total_skus"))
    top = classes.groupBy("client_key").agg(
        F.count(F.when(in_a, 1)).alias("qtd_classe_a"),
        F.sum(F.when(in_a, money("faturamento"))).alias("_a"),
        F.sum(money("faturamento")).alias("_all"),
    )
    mean = margens.groupBy("client_key").agg(
        div0(F.sum(money("pct_margem")), F.count("pct_margem")).alias("margem_media")
    )
    stuck = idle.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("dead_stock_skus"), F.sum("capital_parado").alias("_stuck")
    )
    rows = size
    for part in (top, mean, stuck):
        rows = attach(rows, part, how="left")
    rows = rows.fillna(0, ["qtd_classe_a", "margem_media", "dead_stock_skus"])
    return rows.select(
        "client_key", "total_skus", "qtd_classe_a",
        (div0(F.col("_a"), F.col("_all")) * 100.0).alias("pct_faturamento_a"),
        "margem_media", "dead_stock_skus",
        F.coalesce(dbl("_stuck"), F.lit(0.0)).alias("capital_parado"),
    )


def ranking_produtos(
    produtos: DataFrame, itens: DataFrame, vendas: DataFrame, classes: DataFrame,
    margens: DataFrame, as_of=None,
) -> DataFrame:
    """Revenue of the last 28 days and its trend against the 28 days before."""
    sales, at = with_starts(
        vendas, vendas, as_of, now=days_before(28), before=days_before(56)
    )
    keys = sale_keys(itens, vendas)
    window = sales.filter(F.col("data_venda") >= at["before"]).select(
        *keys, (F.col("data_venda") >= at["now"]).alias("_now")
    )
    revenue = (
        items_since(itens, vendas, as_of, days_before(56)).select(*keys, "produto_key", "total")
        .join(window, keys)
        .groupBy(*KEY)
        .agg(
            F.sum(F.when(F.col("_now"), F.col("total").cast(WIDE_MONEY))).alias("_cur"),
            F.sum(F.when(~F.col("_now"), F.col("total").cast(WIDE_MONEY))).alias("_prev"),
        )
    )
    cur = F.coalesce("_cur", F.lit(0).cast(WIDE_MONEY))
    prev = F.coalesce("_prev", F.lit(0).cast(WIDE_MONEY))
    up, down = F.lit("1.05").cast("decimal(3,2)"), F.lit("0.95").cast("decimal(3,2)")
    return (
        produtos.select(*KEY, "nome", "categoria")
        .join(revenue, KEY, "left")
        .join(classes.select(*KEY, "classe", "classe_xyz"), KEY, "left")
        .join(margens.select(*KEY, "pct_margem"), KEY, "left")
        .select(
            "client_key", F.col("produto_key").alias("id"), "nome",
            F.coalesce("categoria", F.lit("Geral")).alias("categoria"),
            dbl(cur).alias("faturamento"),
            F.coalesce("pct_margem", F.lit(0.0)).alias("margem"),
            F.coalesce("classe", F.lit("C")).alias("classe_abc"),
            F.coalesce("classe_xyz", F.lit("Z")).alias("classe_xyz"),
            F.when(cur > prev * up, "subindo").when(cur < prev * down, "caindo")
            .otherwise("estavel").alias("tendencia"),
        )
    )


def basket_view(rules: DataFrame, n: int = 6) -> DataFrame:
    """Best rule of each unordered pair, first ``n``, read as "1 in N" buyers."""
    first = F.struct(F.least("antecedents", "consequents"), F.greatest("antecedents", "consequents"))
    rows = rules.withColumn("_pair", first)
    best = top_n(
        rows, 1, F.desc("lift"), F.asc("antecedents"), F.asc("consequents"),
        by=["client_key", "_pair"],
    )
    shown = top_n(best, n, F.desc("lift"), F.asc("antecedents"), F.asc("consequents"))
    one_in = F.greatest(F.lit(1.0), F.floor(F.try_divide(F.lit(100.0), F.col("confidence")) + 0.5))
    return shown.select(
        "client_key", "antecedents", "consequents", "confidence", "lift",
        one_in.cast("bigint").alias("um_em"),
    )


def sugestao_reposicao(
    estoque: DataFrame, produtos: DataFrame, forecast_resumo: DataFrame
) -> DataFrame:
    """Days of cover and order size for products in alert."""
    low = _stock(estoque, produtos).filter("alerta")
    wanted = F.coalesce("quantidade_prevista", F.lit(0.0))
    qty = dbl("quantidade")
    cover = F.coalesce(F.try_divide(qty, wanted / 30.0), F.lit(0.0))
    return low.join(
        forecast_resumo.select(*KEY, "quantidade_prevista"), KEY, "left"
    ).select(
        *KEY, "nome", "categoria", qty.alias("quantidade"),
        dbl("quantidade_min").alias("quantidade_min"), wanted.alias("quantidade_prevista"),
        (F.rint(cover * 10.0) / 10.0).alias("dias_cobertura"),
        F.rint(F.greatest(wanted - qty, F.lit(0.0))).alias("pedido_sugerido"),
    )


def forecast_por_produto(
    forecast_resumo: DataFrame, estoque: DataFrame, produtos: DataFrame, n: int = 15
) -> DataFrame:
    """Largest forecasts with product names and the upper error bar."""
    best = top_n(
        forecast_resumo, n, F.desc("quantidade_prevista"), F.asc("produto_key")
    )
    names = _stock(estoque, produtos).select(*KEY, "nome", "categoria")
    return best.join(names, KEY, "left").select(
        *KEY, "nome", "categoria", "quantidade_prevista",
        (F.col("quantidade_max") - F.col("quantidade_prevista")).alias("erro_superior"),
    )


def filtro_cascata(
    ranking: DataFrame, elast: DataFrame, rules: DataFrame, idle: DataFrame,
    categoria: str | None = None, produto: str | None = None,
) -> dict[str, DataFrame]:
    """Restrict every block of the page to the chosen category and product.

    All blocks read the chosen part of the ranking, which is written once.
    """
    kept = ranking
    if categoria is not None:
        kept = kept.filter(F.col("categoria") == categoria)
    if produto is not None:
        kept = kept.filter(F.col("id") == produto)
    kept = materialize(kept)
    keys = kept.select("client_key", F.col("id").alias("produto_key"))

    def side(name: str) -> DataFrame:
        marked = keys.select("client_key", F.col("produto_key").alias(name), F.lit(True).alias(f"_{name}"))
        return marked

    either = (
        rules.join(side("antecedents"), ["client_key", "antecedents"], "left")
        .join(side("consequents"), ["client_key", "consequents"], "left")
        .filter(F.col("_antecedents").isNotNull() | F.col("_consequents").isNotNull())
        .select(*rules.columns)
    )
    return {
        "ranking": kept,
        "elasticidade": elast.join(keys, KEY, "left_semi"),
        "basket": either,
        "dead_stock": idle.join(keys, KEY, "left_semi"),
    }
