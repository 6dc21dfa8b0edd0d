"""Ranked text insights built from the results of the other operators.

Each rule gives at most one row per shop.  ``_seq`` is the number of the rule
and settles equal priorities.  The wording, links and icons of the rules are
fixed values that the pages show as they are.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import div0, plain
from shopgrain.functions.ordering import percentiles, top_n
from shopgrain.functions.periods import hours_before
from shopgrain.functions.tenancy import attach
from shopgrain.operators.customers import AT_RISK
from shopgrain.schema import WIDE_MONEY
from shopgrain.sources.shared import materialize

COLUMNS = (
    "tipo", "prioridade", "titulo", "mensagem", "acao", "href", "categoria", "icone",
)
PENALTY = 10
SHOWN = 3


def _thousands(col: Column | str) -> Column:
    return F.format_number((F.col(col) if isinstance(col, str) else col).cast("double"), 0)


def _row(
    df: DataFrame, seq: int, tipo: str, prioridade: Column | int, titulo: Column | str,
    mensagem: Column, acao: str, href: str, categoria: str, icone: str,
) -> DataFrame:
    def text(v: Column | str | int) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return df.select(
        "client_key", text(tipo).alias("tipo"), text(prioridade).cast("int").alias("prioridade"),
        text(titulo).alias("titulo"), mensagem.alias("mensagem"), text(acao).alias("acao"),
        text(href).alias("href"), text(categoria).alias("categoria"), text(icone).alias("icone"),
        F.lit(seq).alias("_seq"),
    )


def ins_estoque_critico(forecast_resumo: DataFrame, classes: DataFrame) -> DataFrame:
    """Product with the largest expected demand."""
    first = top_n(
        forecast_resumo.filter(F.col("quantidade_prevista") > 0), 1,
        F.desc("quantidade_prevista"), F.asc("produto_key"),
    )
    known = first.join(
        classes.select("client_key", "produto_key", "classe"), ["client_key", "produto_key"], "left"
    )
    is_a = F.coalesce(F.col("classe") == "A", F.lit(False))
    units = plain(F.col("quantidade_prevista"))
    urgent = F.concat(
        F.lit("Produto "), "produto_key", F.lit(" (Classe A) com alta demanda prevista: "), units,
        F.lit(" unidades nos próximos 30 dias. Verifique o nível de estoque."),
    )
    low = F.concat(
        F.lit("Produto "), "produto_key", F.lit(" com demanda prevista de "), units,
        F.lit(" unidades nos próximos 30 dias."),
    )
    return _row(
        known, 1, "estoque_critico", F.when(is_a, 1).otherwise(3),
        F.when(is_a, "Ruptura iminente").otherwise("Estoque baixo"),
        F.when(is_a, urgent).otherwise(low), "Ver estoque", "/estoque", "estoque", "warning",
    )


def ins_churn_vip(scores: DataFrame) -> DataFrame:
    """Valuable customers who stopped buying."""
    scores = materialize(scores.select("client_key", "segmento", "valor_total", "recencia"))
    limit = percentiles(scores, ["client_key"], "valor_total", {"_p75": 0.75})
    vip = attach(scores.filter(F.col("segmento").isin(*AT_RISK)), limit).filter(
        F.col("valor_total") > F.col("_p75")
    )
    sums = vip.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("valor_total").cast(WIDE_MONEY)).alias("_v"),
        F.sum("recencia").alias("_r"),
    )
    text = F.concat(
        F.col("_n").cast("string"),
        F.lit(" cliente(s) de alto valor sem comprar há em média "),
        div0(F.col("_r"), F.col("_n")).cast("bigint").cast("string"),
        F.lit(" dias. Valor histórico em risco: R$ "), _thousands("_v"),
        F.lit(". Entre em contato esta semana."),
    )
    return _row(
        sums, 2, "churn_vip", 2, "Clientes VIP sumindo", text, "Ver clientes", "/clientes",
        "clientes", "danger",
    )


def _most_frequent(df: DataFrame, col: str, name: str) -> DataFrame:
    """Most frequent value per shop, the smaller one on a tie."""
    counts = df.filter(F.col(col).isNotNull()).groupBy("client_key", col).agg(
        F.count(F.lit(1)).alias("_c")
    )
    return counts.groupBy("client_key").agg(
        F.min_by(col, F.struct(-F.col("_c"), F.col(col))).alias(name)
    )


def ins_anomalia_desconto(discounts: DataFrame) -> DataFrame:
    discounts = materialize(discounts.select("client_key", "vendedor_id", "desconto"))
    sums = discounts.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("desconto").cast(WIDE_MONEY)).alias("_v")
    )
    seller = _most_frequent(discounts, "vendedor_id", "_who")
    text = F.concat(
        F.col("_n").cast("string"),
        F.lit(" venda(s) com desconto fora do padrão detectadas. "),
        F.lit("Vendedor com mais ocorrências: "), F.coalesce("_who", F.lit("N/A")),
        F.lit(". Total em descontos incomuns: R$ "), _thousands("_v"), F.lit("."),
    )
    return _row(
        attach(sums, seller, how="left"), 3, "anomalia_desconto", 3, "Descontos anômalos", text,
        "Ver anomalias", "/anomalias", "anomalias", "danger",
    )


def _best_rule(rules: DataFrame) -> DataFrame:
    return top_n(rules, 1, F.desc("lift"), F.asc("antecedents"), F.asc("consequents"))


def ins_combo(rules: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Clientes que compram "), "antecedents", F.lit(" têm "),
        plain(F.col("confidence")), F.lit("% de chance de comprar "), "consequents",
        F.lit(". Treine o balconista para sugerir este combo."),
    )
    return _row(
        _best_rule(rules), 4, "oportunidade_combo", 4, "Oportunidade de venda cruzada", text,
        "Ver produtos", "/produtos", "produtos", "success",
    )


def ins_margem_alta(margens: DataFrame, classes: DataFrame) -> DataFrame:
    """Most profitable product of class A."""
    in_a = classes.filter(F.col("classe") == "A").select("client_key", "produto_key")
    best = top_n(
        margens.join(in_a, ["client_key", "produto_key"], "left_semi"), 1,
        F.desc_nulls_last("pct_margem"), F.desc_nulls_last("margem_bruta"), F.asc("produto_key"),
    )
    text = F.concat(
        F.coalesce("nome", "produto_key"), F.lit(" é seu produto mais rentável: "),
        plain(F.col("pct_margem"), 1), F.lit("% de margem bruta com R$ "), _thousands("receita"),
        F.lit(" em receita. Priorize seu estoque e visibilidade na loja."),
    )
    return _row(
        best, 5, "margem_alta", 5, "Produto com melhor margem", text, "Ver margens", "/preco",
        "financeiro", "success",
    )


def ins_performance(resumo: DataFrame) -> DataFrame:
    text = F.concat(
        F.col("total_vendas").cast("string"), F.lit(" vendas com ticket médio de R$ "),
        _thousands("ticket_medio"), F.lit(". Faturamento total: R$ "), _thousands("faturamento"),
        F.lit(". Produtos classe A respondem por ~80% deste resultado."),
    )
    return _row(
        resumo.filter(F.col("faturamento") > 0), 6, "performance", 6, "Resumo de performance",
        text, "Ver vendas", "/vendas", "vendas", "success",
    )


def ins_vendedor(sellers: DataFrame) -> DataFrame:
    """Seller with the largest revenue."""
    first = top_n(sellers, 1, F.desc("total_faturado"), F.asc("vendedor_id"))
    text = F.concat(
        F.lit("O vendedor "), "vendedor_id",
        F.lit(
            " apresentou métricas atípicas (alto volume de descontos ou UPA muito baixo). "
            "Revise as últimas vendas."
        ),
    )
    return _row(
        first, 1, "vendedor_anomalia", 1, "Atenção com Vendedor", text, "Ver Ranking", "/vendas",
        "vendas", "warning",
    )


def ins_venda_cruzada(rules: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Combo forte detectado: Quem leva "), "antecedents", F.lit(" costuma levar "),
        "consequents",
        F.lit(". Instrua a equipe a oferecer esta venda cruzada para subir o Ticket Médio."),
    )
    return _row(
        _best_rule(rules), 2, "venda_cruzada", 2, "Oportunidade de UPA", text, "Ver Produtos",
        "/produtos", "vendas", "success",
    )


def ins_categoria_foco(classes: DataFrame, produtos: DataFrame) -> DataFrame:
    """Most common category among the products of class A."""
    in_a = classes.filter(F.col("classe") == "A").select("client_key", "produto_key")
    named = in_a.join(
        produtos.select("client_key", "produto_key", "categoria"),
        ["client_key", "produto_key"], "left",
    ).withColumn("categoria", F.coalesce("categoria", F.lit("Diversos")))
    text = F.concat(
        F.lit("A categoria '"), "_cat",
        F.lit(
            "' está puxando o faturamento da curva A. Garanta que a equipe conheça o mix de "
            "produtos desta linha."
        ),
    )
    return _row(
        _most_frequent(named, "categoria", "_cat"), 3, "categoria_foco", 3,
        "Tração de Categoria", text, "Ver Mix", "/vendas", "vendas", "success",
    )


def rotacao_temporal(
    insights: DataFrame, history: DataFrame, now: datetime | Column, hours: int = 24
) -> DataFrame:
    """Push back insight types already shown in the last ``hours``."""
    moment = now if isinstance(now, Column) else F.lit(now)
    recent = history.filter(F.col("gerado_em") >= hours_before(moment, hours)).select(
        "client_key", "tipo", F.lit(True).alias("_seen")
    ).distinct()
    return insights.join(recent, ["client_key", "tipo"], "left").select(
        "client_key", "tipo",
        (F.col("prioridade") + F.when(F.col("_seen"), PENALTY).otherwise(0)).alias("prioridade"),
        *COLUMNS[2:], "_seq",
    )


def _in_order() -> tuple[Column, ...]:
    return F.asc("prioridade"), F.asc("_seq")


def _mark_diverse(insights: DataFrame, n: int) -> DataFrame:
    """Mark the first of each category, filled up in order to ``n``.

    A shop has one row per rule, so these windows stay tiny.
    """
    per_category = Window.partitionBy("client_key", "categoria").orderBy(*_in_order())
    again = (F.row_number().over(per_category) > 1).cast("int")
    shown = Window.partitionBy("client_key").orderBy(F.asc("_again"), *_in_order())
    return insights.withColumn("_again", again).withColumn(
        "top3", F.row_number().over(shown) <= n
    ).drop("_again")


def top3_diverso(insights: DataFrame, n: int = SHOWN) -> DataFrame:
    """The ``n`` insights to show, of different categories where possible."""
    return _mark_diverse(insights, n).filter("top3").drop("top3")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def insights_home(
    forecast_resumo: DataFrame, classes: DataFrame, scores: DataFrame, discounts: DataFrame,
    rules: DataFrame, margens: DataFrame, resumo: DataFrame,
    history: DataFrame | None = None, now: datetime | Column | None = None,
) -> DataFrame:
    """All home insights with their final priority; ``top3`` marks the shown ones."""
    rows = _union([
        ins_estoque_critico(forecast_resumo, classes), ins_churn_vip(scores),
        ins_anomalia_desconto(discounts), ins_combo(rules), ins_margem_alta(margens, classes),
        ins_performance(resumo),
    ])
    if history is not None:
        rows = rotacao_temporal(rows, history, now)
    return _mark_diverse(rows, SHOWN)


def insights_vendas(
    sellers: DataFrame, rules: DataFrame, classes: DataFrame, produtos: DataFrame,
    history: DataFrame | None = None, now: datetime | Column | None = None,
) -> DataFrame:
    """Insights of the sales page; the first three are shown."""
    rows = _union([
        ins_vendedor(sellers), ins_venda_cruzada(rules), ins_categoria_foco(classes, produtos),
    ])
    if history is not None:
        rows = rotacao_temporal(rows, history, now)
    w = Window.partitionBy("client_key").orderBy(*_in_order())
    return rows.withColumn("top3", F.row_number().over(w) <= SHOWN)


def ler_insights(cache: DataFrame, categoria: str | None = None) -> DataFrame:
    """Published insights by priority: ten for the home page, three for a category."""
    rows = cache if categoria is None else cache.filter(F.col("categoria") == categoria)
    filled = rows.select(
        "client_key",
        F.coalesce("tipo", F.lit("")).alias("tipo"),
        F.coalesce("prioridade", F.lit(99)).alias("prioridade"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS[2:7]],
        F.coalesce("icone", F.lit("success")).alias("icone"),
        F.coalesce(F.col("gerado_em"), F.localtimestamp()).cast("string").alias("gerado_em"),
    )
    return top_n(filled, 10 if categoria is None else 3, F.asc("prioridade"), F.asc("tipo"))
