"""Data of the weekly report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import fmt_brl, plain
from shopgrain.functions.ordering import top_n
from shopgrain.operators.customers import clientes_em_risco


def _section(
    df: DataFrame, name: str, order: list[Column], nome: Column, categoria: Column,
    valor: Column, extra: Column,
) -> DataFrame:
    w = Window.partitionBy("client_key").orderBy(*order)
    return df.select(
        "client_key", F.lit(name).alias("secao"),
        F.row_number().over(w).cast("bigint").alias("ordem"),
        nome.alias("nome"), categoria.alias("categoria"), valor.alias("valor"),
        extra.alias("extra"),
    )


def relatorio_semanal(
    resumo: DataFrame, classes: DataFrame, scores: DataFrame, alertas: DataFrame
) -> DataFrame:
    """KPIs, ten best products, five customers at risk and ten lowest stocks, long form."""
    blank = F.lit("")
    kpis = resumo.select("client_key", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(n).alias("nome"), v.alias("valor"))
        for i, (n, v) in enumerate((
            ("faturamento", fmt_brl(F.col("faturamento"))),
            ("ticket_medio", fmt_brl(F.col("ticket_medio"))),
            ("total_vendas", F.col("total_vendas").cast("string")),
            ("total_descontos", fmt_brl(F.col("total_desconto"))),
        ))
    ])))
    best = top_n(classes, 10, F.desc("faturamento"), F.asc("produto_key"))
    risk = clientes_em_risco(scores, 5)
    low = top_n(alertas, 10, F.asc("quantidade"), F.asc("produto_key"))
    parts = [
        _section(kpis, "kpis", [F.asc("_i")], F.col("nome"), blank, F.col("valor"), blank),
        _section(
            best, "top_produtos", [F.desc("faturamento"), F.asc("produto_key")],
            F.col("produto_key"), blank, fmt_brl(F.col("faturamento")), F.col("classe"),
        ),
        _section(
            risk, "clientes_risco", [F.desc("valor_total"), F.asc("cliente_id")],
            F.col("cliente_id"), blank, fmt_brl(F.col("valor_total")),
            F.col("recencia").cast("string"),
        ),
        _section(
            low, "alertas_estoque", [F.asc("quantidade"), F.asc("produto_key")],
            F.col("nome"), blank, plain(F.col("quantidade")), plain(F.col("quantidade_min")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
