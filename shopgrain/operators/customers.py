"""Customer value, recency and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, div0, money_sum, rint
from shopgrain.functions.ordering import percentiles, ranked, top_n
from shopgrain.functions.periods import moment, whole_days, with_starts
from shopgrain.functions.tenancy import attach
from shopgrain.schema import DONE, WIDE_MONEY
from shopgrain.sources.shared import materialize

KEY = ["client_key", "cliente_key"]
AT_RISK = ("em_risco", "hibernando")


def _base(clientes: DataFrame, vendas: DataFrame) -> DataFrame:
    # Sum per customer before the join: one row per customer meets the list.
    bought = vendas.filter(F.col("cliente_key").isNotNull()).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("frequencia"),
        money_sum("total").alias("_valor"),
        F.max("data_venda").alias("_ultima"),
    )
    active = bought.join(clientes.filter("ativo").select(*KEY), KEY, "left_semi")
    rows, at = with_starts(active, vendas, None, now=moment)
    return rows.select(
        *KEY, "frequencia", "_valor", whole_days(at["now"], F.col("_ultima")).alias("recencia")
    )


def clientes_rfm_base(clientes: DataFrame, vendas: DataFrame) -> DataFrame:
    """Active customers with purchases: count, value and days since the last one."""
    return _base(clientes, vendas).select(
        "client_key", F.col("cliente_key").alias("cliente_id"), "frequencia",
        dbl("_valor").alias("valor_total"), "recencia",
    )


# The two ordered lists of segment rules, here and in ``segmento_rfm``.
def _segment3(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r == 3) & (f == 3) & (m == 3), "campeon")
        .when((f >= 2) & (m >= 2), "fiel")
        .when((r == 1) & (f >= 2), "em_risco")
        .when((r == 1) & (f == 1), "perdido")
        .when((r == 3) & (f == 1), "promissor")
        .when((r >= 2) & (f == 1), "novo")
        .when((r <= 2) & (f >= 2), "hibernando")
        .otherwise("outros")
    )


METRICS = {"recencia": "r", "frequencia": "f", "_valor": "m"}


def _long(df: DataFrame) -> DataFrame:
    """One row per customer and metric, so the three are placed in one pass."""
    return df.select(
        *KEY,
        F.inline(F.array(*[
            F.struct(F.lit(tag).alias("_metric"), F.col(c).cast(WIDE_MONEY).alias("_x"))
            for c, tag in METRICS.items()
        ])),
    )


def resumo_segmentos_sql(clientes: DataFrame, vendas: DataFrame) -> DataFrame:
    """Segments from 3-level scores cut at the exact quartiles P25 and P75."""
    base = materialize(_base(clientes, vendas))
    cuts = percentiles(
        _long(base), ["client_key", "_metric"], "_x",
        {"p25": 0.25, "p75": 0.75}, groups_per_tenant=3,
    )
    wide = cuts.groupBy("client_key").agg(*[
        F.max(F.when(F.col("_metric") == tag, F.col(p))).alias(f"_{p}_{tag}")
        for tag in METRICS.values() for p in ("p25", "p75")
    ])
    value, recency, count = dbl("_valor"), F.col("recencia"), F.col("frequencia")
    r = F.when(recency <= F.col("_p25_r"), 3).when(recency <= F.col("_p75_r"), 2).otherwise(1)
    f = F.when(count >= F.col("_p75_f"), 3).when(count >= F.col("_p25_f"), 2).otherwise(1)
    m = F.when(value >= F.col("_p75_m"), 3).when(value >= F.col("_p25_m"), 2).otherwise(1)
    scored = attach(base, wide).select(
        "client_key", "_valor", "recencia", _segment3(r, f, m).alias("segmento")
    )
    n = F.count(F.lit(1))
    total = F.sum("_valor").cast(WIDE_MONEY)
    return scored.groupBy("client_key", "segmento").agg(
        n.alias("clientes"),
        dbl(F.round(total / n, 2)).alias("valor_medio"),
        dbl(total).alias("valor_total"),
        dbl(F.round(F.sum("recencia").cast("decimal(20,0)") / n, 2)).alias("recencia_media"),
    )


def clientes_inativos(
    base: DataFrame, dias: int = 45, n: int = 10, limits: DataFrame | None = None
) -> DataFrame:
    """Most valuable customers without a purchase for ``dias`` days.

    ``limits`` (client_key, churn_days) gives shops a number of days of their own.
    """
    late = base.filter(F.col("recencia") > dias)
    if limits is not None:
        days = attach(base, limits.select("client_key", F.col("churn_days").alias("_dias")), how="left")
        late = days.filter(F.col("recencia") > F.coalesce("_dias", F.lit(dias))).drop("_dias")
    return top_n(late, n, F.desc("valor_total"), F.asc("cliente_id"))


def segmento_kpis(summary: DataFrame) -> DataFrame:
    def customers(*names: str) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("segmento").isin(*names), F.col("clientes"))), F.lit(0)
        )

    return summary.groupBy("client_key").agg(
        F.sum("clientes").alias("total_clientes"),
        dbl(F.sum(F.col("valor_total").cast(WIDE_MONEY))).alias("valor_total"),
        customers(*AT_RISK).alias("em_risco"),
        customers("campeon").alias("campeoes"),
    )


def score_quintil(pos: Column, n: Column, ascending: bool = True) -> Column:
    """Fifth of the group that place ``pos`` of ``n`` falls in, 1 to 5.

    Equals cutting the ranks 1..n at their interpolated quintiles.
    """
    fifth = F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil((pos - 1) * 5 / (n - 1)))
    ).cast("int")
    return fifth if ascending else F.lit(6) - fifth


def segmento_rfm(r: Column, f: Column, m: Column) -> Column:
    """First rule that holds for the 1-to-5 scores."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "campeon")
        .when((f >= 3) & (m >= 3), "fiel")
        .when((r <= 2) & (f >= 3), "em_risco")
        .when((r == 1) & (f <= 2), "perdido")
        .when((r >= 4) & (f <= 2), "promissor")
        .when((r >= 3) & (f == 1), "novo")
        .when((r <= 2) & (f >= 2), "hibernando")
        .otherwise("outros")
    )


def rfm(vendas: DataFrame, as_of=None) -> DataFrame:
    """Recency, frequency, value, their quintile scores and the segment.

    Ties are placed by customer key.  Sales without a customer are left out.
    """
    done = vendas.filter(F.col("status") == DONE)
    bought = done.filter(F.col("cliente_key").isNotNull()).groupBy(*KEY).agg(
        F.count("data_venda").alias("frequencia"),
        money_sum("total").alias("_valor"),
        F.max("data_venda").alias("_ultima"),
    )
    rows, at = with_starts(bought, vendas, as_of, now=moment)
    base = materialize(rows.select(
        *KEY, "frequencia", "_valor", whole_days(at["now"], F.col("_ultima")).alias("recencia")
    ))
    placed = ranked(
        _long(base), ["client_key", "_metric"], [F.col("_x"), F.col("cliente_key")],
        groups_per_tenant=3,
    )

    def of(tag: str, col: Column) -> Column:
        return F.max(F.when(F.col("_metric") == tag, col))

    up = score_quintil(F.col("_pos"), F.col("_n"))
    down = score_quintil(F.col("_pos"), F.col("_n"), ascending=False)
    scored = placed.groupBy(*KEY).agg(
        of("r", F.col("_x")).cast("bigint").alias("recencia"),
        of("f", F.col("_x")).cast("bigint").alias("frequencia"),
        of("m", F.col("_x")).alias("_valor"),
        of("r", down).alias("score_r"), of("f", up).alias("score_f"), of("m", up).alias("score_m"),
    )
    r, f, m = F.col("score_r"), F.col("score_f"), F.col("score_m")
    return scored.select(
        "client_key", F.col("cliente_key").alias("cliente_id"), "recencia", "frequencia",
        dbl("_valor").alias("valor_total"), r, f, m,
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("score_rfm"),
        (r + f + m).alias("score_total"),
        segmento_rfm(r, f, m).alias("segmento"),
    )


def clientes_em_risco(scores: DataFrame, n: int = 20) -> DataFrame:
    risky = scores.filter(F.col("segmento").isin(*AT_RISK))
    return top_n(risky, n, F.desc("valor_total"), F.asc("cliente_id"))


def resumo_segmentos(scores: DataFrame) -> DataFrame:
    total = F.sum(F.col("valor_total").cast(WIDE_MONEY))
    n = F.count(F.lit(1))
    return scores.groupBy("client_key", "segmento").agg(
        n.alias("clientes"),
        rint(div0(total, n), 2).alias("valor_medio"),
        dbl(total).alias("valor_total"),
        rint(div0(F.sum("recencia"), n), 2).alias("recencia_media"),
    )
