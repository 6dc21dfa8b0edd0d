"""ABC (revenue concentration) and XYZ (demand regularity) classes.

``itens`` are items of finished sales, as returned by ``read_itens_venda``, or
their sums as returned by ``totals.sold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, rint
from shopgrain.functions.ordering import ranked
from shopgrain.functions.tenancy import attach
from shopgrain.functions.totals import sold
from shopgrain.schema import WIDE_MONEY

KEY = ["client_key", "produto_key"]


def _letter(share: Column, a: Column, b: Column) -> Column:
    return F.when(share <= a, "A").when(share <= b, "B").otherwise("C")


def _spread() -> list[Column]:
    """Mean and deviation of the monthly quantities; a single month has none."""
    q = dbl("_qtd")
    return [
        F.avg(q).alias("_media"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("_desvio"),
    ]


def _sums() -> list[Column]:
    return [
        F.sum("_fat").cast(WIDE_MONEY).alias("_fat"), F.sum("_qtd").alias("_qtd"),
        F.sum("_linhas").alias("num_vendas"),
    ]


def _cv() -> Column:
    return F.coalesce(F.try_divide(F.col("_desvio"), F.col("_media")), F.lit(0.0))


def _xyz_class() -> Column:
    return F.when(_cv() <= 0.5, "X").when(_cv() <= 1.0, "Y").otherwise("Z")


def _classified(
    per_product: DataFrame, a: float, b: float, *extra: Column, limits: DataFrame | None = None
) -> DataFrame:
    rows = ranked(
        per_product, ["client_key"], [-F.col("_fat"), F.col("produto_key")],
        {"fat": F.col("_fat")},
    )
    upto_a, upto_b = F.lit(a), F.lit(b)
    if limits is not None:
        rows = attach(rows, limits.select("client_key", "abc_a", "abc_b"), how="left")
        upto_a, upto_b = F.coalesce("abc_a", upto_a), F.coalesce("abc_b", upto_b)
    total = dbl("_sum_fat")
    share = F.try_divide(dbl("_fat"), total)
    running = F.try_divide(dbl("_cum_fat"), total)
    return rows.select(
        *KEY,
        dbl("_fat").alias("faturamento"),
        rint(F.col("_qtd"), 2).alias("quantidade"),
        "num_vendas",
        rint(share * 100.0, 2).alias("percentual"),
        rint(running * 100.0, 2).alias("percentual_acumulado"),
        _letter(running, upto_a, upto_b).alias("classe"),
        *extra,
    )


def abc(itens: DataFrame, a: float = 0.80, b: float = 0.95) -> DataFrame:
    """Revenue share and class per product.

    The cumulative share runs row by row; equal revenues are ordered by key.
    """
    per_product = sold(itens, "product").select(
        *KEY, "_fat", "_qtd", F.col("_linhas").alias("num_vendas")
    )
    return _classified(per_product, a, b)


def xyz(itens: DataFrame) -> DataFrame:
    """Variation of monthly quantity; months without a sale do not count."""
    return sold(itens, "month").groupBy(*KEY).agg(*_spread()).select(
        *KEY,
        rint(F.col("_media"), 3).alias("media"),
        rint(F.col("_desvio"), 3).alias("desvio"),
        rint(_cv(), 3).alias("cv"),
        _xyz_class().alias("classe_xyz"),
    )


def abc_xyz(
    itens: DataFrame, a: float = 0.80, b: float = 0.95, limits: DataFrame | None = None
) -> DataFrame:
    """Both classes and their combination from one pass over the items.

    ``limits`` may give each shop its own (client_key, abc_a, abc_b).
    """
    per_product = sold(itens, "month").groupBy(*KEY).agg(*_sums(), *_spread())
    return _classified(
        per_product, a, b, _xyz_class().alias("classe_xyz"), rint(_cv(), 3).alias("cv"),
        limits=limits,
    ).withColumn("classe_abc_xyz", F.concat("classe", "classe_xyz"))


def resumo_abc(classes: DataFrame) -> DataFrame:
    """Products, revenue and share per class."""
    return classes.groupBy("client_key", "classe").agg(
        F.count("produto_key").alias("produtos"),
        rint(F.sum(F.col("faturamento").cast("decimal(28,2)")), 2).alias("faturamento"),
        rint(F.sum(F.col("percentual").cast("decimal(12,2)")), 2).alias("percentual"),
    )


def matriz_abc_xyz(classes: DataFrame) -> DataFrame:
    return classes.groupBy(
        "client_key", F.col("classe").alias("classe_abc"), "classe_xyz"
    ).agg(F.count(F.lit(1)).alias("qtd"))


def matriz_abc_xyz_pivot(classes: DataFrame) -> DataFrame:
    """The same matrix with one column per demand class."""
    return (
        classes.groupBy("client_key", "classe").pivot("classe_xyz", ["X", "Y", "Z"])
        .agg(F.count(F.lit(1))).fillna(0)
    )


def abc_kpis(classes: DataFrame) -> DataFrame:
    """Products and share per class, with the AX and AZ counts of the shop."""
    def paired(letter: str) -> Column:
        hit = (F.col("classe") == "A") & (F.col("classe_xyz") == letter)
        return F.count(F.when(hit, 1))

    return classes.groupBy("client_key", "classe").agg(
        F.count(F.lit(1)).alias("produtos"),
        dbl(F.sum(F.col("percentual").cast("decimal(12,2)"))).alias("percentual"),
        paired("X").alias("ax"),
        paired("Z").alias("az"),
    )
