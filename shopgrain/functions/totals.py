"""Items summed by product and period, which one pass over the items makes for several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.numbers import money_sum
from shopgrain.schema import WIDE_MONEY

KEY = ["client_key", "produto_key"]
#: Column of the period that each unit adds to the product, from the coarsest unit on.
PERIOD = {"product": None, "month": "_mes", "day": "_dia"}
SUMS = ("_fat", "_qtd", "_desc", "_preco", "_precos", "_linhas")


def unit_of(itens: DataFrame) -> str | None:
    """Unit of a frame made by :func:`sold`; none for items."""
    if "_linhas" not in itens.columns:
        return None
    return next((u for u, c in PERIOD.items() if c in itens.columns), "product")


def sold(itens: DataFrame, unit: str) -> DataFrame:
    """Sums of revenue, quantity, discount and prices, and lines, per product and ``unit``.

    ``itens`` are items, or sums of a unit at least as fine.  Items without a
    column have no sum of it.  All sums are exact, so it does not matter over
    how many units they were made.
    """
    made = unit_of(itens)
    if made == unit:
        return itens
    if made is not None and list(PERIOD).index(made) < list(PERIOD).index(unit):
        raise ValueError(f"sums by {made} do not tell the {unit}")
    moment = F.col("data_venda" if made is None else PERIOD[made] or "")
    period = {
        "product": [], "month": [F.trunc(moment, "month").alias("_mes")], "day": [moment.cast("date").alias("_dia")],
    }[unit]
    if made is not None:
        sums = [F.sum(c).cast(itens.schema[c].dataType).alias(c) for c in SUMS if c in itens.columns]
        return itens.groupBy(*KEY, *period).agg(*sums)
    sums = {
        "total": [money_sum("total").alias("_fat")],
        "quantidade": [F.sum("quantidade").alias("_qtd")],
        "desconto": [money_sum("desconto").alias("_desc")],
        "preco_unitario": [
            F.sum(F.col("preco_unitario").cast(WIDE_MONEY)).alias("_preco"),
            F.count("preco_unitario").alias("_precos"),
        ],
    }
    return itens.groupBy(*KEY, *period).agg(
        *[s for c, made_of in sums.items() if c in itens.columns for s in made_of], F.count(F.lit(1)).alias("_linhas"),
    )
