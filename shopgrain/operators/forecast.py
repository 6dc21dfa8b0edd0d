"""Demand forecast per product.

A product with few sale days gets a flat mean; one with enough gets a linear
trend with weekday and month indices.  Both are plain aggregates, so a product
never becomes a Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, rint
from shopgrain.functions.tenancy import attach
from shopgrain.functions.totals import sold
from shopgrain.sources.shared import materialize

KEY = ["client_key", "produto_key"]
ENOUGH_DAYS = 30
BAND = 1.96


def diario(itens: DataFrame) -> DataFrame:
    """Quantity per product and sale day, of items or of their daily sums (``totals.sold``)."""
    return sold(itens, "day").select(*KEY, F.col("_dia").alias("data"), dbl("_qtd").alias("y"))


def _future(last: Column, horizon: int) -> Column:
    return F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, horizon)))


def _not_negative(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def forecast_media_movel(daily: DataFrame, horizon: int = 90) -> DataFrame:
    """Mean of the last 30 sale days, flat, with one deviation as the band."""
    # One row per product and day: the window is bounded by the calendar.
    latest = Window.partitionBy(*KEY).orderBy(F.desc("data"))
    recent = daily.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= 30)
    stats = recent.groupBy(*KEY).agg(
        F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"), F.max("data").alias("_last")
    )
    spread = F.coalesce(F.col("_s"), F.col("_m") * 0.2)
    return stats.select(
        *KEY,
        _future(F.col("_last"), horizon).alias("data"),
        rint(F.col("_m"), 2).alias("quantidade_prevista"),
        rint(_not_negative(F.col("_m") - spread), 2).alias("quantidade_min"),
        rint(F.col("_m") + spread, 2).alias("quantidade_max"),
        F.lit("media_movel").alias("metodo"),
    )


def forecast_sazonal(daily: DataFrame, horizon: int = 90) -> DataFrame:
    """Trend x weekday index x month index with a 95% band.

    Every step is a window inside one product, which has one row per day, so
    the rows are shuffled once, by product.
    """
    product = Window.partitionBy(*KEY)
    y, t = F.col("y"), F.col("_t")
    dated = daily.select(
        *KEY, "data", "y", F.min("data").over(product).alias("_first"),
        F.weekday("data").alias("_wd"), F.month("data").alias("_mo"),
    ).withColumn("_t", F.date_diff("data", "_first").cast("double"))
    fit = dated.withColumn(
        "_b", F.coalesce(F.regr_slope(y, t).over(product), F.lit(0.0))
    ).withColumn(
        "_a", F.coalesce(F.regr_intercept(y, t).over(product), F.avg(y).over(product))
    ).withColumn("_trend", F.col("_a") + F.col("_b") * t)
    trend = F.col("_trend")
    weekly = fit.withColumn(
        "_w", F.avg(F.when(trend > 0, y / trend)).over(Window.partitionBy(*KEY, "_wd"))
    ).withColumn("_level", trend * F.coalesce("_w", F.lit(1.0)))
    level = F.col("_level")
    seasonal = weekly.withColumn(
        "_mi", F.avg(F.when(level > 0, y / level)).over(Window.partitionBy(*KEY, "_mo"))
    )

    def estimate(at: Column, month: Column) -> Column:
        return _not_negative(at * F.coalesce(month, F.lit(1.0)))

    def by_number(of: str, number: str, n: range) -> Column:
        return F.array(*[F.max(F.when(F.col(number) == i, F.col(of))) for i in n])

    model = seasonal.groupBy(*KEY).agg(
        F.first("_a").alias("_a"), F.first("_b").alias("_b"),
        F.first("_first").alias("_first"), F.max("data").alias("_last"),
        F.coalesce(
            F.stddev_samp(y - estimate(level, F.col("_mi"))), F.lit(0.0)
        ).alias("_s"),
        by_number("_w", "_wd", range(7)).alias("_ws"),
        by_number("_mi", "_mo", range(1, 13)).alias("_ms"),
    )
    ahead = model.select("*", _future(F.col("_last"), horizon).alias("data"))
    days = F.date_diff("data", "_first").cast("double")
    w = F.element_at("_ws", F.weekday("data") + 1)
    ahead_level = (F.col("_a") + F.col("_b") * days) * F.coalesce(w, F.lit(1.0))
    yhat = estimate(ahead_level, F.element_at("_ms", F.month("data")))
    band = F.col("_s") * BAND
    return ahead.select(
        *KEY, "data",
        rint(yhat, 2).alias("quantidade_prevista"),
        rint(_not_negative(yhat - band), 2).alias("quantidade_min"),
        rint(yhat + band, 2).alias("quantidade_max"),
        F.lit("sazonal").alias("metodo"),
    )


def forecast(itens: DataFrame, horizon: int = 90, produto: str | None = None) -> DataFrame:
    """Forecast per product and day; the method follows the number of sale days."""
    if produto is not None:
        itens = itens.filter(F.col("produto_key") == produto)
    # Both routes read the daily rows; the items are scanned once for them.
    days = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    routed = materialize(diario(itens).withColumn("_n", days))
    few = routed.filter(F.col("_n") < ENOUGH_DAYS).drop("_n")
    enough = routed.filter(F.col("_n") >= ENOUGH_DAYS).drop("_n")
    return forecast_media_movel(few, horizon).unionByName(forecast_sazonal(enough, horizon))


def forecast_resumo(
    predictions: DataFrame, days: int = 30, per_shop: bool = False
) -> DataFrame:
    """Totals per product from its first forecast day to ``days`` later, inclusive.

    With ``per_shop`` all windows begin at the shop's first forecast day, which
    leaves out products whose sales end later.
    """
    if per_shop:
        first = predictions.groupBy("client_key").agg(F.min("data").alias("_from"))
        dated = attach(predictions, first)
    else:
        # One row per forecast day: the sums below read the same partitions.
        own = Window.partitionBy(*KEY)
        dated = predictions.withColumn("_from", F.min("data").over(own))
    near = dated.filter(F.col("data") <= F.date_add("_from", days))

    def total(col: str) -> Column:
        return rint(F.sum(F.col(col).cast("decimal(18,2)")), 2).alias(col)

    return near.groupBy(*KEY).agg(
        total("quantidade_prevista"), total("quantidade_min"), total("quantidade_max"),
        F.min_by("metodo", "data").alias("metodo"),
    )
