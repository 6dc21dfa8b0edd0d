"""What the insight tables hold after each publication."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.operators.insights import COLUMNS
from shopgrain.schema import INSIGHTS
from shopgrain.sources.shared import materialize
from shopgrain.sources.tables import TableStore

CACHE, HISTORY, SALES = "insights_cache", "insights_historico", "vendas"


def _stamped(insights: DataFrame, now: datetime) -> DataFrame:
    return insights.select(
        "client_key", *COLUMNS, F.lit(now).cast("timestamp_ntz").alias("gerado_em"),
        F.coalesce("top3", F.lit(False)).alias("top3"),
    )


def _shops(df: DataFrame) -> DataFrame:
    return df.select("client_key").distinct()


def cache_after_home(current: DataFrame, home: DataFrame, now: datetime) -> DataFrame:
    """Home insights replace all rows of their shops; ``top3`` marks the shown ones."""
    fresh = _stamped(home, now)
    kept = current.join(_shops(fresh), "client_key", "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def cache_after_sales(current: DataFrame, page: DataFrame, now: datetime) -> DataFrame:
    """The shown sales insights replace the rows of category 'vendas'."""
    fresh = _stamped(page.filter("top3"), now).withColumn("categoria", F.lit(SALES))
    dropped = _shops(fresh).withColumn("categoria", F.lit(SALES))
    kept = current.join(dropped, ["client_key", "categoria"], "left_anti")
    return kept.select(*current.columns).unionByName(fresh.select(*current.columns))


def publicar_insights(
    store: TableStore, home: DataFrame, page: DataFrame, now: datetime
) -> None:
    """Publish both sets and append them to the history that rotation reads."""
    schema = T.StructType([*INSIGHTS.fields, T.StructField("top3", T.BooleanType())])
    batch = now.strftime("%Y%m%d%H%M%S")
    # Few rows, long plans: write them once before the merges read them.
    home, page = materialize(home), materialize(page)
    for step, (rows, fn) in enumerate(((home, cache_after_home), (page, cache_after_sales))):
        store.merge(
            CACHE, rows, ["client_key"], ["client_key"],
            lambda old, new, fn=fn: fn(old, new, now), f"{batch}-{step}", schema,
        )
    both = _stamped(home, now).unionByName(_stamped(page, now)).withColumn("lote", F.lit(batch))
    store.save_result(HISTORY, both, ["client_key", "lote"])
