"""State of the data pulls: counts of the last day, recent runs, active shops."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.periods import hours_before, seconds_between


def _last_day(logs: DataFrame, now: datetime | Column | None) -> DataFrame:
    """Runs started in the 24 hours before ``now``, by default the latest start."""
    if now is None:
        start = logs.agg(hours_before(F.max("started_at"), 24)).scalar()
    else:
        start = hours_before(now if isinstance(now, Column) else F.lit(now), 24)
    return logs.filter(F.col("started_at") >= start)


def etl_execucoes_24h(logs: DataFrame, now=None) -> DataFrame:
    return _last_day(logs, now).agg(F.count(F.lit(1)).alias("value"))


def etl_erros_24h(logs: DataFrame, now=None) -> DataFrame:
    """Runs that failed, in whole or for some files."""
    return _last_day(logs, now).filter(F.col("status").isin("error", "partial")).agg(
        F.count(F.lit(1)).alias("value")
    )


def etl_duracao_media(logs: DataFrame, now=None) -> DataFrame:
    """Mean seconds of the successful runs, as a whole number."""
    took = seconds_between(F.col("finished_at"), F.col("started_at"))
    return _last_day(logs, now).filter(F.col("status") == "success").agg(
        F.round(F.avg(took), 0).cast("bigint").alias("value")
    )


def etl_ultimas(logs: DataFrame, clients: DataFrame, n: int = 50) -> DataFrame:
    """Latest runs of registered shops."""
    return (
        logs.join(clients.select("client_key"), "client_key", "left_semi")
        .select(
            "client_key", "connector_type", "status", "records_read", "records_written",
            "error_message", "started_at", "finished_at",
        )
        .orderBy(F.desc("started_at"), "client_key", "status", "records_read")
        .limit(n)
    )


def clientes_ativos(clients: DataFrame, client_key: str | None = None) -> DataFrame:
    """Active shops by name, or the one with the given key."""
    rows = clients.filter("active")
    if client_key is not None:
        rows = rows.filter(F.col("client_key") == client_key)
    return rows.select("client_key", "name", "segment", "erp_type", "active").orderBy("name")
