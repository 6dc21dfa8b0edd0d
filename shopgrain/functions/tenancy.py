"""Per-retailer helpers.

A statistic "of the whole shop" (a mean, a percentile, the last sale day) is
one row per ``client_key``.  It is joined back with :func:`attach`, which
broadcasts that side only when the number of shops is known and the resulting
size is small.  The number of shops travels with the data as metadata of the
``client_key`` column, so it needs neither a job nor global state.  Where it
is unknown the join carries no hint and adaptive execution decides from the
real size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOUND = "max_tenants"
BROADCAST_BYTES = 64 * 1024 * 1024


def mark_tenants(df: DataFrame, max_tenants: int) -> DataFrame:
    """Record on ``client_key`` that the frame holds at most ``max_tenants`` shops."""
    return df.withMetadata("client_key", {_BOUND: int(max_tenants)})


def tenant_column(value: str, max_tenants: int = 1) -> Column:
    return F.lit(value).alias("client_key", metadata={_BOUND: max_tenants})


def tenant_bound(df: DataFrame) -> int | None:
    return df.schema["client_key"].metadata.get(_BOUND) if "client_key" in df.columns else None


def keep_bound(df: DataFrame, like: DataFrame) -> DataFrame:
    """Carry the number of shops over an operator that drops column metadata."""
    bound = tenant_bound(like)
    return df if bound is None else mark_tenants(df, bound)


def hint_small(
    df: DataFrame, rows_per_tenant: int = 1, row_bytes: int = 128
) -> DataFrame:
    """Ask for a broadcast when shops x rows x bytes is known to be small."""
    bound = tenant_bound(df)
    if bound is not None and bound * rows_per_tenant * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def attach(
    df: DataFrame,
    stats: DataFrame,
    on: Sequence[str] = ("client_key",),
    how: str = "inner",
    rows_per_tenant: int = 1,
    row_bytes: int = 128,
) -> DataFrame:
    """Join statistics that have a bounded number of rows per shop."""
    return df.join(hint_small(stats, rows_per_tenant, row_bytes), list(on), how)


def scope(df: DataFrame, client_key: str) -> DataFrame:
    """Rows of one shop; prunes partitions of tables laid out by ``client_key``."""
    return mark_tenants(df.filter(F.col("client_key") == client_key), 1)


def for_every_shop(rows: DataFrame, shops: DataFrame, zeros: Sequence[str]) -> DataFrame:
    """One row per shop of ``shops``; a shop without a row gets zeros."""
    listed = shops.select("client_key").distinct()
    return attach(listed, rows, how="left").fillna(0, list(zeros))
