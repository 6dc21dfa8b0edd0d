"""Merging canonical rows into the tables held so far.

All merges are DataFrame to DataFrame.  ``incoming`` may hold a key several
times; ``_line`` (and ``_file``) tell which row came last.  Duplicates are
settled by an aggregate, which combines on the map side, so one key that fills
a third of a batch does not end up in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = ("_file", "_line")


def _order(df: DataFrame) -> Column:
    have = [F.col(c) for c in _PLACE if c in df.columns]
    return F.struct(*have) if have else F.struct(F.lit(0))


def _last_rows(incoming: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in incoming.columns if c not in keys and c not in _PLACE]
    last = F.max_by(F.struct(*rest), _order(incoming))
    return incoming.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")


def _replace(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows win; current rows with other keys stay.

    The anti join needs the fresh keys only, so a small batch is broadcast at
    run time and the large table is not shuffled.
    """
    kept = current.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def upsert_vendas(current: DataFrame, incoming: DataFrame, clientes: DataFrame) -> DataFrame:
    """Replace sales by key; an unknown customer becomes null."""
    keys = ["client_key", "venda_key"]
    known = clientes.select("client_key", F.col("cliente_key").alias("_customer"), F.lit(True).alias("_known"))
    # Sales without a customer, often most of them, would be one key of the join; under a key of their own, which no
    # customer has, they are dealt evenly.
    own = F.concat(F.lit("\0"), F.col("venda_key"))
    last = _last_rows(incoming, keys).withColumn("_customer", F.coalesce("cliente_key", own))
    fresh = last.join(known, ["client_key", "_customer"], "left").withColumn(
        "cliente_key", F.when(F.col("_known"), F.col("cliente_key"))
    )
    return _replace(current, fresh, keys)


def upsert_produtos(current: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    keys = ["client_key", "produto_key"]
    fresh = _last_rows(incoming, keys).withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
    return _replace(current, fresh, keys)


# What a repeated customer row may change.
CLIENT_CHANGES = ("nome", "tipo", "cidade", "bairro", "ativo")
CLIENT_KEPT = ("documento", "telefone", "cep", "atributos")


def upsert_clientes(current: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """Replace name, kind, place and state; papers and phone keep their first value."""
    keys = ["client_key", "cliente_key"]
    fresh = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*CLIENT_CHANGES), _order(incoming)).alias("_new"),
        F.min_by(F.struct(*CLIENT_KEPT), _order(incoming)).alias("_firsts"),
    )
    old = current.select(
        *keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old")
    )
    both = old.join(fresh, keys, "full_outer")
    is_new, touched = F.col("_old").isNull(), F.col("_new").isNotNull()

    def value(name: str) -> Column:
        if name in CLIENT_CHANGES:
            return F.when(touched, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))
        if name in CLIENT_KEPT:
            return F.when(is_new, F.col(f"_firsts.{name}")).otherwise(F.col(f"_old.{name}"))
        return F.when(touched, F.lit(now).cast("timestamp_ntz")).otherwise(F.col(f"_old.{name}"))

    return both.select(*[
        F.col(c) if c in keys else value(c).alias(c) for c in current.columns
    ])


def load_itens(current: DataFrame, incoming: DataFrame, vendas: DataFrame) -> DataFrame:
    """Items of known sales; a sale that arrives again replaces its items."""
    keys = ["client_key", "venda_key"]
    fresh = incoming.join(vendas.select(*keys).distinct(), keys, "left_semi")
    return _replace(current, fresh, keys)


def etl_run_log(
    read: DataFrame, written: DataFrame, started_at: datetime, finished_at: datetime,
    connector_type: str = "csv", errors: DataFrame | None = None,
) -> DataFrame:
    """One row per shop of a pull: rows read and written, and the error met.

    ``errors`` has (client_key, error_message) for shops of which a file failed;
    where other files of the shop were written the status is ``partial``.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("client_key").agg(F.count(F.lit(1)).alias(name))

    rows = counted(read, "records_read").join(
        counted(written, "records_written"), "client_key", "left"
    )
    if errors is None:
        rows = rows.withColumn("error_message", F.lit(None).cast("string"))
    else:
        rows = rows.join(errors.select("client_key", "error_message"), "client_key", "full_outer")
    failed = F.col("error_message").isNotNull()
    n_written = F.coalesce("records_written", F.lit(0).cast("bigint"))
    return rows.select(
        "client_key", F.lit(connector_type).alias("connector_type"),
        F.when(failed & (n_written > 0), "partial").when(failed, "error").otherwise("success").alias("status"),
        F.coalesce("records_read", F.lit(0)).alias("records_read"),
        n_written.alias("records_written"),
        "error_message",
        F.lit(started_at).cast("timestamp_ntz").alias("started_at"),
        F.lit(finished_at).cast("timestamp_ntz").alias("finished_at"),
    )
