"""All comparison SQL by query name."""

from __future__ import annotations

from shopgrain.plans import (
    oracle_analytics, oracle_ingest, oracle_models, oracle_sales, oracle_shops, oracle_texts,
)


def all_sql() -> dict[str, str]:
    return {
        **oracle_sales.SQL, **oracle_analytics.SQL, **oracle_models.SQL, **oracle_texts.SQL,
        **oracle_ingest.SQL, **oracle_shops.SQL,
    }
