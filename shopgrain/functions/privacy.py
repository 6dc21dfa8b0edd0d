"""Masking of personal data in text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, applied in this order: tax numbers, telephone, e-mail.
PATTERNS = (
    (r"\d{3}\.\d{3}\.\d{3}-\d{2}", "[CPF]"),
    (r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", "[CNPJ]"),
    (r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}", "[TELEFONE]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
)


def mask(col: Column) -> Column:
    for pattern, label in PATTERNS:
        # (?U): digits and blanks of any script, not only ASCII.
        col = F.regexp_replace(col, "(?U)" + pattern, label)
    return col


def mascarar_pii(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mask the given columns, by default every text column; others stay as they are."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = texts if cols is None else texts & set(cols)
    return df.select(*[mask(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])
