"""Canonical tables, money types and per-segment defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
QUANTITY = T.DecimalType(12, 3)
# Sums of money stay exact: a decimal sum does not depend on the order in
# which partitions arrive, a double sum does.
WIDE_MONEY = T.DecimalType(28, 2)

DONE = "concluida"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


# Moments are UTC wall-clock times without a zone, so no result depends on the
# session time zone.
_S, _B, _TS = T.StringType(), T.BooleanType(), T.TimestampNTZType()

VENDAS = _struct(
    ("client_key", _S, False), ("venda_key", _S, False), ("data_venda", _TS, False),
    ("cliente_key", _S, True), ("vendedor_id", _S, True), ("total", MONEY, False),
    ("desconto", MONEY, False), ("status", _S, True), ("canal", _S, True),
    ("atributos", _S, True),
)

ITENS_VENDA = _struct(
    ("client_key", _S, False), ("venda_key", _S, False), ("produto_key", _S, False),
    ("descricao", _S, False), ("quantidade", QUANTITY, False), ("unidade", _S, True),
    ("preco_unitario", MONEY, False), ("desconto", MONEY, False), ("total", MONEY, False),
    ("atributos", _S, True),
)

PRODUTOS = _struct(
    ("client_key", _S, False), ("produto_key", _S, False), ("nome", _S, False),
    ("categoria", _S, True), ("subcategoria", _S, True), ("unidade", _S, True),
    ("preco_custo", MONEY, True), ("preco_venda", MONEY, True), ("ativo", _B, False),
    ("atributos", _S, True), ("updated_at", _TS, True),
)

CLIENTES = _struct(
    ("client_key", _S, False), ("cliente_key", _S, False), ("nome", _S, False),
    ("tipo", _S, True), ("documento", _S, True), ("telefone", _S, True),
    ("cidade", _S, True), ("bairro", _S, True), ("cep", _S, True), ("ativo", _B, False),
    ("atributos", _S, True), ("updated_at", _TS, True),
)

ESTOQUE = _struct(
    ("client_key", _S, False), ("produto_key", _S, False), ("quantidade", QUANTITY, False),
    ("quantidade_min", QUANTITY, False), ("quantidade_max", QUANTITY, True),
    ("localizacao", _S, True), ("atualizado_em", _TS, True),
)

ETL_LOGS = _struct(
    ("client_key", _S, False), ("connector_type", _S, False), ("status", _S, False),
    ("records_read", T.LongType(), True), ("records_written", T.LongType(), True),
    ("error_message", _S, True), ("started_at", _TS, True), ("finished_at", _TS, True),
)

CLIENTS = _struct(
    ("client_key", _S, False), ("name", _S, False), ("segment", _S, False),
    ("erp_type", _S, False), ("active", _B, False),
)

INSIGHTS = _struct(
    ("client_key", _S, False), ("tipo", _S, False), ("prioridade", T.IntegerType(), False),
    ("titulo", _S, False), ("mensagem", _S, False), ("acao", _S, True), ("href", _S, True),
    ("categoria", _S, True), ("icone", _S, True), ("gerado_em", _TS, True),
)

TABLES = {
    "vendas": VENDAS,
    "itens_venda": ITENS_VENDA,
    "produtos": PRODUTOS,
    "clientes": CLIENTES,
    "estoque": ESTOQUE,
}


@dataclass(frozen=True)
class Segment:
    """Thresholds that depend on the kind of shop."""

    churn_days: int = 45
    abc_a: float = 0.80
    abc_b: float = 0.95


SEGMENTS = {"construcao": Segment(churn_days=45, abc_a=0.80, abc_b=0.95)}
