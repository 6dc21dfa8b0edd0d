"""Standard reads of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.periods import sale_keys
from shopgrain.schema import DONE


def read_vendas(vendas: DataFrame, ordered: bool = True) -> DataFrame:
    """Finished sales, by date unless the reader needs no order."""
    rows = (
        vendas.filter(F.col("status") == DONE)
        .select(
            "client_key", "venda_key", "data_venda", "cliente_key", "vendedor_id", "total",
            "desconto", "status",
        )
    )
    return rows.orderBy("client_key", "data_venda") if ordered else rows


def read_itens_venda(itens: DataFrame, vendas: DataFrame) -> DataFrame:
    """Items of finished sales with the date and customer of the sale.

    Tables bucketed on (client_key, venda_key) join here without a shuffle.
    """
    keys = sale_keys(itens, vendas)
    done = vendas.filter(F.col("status") == DONE).select(*keys, "data_venda", "cliente_key")
    return itens.select(
        *keys, "produto_key", "quantidade", "total", "preco_unitario", "desconto",
    ).join(done, keys).drop("mes")


def read_clientes_ativos(clientes: DataFrame) -> DataFrame:
    return clientes.filter("ativo").select(
        "client_key", "cliente_key", "nome", "tipo", "cidade", "bairro"
    )


def read_produtos_ativos(produtos: DataFrame) -> DataFrame:
    return produtos.filter("ativo").select(
        "client_key", "produto_key", "nome", "categoria", "subcategoria", "preco_custo",
        "preco_venda",
    )
