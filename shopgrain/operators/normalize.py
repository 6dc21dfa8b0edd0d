"""Raw export rows to canonical tables, with a reject log.

Column names are matched through alias lists.  Each function takes text rows
as ``csv_scan`` returns them; the shop is either a given key or a
``client_key`` column of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.parsing import (
    first_non_empty, parse_bool_br, parse_date_multi, parse_decimal_exact,
)
from shopgrain.functions.tenancy import tenant_column
from shopgrain.schema import MONEY, QUANTITY

# Accepted column names per field, in order of preference.
VENDA = {
    "venda_key": (
        "id", "codigo", "numero", "num_venda", "id_venda", "codigo_venda", "nf", "numero_nf",
    ),
    "data_venda": (
        "data", "data_venda", "dt_venda", "data_emissao", "dt_emissao", "created_at", "date",
    ),
    "cliente_key": ("cliente", "id_cliente", "codigo_cliente", "customer_id"),
    "vendedor_id": ("vendedor", "id_vendedor", "codigo_vendedor", "seller_id"),
    "total": ("total", "valor_total", "vl_total", "total_venda"),
    "desconto": ("desconto", "vl_desconto", "discount"),
    "status": ("status", "situacao", "status_venda"),
    "canal": ("canal", "origem", "channel"),
}
ITEM = {
    "venda_key": ("venda_id", "id_venda", "venda_key", "numero_venda"),
    "produto_key": ("produto_key", "produto_id", "codigo_produto", "sku"),
    "descricao": ("descricao", "nome", "description", "produto"),
    "quantidade": ("quantidade", "qtd", "qty"),
    "unidade": ("unidade", "un", "unit"),
    "preco_unitario": ("preco_unitario", "preco", "valor_unitario", "unit_price"),
    "desconto": ("desconto", "vl_desconto", "discount"),
    "total": ("total", "valor_total", "vl_total"),
}
PRODUTO = {
    "produto_key": (
        "id", "codigo", "sku", "produto_id", "id_produto", "codigo_produto", "product_id",
    ),
    "nome": ("nome", "descricao", "name", "produto", "description"),
    "categoria": ("categoria", "grupo", "category", "grupo_produto"),
    "subcategoria": ("subcategoria", "subgrupo", "subcategory"),
    "unidade": ("unidade", "un", "unit", "unidade_medida"),
    "preco_custo": ("custo", "preco_custo", "vl_custo", "cost"),
    "preco_venda": ("preco", "preco_venda", "vl_venda", "price"),
    "ativo": ("ativo", "active", "status", "situacao"),
}
CLIENTE = {
    "cliente_key": ("id", "codigo", "cliente_id", "id_cliente"),
    "nome": ("nome", "name", "razao_social"),
    "tipo": ("tipo", "type", "perfil"),
    "documento": ("documento", "cpf", "cnpj"),
    "telefone": ("telefone", "fone", "phone"),
    "cidade": ("cidade", "city"),
    "bairro": ("bairro", "district"),
    "cep": ("cep", "zipcode"),
    "ativo": ("ativo", "active", "status"),
}
NO_SALE_ID = "ID da venda não encontrado"
NO_PRODUCT_ID = "ID do produto não encontrado"
TOO_LARGE = "valor fora do limite"


def _shop(raw: DataFrame, client_key: str | None) -> Column:
    return F.col("client_key") if client_key is None else tenant_column(client_key)


def _pick(raw: DataFrame, fields: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    return {name: first_non_empty(raw.columns, alias) for name, alias in fields.items()}


def _place(raw: DataFrame) -> list[Column]:
    line = F.col("_line") if "_line" in raw.columns else F.lit(None)
    source = F.col("_file") if "_file" in raw.columns else F.lit(None)
    return [source.cast("string").alias("_file"), line.cast("bigint").alias("_line")]


def _raw_map(raw: DataFrame) -> Column:
    names = [c for c in raw.columns if not c.startswith("_") and c != "client_key"]
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    return F.create_map(*pairs).alias("_raw")


def _or(text: Column, default: str) -> Column:
    return F.when(text == "", F.lit(default)).otherwise(text)


def _blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _money(text: Column) -> Column:
    return F.round(parse_decimal_exact(text), 2).try_cast(MONEY)


def _parsed(raw: DataFrame, client_key: str | None, **fields: Column) -> DataFrame:
    """Parse every field once.

    Spark copies a filter's inputs below the projection that computes them,
    which would parse each text several times.  The running id, which the
    filter in ``_split`` reads, keeps the parsing in one place.
    """
    return raw.select(
        _shop(raw, client_key), *[c.alias(n) for n, c in fields.items()], *_place(raw),
        _raw_map(raw), F.monotonically_increasing_id().alias("_seq"),
    )


def _split(rows: DataFrame, why: Column, columns: list) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason to refuse them, and the refused ones."""
    good = rows.filter(why.isNull() & (F.col("_seq") >= 0)).select(
        "client_key", *columns, "_file", "_line"
    )
    bad = rows.filter(why.isNotNull() & (F.col("_seq") >= 0)).select(
        "client_key", "_file", "_line",
        F.concat(F.lit("linha "), F.col("_line").cast("string"), F.lit(": "), why).alias(
            "_reason"
        ),
        "_raw",
    )
    return good, bad


def normalize_vendas(
    raw: DataFrame, client_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sales and the rows refused for a missing id or a date no layout fits."""
    f = _pick(raw, VENDA)
    rows = _parsed(
        raw, client_key, venda_key=f["venda_key"], _date=f["data_venda"],
        data_venda=parse_date_multi(f["data_venda"]), cliente_key=_blank(f["cliente_key"]),
        vendedor_id=_blank(f["vendedor_id"]), total=_money(f["total"]),
        desconto=_money(f["desconto"]), status=_or(f["status"], "concluida"),
        canal=_or(f["canal"], "balcao"), atributos=F.lit("{}"),
    )
    bad_date = F.concat(F.lit("data inválida '"), "_date", F.lit("'"))
    why = (
        F.when(F.col("venda_key") == "", F.lit(NO_SALE_ID))
        .when(F.col("data_venda").isNull(), bad_date)
        .when(F.col("total").isNull() | F.col("desconto").isNull(), F.lit(TOO_LARGE))
    )
    return _split(rows, why, [
        "venda_key", "data_venda", "cliente_key", "vendedor_id", "total", "desconto", "status",
        "canal", "atributos",
    ])


def normalize_itens(
    raw: DataFrame, client_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sale items; a missing total is quantity x price less discount."""
    f = _pick(raw, ITEM)
    amounts = ("quantidade", "preco_unitario", "desconto", "total")
    rows = _parsed(
        raw, client_key, venda_key=f["venda_key"], produto_key=f["produto_key"],
        descricao=f["descricao"], unidade=_or(f["unidade"], "UN"), atributos=F.lit("{}"),
        **{f"_{n}": parse_decimal_exact(f[n]).try_cast("decimal(18,6)") for n in amounts},
    )
    qty, price, off, given = (F.col(f"_{n}") for n in amounts)
    total = F.when((given == 0) & (qty > 0) & (price > 0), qty * price - off).otherwise(given)
    sized = rows.select(
        "*", F.round(qty, 3).try_cast(QUANTITY).alias("quantidade"),
        *[
            F.round(c, 2).try_cast(MONEY).alias(n)
            for n, c in (("preco_unitario", price), ("desconto", off), ("total", total))
        ],
    )
    why = (
        F.when(F.col("venda_key") == "", F.lit(NO_SALE_ID))
        .when(F.col("produto_key") == "", F.lit(NO_PRODUCT_ID))
        .when(reduce(or_, [F.col(n).isNull() for n in amounts]), F.lit(TOO_LARGE))
    )
    return _split(sized, why, [
        "venda_key", "produto_key", "descricao", "quantidade", "unidade", "preco_unitario",
        "desconto", "total", "atributos",
    ])


def normalize_produtos(
    raw: DataFrame, client_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Products, and those refused for a price over the limit; a row without a key is dropped."""
    f = _pick(raw, PRODUTO)
    prices = ("preco_custo", "preco_venda")
    rows = _parsed(
        raw.filter(f["produto_key"] != ""), client_key,
        produto_key=f["produto_key"], nome=F.coalesce(_blank(f["nome"]), f["produto_key"]),
        categoria=_blank(f["categoria"]), subcategoria=_blank(f["subcategoria"]),
        unidade=_or(f["unidade"], "UN"), **{n: _money(f[n]) for n in prices},
        ativo=parse_bool_br(f["ativo"]), atributos=F.lit("{}"),
    )
    why = F.when(reduce(or_, [F.col(n).isNull() for n in prices]), F.lit(TOO_LARGE))
    return _split(rows, why, [
        "produto_key", "nome", "categoria", "subcategoria", "unidade", *prices, "ativo", "atributos",
    ])


def normalize_clientes(raw: DataFrame, client_key: str | None = None) -> DataFrame:
    """Customers; a row without a key is dropped."""
    f = _pick(raw, CLIENTE)
    texts = ("tipo", "documento", "telefone", "cidade", "bairro", "cep")
    return raw.filter(f["cliente_key"] != "").select(
        _shop(raw, client_key),
        f["cliente_key"].alias("cliente_key"),
        F.coalesce(_blank(f["nome"]), f["cliente_key"]).alias("nome"),
        *[_blank(f[n]).alias(n) for n in texts],
        parse_bool_br(f["ativo"]).alias("ativo"),
        F.lit("{}").alias("atributos"), *_place(raw),
    )
