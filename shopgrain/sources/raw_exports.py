"""The driver's tables written the way shop systems export them: as text.

Headers differ from the canonical names, dates come in four layouts and money
in three, some ids and dates are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.numbers import fmt_brl
from shopgrain.functions.tenancy import tenant_column
from shopgrain.schema import MONEY
from shopgrain.sources.driver_tables import SHOP, DriverShop


def _pick(by: Column, *options: Column) -> Column:
    last = options[-1]
    rest = list(enumerate(options[:-1]))
    return reduce(lambda acc, o: F.when(by == o[0], o[1]).otherwise(acc), reversed(rest), last)


def _money_text(by: Column, amount: Column) -> Column:
    plain = amount.cast("string")
    return _pick(F.pmod(by, F.lit(3)), fmt_brl(amount), F.translate(plain, ".", ","), plain)


def raw_vendas(shop: DriverShop) -> DataFrame:
    key, moment = F.col("o_orderkey"), F.col("o_orderdate")
    no_id = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "F")
    no_date = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O")
    text = _pick(F.pmod(key, F.lit(4)), *[
        F.date_format(moment, f)
        for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ])
    return shop.table("orders").select(
        tenant_column(SHOP),
        F.when(no_id, "").otherwise(key.cast("string")).alias("numero"),
        F.when(no_date, "sem data").otherwise(text).alias("dt_venda"),
        F.col("o_custkey").cast("string").alias("id_cliente"),
        F.lit("").alias("vendedor"),
        F.concat(F.lit("VEN"), F.pmod(key, F.lit(7)).cast("string")).alias("codigo_vendedor"),
        _money_text(key, F.col("o_totalprice").cast(MONEY)).alias("valor_total"),
        F.when(F.col("o_orderstatus") == "P", "pendente").otherwise("").alias("situacao"),
        (key + 1).alias("_line"),
    )


def raw_itens(shop: DriverShop) -> DataFrame:
    """Items without a total; returned ones lost their product."""
    price = F.col("l_extendedprice").cast(MONEY)
    return shop.table("lineitem").select(
        tenant_column(SHOP),
        F.col("l_orderkey").cast("string").alias("numero_venda"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(
            F.col("l_partkey").cast("string")
        ).alias("sku"),
        F.lit("1").alias("qtd"),
        _money_text(F.col("l_linenumber"), price).alias("valor_unitario"),
        F.lit("R$ 1,50").alias("vl_desconto"),
        F.col("l_linenumber").cast("bigint").alias("_line"),
    )


def raw_produtos(shop: DriverShop) -> DataFrame:
    by = F.col("p_partkey")
    return shop.table("part").select(
        tenant_column(SHOP),
        by.cast("string").alias("codigo"),
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_name")).alias("descricao"),
        F.col("p_brand").alias("grupo"),
        F.lit("").alias("unidade"),
        _money_text(by, F.col("p_retailprice").cast(MONEY)).alias("preco"),
        _pick(F.pmod(by, F.lit(3)), F.lit("SIM"), F.lit("ativo"), F.lit("nao")).alias("situacao"),
    )


def raw_clientes(shop: DriverShop) -> DataFrame:
    idle = F.col("c_acctbal") < 0
    return shop.table("customer").select(
        tenant_column(SHOP),
        F.col("c_custkey").cast("string").alias("codigo"),
        F.col("c_name").alias("razao_social"),
        F.col("c_mktsegment").alias("perfil"),
        F.when(idle, "").otherwise(F.lit("s")).alias("active"),
    )
