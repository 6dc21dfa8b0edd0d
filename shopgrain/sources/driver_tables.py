"""Canonical shop tables derived from the TPC-H-like parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.functions.tenancy import tenant_column
from shopgrain.schema import MONEY, QUANTITY

SHOP = "loja"


def _money(col: str) -> Column:
    return F.col(col).cast(MONEY)


def _line_discount() -> Column:
    rate = F.col("l_discount").cast("decimal(4,2)")
    return F.round(_money("l_extendedprice") * rate, 2).cast(MONEY)


class DriverShop:
    """The driver's tables seen as one shop's data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def vendas(self) -> DataFrame:
        """Sales without the discount, which needs a pass over the items."""
        return self.table("orders").select(
            tenant_column(SHOP),
            F.col("o_orderkey").cast("string").alias("venda_key"),
            F.col("o_orderdate").alias("data_venda"),
            F.col("o_custkey").cast("string").alias("cliente_key"),
            F.concat(F.lit("VEN"), F.pmod("o_orderkey", F.lit(7)).cast("string")).alias(
                "vendedor_id"
            ),
            _money("o_totalprice").alias("total"),
            F.when(F.col("o_orderstatus").isin("F", "O"), F.lit("concluida"))
            .otherwise(F.lit("pendente")).alias("status"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("telefone"))
            .otherwise(F.lit("balcao")).alias("canal"),
        )

    @cached_property
    def vendas_com_desconto(self) -> DataFrame:
        per_order = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").cast("string").alias("venda_key"))
            .agg(F.sum(_line_discount()).cast(MONEY).alias("desconto"))
        )
        return self.vendas.join(per_order, "venda_key", "left").select(
            *self.vendas.columns,
            F.coalesce("desconto", F.lit(0)).cast(MONEY).alias("desconto"),
        )

    @cached_property
    def itens(self) -> DataFrame:
        price = _money("l_extendedprice")
        return self.table("lineitem").select(
            tenant_column(SHOP),
            F.col("l_orderkey").cast("string").alias("venda_key"),
            F.col("l_partkey").cast("string").alias("produto_key"),
            F.col("l_quantity").cast(QUANTITY).alias("quantidade"),
            F.lit("UN").alias("unidade"),
            F.round(price / F.col("l_quantity").cast("decimal(12,0)"), 2).cast(MONEY).alias(
                "preco_unitario"
            ),
            _line_discount().alias("desconto"),
            (price - _line_discount()).cast(MONEY).alias("total"),
        )

    @cached_property
    def produtos(self) -> DataFrame:
        price = _money("p_retailprice")
        return self.table("part").select(
            tenant_column(SHOP),
            F.col("p_partkey").cast("string").alias("produto_key"),
            F.col("p_name").alias("nome"),
            F.col("p_brand").alias("categoria"),
            F.col("p_type").alias("subcategoria"),
            F.lit("UN").alias("unidade"),
            F.round(price * F.lit(0.7).cast("decimal(2,1)"), 2).cast(MONEY).alias("preco_custo"),
            price.alias("preco_venda"),
            F.lit(True).alias("ativo"),
        )

    @cached_property
    def clientes(self) -> DataFrame:
        place = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.table("customer")
            .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                tenant_column(SHOP),
                F.col("c_custkey").cast("string").alias("cliente_key"),
                F.col("c_name").alias("nome"),
                F.col("c_mktsegment").alias("tipo"),
                F.col("n_name").alias("cidade"),
                F.col("r_name").alias("bairro"),
                (F.col("c_acctbal") >= 0).alias("ativo"),
            )
        )

    @cached_property
    def estoque(self) -> DataFrame:
        return self.table("part").select(
            tenant_column(SHOP),
            F.col("p_partkey").cast("string").alias("produto_key"),
            F.pmod(F.col("p_partkey") * 37, F.lit(200)).cast(QUANTITY).alias("quantidade"),
            F.col("p_size").cast(QUANTITY).alias("quantidade_min"),
        )

    @cached_property
    def vendas_por_evento(self) -> DataFrame:
        """Purchases of the event stream: sales with a time of day."""
        return self.table("events").filter(F.col("event_type") == "purchase").select(
            tenant_column(SHOP),
            F.col("event_id").cast("string").alias("venda_key"),
            F.col("ts").alias("data_venda"),
            F.col("user_id").cast("string").alias("cliente_key"),
            F.concat(F.lit("VEN"), F.pmod("event_id", F.lit(7)).cast("string")).alias(
                "vendedor_id"
            ),
            _money("value").alias("total"),
            F.lit(0).cast(MONEY).alias("desconto"),
            F.lit("concluida").alias("status"),
        )

    @cached_property
    def etl_logs(self) -> DataFrame:
        """Each event read as one run of a data pull."""
        failed = F.col("event_type") == "error"
        rows = F.floor("value").cast("bigint")
        return self.table("events").select(
            F.concat(F.lit("loja_"), F.pmod("user_id", F.lit(25)).cast("string")).alias(
                "client_key", metadata={"max_tenants": 25}
            ),
            F.lit("csv").alias("connector_type"),
            F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
            rows.alias("records_read"),
            F.when(failed, F.lit(0)).otherwise(rows).cast("bigint").alias("records_written"),
            F.when(failed, F.col("props")).alias("error_message"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias(
                "finished_at"
            ),
        )

    @cached_property
    def clients(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("loja_"), F.col("n_nationkey").cast("string")).alias(
                "client_key", metadata={"max_tenants": 25}
            ),
            F.col("n_name").alias("name"),
            F.lit("construcao").alias("segment"),
            F.lit("csv").alias("erp_type"),
            (F.col("n_regionkey") != 0).alias("active"),
        )


class DriverShops(DriverShop):
    """The same sales dealt to shops by the customer's nation.

    About half of all sales belong to one shop, and one shop has no finished
    sale.  The number of shops is not carried along, as for tables read back
    from storage.
    """

    def _dealt(self, sales: DataFrame) -> DataFrame:
        nation = F.col("c_nationkey")
        where = self.table("customer").select(F.col("c_custkey").cast("string").alias("cliente_key"), "c_nationkey")
        shop = F.when(nation.isNull() | (nation < 12), "loja_0").otherwise(
            F.concat(F.lit("loja_"), nation.cast("string"))
        )
        status = F.when(nation == 24, "pendente").otherwise(F.col("status"))
        rest = [c for c in sales.columns if c not in ("client_key", "status")]
        return sales.join(where, "cliente_key", "left").select(
            shop.alias("client_key"), *rest, status.alias("status")
        )

    @cached_property
    def vendas(self) -> DataFrame:
        return self._dealt(DriverShop(self.spark, self.path).vendas)

    @cached_property
    def vendas_com_desconto(self) -> DataFrame:
        return self._dealt(DriverShop(self.spark, self.path).vendas_com_desconto)

    @cached_property
    def itens(self) -> DataFrame:
        plain = DriverShop(self.spark, self.path).itens
        return plain.drop("client_key").join(self.vendas.select("client_key", "venda_key"), "venda_key")
