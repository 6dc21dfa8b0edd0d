"""Registered queries for reading, normalising, merging and storing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.tenancy import scope, tenant_column
from shopgrain.operators import load, normalize
from shopgrain.operators.insights import COLUMNS
from shopgrain.operators.publish import CACHE, publicar_insights
from shopgrain.schema import MONEY
from shopgrain.sources import csv_files, raw_exports
from shopgrain.sources.driver_tables import SHOP, DriverShop
from shopgrain.sources.shared import shared_dir
from shopgrain.sources.tables import TableStore
from shopgrain.streaming.sync import incremental_sync

NOW = datetime(2024, 1, 1, 12, 0, 0)
#: Blocks that the scan of quoted lines is cut into at most, files of less than a block aside.
MOST_BLOCKS = 256


def fresh_dir(s: DriverShop) -> str:
    return f"{shared_dir(s.spark).rstrip('/')}/shopgrain-{uuid.uuid4().hex}"


def fresh_store(s: DriverShop) -> TableStore:
    return TableStore(s.spark, fresh_dir(s))


def _good(df: DataFrame) -> DataFrame:
    return df.drop("_file", "_line", "atributos")


def _rejects(df: DataFrame) -> DataFrame:
    return df.select("client_key", "_line", "_reason")


def export(df: DataFrame, path: str, sep: str = ";") -> None:
    """Write text rows as a CSV export."""
    rows = df.drop("client_key", "_line")
    rows.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def csv_roundtrip(s: DriverShop) -> DataFrame:
    path = fresh_dir(s)
    export(raw_exports.raw_vendas(s), path)
    return csv_files.csv_scan(s.spark, path).drop("_file", "_line")


def border_block(total: int) -> int:
    """Bytes of a block for files of ``total`` bytes: 64 kB, or more where that gives over MOST_BLOCKS blocks."""
    return max(64 * 1024, -(-total // MOST_BLOCKS))


def csv_quoted_lines(s: DriverShop) -> DataFrame:
    """Orders with notes over several lines, read in blocks so small that many records lie on a border of two.

    Each block is a task of every pass, so their number stays bounded.
    """
    key = F.col("o_orderkey")
    note = F.concat("o_orderpriority", F.element_at(F.array(
        F.lit(""), F.lit('\nsaiu "hoje"; ok'), F.lit("\n\nfim"), F.lit("; a\n;b\n\"c\""), F.lit(' "x"'),
    ), (key % 5 + 1).cast("int")))
    path = fresh_dir(s)
    s.table("orders").select(key.cast("string").alias("numero"), note.alias("nota"), "o_orderstatus").write.option(
        "header", True).option("sep", ";").option("escape", '"').csv(path)
    old = s.spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Lengths come with the list of files; no content is read.
    total = s.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    s.spark.conf.set("spark.sql.files.maxPartitionBytes", str(border_block(total)))
    try:
        return csv_files.csv_scan(s.spark, path).drop("_file", "_line")
    finally:
        s.spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def upsert_sales(s: DriverShop) -> DataFrame:
    """Pending orders come again finished, twice; event purchases are new sales."""
    current = s.vendas
    pending = current.filter(F.col("status") == "pendente").withColumn(
        "_line", F.explode(F.array(F.lit(1), F.lit(2)))
    ).withColumn("status", F.lit("concluida")).withColumn(
        "total", (F.col("total") + F.col("_line")).cast(MONEY)
    )
    new = s.vendas_por_evento.select(
        "client_key", F.concat(F.lit("ev"), "venda_key").alias("venda_key"), "data_venda",
        F.concat(F.lit("u"), "cliente_key").alias("cliente_key"), "vendedor_id", "total", "status",
        F.lit("telefone").alias("canal"), F.lit(1).alias("_line"),
    )
    return load.upsert_vendas(current, pending.unionByName(new), s.clientes)


def upsert_products(s: DriverShop) -> DataFrame:
    """Economy products come again at a new price."""
    current = s.produtos.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    raised = s.produtos.filter(F.col("subcategoria") == "ECONOMY").withColumn(
        "preco_venda", (F.col("preco_venda") + 1).cast(MONEY)
    ).withColumn("_line", F.lit(1))
    return load.upsert_produtos(current, raised, NOW)


def upsert_customers(s: DriverShop) -> DataFrame:
    """Inactive customers come back; suppliers become customers, listed twice."""
    none = F.lit(None).cast("string")
    current = s.clientes.select(
        "*", F.concat(F.lit("D"), "cliente_key").alias("documento"), none.alias("telefone"),
        none.alias("cep"), F.lit("{}").alias("atributos"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    back = current.filter(~F.col("ativo")).select(
        "client_key", "cliente_key", F.concat("nome", F.lit(" (novo)")).alias("nome"), "tipo",
        "cidade", "bairro", F.lit(True).alias("ativo"), F.lit("X").alias("documento"), "telefone",
        "cep", "atributos", F.lit(1).alias("_line"),
    )
    twice = s.table("supplier").select(
        tenant_column(SHOP), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("cliente_key"),
        F.col("s_name").alias("nome"), F.lit("fornecedor").alias("tipo"), none.alias("cidade"),
        none.alias("bairro"), F.lit(True).alias("ativo"), none.alias("telefone"),
        none.alias("cep"), F.lit("{}").alias("atributos"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("_line"),
    ).withColumn("documento", F.concat(F.lit("doc"), F.col("_line").cast("string"))).withColumn(
        "nome", F.concat("nome", F.lit(" "), F.col("_line").cast("string"))
    )
    return load.upsert_clientes(current, back.unionByName(twice), NOW).drop("atributos")


def replace_items(s: DriverShop) -> DataFrame:
    """Items of pending sales come again without discount; event items have no sale."""
    waiting = s.vendas.filter(F.col("status") == "pendente").select("client_key", "venda_key")
    again = s.itens.join(waiting, ["client_key", "venda_key"], "left_semi").withColumn(
        "total", (F.col("total") + F.col("desconto")).cast(MONEY)
    ).withColumn("desconto", F.lit(0).cast(MONEY))
    orphans = s.vendas_por_evento.select(
        "client_key", F.concat(F.lit("ev"), "venda_key").alias("venda_key"),
        F.lit("0").alias("produto_key"), F.lit(1).cast("decimal(12,3)").alias("quantidade"),
        F.lit("UN").alias("unidade"), F.col("total").alias("preco_unitario"), "desconto", "total",
    )
    return load.load_itens(s.itens, again.unionByName(orphans), s.vendas)


def run_log(s: DriverShop) -> DataFrame:
    raw = raw_exports.raw_vendas(s)
    return load.etl_run_log(raw, normalize.normalize_vendas(raw)[0], NOW, NOW)


def sync(s: DriverShop) -> DataFrame:
    """Exports of customers and sales pulled by the stream, read back from the table."""
    root = fresh_dir(s)
    export(raw_exports.raw_clientes(s), f"{root}/inbox/{SHOP}/clientes", ",")
    export(raw_exports.raw_vendas(s), f"{root}/inbox/{SHOP}/vendas")
    store = TableStore(s.spark, f"{root}/tables")
    incremental_sync(s.spark, f"{root}/inbox", store, f"{root}/checkpoint").awaitTermination()
    return store.read("vendas").drop("atributos", "mes")


def saved_result(s: DriverShop, result: DataFrame) -> DataFrame:
    store = fresh_store(s)
    # The first result of a quiet algorithm is empty.
    store.save_result("resultado", result.limit(0))
    store.save_result("resultado", store.load_result("resultado").unionByName(result))
    # An empty result leaves what is there.
    store.save_result("resultado", result.limit(0))
    return store.load_result("resultado")


def cached_top(s: DriverShop, rules: DataFrame) -> DataFrame:
    store = fresh_store(s)
    store.publish_cache(
        "basket_cache", rules, 50, F.desc("lift"), F.asc("antecedents"), F.asc("consequents")
    )
    return store.read("basket_cache")


def erased(s: DriverShop) -> DataFrame:
    """Pull logs after one shop left."""
    store = fresh_store(s)
    store.save_result("etl_logs", s.etl_logs)
    store.erase_tenant("loja_3")
    return store.read("etl_logs").groupBy("client_key").agg(F.count(F.lit(1)).alias("execucoes"))


def published(s: DriverShop, home: DataFrame, page: DataFrame) -> DataFrame:
    store = fresh_store(s)
    publicar_insights(store, home, page, NOW)
    return store.read(CACHE).select("client_key", *COLUMNS, "gerado_em", "top3")


def separators(s: DriverShop) -> DataFrame:
    """Exports of three entities, and the separator and header found in them."""
    root = fresh_dir(s)
    for name, rows, sep in (
        ("clientes", raw_exports.raw_clientes(s), ","), ("vendas", raw_exports.raw_vendas(s), ";"),
        ("produtos", raw_exports.raw_produtos(s), "\t"),
    ):
        export(rows, f"{root}/{name}", sep)
    heads = csv_files.file_heads(s.spark, [f"{root}/{n}" for n in ("clientes", "vendas", "produtos")])
    return heads.select(
        F.element_at(F.split("path", "/"), -2).alias("entidade"), "sep", "header"
    ).distinct()


INGEST = {
    "detect_separator": separators,
    "csv_scan": csv_roundtrip,
    "csv_scan_quebras": csv_quoted_lines,
    "normalize_vendas": lambda s: _good(normalize.normalize_vendas(raw_exports.raw_vendas(s))[0]),
    "reject_log_vendas": lambda s: _rejects(
        normalize.normalize_vendas(raw_exports.raw_vendas(s))[1]
    ),
    "normalize_itens": lambda s: _good(normalize.normalize_itens(raw_exports.raw_itens(s))[0]),
    "reject_log_itens": lambda s: _rejects(
        normalize.normalize_itens(raw_exports.raw_itens(s))[1]
    ),
    "normalize_produtos": lambda s: _good(
        normalize.normalize_produtos(raw_exports.raw_produtos(s))[0]
    ),
    "normalize_clientes": lambda s: _good(
        normalize.normalize_clientes(raw_exports.raw_clientes(s))
    ),
    "upsert_vendas": upsert_sales,
    "upsert_produtos": upsert_products,
    "upsert_clientes": upsert_customers,
    "load_itens": replace_items,
    "etl_run_log": run_log,
    "incremental_sync": sync,
    "erase_tenant": erased,
    "tenant_scope": lambda s: scope(s.etl_logs, "loja_3"),
}
