import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture
def make(spark):
    """Build small canonical frames from plain rows."""
    def vendas(rows):
        """(shop, sale, moment, customer, seller, total, discount[, status])"""
        full = [
            (r[0], r[1], ts(r[2]), r[3], r[4], str(r[5]), str(r[6]), r[7] if len(r) > 7 else "concluida")
            for r in rows
        ]
        df = spark.createDataFrame(
            full, "client_key string, venda_key string, data_venda timestamp_ntz, cliente_key string, "
            "vendedor_id string, total string, desconto string, status string",
        )
        return df.withColumn("total", df.total.cast("decimal(12,2)")).withColumn(
            "desconto", df.desconto.cast("decimal(12,2)")
        )

    def itens(rows):
        """(shop, sale, product, quantity, price, discount, total[, moment])"""
        full = [
            (r[0], r[1], r[2], str(r[3]), str(r[4]), str(r[5]), str(r[6]), ts(r[7]) if len(r) > 7 else None)
            for r in rows
        ]
        df = spark.createDataFrame(
            full, "client_key string, venda_key string, produto_key string, quantidade string, "
            "preco_unitario string, desconto string, total string, data_venda timestamp_ntz",
        )
        for c, t in (("quantidade", "decimal(12,3)"), ("preco_unitario", "decimal(12,2)"),
                     ("desconto", "decimal(12,2)"), ("total", "decimal(12,2)")):
            df = df.withColumn(c, df[c].cast(t))
        return df

    def produtos(rows):
        """(shop, product, name, category, cost, price)"""
        df = spark.createDataFrame(
            [(*r[:4], str(r[4]), str(r[5]), True) for r in rows],
            "client_key string, produto_key string, nome string, categoria string, preco_custo string, "
            "preco_venda string, ativo boolean",
        )
        for c in ("preco_custo", "preco_venda"):
            df = df.withColumn(c, df[c].cast("decimal(12,2)"))
        return df.withColumn("subcategoria", df.categoria)

    class Make:
        pass

    m = Make()
    m.vendas, m.itens, m.produtos = vendas, itens, produtos
    return m
