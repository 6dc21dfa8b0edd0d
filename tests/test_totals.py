"""Sums of items that several operators read, and the passes that queries make."""

import pytest
from pyspark.sql import functions as F

from shopgrain.functions import totals
from shopgrain.operators import abcxyz, forecast, pricing
from shopgrain.plans import ingest_queries, queries
from shopgrain.sources import canonical
from shopgrain.sources.driver_tables import DriverShop


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def items(make):
    rows = []
    for i in range(60):
        day = f"2024-{1 + i % 9:02d}-{1 + i % 27:02d} 10:00:00"
        rows.append(("a" if i % 3 else "b", f"s{i}", f"p{i % 4}", i % 5 + 1, 10 + i % 7, i % 2, 9 + i, day))
    return make.itens(rows + rows[:7])


@pytest.fixture
def produtos(spark):
    return spark.createDataFrame(
        [(s, f"p{i}", f"n{i}", "c", "2.50", "9.00") for s in "ab" for i in range(3)],
        "client_key string, produto_key string, nome string, categoria string, preco_custo string, preco_venda string",
    ).withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("preco_custo", "preco_venda")})


@pytest.mark.parametrize("unit", ["month", "day"])
def test_operators_read_sums_as_items(items, produtos, unit):
    summed = totals.sold(items, unit)
    for build in (
        abcxyz.abc, abcxyz.abc_xyz, abcxyz.xyz, lambda i: pricing.margem(i, produtos),
        lambda i: pricing.elasticidade(i, produtos, 2, 1),
    ):
        assert build(summed).dtypes == build(items).dtypes
        assert _rows(build(summed)) == _rows(build(items))
    if unit == "day":
        assert _rows(forecast.diario(summed)) == _rows(forecast.diario(items))


def test_sums_of_sums(items):
    assert _rows(totals.sold(totals.sold(items, "day"), "product")) == _rows(totals.sold(items, "product"))
    with pytest.raises(ValueError):
        totals.sold(totals.sold(items, "month"), "day")


@pytest.mark.parametrize("name, passes", [
    ("catalog_kpis", 1), ("ins_margem_alta", 1), ("ranking_produtos", 1), ("matriz_preco", 1), ("top3_diverso", 2),
    ("filtro_cascata", 2),
])
def test_items_meet_sales_once_for_all_sums(spark, monkeypatch, name, passes):
    """Frames of items with their sales that a query builds and reads: one for sums, one for baskets."""
    made, summed = [], []
    read, sold = canonical.read_itens_venda, totals.sold
    monkeypatch.setattr(canonical, "read_itens_venda", lambda *a: made.append(read(*a)) or made[-1])
    monkeypatch.setattr(totals, "sold", lambda i, unit: summed.append(totals.unit_of(i)) or sold(i, unit))
    queries.all_queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == passes and summed.count(None) == 1


def test_products_are_named_before_items_meet_sales(spark):
    """Baskets then need no shuffle after the join with the sales."""
    plan = queries._by_category(DriverShop(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[1].lstrip(" :+-").startswith("Join Inner, (venda_key")


def test_blocks_of_quoted_lines_are_bounded():
    block = ingest_queries.border_block
    assert block(0) == block(10_000_000) == 64 * 1024
    for total in (10**8, 25 * 10**8, 10**12):
        assert -(-total // block(total)) <= ingest_queries.MOST_BLOCKS
