"""Registered queries against their SQL at the smallest scale.

CHECK_ALL=1 runs every query; the default is one of each family.
"""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import compare, database

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SOME = (
    "home_kpis", "vendas_tendencia_year", "mix_categorias", "comparativo_year", "produtos_abc_sql", "dead_stock",
    "resumo_segmentos_sql", "abc_xyz", "rfm", "elasticidade", "regras", "forecast_categoria", "anomalias_desconto",
    "ins_margem_alta", "relatorio_semanal", "home_kpis_lojas", "abc_lojas", "detect_separator", "filtro_cascata", "ler_insights_home", "period_starts",
    "forecast_resumo", "forecast_resumo_loja", "forecast_por_produto", "save_result", "vendas_resumo", "mascarar_pii_documentos", "etl_ultimas", "anomalias_vendas", "resumo_anomalias", "csv_scan", "upsert_vendas",
)
NAMES = list(QUERIES) if os.environ.get("CHECK_ALL") else [n for n in SOME if n in QUERIES]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    retail = {n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert retail <= set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        message, _ = compare(df, con, SQL[name])
        assert not message, message
    else:
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_date_filter_reaches_the_scan(spark):
    df = QUERIES["vendas_por_dia_month"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in plan.splitlines() if "FileScan" in l and "o_totalprice" in l]
    assert scan and "o_custkey" not in scan[0] and "o_orderdate" in scan[0].split("DataFilters")[1]
