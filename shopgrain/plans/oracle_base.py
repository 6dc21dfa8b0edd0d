"""Shared pieces of the comparison SQL: the canonical tables as CTEs.

Written for DuckDB over the driver's views.  Each piece names the pieces it
needs; :func:`sql` puts the required ones in front of a query.
"""

from __future__ import annotations

import re

PIECES: dict[str, str] = {
    "linhas": """
        SELECT CAST(l_orderkey AS VARCHAR) AS venda_key, CAST(l_partkey AS VARCHAR) AS produto_key,
               CAST(l_quantity AS DECIMAL(12,3)) AS quantidade,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS bruto,
               CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2)
                    AS DECIMAL(12,2)) AS desconto,
               l_quantity AS qf
        FROM lineitem""",
    "itens": """
        SELECT 'loja' AS client_key, venda_key, produto_key, quantidade, 'UN' AS unidade,
               CAST(CAST((2 * CAST(bruto * 100 AS BIGINT) + CAST(qf AS BIGINT))
                    // (2 * CAST(qf AS BIGINT)) AS DECIMAL(14,0)) / 100 AS DECIMAL(12,2)) AS preco_unitario,
               desconto, CAST(bruto - desconto AS DECIMAL(12,2)) AS total
        FROM linhas""",
    "vendas": """
        SELECT 'loja' AS client_key, CAST(o_orderkey AS VARCHAR) AS venda_key,
               o_orderdate AS data_venda, CAST(o_custkey AS VARCHAR) AS cliente_key,
               'VEN' || (o_orderkey % 7) AS vendedor_id,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total,
               CASE WHEN o_orderstatus IN ('F','O') THEN 'concluida' ELSE 'pendente' END AS status,
               CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'telefone' ELSE 'balcao' END AS canal
        FROM orders""",
    "vendas_desc": """
        SELECT v.*, CAST(coalesce(d.desconto, 0) AS DECIMAL(12,2)) AS desconto
        FROM vendas v LEFT JOIN (SELECT venda_key, sum(desconto) AS desconto FROM linhas GROUP BY 1) d
        USING (venda_key)""",
    "itens_ok": """
        SELECT i.*, v.data_venda, v.cliente_key FROM itens i
        JOIN vendas v USING (venda_key) WHERE v.status = 'concluida'""",
    "produtos": """
        SELECT 'loja' AS client_key, CAST(p_partkey AS VARCHAR) AS produto_key, p_name AS nome,
               p_brand AS categoria, p_type AS subcategoria, 'UN' AS unidade,
               CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * 0.7, 2) AS DECIMAL(12,2)) AS preco_custo,
               CAST(p_retailprice AS DECIMAL(12,2)) AS preco_venda, TRUE AS ativo
        FROM part""",
    "clientes": """
        SELECT 'loja' AS client_key, CAST(c_custkey AS VARCHAR) AS cliente_key, c_name AS nome,
               c_mktsegment AS tipo, n_name AS cidade, r_name AS bairro, c_acctbal >= 0 AS ativo
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "estoque": """
        SELECT 'loja' AS client_key, CAST(p_partkey AS VARCHAR) AS produto_key,
               CAST((p_partkey * 37) % 200 AS DECIMAL(12,3)) AS quantidade,
               CAST(p_size AS DECIMAL(12,3)) AS quantidade_min
        FROM part""",
    "eventos": """
        SELECT 'loja' AS client_key, CAST(event_id AS VARCHAR) AS venda_key, ts AS data_venda,
               CAST(user_id AS VARCHAR) AS cliente_key, 'VEN' || (event_id % 7) AS vendedor_id,
               CAST(value AS DECIMAL(12,2)) AS total, CAST(0 AS DECIMAL(12,2)) AS desconto,
               'concluida' AS status
        FROM events WHERE event_type = 'purchase'""",
    "logs": """
        SELECT 'loja_' || (user_id % 25) AS client_key, 'csv' AS connector_type,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               CAST(floor(value) AS BIGINT) AS records_read,
               CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS records_written,
               CASE WHEN event_type = 'error' THEN props END AS error_message,
               ts AS started_at, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS finished_at
        FROM events""",
    "lojas": """
        SELECT 'loja_' || n_nationkey AS client_key, n_name AS name, 'construcao' AS segment,
               'csv' AS erp_type, n_regionkey <> 0 AS active
        FROM nation""",
    "hoje": "SELECT max(o_orderdate) AS d FROM orders",
    "hoje_ev": "SELECT max(data_venda) AS d FROM eventos",
}

_WORD = re.compile(r"[a-z_0-9]+")


def _needs(text: str, seen: list[str]) -> None:
    words = set(_WORD.findall(text))
    for name, body in PIECES.items():
        if name in words and name not in seen:
            _needs(body, seen)
            if name not in seen:
                seen.append(name)


def sql(body: str) -> str:
    """``body`` with the CTEs it mentions; ``body`` may start with its own WITH."""
    needed: list[str] = []
    _needs(body, needed)
    ctes = ",\n".join(f"{n} AS ({PIECES[n].strip()})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
