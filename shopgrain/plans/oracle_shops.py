"""Comparison SQL for queries over many shops; every statistic is one of the shop."""

from shopgrain.plans.oracle_analytics import r
from shopgrain.plans.oracle_base import PIECES, sql

PIECES.update({
    "m_vendas": """
        SELECT CASE WHEN c_nationkey IS NULL OR c_nationkey < 12 THEN 'loja_0' ELSE 'loja_' || c_nationkey END AS client_key,
               v.* EXCLUDE (client_key) REPLACE (CASE WHEN c_nationkey = 24 THEN 'pendente' ELSE status END AS status)
        FROM vendas_desc v LEFT JOIN customer ON cliente_key = CAST(c_custkey AS VARCHAR)""",
    "m_itens": """
        SELECT v.client_key, i.* EXCLUDE (client_key), v.data_venda, v.status FROM itens i JOIN m_vendas v USING (venda_key)""",
    "m_hoje": "SELECT client_key, max(data_venda) AS d FROM m_vendas GROUP BY 1",
})

SQL = {
    "vendas_resumo_lojas": sql("""
        WITH k AS (SELECT client_key, sum(total) FILTER (WHERE status = 'concluida') AS f,
                   count(*) FILTER (WHERE status = 'concluida') AS n,
                   sum(desconto) FILTER (WHERE status = 'concluida') AS x FROM m_vendas GROUP BY 1)
        SELECT client_key, coalesce(CAST(f AS DOUBLE), 0) AS faturamento, n AS total_vendas,
               coalesce(CAST(f AS DOUBLE) / nullif(n, 0), 0) AS ticket_medio,
               coalesce(CAST(x AS DOUBLE), 0) AS total_desconto FROM k"""),
    "home_kpis_lojas": sql("""
        WITH v AS (SELECT v.* FROM m_vendas v JOIN m_hoje USING (client_key)
                   WHERE status = 'concluida' AND data_venda >= date_trunc('month', d)),
        k AS (SELECT client_key, sum(total) AS f, count(*) AS n FROM v GROUP BY 1),
        q AS (SELECT client_key, sum(quantidade) AS q FROM m_itens
              WHERE venda_key IN (SELECT venda_key FROM v) GROUP BY 1)
        SELECT h.client_key, coalesce(CAST(f AS DOUBLE), 0) AS faturamento,
               coalesce(CAST(f AS DOUBLE) / n, 0) AS ticket_medio, coalesce(n, 0) AS total_vendas,
               coalesce(CAST(q AS DOUBLE) / n, 0) AS itens_por_venda
        FROM m_hoje h LEFT JOIN k USING (client_key) LEFT JOIN q USING (client_key)"""),
    "ranking_vendedores_lojas": sql("""
        WITH v AS (SELECT v.* FROM m_vendas v JOIN m_hoje USING (client_key)
                   WHERE status = 'concluida' AND data_venda >= date_trunc('year', d)),
        q AS (SELECT venda_key, sum(quantidade) AS q FROM itens GROUP BY 1)
        SELECT client_key, vendedor_id AS id, vendedor_id AS nome, count(*) AS vendas,
               CAST(sum(total) AS DOUBLE) AS faturamento, CAST(sum(total) AS DOUBLE) / count(*) AS ticket,
               coalesce(CAST(sum(q) AS DOUBLE) / count(*), 0) AS upa,
               CAST(sum(desconto) AS DOUBLE) / CAST(sum(total) + sum(desconto) AS DOUBLE) * 100.0 AS desconto
        FROM v LEFT JOIN q USING (venda_key) GROUP BY client_key, vendedor_id"""),
    "abc_lojas": sql(f"""
        WITH b AS (SELECT client_key, produto_key, sum(total) AS fat, sum(quantidade) AS qtd, count(*) AS num_vendas
                   FROM m_itens WHERE status = 'concluida' GROUP BY 1, 2),
        a AS (SELECT *, CAST(fat AS DOUBLE) / CAST(sum(fat) OVER (PARTITION BY client_key) AS DOUBLE) AS share,
              CAST(sum(fat) OVER (PARTITION BY client_key ORDER BY fat DESC, produto_key ROWS UNBOUNDED PRECEDING) AS DOUBLE)
                / CAST(sum(fat) OVER (PARTITION BY client_key) AS DOUBLE) AS acum FROM b)
        SELECT client_key, produto_key, CAST(fat AS DOUBLE) AS faturamento,
               {r('CAST(qtd AS DOUBLE)', 2)} AS quantidade, num_vendas,
               {r('share * 100.0', 2)} AS percentual, {r('acum * 100.0', 2)} AS percentual_acumulado,
               CASE WHEN acum <= 0.8 THEN 'A' WHEN acum <= 0.95 THEN 'B' ELSE 'C' END AS classe FROM a"""),
    "rfm_lojas": sql("""
        WITH b AS (SELECT client_key, cliente_key, count(*) AS frequencia, sum(total) AS valor,
                   CAST(date_diff('second', max(data_venda), any_value(d)) // 86400 AS BIGINT) AS recencia
                   FROM m_vendas JOIN m_hoje USING (client_key) WHERE status = 'concluida' GROUP BY 1, 2),
        p AS (SELECT *, count(*) OVER (PARTITION BY client_key) AS n,
              row_number() OVER (PARTITION BY client_key ORDER BY recencia, cliente_key) AS kr,
              row_number() OVER (PARTITION BY client_key ORDER BY frequencia, cliente_key) AS kf,
              row_number() OVER (PARTITION BY client_key ORDER BY valor, cliente_key) AS km FROM b),
        s AS (SELECT *, CAST(6 - CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((kr - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_r,
              CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((kf - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_f,
              CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((km - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_m FROM p)
        SELECT client_key, cliente_key AS cliente_id, recencia, frequencia, CAST(valor AS DOUBLE) AS valor_total,
               score_r, score_f, score_m, CAST(score_r AS VARCHAR) || score_f || score_m AS score_rfm,
               CAST(score_r + score_f + score_m AS INTEGER) AS score_total,
               CASE WHEN score_r >= 4 AND score_f >= 4 AND score_m >= 4 THEN 'campeon'
                    WHEN score_f >= 3 AND score_m >= 3 THEN 'fiel'
                    WHEN score_r <= 2 AND score_f >= 3 THEN 'em_risco'
                    WHEN score_r = 1 AND score_f <= 2 THEN 'perdido'
                    WHEN score_r >= 4 AND score_f <= 2 THEN 'promissor'
                    WHEN score_r >= 3 AND score_f = 1 THEN 'novo'
                    WHEN score_r <= 2 AND score_f >= 2 THEN 'hibernando' ELSE 'outros' END AS segmento
        FROM s"""),
    "anomalias_desconto_lojas": sql(f"""
        WITH p AS (SELECT client_key, venda_key, data_venda, vendedor_id, CAST(total AS DOUBLE) AS total,
                   CAST(desconto AS DOUBLE) AS desconto,
                   coalesce(CAST(desconto AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0) * 100.0::DOUBLE AS pct_desconto
                   FROM m_vendas WHERE status = 'concluida'),
        m AS (SELECT client_key, avg(pct_desconto) AS media, stddev_samp(pct_desconto) AS desvio FROM p GROUP BY 1)
        SELECT p.*, {r('(pct_desconto - media) / desvio', 9)} AS z_score
        FROM p JOIN m USING (client_key) WHERE desvio > 0 AND (pct_desconto - media) / desvio > 2"""),
}
