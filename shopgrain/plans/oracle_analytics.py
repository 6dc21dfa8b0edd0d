"""Comparison SQL for products, customers and the statistical operators."""

from shopgrain.plans.oracle_base import PIECES, sql


def r(x: str, n: int) -> str:
    """Round half to even on the scaled double."""
    k = 10 ** n
    return f"(round_even(({x}) * {k}.0, 0) / {k}.0)"


PIECES.update({
    "abc_base": """
        SELECT produto_key, sum(total) AS fat, sum(quantidade) AS qtd, count(*) AS num_vendas
        FROM itens_ok GROUP BY 1""",
    "abc_acum": """
        SELECT *, CAST(fat AS DOUBLE) / CAST(sum(fat) OVER () AS DOUBLE) AS share,
               CAST(sum(fat) OVER (ORDER BY fat DESC, produto_key ROWS UNBOUNDED PRECEDING) AS DOUBLE)
                 / CAST(sum(fat) OVER () AS DOUBLE) AS acum FROM abc_base""",
    "abc_res": f"""
        SELECT 'loja' AS client_key, produto_key, CAST(fat AS DOUBLE) AS faturamento,
               {r('CAST(qtd AS DOUBLE)', 2)} AS quantidade, num_vendas,
               {r('share * 100.0', 2)} AS percentual, {r('acum * 100.0', 2)} AS percentual_acumulado,
               CASE WHEN acum <= 0.8 THEN 'A' WHEN acum <= 0.95 THEN 'B' ELSE 'C' END AS classe
        FROM abc_acum""",
    "xyz_mes": """
        SELECT produto_key, date_trunc('month', data_venda) AS mes, CAST(sum(quantidade) AS DOUBLE) AS q
        FROM itens_ok GROUP BY 1, 2""",
    "xyz_cv": """
        SELECT produto_key, avg(q) AS media, coalesce(stddev_samp(q), 0) AS desvio,
               coalesce(coalesce(stddev_samp(q), 0) / nullif(avg(q), 0), 0) AS cv
        FROM xyz_mes GROUP BY 1""",
    "xyz_res": f"""
        SELECT 'loja' AS client_key, produto_key, {r('media', 3)} AS media, {r('desvio', 3)} AS desvio,
               {r('cv', 3)} AS cv,
               CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS classe_xyz
        FROM xyz_cv""",
    "abc_xyz_res": """
        SELECT a.*, coalesce(x.classe_xyz, 'Z') AS classe_xyz, x.cv,
               a.classe || coalesce(x.classe_xyz, 'Z') AS classe_abc_xyz
        FROM abc_res a LEFT JOIN xyz_res x USING (produto_key)""",
    "margem_res": f"""
        SELECT 'loja' AS client_key, m.produto_key, CAST(receita AS DOUBLE) AS receita,
               CAST(qtd AS DOUBLE) AS quantidade, CAST(desconto AS DOUBLE) AS desconto, nome, categoria,
               CAST(preco_custo AS DOUBLE) AS preco_custo, CAST(preco_venda AS DOUBLE) AS preco_venda,
               {r('CAST(qtd * preco_custo AS DOUBLE)', 2)} AS custo_total,
               {r('CAST(receita - qtd * preco_custo AS DOUBLE)', 2)} AS margem_bruta,
               {r('CAST(receita - qtd * preco_custo AS DOUBLE) / CAST(receita AS DOUBLE) * 100.0', 2)} AS pct_margem
        FROM (SELECT produto_key, sum(total) AS receita, CAST(sum(quantidade) AS DECIMAL(15,3)) AS qtd,
                     sum(desconto) AS desconto FROM itens_ok GROUP BY 1) m
        LEFT JOIN produtos p USING (produto_key)""",
    "el_mes": """
        SELECT produto_key, date_trunc('month', data_venda) AS mes,
               CAST(sum(preco_unitario) AS DOUBLE) / count(*) AS p, CAST(sum(quantidade) AS DOUBLE) AS q,
               sum(total) AS r FROM itens_ok GROUP BY 1, 2""",
    "el_var": """
        SELECT produto_key, p, q, r, (p / lag(p) OVER w - 1.0) * 100.0 AS dp,
               (q / lag(q) OVER w - 1.0) * 100.0 AS dq, count(*) OVER (PARTITION BY produto_key) AS meses
        FROM el_mes WINDOW w AS (PARTITION BY produto_key ORDER BY mes)""",
    "el_fit": """
        SELECT produto_key, count(*) AS n,
               CASE WHEN var_pop(dp) = 0 THEN 0 ELSE coalesce(regr_slope(dq, dp), 0) END AS e,
               CASE WHEN var_pop(dp) = 0 THEN CASE WHEN var_pop(dq) = 0 THEN 1.0 ELSE 0.0 END
                    ELSE regr_r2(dq, dp) END AS r2,
               avg(p) AS p, sum(r) AS r
        FROM el_var WHERE meses >= 6 AND dp IS NOT NULL AND dq IS NOT NULL
        GROUP BY 1 HAVING count(*) >= 5""",
    "el_res": f"""
        SELECT 'loja' AS client_key, f.produto_key, coalesce(nome, f.produto_key) AS nome,
               coalesce(categoria, '') AS categoria, {r('e', 3)} AS elasticidade, {r('r2', 3)} AS r2,
               CASE WHEN e < -1 THEN 'elastico' WHEN e > -0.5 THEN 'inelastico' ELSE 'moderado' END AS tipo,
               CASE WHEN e < -1 THEN 'Reduzir preço pode aumentar receita total'
                    WHEN e > -0.5 THEN 'Preço pouco sensível — evite descontos desnecessários'
                    ELSE 'Elasticidade moderada — avalie caso a caso' END AS recomendacao,
               {r('p', 2)} AS preco_medio, CAST(r AS DOUBLE) AS receita_total
        FROM el_fit f LEFT JOIN produtos USING (produto_key)""",
    "parado": """
        SELECT p.produto_key, p.nome, e.quantidade, p.preco_custo, e.quantidade * p.preco_custo AS capital
        FROM produtos p JOIN estoque e USING (produto_key)
        WHERE e.quantidade > 0 AND p.produto_key NOT IN (
            SELECT i.produto_key FROM itens i JOIN vendas v USING (venda_key)
            WHERE v.data_venda >= (SELECT d FROM hoje) - INTERVAL 90 DAY)""",
    "est": """
        SELECT 'loja' AS client_key, e.produto_key, coalesce(p.nome, e.produto_key) AS nome,
               coalesce(p.categoria, '') AS categoria, CAST(e.quantidade AS DOUBLE) AS quantidade,
               CAST(e.quantidade_min AS DOUBLE) AS quantidade_min,
               CAST(coalesce(p.preco_venda, 0) AS DOUBLE) AS preco_venda,
               CAST(coalesce(p.preco_custo, 0) AS DOUBLE) AS preco_custo,
               e.quantidade <= e.quantidade_min AS alerta
        FROM estoque e LEFT JOIN produtos p USING (produto_key)""",
    "rank_prod": """
        SELECT 'loja' AS client_key, p.produto_key AS id, p.nome, coalesce(p.categoria, 'Geral') AS categoria,
               CAST(coalesce(f.cur, 0) AS DOUBLE) AS faturamento, coalesce(m.pct_margem, 0) AS margem,
               coalesce(a.classe, 'C') AS classe_abc, coalesce(a.classe_xyz, 'Z') AS classe_xyz,
               CASE WHEN coalesce(f.cur, 0) > coalesce(f.prev, 0) * 1.05 THEN 'subindo'
                    WHEN coalesce(f.cur, 0) < coalesce(f.prev, 0) * 0.95 THEN 'caindo'
                    ELSE 'estavel' END AS tendencia
        FROM produtos p LEFT JOIN (
            SELECT produto_key,
                   sum(i.total) FILTER (WHERE data_venda >= (SELECT d FROM hoje) - INTERVAL 28 DAY) AS cur,
                   sum(i.total) FILTER (WHERE data_venda >= (SELECT d FROM hoje) - INTERVAL 56 DAY
                                      AND data_venda < (SELECT d FROM hoje) - INTERVAL 28 DAY) AS prev
            FROM itens i JOIN vendas v USING (venda_key) GROUP BY 1) f USING (produto_key)
        LEFT JOIN abc_xyz_res a USING (produto_key) LEFT JOIN margem_res m USING (produto_key)""",
    "cli_base": """
        SELECT c.cliente_key, count(*) AS frequencia, sum(v.total) AS valor,
               CAST(date_diff('second', max(v.data_venda), (SELECT d FROM hoje)) // 86400 AS BIGINT) AS recencia
        FROM clientes c JOIN vendas v USING (cliente_key) WHERE c.ativo GROUP BY 1""",
    "seg3": """
        SELECT CASE WHEN sr = 3 AND sf = 3 AND sm = 3 THEN 'campeon' WHEN sf >= 2 AND sm >= 2 THEN 'fiel'
                    WHEN sr = 1 AND sf >= 2 THEN 'em_risco' WHEN sr = 1 AND sf = 1 THEN 'perdido'
                    WHEN sr = 3 AND sf = 1 THEN 'promissor' WHEN sr >= 2 AND sf = 1 THEN 'novo'
                    WHEN sr <= 2 AND sf >= 2 THEN 'hibernando' ELSE 'outros' END AS segmento,
               valor, recencia
        FROM (SELECT b.*,
                CASE WHEN recencia <= r25 THEN 3 WHEN recencia <= r75 THEN 2 ELSE 1 END AS sr,
                CASE WHEN frequencia >= f75 THEN 3 WHEN frequencia >= f25 THEN 2 ELSE 1 END AS sf,
                CASE WHEN CAST(valor AS DOUBLE) >= m75 THEN 3 WHEN CAST(valor AS DOUBLE) >= m25 THEN 2 ELSE 1 END AS sm
              FROM cli_base b, (SELECT quantile_cont(recencia, 0.25) AS r25, quantile_cont(recencia, 0.75) AS r75,
                quantile_cont(frequencia, 0.25) AS f25, quantile_cont(frequencia, 0.75) AS f75,
                quantile_cont(CAST(valor AS DOUBLE), 0.25) AS m25, quantile_cont(CAST(valor AS DOUBLE), 0.75) AS m75
                FROM cli_base))""",
    "seg3_res": """
        SELECT 'loja' AS client_key, segmento, count(*) AS clientes,
               ((2 * CAST(sum(valor) * 100 AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS valor_medio,
               CAST(sum(valor) AS DOUBLE) AS valor_total,
               ((200 * CAST(sum(recencia) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS recencia_media
        FROM seg3 GROUP BY 2""",
    "rfm_base": """
        SELECT cliente_key, count(*) AS frequencia, sum(total) AS valor,
               CAST(date_diff('second', max(data_venda), (SELECT d FROM hoje)) // 86400 AS BIGINT) AS recencia
        FROM vendas WHERE status = 'concluida' GROUP BY 1""",
    "rfm_pos": """
        SELECT *, count(*) OVER () AS n,
               row_number() OVER (ORDER BY recencia, cliente_key) AS kr,
               row_number() OVER (ORDER BY frequencia, cliente_key) AS kf,
               row_number() OVER (ORDER BY valor, cliente_key) AS km FROM rfm_base""",
    "rfm_sc": """
        SELECT *, CAST(6 - CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((kr - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_r,
               CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((kf - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_f,
               CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((km - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS score_m
        FROM rfm_pos""",
    "rfm_res": """
        SELECT 'loja' AS client_key, cliente_key AS cliente_id, recencia, frequencia,
               CAST(valor AS DOUBLE) AS valor_total, score_r, score_f, score_m,
               CAST(score_r AS VARCHAR) || score_f || score_m AS score_rfm,
               CAST(score_r + score_f + score_m AS INTEGER) AS score_total,
               CASE WHEN score_r >= 4 AND score_f >= 4 AND score_m >= 4 THEN 'campeon'
                    WHEN score_f >= 3 AND score_m >= 3 THEN 'fiel'
                    WHEN score_r <= 2 AND score_f >= 3 THEN 'em_risco'
                    WHEN score_r = 1 AND score_f <= 2 THEN 'perdido'
                    WHEN score_r >= 4 AND score_f <= 2 THEN 'promissor'
                    WHEN score_r >= 3 AND score_f = 1 THEN 'novo'
                    WHEN score_r <= 2 AND score_f >= 2 THEN 'hibernando' ELSE 'outros' END AS segmento
        FROM rfm_sc""",
})

SQL = {
    "estoque_alertas": sql("""
        SELECT client_key, produto_key, nome, quantidade, quantidade_min FROM est WHERE alerta"""),
    "estoque_completo": sql("SELECT * FROM est"),
    "estoque_completo_filtrado": sql("SELECT * FROM est WHERE categoria = 'Brand#7' AND alerta"),
    "estoque_kpis": sql("""
        SELECT 'loja' AS client_key, count(*) AS total_skus, count(*) FILTER (WHERE alerta) AS alertas,
               CAST(sum(CAST(quantidade AS DECIMAL(12,3)) * CAST(preco_custo AS DECIMAL(12,2))) AS DOUBLE) AS valor_estoque,
               count(*) FILTER (WHERE NOT alerta) AS estoque_ok FROM est"""),
    "produtos_abc_sql": sql("""
        WITH f AS (SELECT i.produto_key, coalesce(p.nome, i.produto_key) AS nome,
                     coalesce(p.categoria, '') AS categoria, sum(i.total) AS fat
                   FROM itens i LEFT JOIN produtos p USING (produto_key) GROUP BY 1, 2, 3),
        a AS (SELECT *, CAST(sum(fat) OVER (ORDER BY fat DESC) AS DOUBLE)
                / CAST(sum(fat) OVER () AS DOUBLE) AS s FROM f)
        SELECT 'loja' AS client_key, produto_key, nome, categoria, CAST(fat AS DOUBLE) AS faturamento,
               CASE WHEN s <= 0.8 THEN 'A' WHEN s <= 0.95 THEN 'B' ELSE 'C' END AS classe FROM a"""),
    "dead_stock": sql("""
        SELECT 'loja' AS client_key, produto_key, nome, CAST(quantidade AS DOUBLE) AS quantidade,
               CAST(preco_custo AS DOUBLE) AS preco_custo, CAST(capital AS DOUBLE) AS capital_parado
        FROM parado"""),
    "dead_stock_totals": sql("""
        SELECT 'loja' AS client_key, CAST(sum(capital) AS DOUBLE) AS capital_total,
               CAST(sum(quantidade) AS DOUBLE) AS itens_total FROM parado"""),
    "catalog_kpis": sql("""
        SELECT 'loja' AS client_key, (SELECT count(*) FROM produtos) AS total_skus,
               (SELECT count(*) FROM abc_res WHERE classe = 'A') AS qtd_classe_a,
               (SELECT CAST(sum(CAST(faturamento AS DECIMAL(18,2))) FILTER (WHERE classe = 'A') AS DOUBLE)
                     / CAST(sum(CAST(faturamento AS DECIMAL(18,2))) AS DOUBLE) * 100.0 FROM abc_res) AS pct_faturamento_a,
               (SELECT CAST(sum(CAST(pct_margem AS DECIMAL(18,2))) AS DOUBLE) / count(pct_margem) FROM margem_res) AS margem_media,
               (SELECT count(*) FROM parado) AS dead_stock_skus,
               (SELECT CAST(coalesce(sum(capital), 0) AS DOUBLE) FROM parado) AS capital_parado"""),
    "matriz_abc_xyz": sql("""
        SELECT 'loja' AS client_key, classe AS classe_abc, classe_xyz, count(*) AS qtd
        FROM abc_xyz_res GROUP BY 2, 3"""),
    "matriz_abc_xyz_pivot": sql("""
        SELECT 'loja' AS client_key, classe, count(*) FILTER (WHERE classe_xyz = 'X') AS X,
               count(*) FILTER (WHERE classe_xyz = 'Y') AS Y, count(*) FILTER (WHERE classe_xyz = 'Z') AS Z
        FROM abc_xyz_res GROUP BY 2"""),
    "abc_kpis": sql("""
        SELECT 'loja' AS client_key, classe, count(*) AS produtos,
               CAST(sum(CAST(percentual AS DECIMAL(12,2))) AS DOUBLE) AS percentual,
               count(*) FILTER (WHERE classe = 'A' AND classe_xyz = 'X') AS ax,
               count(*) FILTER (WHERE classe = 'A' AND classe_xyz = 'Z') AS az
        FROM abc_xyz_res GROUP BY 2"""),
    "ranking_produtos": sql("SELECT * FROM rank_prod"),
    "elasticidade_view": sql("""
        SELECT client_key, produto_key, elasticidade, tipo AS interpretacao, receita_total AS receita
        FROM el_res WHERE receita_total > 0"""),
    "matriz_preco": sql("""
        SELECT e.client_key, e.produto_key, e.elasticidade, e.receita_total AS receita,
               CASE WHEN e.elasticidade < -1 AND alto THEN 'chama-cliente' WHEN alto THEN 'ouro-oculto'
                    WHEN e.elasticidade < -1 THEN 'gira-estoque' ELSE 'margem-segura' END AS quadrante
        FROM (SELECT x.*, k.faturamento IS NULL OR k.faturamento >= (
                SELECT CAST(sum(CAST(faturamento AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM rank_prod) AS alto
              FROM el_res x LEFT JOIN rank_prod k ON k.id = x.produto_key WHERE receita_total > 0) e"""),
    "margem_kpis": sql("""
        WITH s AS (SELECT sum(CAST(receita AS DECIMAL(18,2))) AS r, sum(CAST(margem_bruta AS DECIMAL(18,2))) AS m
                   FROM margem_res),
        b AS (SELECT nome, pct_margem FROM margem_res ORDER BY pct_margem DESC, margem_bruta DESC, produto_key LIMIT 1),
        w AS (SELECT nome, pct_margem FROM margem_res ORDER BY pct_margem, margem_bruta DESC, produto_key LIMIT 1)
        SELECT 'loja' AS client_key, CAST(r AS DOUBLE) AS receita_total, CAST(m AS DOUBLE) AS margem_total,
               CAST(m AS DOUBLE) / CAST(r AS DOUBLE) * 100.0 AS pct_margem,
               (SELECT count(*) FROM el_res WHERE tipo = 'elastico') AS produtos_elasticos,
               b.nome AS maior_margem_nome, b.pct_margem AS maior_margem_pct,
               w.nome AS menor_margem_nome, w.pct_margem AS menor_margem_pct FROM s, b, w"""),
    "elasticidade_contagem": sql("""
        SELECT 'loja' AS client_key, tipo, count(*) AS quantidade FROM el_res GROUP BY 2"""),
    "clientes_rfm_base": sql("""
        SELECT 'loja' AS client_key, cliente_key AS cliente_id, frequencia, CAST(valor AS DOUBLE) AS valor_total,
               recencia FROM cli_base"""),
    "resumo_segmentos_sql": sql("SELECT * FROM seg3_res"),
    "clientes_inativos": sql("""
        SELECT 'loja' AS client_key, cliente_key AS cliente_id, frequencia, CAST(valor AS DOUBLE) AS valor_total,
               recencia FROM cli_base WHERE recencia > 45 ORDER BY valor DESC, cliente_key LIMIT 10"""),
    "segmento_kpis": sql("""
        SELECT 'loja' AS client_key, CAST(sum(clientes) AS BIGINT) AS total_clientes,
               CAST(sum(CAST(valor_total AS DECIMAL(18,2))) AS DOUBLE) AS valor_total,
               CAST(coalesce(sum(clientes) FILTER (WHERE segmento IN ('em_risco','hibernando')), 0) AS BIGINT) AS em_risco,
               CAST(coalesce(sum(clientes) FILTER (WHERE segmento = 'campeon'), 0) AS BIGINT) AS campeoes
        FROM seg3_res"""),
    "abc": sql("SELECT * FROM abc_res"),
    "xyz": sql("SELECT * FROM xyz_res"),
    "abc_xyz": sql("SELECT * FROM abc_xyz_res"),
    "resumo_abc": sql("""
        SELECT 'loja' AS client_key, classe, count(*) AS produtos,
               CAST(sum(CAST(faturamento AS DECIMAL(18,2))) AS DOUBLE) AS faturamento,
               CAST(sum(CAST(percentual AS DECIMAL(18,2))) AS DOUBLE) AS percentual FROM abc_res GROUP BY 2"""),
    "score_quintil": sql("""
        SELECT 'loja' AS client_key, cliente_key AS cliente_id, score_r, score_f, score_m FROM rfm_sc"""),
    "rfm": sql("SELECT * FROM rfm_res"),
    "segmento_rfm": sql("""
        SELECT 'loja' AS client_key, segmento, count(*) AS clientes FROM rfm_res GROUP BY 2"""),
    "clientes_em_risco": sql("""
        SELECT * FROM rfm_res WHERE segmento IN ('em_risco','hibernando')
        ORDER BY valor_total DESC, cliente_id LIMIT 20"""),
    "resumo_segmentos": sql(f"""
        SELECT 'loja' AS client_key, segmento, count(*) AS clientes,
               {r('CAST(sum(CAST(valor_total AS DECIMAL(18,2))) AS DOUBLE) / count(*)', 2)} AS valor_medio,
               CAST(sum(CAST(valor_total AS DECIMAL(18,2))) AS DOUBLE) AS valor_total,
               {r('CAST(sum(recencia) AS DOUBLE) / count(*)', 2)} AS recencia_media
        FROM rfm_res GROUP BY 2"""),
    "elasticidade": sql("SELECT * FROM el_res"),
    "cenario_preco": sql(f"""
        WITH g AS (SELECT e.*, CAST(unnest([-30,-25,-20,-15,-10,-5,0,5,10,15,20,25,30]) AS DOUBLE) AS v FROM el_res e),
        c AS (SELECT *, elasticidade * v AS dq,
                receita_total * (1.0::DOUBLE + v / 100.0::DOUBLE) * (1.0::DOUBLE + elasticidade * v / 100.0::DOUBLE) AS nova FROM g)
        SELECT client_key, produto_key, {r('preco_medio', 2)} AS preco_atual,
               {r('preco_medio * (1.0::DOUBLE + v / 100.0::DOUBLE)', 2)} AS preco_novo, v AS variacao_preco,
               {r('dq', 2)} AS variacao_qtd, {r('receita_total', 2)} AS receita_atual, {r('nova', 2)} AS receita_nova,
               {r('nova - receita_total', 2)} AS impacto_receita,
               {r('(nova - receita_total) / receita_total * 100.0::DOUBLE', 2)} AS impacto_pct FROM c"""),
    "margem": sql("SELECT * FROM margem_res"),
}
