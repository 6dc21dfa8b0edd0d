"""Comparison SQL for insights, the report, masking and monitoring.

Fixed values: the wording of insights must be the one that the pages show.
"""

from shopgrain.plans.oracle_base import sql
from shopgrain.plans.oracle_models import FC, RULES


def _ins(seq: int, tipo: str, prio: str, titulo: str, msg: str, acao: str, href: str, cat: str,
         icone: str, source: str) -> str:
    return f"""SELECT 'loja' AS client_key, '{tipo}' AS tipo, CAST({prio} AS INTEGER) AS prioridade,
        {titulo} AS titulo, {msg} AS mensagem, '{acao}' AS acao, '{href}' AS href,
        '{cat}' AS categoria, '{icone}' AS icone, CAST({seq} AS INTEGER) AS _seq FROM {source}"""


def _n0(x: str) -> str:
    return f"format('{{:,.0f}}', CAST({x} AS DOUBLE))"


I1 = _ins(
    1, "estoque_critico", "CASE WHEN classe = 'A' THEN 1 ELSE 3 END",
    "CASE WHEN classe = 'A' THEN 'Ruptura iminente' ELSE 'Estoque baixo' END",
    "CASE WHEN classe = 'A' THEN 'Produto ' || produto_key || ' (Classe A) com alta demanda prevista: ' "
    "|| format('{:.0f}', quantidade_prevista) || ' unidades nos próximos 30 dias. Verifique o nível de estoque.' "
    "ELSE 'Produto ' || produto_key || ' com demanda prevista de ' || format('{:.0f}', quantidade_prevista) "
    "|| ' unidades nos próximos 30 dias.' END",
    "Ver estoque", "/estoque", "estoque", "warning",
    "(SELECT f.produto_key, f.quantidade_prevista, a.classe FROM (SELECT * FROM pres WHERE quantidade_prevista > 0 "
    "ORDER BY quantidade_prevista DESC, produto_key LIMIT 1) f LEFT JOIN abc_res a USING (produto_key))",
)
I2 = _ins(
    2, "churn_vip", "2", "'Clientes VIP sumindo'",
    "n || ' cliente(s) de alto valor sem comprar há em média ' || rec || ' dias. Valor histórico em risco: R$ ' || "
    + _n0("v") + " || '. Entre em contato esta semana.'",
    "Ver clientes", "/clientes", "clientes", "danger",
    "(SELECT count(*) AS n, sum(CAST(valor_total AS DECIMAL(18,2))) AS v, CAST(sum(recencia) AS BIGINT) // count(*) AS rec "
    "FROM rfm_res WHERE segmento IN ('em_risco','hibernando') AND valor_total > "
    "(SELECT quantile_cont(valor_total, 0.75) FROM rfm_res) HAVING count(*) > 0)",
)
I3 = _ins(
    3, "anomalia_desconto", "3", "'Descontos anômalos'",
    "n || ' venda(s) com desconto fora do padrão detectadas. Vendedor com mais ocorrências: ' || coalesce(q, 'N/A') "
    "|| '. Total em descontos incomuns: R$ ' || " + _n0("v") + " || '.'",
    "Ver anomalias", "/anomalias", "anomalias", "danger",
    "(SELECT count(*) AS n, sum(CAST(desconto AS DECIMAL(18,2))) AS v, (SELECT vendedor_id FROM desc_an "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS q FROM desc_an HAVING count(*) > 0)",
)
_BEST = "(SELECT * FROM regra ORDER BY lift DESC, antecedents, consequents LIMIT 1)"
I4 = _ins(
    4, "oportunidade_combo", "4", "'Oportunidade de venda cruzada'",
    "'Clientes que compram ' || antecedents || ' têm ' || format('{:.0f}', confidence) || '% de chance de comprar ' "
    "|| consequents || '. Treine o balconista para sugerir este combo.'",
    "Ver produtos", "/produtos", "produtos", "success", _BEST,
)
I5 = _ins(
    5, "margem_alta", "5", "'Produto com melhor margem'",
    "coalesce(nome, produto_key) || ' é seu produto mais rentável: ' || format('{:.1f}', pct_margem) || "
    "'% de margem bruta com R$ ' || " + _n0("receita") + " || ' em receita. Priorize seu estoque e visibilidade na loja.'",
    "Ver margens", "/preco", "financeiro", "success",
    "(SELECT * FROM margem_res WHERE produto_key IN (SELECT produto_key FROM abc_res WHERE classe = 'A') "
    "ORDER BY pct_margem DESC, margem_bruta DESC, produto_key LIMIT 1)",
)
I6 = _ins(
    6, "performance", "6", "'Resumo de performance'",
    "n || ' vendas com ticket médio de R$ ' || " + _n0("t") + " || '. Faturamento total: R$ ' || " + _n0("f")
    + " || '. Produtos classe A respondem por ~80% deste resultado.'",
    "Ver vendas", "/vendas", "vendas", "success",
    "(SELECT count(*) AS n, CAST(sum(total) AS DOUBLE) AS f, CAST(sum(total) AS DOUBLE) / count(*) AS t "
    "FROM vendas WHERE status = 'concluida')",
)
V1 = _ins(
    1, "vendedor_anomalia", "1", "'Atenção com Vendedor'",
    "'O vendedor ' || vendedor_id || ' apresentou métricas atípicas (alto volume de descontos ou UPA muito baixo). "
    "Revise as últimas vendas.'",
    "Ver Ranking", "/vendas", "vendas", "warning",
    "(SELECT * FROM vend_an ORDER BY total_faturado DESC, vendedor_id LIMIT 1)",
)
V2 = _ins(
    2, "venda_cruzada", "2", "'Oportunidade de UPA'",
    "'Combo forte detectado: Quem leva ' || antecedents || ' costuma levar ' || consequents || '. Instrua a equipe a "
    "oferecer esta venda cruzada para subir o Ticket Médio.'",
    "Ver Produtos", "/produtos", "vendas", "success", _BEST,
)
V3 = _ins(
    3, "categoria_foco", "3", "'Tração de Categoria'",
    "'A categoria ''' || c || ''' está puxando o faturamento da curva A. Garanta que a equipe conheça o mix de "
    "produtos desta linha.'",
    "Ver Mix", "/vendas", "vendas", "success",
    "(SELECT coalesce(categoria, 'Diversos') AS c FROM abc_res LEFT JOIN produtos USING (produto_key) "
    "WHERE classe = 'A' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)

_HOME = f"WITH {FC}, {RULES}, ins AS ({' UNION ALL '.join((I1, I2, I3, I4, I5, I6))})"
_VENDAS = f"WITH {RULES}, ins AS ({' UNION ALL '.join((V1, V2, V3))})"
_HIST = """hist AS (SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 'performance'
        WHEN 'error' THEN 'anomalia_desconto' WHEN 'click' THEN 'venda_cruzada' ELSE 'outro' END AS tipo
        FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR),
    rot AS (SELECT i.* REPLACE (CAST(prioridade + CASE WHEN tipo IN (SELECT tipo FROM hist) THEN 10 ELSE 0 END
        AS INTEGER) AS prioridade) FROM ins i)"""


def _top3(src: str) -> str:
    return f"""(SELECT *, row_number() OVER (ORDER BY CASE WHEN rn > 1 THEN 1 ELSE 0 END, prioridade, _seq) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY prioridade, _seq) AS rn FROM {src}))"""


def _brl(x: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,')"


_MASK = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,"
    r" '\d{3}\.\d{3}\.\d{3}-\d{2}', '[CPF]', 'g'), '\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}', '[CNPJ]', 'g'),"
    r" '\(?\d{2}\)?\s?\d{4,5}-?\d{4}', '[TELEFONE]', 'g'),"
    r" '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g')"
)
_DAY = "started_at >= (SELECT max(started_at) FROM logs) - INTERVAL 24 HOUR"

SQL = {
    "ins_estoque_critico": sql(f"WITH {FC} {I1}"),
    "ins_churn_vip": sql(I2),
    "ins_anomalia_desconto": sql(I3),
    "ins_combo": sql(f"WITH {RULES} {I4}"),
    "ins_margem_alta": sql(I5),
    "ins_performance": sql(I6),
    "ins_vendedor": sql(V1),
    "ins_venda_cruzada": sql(f"WITH {RULES} {V2}"),
    "ins_categoria_foco": sql(V3),
    "rotacao_temporal": sql(f"{_VENDAS}, {_HIST} SELECT * FROM rot"),
    "top3_diverso": sql(
        f"{_HOME} SELECT * EXCLUDE (rn, k) FROM {_top3('ins')} WHERE k <= 3"
    ),
    "insights_home": sql(
        f"{_HOME}, {_HIST} SELECT * EXCLUDE (rn, k), k <= 3 AS top3 FROM {_top3('rot')}"
    ),
    "insights_vendas": sql(
        f"{_VENDAS}, {_HIST} SELECT *, row_number() OVER (ORDER BY prioridade, _seq) <= 3 AS top3 FROM rot"
    ),
    "ler_insights": sql(f"""
        {_VENDAS} SELECT client_key, tipo, prioridade, titulo, mensagem, acao, href, categoria, icone,
            '2024-01-01 00:00:00' AS gerado_em FROM ins ORDER BY prioridade, tipo LIMIT 3"""),
    "ler_insights_home": sql(f"""
        {_HOME} SELECT client_key, tipo, prioridade, titulo, mensagem, acao, href, categoria, icone,
            '2024-01-01 00:00:00' AS gerado_em FROM ins ORDER BY prioridade, tipo LIMIT 10"""),
    "filtro_cascata": sql(f"""
        WITH {RULES}, pk AS (SELECT categoria, min(produto_key) AS k FROM produtos GROUP BY 1),
        esc AS (SELECT id FROM rank_prod WHERE categoria = 'Brand#7'),
        rp AS (SELECT a.k AS an, c.k AS co, lift FROM regra JOIN pk a ON a.categoria = antecedents
               JOIN pk c ON c.categoria = consequents)
        SELECT 'loja' AS client_key, 'ranking' AS bloco, id AS item, '' AS par, faturamento AS valor
        FROM rank_prod WHERE id IN (SELECT id FROM esc)
        UNION ALL SELECT 'loja', 'elasticidade', produto_key, '', elasticidade FROM el_res
        WHERE produto_key IN (SELECT id FROM esc)
        UNION ALL SELECT 'loja', 'basket', an, co, lift FROM rp
        WHERE an IN (SELECT id FROM esc) OR co IN (SELECT id FROM esc)
        UNION ALL SELECT 'loja', 'dead_stock', produto_key, '', CAST(capital AS DOUBLE) FROM parado
        WHERE produto_key IN (SELECT id FROM esc)"""),
    "relatorio_semanal": sql(f"""
        WITH k AS (SELECT CAST(sum(total) AS DOUBLE) AS f, count(*) AS n, CAST(sum(desconto) AS DOUBLE) AS d
                   FROM vendas_desc WHERE status = 'concluida')
        SELECT 'loja' AS client_key, 'kpis' AS secao, 1::BIGINT AS ordem, 'faturamento' AS nome, '' AS categoria,
               {_brl('f')} AS valor, '' AS extra FROM k
        UNION ALL SELECT 'loja', 'kpis', 2, 'ticket_medio', '', {_brl('f / n')}, '' FROM k
        UNION ALL SELECT 'loja', 'kpis', 3, 'total_vendas', '', CAST(n AS VARCHAR), '' FROM k
        UNION ALL SELECT 'loja', 'kpis', 4, 'total_descontos', '', {_brl('d')}, '' FROM k
        UNION ALL (SELECT 'loja', 'top_produtos', row_number() OVER (ORDER BY faturamento DESC, produto_key),
               produto_key, '', {_brl('faturamento')}, classe FROM abc_res ORDER BY 3 LIMIT 10)
        UNION ALL (SELECT 'loja', 'clientes_risco', row_number() OVER (ORDER BY valor_total DESC, cliente_id),
               cliente_id, '', {_brl('valor_total')}, CAST(recencia AS VARCHAR) FROM rfm_res
               WHERE segmento IN ('em_risco','hibernando') ORDER BY 3 LIMIT 5)
        UNION ALL (SELECT 'loja', 'alertas_estoque', row_number() OVER (ORDER BY quantidade, produto_key),
               nome, '', format('{{:.0f}}', quantidade), format('{{:.0f}}', quantidade_min) FROM est
               WHERE alerta ORDER BY 3 LIMIT 10)"""),
    "fmt_brl": sql(f"SELECT client_key, venda_key, {_brl('total')} AS total_brl FROM vendas"),
    "mascarar_pii_documentos": sql(f"SELECT doc_id, {_MASK} AS text FROM documents"),
    "mascarar_pii_conversas": sql(f"SELECT conv_id, turn, {_MASK} AS text FROM conversations"),
    "etl_execucoes_24h": sql(f"SELECT count(*) AS value FROM logs WHERE {_DAY}"),
    "etl_erros_24h": sql(f"SELECT count(*) AS value FROM logs WHERE status = 'error' AND {_DAY}"),
    "etl_duracao_media": sql(f"""
        SELECT CAST(round(avg(date_diff('second', started_at, finished_at))) AS BIGINT) AS value
        FROM logs WHERE status = 'success' AND {_DAY}"""),
    "etl_ultimas": sql("""
        SELECT l.client_key, connector_type, status, records_read, records_written, error_message,
               started_at, finished_at
        FROM logs l JOIN lojas c ON c.client_key = l.client_key
        ORDER BY started_at DESC, l.client_key, status, records_read LIMIT 50"""),
    "clientes_ativos": sql("SELECT * FROM lojas WHERE active"),
}
