"""Comparison SQL for the reads and the sales dashboards."""

from shopgrain.plans.oracle_base import sql


def _start(kind: str, period: str, d: str) -> str:
    """Start of a period as SQL over the date expression ``d``."""
    eod = f"(date_trunc('day', {d}) + INTERVAL 86399 SECOND)"
    month, year = f"date_trunc('month', {d})", f"date_trunc('year', {d})"
    day = f"date_trunc('day', {d})"
    table = {
        ("rolling", "week"): f"{eod} - INTERVAL 7 DAY",
        ("rolling", "month"): f"{month} - INTERVAL 1 MONTH + ({eod} - {month})",
        ("rolling", "year"): f"{month} - INTERVAL 1 YEAR + ({eod} - {month})",
        ("double", "week"): f"{eod} - INTERVAL 14 DAY",
        ("double", "month"): f"{month} - INTERVAL 2 MONTH + ({eod} - {month})",
        ("double", "year"): f"{month} - INTERVAL 2 YEAR + ({eod} - {month})",
        ("calendar", "week"): f"date_trunc('week', {d})",
        ("calendar", "month"): month,
        ("calendar", "year"): year,
        ("to_date", "week"): f"{eod} - INTERVAL 7 DAY",
        ("to_date", "month"): month,
        ("to_date", "year"): year,
        ("current", "week"): f"{day} - INTERVAL 6 DAY",
        ("current", "month"): month,
        ("current", "year"): year,
        ("previous", "week"): f"{day} - INTERVAL 13 DAY",
        ("previous", "month"): f"{month} - INTERVAL 1 MONTH",
        ("previous", "year"): f"{year} - INTERVAL 1 YEAR",
        ("compare", "week"): f"{eod} - INTERVAL 14 DAY",
        ("compare", "month"): f"{month} - INTERVAL 1 MONTH",
        ("compare", "year"): f"{year} - INTERVAL 1 YEAR",
        ("trend", "week"): f"{eod} - INTERVAL 13 DAY",
        ("trend", "month"): f"{month} - INTERVAL 6 DAY",
        ("trend", "year"): year,
    }
    return table[kind, period]


def _ok(kind: str, period: str, table: str = "vendas", clock: str = "hoje") -> str:
    start = _start(kind, period, f"(SELECT d FROM {clock})")
    return f"SELECT * FROM {table} WHERE status = 'concluida' AND data_venda >= {start}"


def _day_rows(kind: str, period: str) -> str:
    return f"""SELECT CAST(data_venda AS DATE) AS d, count(*) AS n, sum(total) AS fat
               FROM ({_ok(kind, period)}) GROUP BY 1"""


def _tendencia(period: str, skip: int) -> str:
    return sql(f"""
        WITH dias AS ({_day_rows('trend', period)}),
        w AS (SELECT d, n, fat,
                CAST(sum(fat) OVER (ORDER BY d ROWS 6 PRECEDING) * 100 AS BIGINT) AS s,
                count(*) OVER (ORDER BY d ROWS 6 PRECEDING) AS c,
                row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS days FROM dias)
        SELECT 'loja' AS client_key, CAST(d AS VARCHAR) AS dia, n AS vendas,
               CAST(fat AS DOUBLE) AS faturamento, ((2 * s + c) // (2 * c)) / 100.0 AS media_movel
        FROM w WHERE rn > {skip} OR days <= {skip}""")


def _trend(period: str) -> str:
    cur = _start("current", period, "(SELECT d FROM hoje)")
    prev = _start("previous", period, "(SELECT d FROM hoje)")
    return sql(f"""
        WITH s AS (SELECT
            CAST(coalesce(sum(total) FILTER (WHERE data_venda >= {cur}), 0) AS DOUBLE) AS fa,
            CAST(count(*) FILTER (WHERE data_venda >= {cur}) AS DOUBLE) AS na,
            CAST(coalesce(sum(desconto) FILTER (WHERE data_venda >= {cur}), 0) AS DOUBLE) AS da,
            CAST(coalesce(sum(total) FILTER (WHERE data_venda < {cur}), 0) AS DOUBLE) AS fp,
            CAST(count(*) FILTER (WHERE data_venda < {cur}) AS DOUBLE) AS np,
            CAST(coalesce(sum(desconto) FILTER (WHERE data_venda < {cur}), 0) AS DOUBLE) AS dp
            FROM vendas_desc WHERE status = 'concluida' AND data_venda >= {prev}),
        k AS (SELECT 'faturamento' AS kpi, fa AS a, fp AS p FROM s
            UNION ALL SELECT 'ticket_medio', CASE WHEN na = 0 THEN 0 ELSE fa / na END,
                CASE WHEN np = 0 THEN 0 ELSE fp / np END FROM s
            UNION ALL SELECT 'total_transacoes', na, np FROM s)
        SELECT 'loja' AS client_key, kpi, a AS atual, p AS anterior,
               CASE WHEN p = 0 THEN CASE WHEN a > 0 THEN 100.0 ELSE 0.0 END
                    ELSE (a - p) / p * 100.0 END AS variacao FROM k
        UNION ALL SELECT 'loja', 'perc_desconto', x, y, x - y FROM (
            SELECT CASE WHEN fa + da = 0 THEN 0 ELSE da / (fa + da) * 100.0 END AS x,
                   CASE WHEN fp + dp = 0 THEN 0 ELSE dp / (fp + dp) * 100.0 END AS y FROM s)""")


def _comparativo(period: str) -> str:
    base = _day_rows("compare", period)
    if period == "week":
        points = """SELECT generate_series AS i, CAST(date_trunc('week', u) AS DATE) + CAST(generate_series AS INT) AS d,
                    CAST(date_trunc('week', u) AS DATE) + CAST(generate_series AS INT) - 7 AS e FROM ult, generate_series(0, 6)"""
        label = "['Dom','Seg','Ter','Qua','Qui','Sex','Sáb'][1 + dayofweek(d)]"
    elif period == "month":
        points = """SELECT generate_series AS i, CAST(date_trunc('month', u) AS DATE) + CAST(generate_series AS INT) AS d,
                    CAST(CAST(date_trunc('month', u) AS DATE) + CAST(generate_series AS INT) - INTERVAL 1 MONTH AS DATE) AS e
                    FROM ult, generate_series(0, 30) WHERE generate_series < day(u)"""
        label = "CAST(day(d) AS VARCHAR)"
    else:
        base = f"SELECT CAST(date_trunc('month', d) AS DATE) AS d, sum(fat) AS fat FROM ({base}) GROUP BY 1"
        points = """SELECT generate_series AS i,
                    CAST(date_trunc('year', u) + to_months(CAST(generate_series AS INT)) AS DATE) AS d,
                    CAST(date_trunc('year', u) + to_months(CAST(generate_series AS INT) - 12) AS DATE) AS e
                    FROM ult, generate_series(0, 11) WHERE generate_series < month(u)"""
        label = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][month(d)]"
    return sql(f"""
        WITH dias AS ({base}), ult AS (SELECT max(d) AS u FROM dias), pontos AS ({points})
        SELECT 'loja' AS client_key, i + 1 AS ordem, {label} AS label,
               CAST(coalesce((SELECT fat FROM dias x WHERE x.d = p.d), 0) AS DOUBLE) AS atual,
               CAST(coalesce((SELECT fat FROM dias x WHERE x.d = p.e), 0) AS DOUBLE) AS anterior
        FROM pontos p""")


_HEAT = f"""SELECT ['Dom','Seg','Ter','Qua','Qui','Sex','Sáb'][1 + dayofweek(data_venda)] AS dia,
    strftime(data_venda, '%Hh') AS hora, CAST(sum(total) AS DOUBLE) AS faturamento
    FROM ({_ok('to_date', 'month', 'eventos', 'hoje_ev')}) GROUP BY 1, 2"""

_MIX = f"""SELECT coalesce(p.categoria, 'Sem Categoria') AS categoria, CAST(sum(i.total) AS DOUBLE) AS faturamento
    FROM itens i JOIN ({_ok('rolling', 'year')}) v ON i.venda_key = v.venda_key
    LEFT JOIN produtos p ON p.produto_key = i.produto_key
    GROUP BY 1 ORDER BY sum(i.total) DESC, 1 LIMIT 5"""

_DAYS_YEAR = _day_rows("compare", "year")

SQL = {
    "read_vendas": sql("""
        SELECT client_key, venda_key, data_venda, cliente_key, vendedor_id,
               CAST(total AS DOUBLE) AS total, CAST(desconto AS DOUBLE) AS desconto, status
        FROM vendas_desc WHERE status = 'concluida'"""),
    "read_itens_venda": sql("""
        SELECT client_key, venda_key, produto_key, CAST(quantidade AS DOUBLE) AS quantidade,
               CAST(total AS DOUBLE) AS total, CAST(preco_unitario AS DOUBLE) AS preco_unitario,
               CAST(desconto AS DOUBLE) AS desconto, data_venda, cliente_key FROM itens_ok"""),
    "read_clientes_ativos": sql("""
        SELECT client_key, cliente_key, nome, tipo, cidade, bairro FROM clientes WHERE ativo"""),
    "read_produtos_ativos": sql("""
        SELECT client_key, produto_key, nome, categoria, subcategoria,
               CAST(preco_custo AS DOUBLE) AS preco_custo, CAST(preco_venda AS DOUBLE) AS preco_venda
        FROM produtos WHERE ativo"""),
    "home_kpis": sql(f"""
        WITH v AS ({_ok('to_date', 'month')})
        SELECT 'loja' AS client_key, CAST(coalesce(sum(total), 0) AS DOUBLE) AS faturamento,
               coalesce(CAST(sum(total) AS DOUBLE) / nullif(count(*), 0), 0) AS ticket_medio, count(*) AS total_vendas,
               coalesce(CAST((SELECT sum(quantidade) FROM itens WHERE venda_key IN (SELECT venda_key FROM v)) AS DOUBLE)
                 / nullif(count(*), 0), 0) AS itens_por_venda FROM v"""),
    "vendas_resumo": sql("""
        SELECT 'loja' AS client_key, CAST(sum(total) AS DOUBLE) AS faturamento, count(*) AS total_vendas,
               CAST(sum(total) AS DOUBLE) / count(*) AS ticket_medio,
               CAST(sum(desconto) AS DOUBLE) AS total_desconto
        FROM vendas_desc WHERE status = 'concluida'"""),
    **{
        f"vendas_por_dia_{p}": sql(f"""
            SELECT 'loja' AS client_key, CAST(d AS VARCHAR) AS dia, n AS vendas,
                   CAST(fat AS DOUBLE) AS faturamento, 0.0::DOUBLE AS media_movel
            FROM ({_day_rows('compare', p)})""")
        for p in ("week", "month", "year")
    },
    "vendas_tendencia_week": _tendencia("week", 6),
    "vendas_tendencia_month": _tendencia("month", 6),
    "vendas_tendencia_year": _tendencia("year", 0),
    **{
        f"top_dias_{p}": sql(f"""
            SELECT 'loja' AS client_key, CAST(d AS VARCHAR) AS dia, n AS vendas,
                   CAST(fat AS DOUBLE) AS faturamento
            FROM ({_day_rows('to_date', p)}) ORDER BY fat DESC, d LIMIT 5""")
        for p in ("week", "year")
    },
    "vendas_por_hora": sql(f"""
        SELECT 'loja' AS client_key, strftime(data_venda, '%H:00') AS hora,
               CAST(sum(total) AS DOUBLE) AS faturamento
        FROM ({_ok('rolling', 'week', 'eventos', 'hoje_ev')}) GROUP BY 2"""),
    "mix_categorias": sql(f"SELECT 'loja' AS client_key, * FROM ({_MIX})"),
    "vendas_kpis_trend_week": _trend("week"),
    "vendas_kpis_trend_month": _trend("month"),
    "vendas_kpis_trend_year": _trend("year"),
    "ranking_vendedores": sql(f"""
        WITH v AS (SELECT * FROM vendas_desc WHERE status = 'concluida'
                   AND data_venda >= {_start('to_date', 'year', '(SELECT d FROM hoje)')}),
        q AS (SELECT venda_key, sum(quantidade) AS q FROM itens GROUP BY 1)
        SELECT 'loja' AS client_key, coalesce(vendedor_id, 'Não Informado') AS id,
               coalesce(vendedor_id, 'Não Informado') AS nome, count(*) AS vendas,
               CAST(sum(total) AS DOUBLE) AS faturamento,
               CAST(sum(total) AS DOUBLE) / count(*) AS ticket,
               CAST(sum(q) AS DOUBLE) / count(*) AS upa,
               CAST(sum(desconto) AS DOUBLE) / CAST(sum(total) + sum(desconto) AS DOUBLE) * 100.0 AS desconto
        FROM v LEFT JOIN q USING (venda_key) GROUP BY vendedor_id"""),
    "vendas_heatmap": sql(f"SELECT 'loja' AS client_key, * FROM ({_HEAT})"),
    "period_starts": sql("SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT 'loja' AS client_key, '{p}' AS periodo, '{k}' AS tipo, "
        f"CAST({_start(k, p, '(SELECT d FROM hoje)')} AS TIMESTAMP) AS inicio"
        for k in ("rolling", "double", "to_date", "calendar", "current", "previous", "compare", "trend")
        for p in ("week", "month", "year")
    ) + ")"),
    "comparativo_week": _comparativo("week"),
    "comparativo_month": _comparativo("month"),
    "comparativo_year": _comparativo("year"),
    "mix_share": sql(f"""
        SELECT 'loja' AS client_key, categoria, faturamento,
               faturamento / sum(faturamento) OVER () * 100.0 AS percentual FROM ({_MIX})"""),
    "heatmap_normalizado": sql(f"""
        WITH h AS ({_HEAT}), g AS (
            SELECT * FROM (SELECT unnest(['Seg','Ter','Qua','Qui','Sex','Sáb']) AS dia),
            (SELECT unnest(['08h','09h','10h','11h','12h','13h','14h','15h','16h','17h','18h']) AS hora))
        SELECT 'loja' AS client_key, g.dia, g.hora, coalesce(h.faturamento, 0) AS faturamento,
               coalesce(h.faturamento, 0) / (SELECT greatest(max(faturamento), 1) FROM h) AS intensidade
        FROM g LEFT JOIN h USING (dia, hora)"""),
    "dia_detalhe": sql(f"""
        SELECT 'loja' AS client_key, CAST(d AS VARCHAR) AS dia, n AS vendas,
               CAST(fat AS DOUBLE) AS faturamento, CAST(fat AS DOUBLE) / n AS ticket_medio
        FROM ({_DAYS_YEAR})"""),
    "dia_extremos": sql(f"""
        WITH x AS (SELECT CAST(d AS VARCHAR) AS dia, n, CAST(fat AS DOUBLE) AS fat FROM ({_DAYS_YEAR})),
        b AS (SELECT * FROM x ORDER BY fat DESC, dia LIMIT 1), w AS (SELECT * FROM x ORDER BY fat, dia LIMIT 1)
        SELECT 'loja' AS client_key, b.dia AS melhor_dia, b.fat AS melhor_faturamento, b.n AS melhor_vendas,
               w.dia AS pior_dia, w.fat AS pior_faturamento, w.n AS pior_vendas FROM b, w"""),
}
