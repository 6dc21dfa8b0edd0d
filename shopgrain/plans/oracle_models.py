"""Comparison SQL for baskets, forecasts, anomalies, texts and monitoring."""

from shopgrain.plans.oracle_analytics import r
from shopgrain.plans.oracle_base import PIECES, sql

PIECES.update({
    "cesta": """
        SELECT DISTINCT i.venda_key, p.categoria AS it FROM itens_ok i JOIN produtos p USING (produto_key)""",
    "cesta_n": "SELECT count(DISTINCT venda_key)::DOUBLE AS n FROM cesta",
})


def _sets(support: float) -> str:
    ok = f"HAVING count(*)::DOUBLE / (SELECT n FROM cesta_n) >= {support}"
    return f"""
        l1 AS (SELECT it AS a, count(*) AS c FROM cesta GROUP BY 1 {ok}),
        f AS (SELECT * FROM cesta WHERE it IN (SELECT a FROM l1)),
        l2 AS (SELECT x.it AS a, y.it AS b, count(*) AS c FROM f x JOIN f y
               ON x.venda_key = y.venda_key AND x.it < y.it GROUP BY 1, 2 {ok}),
        l3 AS (SELECT x.it AS a, y.it AS b, z.it AS d, count(*) AS c FROM f x
               JOIN f y ON x.venda_key = y.venda_key AND x.it < y.it
               JOIN f z ON x.venda_key = z.venda_key AND y.it < z.it GROUP BY 1, 2, 3 {ok}),
        conj AS (SELECT [a] AS itens, 1 AS k, c FROM l1 UNION ALL SELECT [a, b], 2, c FROM l2
                 UNION ALL SELECT [a, b, d], 3, c FROM l3),
        sup AS (SELECT itens, CAST(k AS BIGINT) AS tamanho, c AS contagem,
                c::DOUBLE / (SELECT n FROM cesta_n) AS suporte FROM conj)"""


def _rules(support: float, conf: float, lift: float) -> str:
    return f"""{_sets(support)},
        div AS (
            SELECT [itens[1]] AS an, [itens[2]] AS co, suporte AS s FROM sup WHERE tamanho = 2
            UNION ALL SELECT [itens[2]], [itens[1]], suporte FROM sup WHERE tamanho = 2
            UNION ALL SELECT [itens[1]], [itens[2], itens[3]], suporte FROM sup WHERE tamanho = 3
            UNION ALL SELECT [itens[2]], [itens[1], itens[3]], suporte FROM sup WHERE tamanho = 3
            UNION ALL SELECT [itens[3]], [itens[1], itens[2]], suporte FROM sup WHERE tamanho = 3
            UNION ALL SELECT [itens[2], itens[3]], [itens[1]], suporte FROM sup WHERE tamanho = 3
            UNION ALL SELECT [itens[1], itens[3]], [itens[2]], suporte FROM sup WHERE tamanho = 3
            UNION ALL SELECT [itens[1], itens[2]], [itens[3]], suporte FROM sup WHERE tamanho = 3),
        m AS (SELECT an, co, s, s / x.suporte AS conf, s / x.suporte / y.suporte AS lift
              FROM div JOIN sup x ON x.itens = an JOIN sup y ON y.itens = co),
        regra AS (SELECT 'loja' AS client_key, array_to_string(an, ', ') AS antecedents,
                array_to_string(co, ', ') AS consequents, {r('s * 100.0', 2)} AS support,
                {r('conf * 100.0', 2)} AS confidence, {r('lift', 3)} AS lift
              FROM m WHERE lift >= {lift} AND conf >= {conf})"""


RULES = _rules(0.01, 0.1, 1.0)
BEST = "ORDER BY lift DESC, antecedents, consequents"


def forecast_ctes(key: str, prefix: str) -> str:
    """Daily series, both methods and their union for one grain."""
    p = prefix
    return f"""
        {p}d AS (SELECT {key} AS produto_key, CAST(data_venda AS DATE) AS dia,
                 CAST(sum(quantidade) AS DOUBLE) AS y
                 FROM itens_ok i JOIN produtos p USING (produto_key) GROUP BY 1, 2),
        {p}n AS (SELECT produto_key, count(*) AS n, min(dia) AS d0, max(dia) AS d1 FROM {p}d GROUP BY 1),
        {p}mm AS (SELECT produto_key, avg(y) AS m, coalesce(stddev_samp(y), avg(y) * 0.2::DOUBLE) AS s, max(dia) AS d1
                 FROM (SELECT d.*, row_number() OVER (PARTITION BY produto_key ORDER BY dia DESC) AS rn
                       FROM {p}d d JOIN {p}n USING (produto_key) WHERE n < 30) WHERE rn <= 30 GROUP BY 1),
        {p}h AS (SELECT CAST(unnest(generate_series(1, 90)) AS INTEGER) AS h),
        {p}f1 AS (SELECT 'loja' AS client_key, produto_key, d1 + h AS data, {r('m', 2)} AS quantidade_prevista,
                 {r('greatest(m - s, 0)', 2)} AS quantidade_min, {r('m + s', 2)} AS quantidade_max,
                 'media_movel' AS metodo FROM {p}mm, {p}h),
        {p}l AS (SELECT d.*, date_diff('day', d0, dia)::DOUBLE AS t FROM {p}d d JOIN {p}n USING (produto_key) WHERE n >= 30),
        {p}fit AS (SELECT produto_key, coalesce(regr_slope(y, t), 0) AS b, coalesce(regr_intercept(y, t), avg(y)) AS a,
                  min(dia) AS d0, max(dia) AS d1 FROM {p}l GROUP BY 1),
        {p}b AS (SELECT l.produto_key, y, a + b * t AS tr, isodow(dia) - 1 AS wd, month(dia) AS mo
                 FROM {p}l l JOIN {p}fit USING (produto_key)),
        {p}w AS (SELECT produto_key, wd, avg(y / tr) AS w FROM {p}b WHERE tr > 0 GROUP BY 1, 2),
        {p}bw AS (SELECT b.*, tr * coalesce(w, 1) AS lv FROM {p}b b LEFT JOIN {p}w USING (produto_key, wd)),
        {p}m AS (SELECT produto_key, mo, avg(y / lv) AS mi FROM {p}bw WHERE lv > 0 GROUP BY 1, 2),
        {p}s AS (SELECT produto_key, coalesce(stddev_samp(y - greatest(lv * coalesce(mi, 1), 0)), 0) AS s
                 FROM {p}bw LEFT JOIN {p}m USING (produto_key, mo) GROUP BY 1),
        {p}fu AS (SELECT produto_key, a, b, s, d1 + h AS dia, date_diff('day', d0, d1 + h)::DOUBLE AS t,
                 isodow(d1 + h) - 1 AS wd, month(d1 + h) AS mo FROM {p}fit JOIN {p}s USING (produto_key), {p}h),
        {p}y AS (SELECT produto_key, dia, s, greatest((a + b * t) * coalesce(w, 1) * coalesce(mi, 1), 0) AS v
                 FROM {p}fu LEFT JOIN {p}w USING (produto_key, wd) LEFT JOIN {p}m USING (produto_key, mo)),
        {p}f2 AS (SELECT 'loja' AS client_key, produto_key, dia AS data, {r('v', 2)} AS quantidade_prevista,
                 {r('greatest(v - s * 1.96::DOUBLE, 0)', 2)} AS quantidade_min, {r('v + s * 1.96::DOUBLE', 2)} AS quantidade_max,
                 'sazonal' AS metodo FROM {p}y),
        {p}fc AS (SELECT * FROM {p}f1 UNION ALL SELECT * FROM {p}f2),
        {p}ini AS (SELECT *, min(data) OVER (PARTITION BY produto_key) AS ini, min(data) OVER () AS ini_loja FROM {p}fc),
        {_summary(p, "res", "ini")}, {_summary(p, "res_loja", "ini_loja")}"""


def _summary(p: str, name: str, start: str) -> str:
    return f"""{p}{name} AS (SELECT 'loja' AS client_key, produto_key,
                 {r('CAST(sum(CAST(quantidade_prevista AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS quantidade_prevista,
                 {r('CAST(sum(CAST(quantidade_min AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS quantidade_min,
                 {r('CAST(sum(CAST(quantidade_max AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS quantidade_max,
                 min(metodo) AS metodo
                 FROM {p}ini WHERE data <= {start} + 30 GROUP BY 2)"""


FC = forecast_ctes("i.produto_key", "p")
FC_CAT = forecast_ctes("p.categoria", "c")

def _md5(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _tail(m: str) -> str:
    return (f"CASE WHEN {m} <= 1 THEN 0.0 WHEN {m} = 2 THEN 1.0 "
            f"ELSE 2.0::DOUBLE * (ln({m} - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({m} - 1) / {m} END")


def _forest(sales: str, trees: int = 100, sample: int = 256, seed: int = 42, levels: int = 8) -> str:
    """Isolation forest: samples, one split of every node per level, then every sale's way down."""
    f = ("a", "b", "c", "d")
    prime = 2_147_483_647
    pick = "CASE f " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(f)) + " END"
    out = f"""
        fx AS (SELECT venda_key, data_venda, coalesce(total::DOUBLE, 0) AS a, coalesce(desconto::DOUBLE, 0) AS b,
               hour(data_venda)::DOUBLE AS c, (isodow(data_venda) - 1)::DOUBLE AS d,
               {_md5(f"'{seed}:' || venda_key", 8)} % {prime} AS h FROM {sales} WHERE status = 'concluida'),
        ft AS (SELECT i AS tree, 1 + {_md5(f"'{seed}:' || i || ':a'", 8)} % {prime - 1} AS ma,
               {_md5(f"'{seed}:' || i || ':b'", 8)} % {prime} AS mb FROM range({trees}) t(i)),
        fn AS (SELECT least(count(*), {sample}) AS psi FROM fx),
        r0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, a, b, c, d FROM fx, ft
            QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (h * ma + mb) % {prime}, venda_key) <= {sample})"""
    for k in range(levels + 1):
        lo, hi = (", ".join(f"{g}({x})" for x in f) for g in ("min", "max"))
        out += f""",
        g{k} AS MATERIALIZED (SELECT tree, node, count(*) AS m, [{lo}] AS lo, [{hi}] AS hi FROM r{k} GROUP BY 1, 2),
        u{k} AS (SELECT *, CASE WHEN {k} < (SELECT greatest(1, ceil(log2(psi))) FROM fn)
                 THEN [i FOR i IN [0, 1, 2, 3] IF hi[i + 1] > lo[i + 1]] ELSE [] END AS ok FROM g{k}),
        s{k} AS MATERIALIZED (SELECT tree, node, f, lo[f + 1] + u * (hi[f + 1] - lo[f + 1]) AS cut FROM (
            SELECT *, ok[1 + {_md5(f"'{seed}:' || tree || ':' || node || ':f'", 8)} % len(ok)]::INT AS f,
                   {_md5(f"'{seed}:' || tree || ':' || node || ':c'", 13)}::DOUBLE / 4503599627370496.0::DOUBLE AS u
            FROM u{k} WHERE len(ok) > 0)),
        e{k} AS (SELECT tree, node, {k} + {_tail('m')} AS depth FROM u{k} WHERE len(ok) = 0)"""
        if k < levels:
            out += f""",
        r{k + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN {pick} <= cut THEN 0 ELSE 1 END AS node, a, b, c, d
            FROM r{k} JOIN s{k} USING (tree, node))"""
    out += """,
        w0 AS (SELECT venda_key, tree, 1::BIGINT AS node, a, b, c, d FROM fx, ft)"""
    for k in range(levels):
        out += f""",
        w{k + 1} AS MATERIALIZED (SELECT venda_key, tree, a, b, c, d,
            CASE WHEN cut IS NULL THEN node WHEN {pick} <= cut THEN 2 * node ELSE 2 * node + 1 END AS node
            FROM w{k} LEFT JOIN s{k} USING (tree, node))"""
    ends = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(levels + 1))
    return out + f""",
        fe AS ({ends}),
        fs AS (SELECT venda_key, round(-pow(2.0::DOUBLE, -(sum(depth) / {trees}) / (SELECT {_tail('psi')} FROM fn)), 9)
               AS anomalia_score FROM w{levels} JOIN fe USING (tree, node) GROUP BY 1),
        anom AS (SELECT 'loja' AS client_key, venda_key, data_venda, a AS total, b AS desconto, c::INT AS hora, anomalia_score
                 FROM fx JOIN fs USING (venda_key)
                 WHERE anomalia_score < (SELECT quantile_cont(anomalia_score, 0.05) FROM fs))"""


FOREST = _forest("eventos")

PIECES.update({
    "desc_pct": """
        SELECT venda_key, data_venda, vendedor_id, CAST(total AS DOUBLE) AS total, CAST(desconto AS DOUBLE) AS desconto,
               coalesce(CAST(desconto AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0) * 100.0::DOUBLE AS pct_desconto
        FROM vendas_desc WHERE status = 'concluida'""",
    "desc_mom": "SELECT avg(pct_desconto) AS media, stddev_samp(pct_desconto) AS desvio FROM desc_pct",
    "desc_an": f"""
        SELECT 'loja' AS client_key, d.*, {r('(pct_desconto - media) / desvio', 9)} AS z_score
        FROM desc_pct d, desc_mom WHERE (pct_desconto - media) / desvio > 2""",
    "vend_an": f"""
        WITH v AS (SELECT vendedor_id, count(*) AS total_vendas,
                {r('CAST(sum(total) AS DOUBLE) / count(*)', 2)} AS ticket_medio,
                {r('avg(coalesce(CAST(desconto AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0) * 100.0::DOUBLE)', 2)} AS desconto_medio,
                CAST(sum(total) AS DOUBLE) AS total_faturado
            FROM vendas_desc WHERE status = 'concluida' AND vendedor_id IS NOT NULL GROUP BY 1)
        SELECT 'loja' AS client_key, v.*,
               {r('(ticket_medio - avg(ticket_medio) OVER ()) / stddev_samp(ticket_medio) OVER ()', 2)} AS z_ticket
        FROM v""",
})

SQL = {
    "itemsets": sql(f"""
        WITH {_sets(0.01)} SELECT 'loja' AS client_key, array_to_string(itens, ', ') AS itens, tamanho, contagem, suporte FROM sup"""),
    "itemsets_trios": sql(f"""
        WITH {_sets(0.005)} SELECT 'loja' AS client_key, array_to_string(itens, ', ') AS itens, tamanho, contagem, suporte FROM sup"""),
    "regras": sql(f"WITH {RULES} SELECT * FROM regra"),
    "regras_padrao": sql(f"WITH {_rules(0.01, 0.2, 1.2)} SELECT * FROM regra"),
    "regras_trios": sql(f"WITH {_rules(0.005, 0.1, 1.0)} SELECT * FROM regra"),
    "sugestoes": sql(f"""
        WITH {RULES} SELECT * FROM regra WHERE list_contains(string_split(antecedents, ', '), 'Brand#7')
        {BEST} LIMIT 5"""),
    "top_regras": sql(f"WITH {RULES} SELECT * FROM regra {BEST} LIMIT 50"),
    "basket_view": sql(f"""
        WITH {RULES}, u AS (SELECT *, row_number() OVER (PARTITION BY least(antecedents, consequents),
            greatest(antecedents, consequents) {BEST}) AS rn FROM regra)
        SELECT client_key, antecedents, consequents, confidence, lift,
               CAST(greatest(1, floor(100.0 / confidence + 0.5)) AS BIGINT) AS um_em
        FROM u WHERE rn = 1 {BEST} LIMIT 6"""),
    "forecast_media_movel": sql(f"WITH {FC} SELECT * FROM pf1"),
    "forecast_sazonal": sql(f"WITH {FC_CAT} SELECT * FROM cf2"),
    "forecast": sql(f"WITH {FC} SELECT * FROM pfc"),
    "forecast_categoria": sql(f"WITH {FC_CAT} SELECT * FROM cfc"),
    "forecast_resumo": sql(f"WITH {FC} SELECT * FROM pres"),
    "forecast_resumo_loja": sql(f"WITH {FC} SELECT * FROM pres_loja"),
    "forecast_resumo_categoria": sql(f"WITH {FC_CAT} SELECT * FROM cres"),
    "sugestao_reposicao": sql(f"""
        WITH {FC}
        SELECT e.client_key, e.produto_key, nome, categoria, e.quantidade, e.quantidade_min,
               coalesce(quantidade_prevista, 0) AS quantidade_prevista,
               round_even(coalesce(quantidade / nullif(coalesce(quantidade_prevista, 0) / 30.0::DOUBLE, 0), 0) * 10.0::DOUBLE, 0)
                 / 10.0::DOUBLE AS dias_cobertura,
               round_even(greatest(coalesce(quantidade_prevista, 0) - quantidade, 0), 0) AS pedido_sugerido
        FROM est e LEFT JOIN pres USING (produto_key) WHERE alerta"""),
    "forecast_por_produto": sql(f"""
        WITH {FC}, t AS (SELECT * FROM pres ORDER BY quantidade_prevista DESC, produto_key LIMIT 15)
        SELECT t.client_key, t.produto_key, nome, categoria, quantidade_prevista,
               quantidade_max - quantidade_prevista AS erro_superior
        FROM t LEFT JOIN est USING (produto_key)"""),
    "anomalias_vendas": sql(f"WITH {FOREST} SELECT * FROM anom"),
    "anomalias_por_hora": sql(f"""
        WITH {FOREST} SELECT client_key, hora, count(*) AS ocorrencias FROM anom GROUP BY 1, 2"""),
    "resumo_anomalias": sql(f"""
        WITH {FOREST},
        va AS (SELECT count(*) AS n, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS v FROM anom),
        vd AS (SELECT count(*) AS n, CAST(sum(CAST(desconto AS DECIMAL(18,2))) AS DOUBLE) AS v FROM desc_an)
        SELECT 'loja' AS client_key, va.n AS total_anomalias_venda, va.v AS valor_anomalias,
               vd.n AS total_descontos_anomalos, vd.v AS valor_descontos FROM va, vd"""),
    "anomalias_desconto": sql("SELECT * FROM desc_an"),
    "anomalias_vendedor": sql("SELECT * FROM vend_an"),
    "descontos_por_vendedor": sql("""
        WITH v AS (SELECT vendedor_id, count(*) AS ocorrencias,
                   CAST(sum(CAST(desconto AS DECIMAL(18,2))) AS DOUBLE) AS desconto_total FROM desc_an GROUP BY 1)
        SELECT 'loja' AS client_key, v.*, vendedor_id = (
            SELECT vendedor_id FROM v ORDER BY ocorrencias DESC, vendedor_id LIMIT 1) AS destaque FROM v"""),
}
