"""Comparison SQL for reading, normalising, merging and storing."""

from shopgrain.plans.oracle_base import PIECES, sql
from shopgrain.plans.oracle_models import BEST, RULES
from shopgrain.plans.oracle_texts import _HOME, _top3, V1, V2, V3

NO_ID = "(o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F')"
NO_DATE = "(o_orderpriority = '5-LOW' AND o_orderstatus = 'O')"
_STAMP = "TIMESTAMP '2024-01-01 12:00:00'"


def _brl(x: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,')"


PIECES.update({
    "vendas_norm": f"""
        SELECT client_key, venda_key, date_trunc('day', data_venda)::TIMESTAMP AS data_venda, cliente_key,
               vendedor_id, CAST(total AS DOUBLE) AS total, 0.0::DOUBLE AS desconto, status, 'balcao' AS canal
        FROM vendas WHERE venda_key IN (
            SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT {NO_ID} AND NOT {NO_DATE})""",
})

SQL = {
    "detect_separator": """
        SELECT 'clientes' AS entidade, ',' AS sep, 'codigo,razao_social,perfil,active' AS header
        UNION ALL SELECT 'vendas', ';',
            'numero;dt_venda;id_cliente;vendedor;codigo_vendedor;valor_total;situacao'
        UNION ALL SELECT 'produtos', chr(9),
            array_to_string(['codigo', 'descricao', 'grupo', 'unidade', 'preco', 'situacao'], chr(9))""",
    "csv_scan": sql(f"""
        SELECT CASE WHEN {NO_ID} THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS numero,
               CASE WHEN {NO_DATE} THEN 'sem data' ELSE CASE o_orderkey % 4
                   WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
                   WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END
               END AS dt_venda, CAST(o_custkey AS VARCHAR) AS id_cliente, '' AS vendedor,
               'VEN' || (o_orderkey % 7) AS codigo_vendedor,
               CASE o_orderkey % 3 WHEN 0 THEN {_brl('o_totalprice')}
                   WHEN 1 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
                   ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS valor_total,
               CASE WHEN o_orderstatus = 'P' THEN 'pendente' ELSE '' END AS situacao FROM orders"""),
    "csv_scan_quebras": sql("""
        SELECT CAST(o_orderkey AS VARCHAR) AS numero, o_orderpriority || CASE o_orderkey % 5
                   WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'saiu "hoje"; ok' WHEN 2 THEN chr(10) || chr(10) || 'fim'
                   WHEN 3 THEN '; a' || chr(10) || ';b' || chr(10) || '"c"' ELSE ' "x"' END AS nota, o_orderstatus
        FROM orders"""),
    "normalize_vendas": sql("SELECT * FROM vendas_norm"),
    "reject_log_vendas": sql(f"""
        SELECT 'loja' AS client_key, o_orderkey + 1 AS _line, 'linha ' || (o_orderkey + 1) ||
               CASE WHEN {NO_ID} THEN ': ID da venda não encontrado' ELSE ': data inválida ''sem data''' END AS _reason
        FROM orders WHERE {NO_ID} OR {NO_DATE}"""),
    "normalize_itens": sql("""
        SELECT 'loja' AS client_key, CAST(l_orderkey AS VARCHAR) AS venda_key, CAST(l_partkey AS VARCHAR) AS produto_key,
               '' AS descricao, 1.0::DOUBLE AS quantidade, 'UN' AS unidade,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS preco_unitario, 1.5::DOUBLE AS desconto,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - 1.50 AS DOUBLE) AS total
        FROM lineitem WHERE l_returnflag <> 'R'"""),
    "reject_log_itens": sql("""
        SELECT 'loja' AS client_key, CAST(l_linenumber AS BIGINT) AS _line,
               'linha ' || l_linenumber || ': ID do produto não encontrado' AS _reason
        FROM lineitem WHERE l_returnflag = 'R'"""),
    "normalize_produtos": sql("""
        SELECT 'loja' AS client_key, CAST(p_partkey AS VARCHAR) AS produto_key,
               CASE WHEN p_type = 'ECONOMY' THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS nome,
               p_brand AS categoria, CAST(NULL AS VARCHAR) AS subcategoria, 'UN' AS unidade,
               0.0::DOUBLE AS preco_custo, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS preco_venda,
               p_partkey % 3 <> 2 AS ativo FROM part"""),
    "normalize_clientes": sql("""
        SELECT 'loja' AS client_key, CAST(c_custkey AS VARCHAR) AS cliente_key, c_name AS nome, c_mktsegment AS tipo,
               CAST(NULL AS VARCHAR) AS documento, CAST(NULL AS VARCHAR) AS telefone, CAST(NULL AS VARCHAR) AS cidade,
               CAST(NULL AS VARCHAR) AS bairro, CAST(NULL AS VARCHAR) AS cep, c_acctbal >= 0 AS ativo FROM customer"""),
    "upsert_vendas": sql("""
        SELECT client_key, venda_key, data_venda, cliente_key, vendedor_id,
               CAST(CASE WHEN status = 'pendente' THEN total + 2 ELSE total END AS DOUBLE) AS total,
               'concluida' AS status, canal FROM vendas
        UNION ALL SELECT client_key, 'ev' || venda_key, data_venda, NULL, vendedor_id, CAST(total AS DOUBLE), status,
               'telefone' FROM eventos"""),
    "upsert_produtos": sql(f"""
        SELECT client_key, produto_key, nome, categoria, subcategoria, unidade, CAST(preco_custo AS DOUBLE) AS preco_custo,
               CAST(CASE WHEN subcategoria = 'ECONOMY' THEN preco_venda + 1 ELSE preco_venda END AS DOUBLE) AS preco_venda,
               ativo, CASE WHEN subcategoria = 'ECONOMY' THEN {_STAMP} END AS updated_at FROM produtos"""),
    "upsert_clientes": sql(f"""
        SELECT client_key, cliente_key, CASE WHEN ativo THEN nome ELSE nome || ' (novo)' END AS nome, tipo, cidade, bairro,
               TRUE AS ativo, 'D' || cliente_key AS documento, CAST(NULL AS VARCHAR) AS telefone,
               CAST(NULL AS VARCHAR) AS cep, CASE WHEN NOT ativo THEN {_STAMP} END AS updated_at FROM clientes
        UNION ALL SELECT 'loja', 'f' || s_suppkey, s_name || ' 2', 'fornecedor', NULL, NULL, TRUE, 'doc1', NULL, NULL,
               {_STAMP} FROM supplier"""),
    "load_itens": sql("""
        SELECT i.client_key, i.venda_key, i.produto_key, CAST(i.quantidade AS DOUBLE) AS quantidade, i.unidade,
               CAST(i.preco_unitario AS DOUBLE) AS preco_unitario,
               CAST(CASE WHEN v.status = 'pendente' THEN 0 ELSE i.desconto END AS DOUBLE) AS desconto,
               CAST(CASE WHEN v.status = 'pendente' THEN i.total + i.desconto ELSE i.total END AS DOUBLE) AS total
        FROM itens i LEFT JOIN vendas v USING (venda_key)"""),
    "etl_run_log": sql(f"""
        SELECT 'loja' AS client_key, 'csv' AS connector_type, 'success' AS status,
               (SELECT count(*) FROM vendas) AS records_read, (SELECT count(*) FROM vendas_norm) AS records_written,
               CAST(NULL AS VARCHAR) AS error_message, {_STAMP} AS started_at, {_STAMP} AS finished_at"""),
    "incremental_sync": sql("SELECT * FROM vendas_norm"),
    "erase_tenant": sql("""
        SELECT client_key, count(*) AS execucoes FROM logs WHERE client_key <> 'loja_3' GROUP BY 1"""),
    "tenant_scope": sql("SELECT * FROM logs WHERE client_key = 'loja_3'"),
    "save_result": sql("""
        SELECT 'loja' AS client_key, classe AS classe_abc, classe_xyz, count(*) AS qtd
        FROM abc_xyz_res GROUP BY 2, 3"""),
    "publish_cache": sql(f"WITH {RULES} SELECT * FROM regra {BEST} LIMIT 50"),
    "publicar_insights": sql(f"""
        {_HOME}, pag AS ({' UNION ALL '.join((V1, V2, V3))})
        SELECT * EXCLUDE (_seq, rn, k), {_STAMP} AS gerado_em, k <= 3 AS top3 FROM {_top3('ins')} WHERE categoria <> 'vendas'
        UNION ALL SELECT * EXCLUDE (_seq), {_STAMP}, TRUE FROM pag"""),
}
